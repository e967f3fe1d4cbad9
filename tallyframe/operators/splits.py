"""Leakage-free splits and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction, stable_hash
from ..graphs import connected_components
from ..skew import ordered_index


def split_by_fraction(fraction: Column, cuts: Sequence[float] = (0.7, 0.8)) -> Column:
    return F.when(fraction < cuts[0], "train").when(fraction < cuts[1], "val").otherwise("test")


def component_split(
    families: DataFrame, edges: DataFrame, family: str, asset: str, seed: str, cuts: Sequence[float] = (0.7, 0.8)
) -> DataFrame:
    """Families that share any asset, directly or through others, get the same split; one without assets is on its own.

    Every asset links its families to the smallest of them, so an asset shared by a large part of all families adds one
    edge per family. The split hashes the smallest family id of a component: the full sorted key list of a giant component
    would be one huge value on one task.
    """
    held = edges.select(F.col(family).alias("a"), F.col(asset).alias("asset")).filter("asset IS NOT NULL").distinct()
    hubs = held.groupBy("asset").agg(F.min("a").alias("b"))
    roots = connected_components(held.join(hubs, "asset").select("a", "b")).withColumnsRenamed({"node": family})
    every = families.select(family).union(edges.select(family)).distinct()
    parts = every.join(roots, family, "left").select(family, F.coalesce("root", family).alias("component"))
    return parts.withColumn("split", split_by_fraction(hash_fraction(F.col("component"), seed), cuts))


def category_split(df: DataFrame, category: str, held_out: int, seed: int) -> DataFrame:
    """Whole categories held out: the first ``held_out`` in hash order go to validation."""
    names = df.select(category).distinct()
    held = names.orderBy(stable_hash(F.col(category), str(seed)), category).limit(held_out).withColumn("_held", F.lit(True))
    part = F.when(F.col("_held"), "validation").otherwise("train")
    return df.join(held, category, "left").withColumn("split", part).drop("_held")


def shard_families(df: DataFrame, family: str, shards: int) -> DataFrame:
    """Index of each family in sorted order modulo the number of shards; all rows of a family stay together."""
    families = ordered_index(df.select(family).distinct(), [], [family], "_index")
    return df.join(families.select(family, ((F.col("_index") - 1) % shards).cast("int").alias("shard")), family)
