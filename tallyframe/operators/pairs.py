"""Pair mining that is linear in the rows: partners are computed ranks, never a product of a group with itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import digest_int, stable_hash
from ..skew import hash_ranked, ordered_index
from .curation import evenly_spaced, first_per_group


def signature_partner(df: DataFrame, sig: str, category: str, key: str, salt: str) -> DataFrame:
    """One partner of another category with the same signature for each row; null where no other category exists.

    Categories of a signature form a ring; the i-th row of a category meets the i-th row of the next category, counted
    cyclically. The small (signature, category) table holds the ring.
    """
    rows = hash_ranked(df.select(sig, category, key), [sig, category], stable_hash(F.col(key), salt), "rank", [key])
    sizes = df.groupBy(sig, category).agg(F.count("*").alias("_size"))
    ring, whole = W.partitionBy(sig).orderBy(category), W.partitionBy(sig)
    following = F.struct(F.col(category).alias("c"), F.col("_size").alias("n"))
    nexts = sizes.select(
        sig, category, F.coalesce(F.lead(following).over(ring), F.first(following).over(ring.rowsBetween(W.unboundedPreceding, 0))).alias("_n"),
        F.count("*").over(whole).alias("_categories"),
    )
    wanted = rows.join(nexts, [sig, category]).select(
        sig, category, key, F.when(F.col("_categories") > 1, F.col("_n.c")).alias("partner_category"),
        ((F.col("rank") - 1) % F.col("_n.n") + 1).alias("_rank"),
    )
    offered = rows.select(sig, F.col(category).alias("partner_category"), F.col("rank").alias("_rank"), F.col(key).alias("partner"))
    return wanted.join(offered, [sig, "partner_category", "_rank"], "left").select(sig, category, key, "partner_category", "partner")


def positive_pairs(df: DataFrame, sequence: str, position: str, min_gap: int, frames: int) -> DataFrame:
    """Unordered pairs of one sequence at least ``min_gap`` apart, among ``frames`` evenly spread rows of it.

    The spread bounds a sequence to ``frames`` rows before rows meet, whatever its length; a sequence with fewer rows
    than that gives no pairs.
    """
    long = df.groupBy(sequence).agg(F.count("*").alias("_n")).filter(F.col("_n") >= frames).select(sequence)
    spread = evenly_spaced(df.join(long, sequence, "left_semi"), [sequence], [position], frames).select(sequence, position)
    left, right = spread.withColumnRenamed(position, "first"), spread.withColumnRenamed(position, "second")
    return left.join(right, sequence).filter(F.col("second") - F.col("first") >= min_gap)


def negative_pairs(df: DataFrame, split: str, category: str, key: str, k: int, salt: str) -> DataFrame:
    """``k`` partners of other categories from the same split for each row.

    Rows of a split are ordered by category and hash, so a category is one range. A row draws ``k`` consecutive places
    from the places outside its own range, starting at its hash: an equi-join on the place, k rows per anchor.
    """
    base = df.select(split, category, key).withColumn("_h", stable_hash(F.col(key), salt))
    placed = ordered_index(base, [split], [category, "_h", key], "place", "size")
    ranges = placed.groupBy(split, category).agg(F.min("place").alias("_from"), F.count("*").alias("_own"))
    others = F.col("size") - F.col("_own")
    turns = F.sequence(F.lit(0), F.least(F.lit(k), others).cast("int") - 1)
    anchors = placed.join(ranges, [split, category]).filter(others > 0).withColumn("_turn", F.explode(turns))
    draw = (digest_int(F.col("_h")) + F.col("_turn")) % others + 1
    spot = F.when(draw < F.col("_from"), draw).otherwise(draw + F.col("_own"))
    partners = placed.select(split, F.col("place").alias("_spot"), F.col(key).alias("partner"), F.col(category).alias("partner_category"))
    return anchors.withColumn("_spot", spot).join(partners, [split, "_spot"]).select(split, key, category, "partner", "partner_category")


def dedupe_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair once."""
    return pairs.select(F.least(a, b).alias("first"), F.greatest(a, b).alias("second")).distinct()


def cap_per_group(pairs: DataFrame, group: Sequence[str], key: str, k: int, salt: str) -> DataFrame:
    """At most ``k`` rows per group in hash order."""
    return first_per_group(pairs, group, stable_hash(F.col(key), salt), k, [key]).drop("rank")
