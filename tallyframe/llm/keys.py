"""Keys of documents and line or text fingerprints, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def document_key(id_col: str, text: str) -> Column:
    """Id and text hash: rows that repeat both are one document, and a null id compares equal to itself inside a struct."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))


def fingerprint(value: Column) -> Column:
    """128 bits of a string as two longs."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value, F.lit(11)).alias("b"))


def lookup(rows: DataFrame, table: DataFrame, size: int, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a table of short rows that is broadcast only if its counted rows stay below a bound, and shuffled otherwise."""
    return rows.join(F.broadcast(table) if size <= BROADCAST_ROWS else table, on, how)


# Groups with more than one of this many rows of a table: at most as many groups as this number, so they may be broadcast.
HOT_GROUPS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spot: Column, total: int) -> DataFrame:
    """Left join of rows with a table of their groups, in which ``size`` counts the rows of each group.

    Groups that hold more than one ten-thousandth of all ``total`` rows are at most ten thousand and are broadcast; their rows
    then take a key of their own in the shuffled join with the rest, so that no task meets more than such a share of a group.
    ``spot`` is unique per row. A row without a group has nulls in the columns of ``groups``.
    """
    fields = [c for c in groups.columns if c != key]
    large = F.col("size") * HOT_GROUPS > total
    hot = groups.where(large).select(key, F.struct(*fields).alias("_hot"))
    cold = groups.where(~large).select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_spread"), F.struct(*fields).alias("_cold"))
    out = rows.join(F.broadcast(hot), key, "left")
    out = out.withColumn("_spread", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spot).bitwiseOR(F.lit(1).cast("long"))))
    out = out.join(cold, (F.col(key) == F.col("_key")) & (out["_spread"] == cold["_spread"]), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("_hot")[f], F.col("_cold")[f]).alias(f) for f in fields])
