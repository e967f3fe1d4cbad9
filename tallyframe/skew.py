"""Ranking, ordered replay and digests which never put a whole group into one task.

A group (stratum, episode, source) may hold a large share of all rows. A plain window over such a group sorts it in
one task; the functions here split the group by order first and combine small per-piece summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .session import materialize


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def let_both(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """As ``let`` for two values, which may be of different types."""
    return F.zip_with(F.array(a), F.array(b), body)[0]


def among(value: Column, values: Column) -> Column:
    """Whether ``values`` holds ``value``, for bodies of lambda functions.

    Those are not compiled, and there ``array_contains`` leaves its loop by an exception for every hit.
    """
    return F.exists(values, lambda v: v == value)


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that is never broadcast.

    Before it has run, Spark takes the size of exploded or well-compressed rows for about that of their files.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by key to as many tasks as a shuffle has: a table of few files becomes much work, or many bytes, in what follows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hash_ranked(
    df: DataFrame, group: Sequence[str], digest: Column, rank: str = "rank", tie: Sequence[str] = (), digits: int = 4
) -> DataFrame:
    """1-based rank of each row inside its group in the order of a hex digest.

    The digest is uniform, so its first four hex digits cut every group into 65,536 even buckets: one sort per (group, bucket)
    and an offset from the bucket counts. The counts combine before their shuffle, and the join reuses the
    partitioning of the bucket sort.
    """
    rows, whole = _with_group(df, group)
    keys = [*whole, "_bucket"]
    rows = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    before = W.partitionBy(*whole).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    )
    local = W.partitionBy(*keys).orderBy("_digest", *tie)
    return (
        rows.withColumn("_local", F.row_number().over(local)).join(offsets, keys)
        .withColumn(rank, F.col("_offset") + F.col("_local"))
        .drop("_digest", "_bucket", "_local", "_offset", *whole)
    )


def _with_group(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The group as one struct column: structs compare equal where fields are null, so joins on it keep null groups."""
    return (df.withColumn("_group", F.struct(*group)), ["_group"]) if group else (df, [])


def ordered_index(
    df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str = "rank", size: str | None = None
) -> DataFrame:
    """1-based rank of each row inside its group in the order of any columns, for groups of any size.

    Rows are range-partitioned by group and order, so a large group spans many partitions, and numbered inside each
    partition. The numbered table is written once; the number of rows each partition holds of a group then gives the
    offsets. ``order`` must be unique inside a group. ``size`` adds the group size.
    """
    keys = [*group, *order]
    spot = F.monotonically_increasing_id()
    numbered = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).withColumn("_spot", spot), "index"
    )
    rows, whole = _with_group(numbered.withColumn("_part", F.shiftright("_spot", 33)), group)
    runs = rows.groupBy(*whole, "_part").agg(F.min("_spot").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy(*whole).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    if size:
        runs = runs.withColumn(size, F.sum("_rows").over(W.partitionBy(*whole)))
    out = rows.join(runs, [*whole, "_part"])
    out = out.withColumn(rank, F.col("_spot") - F.col("_first") + F.col("_offset") + 1)
    return out.drop("_spot", "_part", "_first", "_rows", "_offset", *whole)


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, name: str, total: str) -> DataFrame:
    """Sum of ``weight`` up to and with each row of its group, and over the whole group, for groups of any size.

    As in ``ordered_index``, rows are range-partitioned by group and order, which must be unique inside a group.
    """
    keys = [*group, *order]
    numbered = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).withColumn("_spot", F.monotonically_increasing_id()), "totals"
    )
    rows, whole = _with_group(numbered.withColumn("_part", F.shiftright("_spot", 33)), group)
    before = W.partitionBy(*whole).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy(*whole, "_part").agg(F.sum(weight).alias("_sum"))
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).withColumn(total, F.sum("_sum").over(W.partitionBy(*whole)))
    local = W.partitionBy(*whole, "_part").orderBy("_spot").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_local", F.sum(weight).over(local)).join(parts.drop("_sum"), [*whole, "_part"])
    return out.withColumn(name, F.col("_local") + F.col("_offset")).drop("_spot", "_part", "_local", "_offset", *whole)


def replay_states(
    df: DataFrame, group: Sequence[str], order: Sequence[str], step: Column, states: int, initial: int,
    before: str = "state_before", after: str = "state_after", segment: int = 256,
) -> DataFrame:
    """Ordered replay of a finite-state machine per group, in parallel inside each group.

    ``step`` is an array column with ``states`` entries: the next state for every possible state. Steps compose, so a
    long log is cut into segments of at most ``segment`` rows; each segment becomes one composed array, segments of
    segments compose again, and entry states flow back down. No task ever holds more than one segment.
    """
    payload = [c for c in df.columns if c not in group]
    rows, group = _with_group(ordered_index(df, group, order, "_rank"), group)
    longest = rows.agg(F.max("_rank")).first()[0] or 0
    def cut(position: str) -> Column:
        return F.floor((F.col(position) - 1) / segment).cast("long") + 1

    leaf = (
        rows.withColumn("_step", step).withColumn("_node", cut("_rank"))
        .groupBy(*group, "_node")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "_step", F.struct(*payload).alias("_row")))).alias("_items"))
    )
    leaf = materialize(leaf, "replay")
    identity = F.sequence(F.lit(0), F.lit(states - 1))

    def composed(items: Column) -> Column:
        return F.aggregate(items, identity, lambda acc, item: F.transform(acc, lambda s: F.get(item["_step"], s)))

    levels, width, current = [], longest, leaf
    while width > segment:
        width = -(-width // segment)
        node = current.select(*group, F.col("_node").alias("_rank"), composed(F.col("_items")).alias("_step"))
        current = (
            node.withColumn("_parent", cut("_rank")).groupBy(*group, "_parent")
            .agg(F.array_sort(F.collect_list(F.struct("_rank", "_step"))).alias("_items"))
            .withColumnRenamed("_parent", "_node")
        )
        levels.append(current)

    def walk(items: Column, enter: Column) -> Column:
        """Items with the state before and after each of them."""
        start = F.struct(enter.alias("at"), F.array().cast("array<int>").alias("seen"))
        entered = F.aggregate(
            items, start,
            lambda acc, item: F.struct(
                F.get(item["_step"], acc["at"]).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")
            ),
        )
        return F.arrays_zip(items.alias("item"), entered["seen"].alias("enter"))

    enter = None
    for level in reversed(levels):
        if enter is None:
            opened = level.withColumn("_enter", F.lit(initial))
        else:
            opened = level.join(enter, [*group, "_node"])
        enter = (
            opened.select(*group, F.explode(walk(F.col("_items"), F.col("_enter"))).alias("z"))
            .select(*group, F.col("z.item._rank").alias("_node"), F.col("z.enter").alias("_enter"))
        )
    opened = leaf.withColumn("_enter", F.lit(initial)) if enter is None else leaf.join(enter, [*group, "_node"])
    return (
        opened.select(*group, F.explode(walk(F.col("_items"), F.col("_enter"))).alias("z"))
        .select(
            *[f"{g}.*" for g in group], "z.item._row.*", F.col("z.enter").alias(before),
            F.get(F.col("z.item._step"), F.col("z.enter")).alias(after),
        )
    )


def composed_log(
    df: DataFrame, group: Sequence[str], order: Sequence[str], step: str, start: Column, after: Callable[[Column, Column], Column], segment: int = 256,
) -> DataFrame:
    """All steps of each group composed in order: ``_keys`` (struct of the group) and ``step``.

    ``after(first, second)`` composes two steps and is associative, ``start`` is neutral. A long log is cut into segments,
    whose compositions are cut into segments again, so that no task ever holds more than one segment.
    """
    level = ordered_index(df.select(*group, *order, step), group, order, "_rank").select(F.struct(*group).alias("_keys"), "_rank", step)
    longest = level.agg(F.max("_rank")).first()[0] or 0
    while longest > 1:
        cut = F.floor((F.col("_rank") - 1) / segment).cast("long") + 1
        items = F.array_sort(F.collect_list(F.struct("_rank", step)))
        folded = F.aggregate(F.transform("_items", lambda i: i[step]), start, after)
        level = level.groupBy("_keys", cut.alias("_rank2")).agg(items.alias("_items")).select("_keys", F.col("_rank2").alias("_rank"), folded.alias(step))
        longest = -(-longest // segment)
    return level.drop("_rank")


# Words of a digest used by multiset digests: start of each 15-hex-digit word (60 bits).
DIGEST_WORDS = (1, 16, 31, 46)


def digest_sums(digest: Column) -> list[Column]:
    """Aggregates of an order-independent digest: row count and the sums of four 60-bit words of each row digest."""
    sums = [
        F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")).alias(f"_word{i}")
        for i, start in enumerate(DIGEST_WORDS)
    ]
    return [F.count(digest).alias("_digest_rows"), *sums]


def digest_of_sums() -> Column:
    parts = ["_digest_rows", *[f"_word{i}" for i in range(len(DIGEST_WORDS))]]
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.col(p), F.lit(0)).cast("string") for p in parts]), 256)


def multiset_digest(df: DataFrame, group: Sequence[str], digest: Column, name: str = "digest") -> DataFrame:
    """One digest per group of rows, equal exactly for equal multisets of row digests.

    Sums combine before the shuffle, so a group of any size costs one small row per input partition.
    """
    out = df.groupBy(*group).agg(*digest_sums(digest))
    return out.select(*group, F.col("_digest_rows").alias("rows"), digest_of_sums().alias(name))
