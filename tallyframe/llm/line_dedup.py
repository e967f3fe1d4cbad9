"""Deletion of repeated line runs by a suffix array over line sequences, built by distributed prefix doubling.

A text is the sequence of its lines. Level j of the doubling ranks every suffix by its first 2^j lines; a suffix whose
first 2^j lines occur nowhere else leaves, so that each level is smaller. Two ranks of one level that overlap compare runs
of any length: suffixes with the same pair form the interval that shares a prefix of that many lines, and all but its
first member are later copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize
from .keys import document_key, fingerprint


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def ranked_classes(suffixes: DataFrame, key: list[str], name: str) -> DataFrame:
    """Order-preserving ranks of the keys that several suffixes share, with the first suffix of each.

    Counts combine before the shuffle, so a line of a third of all documents costs a row per task.
    """
    classes = suffixes.groupBy(*key).agg(F.count("*").alias("members"), F.min(F.struct("key", "pos")).alias("first"))
    classes = classes.where("members > 1").drop("members")
    classes = classes.repartitionByRange(*[F.col(k) for k in key]).sortWithinPartitions(*key)
    return materialize(classes.withColumn("rank", F.monotonically_increasing_id()), name)


def doubled(level: DataFrame, width: int) -> DataFrame | None:
    """Ranks by the first 2 * width lines from ranks by the first width lines; None when no run of that length repeats."""
    ahead = W.partitionBy("key").orderBy("pos").rangeBetween(width, width)
    pairs = level.withColumn("next", F.max("rank").over(ahead)).where("next IS NOT NULL")
    pairs = pairs.select("key", "pos", F.col("rank").alias("left"), F.col("next").alias("right"))
    classes = ranked_classes(pairs, ["left", "right"], "line-ranks")
    if classes.isEmpty():
        return None
    return materialize(pairs.join(classes, ["left", "right"]).select("key", "pos", "rank"), "line-level")


def shortest_windows(lines: DataFrame, min_chars: int) -> DataFrame:
    """``after`` and ``before``: the ends of the shortest runs with ``min_chars`` characters that begin, and end, with each line.

    Each run of so many characters is a union of such runs. Frames grow from the partition's start, so a text costs its lines once.
    """
    rows = lines.withColumn("upto", F.sum("chars").over(W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("from", F.col("upto") - F.col("chars")).withColumn("total", F.max("upto").over(W.partitionBy("key")))
    rows = rows.withColumn("last", F.max("pos").over(W.partitionBy("key")))
    ahead = W.partitionBy("key").orderBy(F.col("from").desc()).rangeBetween(W.unboundedPreceding, -min_chars)
    behind = W.partitionBy("key").orderBy("upto").rangeBetween(W.unboundedPreceding, -min_chars)
    rows = rows.withColumn("after", F.coalesce(F.min("pos").over(ahead) - 1, F.when(F.col("total") - F.col("from") >= min_chars, F.col("last"))))
    rows = rows.withColumn("before", F.coalesce(F.max("pos").over(behind) + 1, F.when(F.col("upto") >= min_chars, F.lit(0))))
    return rows.drop("upto", "from", "total", "last")


def covered(runs: DataFrame) -> DataFrame:
    """``key``, ``pos``: each line of the runs (``key``, ``start``, ``run``) once, however they overlap."""
    runs = runs.distinct().withColumn("stop", F.col("start") + F.col("run"))
    order = W.partitionBy("key").orderBy("start", "stop")
    runs = runs.withColumn("reached", F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)))
    opens = F.when(F.col("start") <= F.col("reached"), 0).otherwise(1)
    islands = runs.withColumn("island", F.sum(opens).over(order.rowsBetween(W.unboundedPreceding, 0)))
    islands = islands.groupBy("key", "island").agg(F.min("start").alias("low"), F.max("stop").alias("high"))
    return islands.select("key", F.explode(F.sequence("low", F.col("high") - 1)).alias("pos"))


def removed_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = 20, short_runs: bool = False) -> DataFrame:
    """Positions (from 0) of all lines to delete: ``key`` (id and text hash), ``pos``."""
    keyed = docs.select(document_key(id_col, text).alias("key"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    order = W.partitionBy("key").orderBy("pos")
    lines = keyed.select(
        "key", "pos", (F.length("line") >= min_chars).alias("strong"), F.length("line").cast("long").alias("chars"), fingerprint(F.col("line")).alias("line")
    )
    if short_runs:
        lines = shortest_windows(lines, min_chars)
    else:
        lines = lines.withColumn("after", F.min(F.when(F.col("strong"), F.col("pos"))).over(order.rowsBetween(1, W.unboundedFollowing)))
        lines = lines.withColumn("before", F.max(F.when(F.col("strong"), F.col("pos"))).over(order.rowsBetween(W.unboundedPreceding, -1)))
    lines = materialize(lines.drop("chars"), "lines")
    classes = ranked_classes(lines.select("key", "pos", "line"), ["line"], "line-ranks")
    active = materialize(lines.join(classes, "line"), "line-level").drop("line")
    levels, level, width = [], active.select("key", "pos", "rank"), 1
    while True:
        level = doubled(level, width)
        if level is None:
            break
        width *= 2
        levels.append(level.withColumn("width", F.lit(width)))
    alone = active.where(F.col("strong") & (F.col("first") < F.struct("key", "pos"))).select("key", "pos")
    if not levels:
        return alone
    # A short line goes with the run that links it to the nearest long line on either side, if an earlier run equals it. With
    # short_runs it is the shortest run of min_chars characters on either side, and all lines of it go.
    short = active.where(~F.col("strong"))
    runs = (
        short.where("after IS NOT NULL").select("key", "pos", F.col("pos").alias("start"), (F.col("after") - F.col("pos") + 1).alias("run"))
        .union(short.where("before IS NOT NULL").select("key", "pos", F.col("before").alias("start"), (F.col("pos") - F.col("before") + 1).alias("run")))
        .withColumn("width", F.expr("CAST(POW(2, FLOOR(LOG2(run))) AS INT)"))
    )
    ranks = levels[0]
    for level in levels[1:]:
        ranks = ranks.union(level)
    ranks = ranks.select("key", "width", F.col("pos").alias("at"), "rank")
    runs = runs.join(ranks.withColumnsRenamed({"at": "start", "rank": "left"}), ["key", "width", "start"])
    runs = runs.withColumn("at", F.expr("start + run - width")).join(ranks.withColumnRenamed("rank", "right"), ["key", "width", "at"])
    runs = materialize(runs.select("key", "pos", "start", "run", "left", "right"), "line-runs")
    # The copies of a run start anywhere in the corpus, so their first member is taken over all suffixes with that prefix.
    asked = runs.select("run", "left", "right").distinct().withColumn("width", F.expr("CAST(POW(2, FLOOR(LOG2(run))) AS INT)"))
    begin = asked.join(ranks.withColumnsRenamed({"rank": "left", "at": "start"}), ["width", "left"]).withColumn("at", F.expr("start + run - width"))
    same = begin.join(ranks.withColumnRenamed("rank", "right"), ["key", "width", "at", "right"])
    first = same.groupBy("run", "left", "right").agg(F.min(F.struct("key", F.col("start").alias("pos"))).alias("first"))
    linked = runs.join(first, ["run", "left", "right"]).where(F.col("first") < F.struct("key", F.col("start").alias("pos")))
    gone = covered(linked.select("key", "start", "run")) if short_runs else linked.select("key", "pos")
    return alone.union(gone)


def with_kept_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = 20, short_runs: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``kept_text``, ``n_lines``, ``n_removed`` and ``n_runs`` of ``dedup_lines``.

    With ``short_runs`` a repeated run goes as soon as its lines have ``min_chars`` characters together, line feeds not counted.
    """
    gone = removed_lines(docs, text, id_col, min_chars, short_runs)
    gone = gone.groupBy("key").agg(F.collect_set("pos").alias("_gone")).withColumnRenamed("key", "_key")
    out = docs.withColumn("_key", document_key(id_col, text)).join(gone, "_key", "left").withColumn("_lines", split_lines(F.col(text)))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    out = out.withColumn("_stay", F.when(F.col("_gone").isNotNull(), F.array_except(every, F.col("_gone"))))
    whole, changed = F.coalesce(F.col(text), F.lit("")), F.col("_gone").isNotNull()
    kept = F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")
    runs = F.size("_gone") - F.size(F.array_intersect("_gone", F.transform("_gone", lambda i: i + 1)))
    out = out.withColumns({
        "kept_text": F.when(changed, kept).otherwise(whole), "n_lines": F.size("_lines"),
        "n_removed": F.when(changed, F.size("_gone")).otherwise(0), "n_runs": F.when(changed, runs).otherwise(0),
    })
    return out.drop("_key", "_gone", "_lines", "_stay")


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = 20) -> DataFrame:
    """Texts without later copies of repeated line runs: ``id_col``, ``kept_text``, ``n_lines``, ``n_removed``, ``n_runs``.

    Lines end at a line feed. A run of consecutive lines is repeated if an equal run starts earlier: in a document with a
    smaller id (a null id first; equal ids in the order of a text hash), or further up in the same one. Every line that
    lies in a repeated run with a line of ``min_chars`` characters or more is deleted; a run of short lines alone stays.
    Runs are judged on the input, not on what is left. ``n_runs`` counts maximal deleted runs.

    One row per input row; rows that repeat id and text are one document and get the same result. A null or empty text is
    one empty line and stays (null becomes empty). Other columns are ignored; an empty table gives an empty result.
    """
    out = with_kept_lines(docs.select(F.col(id_col), F.col(text).alias("_text")), "_text", id_col, min_chars)
    return out.drop("_text")
