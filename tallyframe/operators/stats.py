"""Means, counters, agreement, paired comparisons and exact tests.

Row data is aggregated once, at the finest level, before anything is pivoted, rolled up or tested; every such
aggregation combines before its shuffle.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.evidence import REFUTED, SUPPORTED, UNDECIDED, transition
from ..skew import running_total

NO_VERDICT = "No submitted verdict"
DEFINITE = (SUPPORTED, REFUTED)


def rate(condition: Column) -> Column:
    """Share of rows for which a condition holds; unknown counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def is_correct() -> Column:
    return F.col("verdict").eqNullSafe(F.col("source_label"))


def is_definite() -> Column:
    return F.coalesce(F.col("verdict").isin(*DEFINITE), F.lit(False))


def with_overall(counts: DataFrame, by: Sequence[str], over: str, sums: Sequence[str]) -> DataFrame:
    """Add an ``overall`` row per group to counts which are split by ``over``.

    ``counts`` is already aggregated, so the grouping sets expand a small table rather than the rows.
    """
    rolled = counts.groupingSets([list(map(F.col, by)), [*map(F.col, by), F.col(over)]], *by, over).agg(
        *[F.sum(s).alias(s) for s in sums], F.grouping(over).alias("_all")
    )
    return rolled.withColumn(over, F.when(F.col("_all") == 1, "overall").otherwise(F.col(over))).drop("_all")


def metric_means(df: DataFrame, by: Sequence[str], metrics: Sequence[str], family: str, memory: str | None = None) -> DataFrame:
    """Mean of boolean or numeric metrics with episode and family counts; a metric never recorded stays null."""
    means = [F.avg(F.col(m).cast("double")).alias(m) for m in metrics]
    peak = [F.max(memory).alias(f"max_{memory}")] if memory else []
    return df.groupBy(*by).agg(F.count("*").alias("episodes"), F.count_distinct(family).alias("families"), *means, *peak)


def counter(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count per value; a missing answer has a name of its own."""
    answer = F.coalesce(F.col(value), F.lit(NO_VERDICT)).alias("answer")
    return df.groupBy(*by, answer).agg(F.count("*").alias("n"))


def counter_map(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Map answer → count per group, for fixed sets of answers; ``counter`` gives free answers as rows."""
    entries = F.array_sort(F.collect_list(F.struct("answer", "n")))
    return counter(df, by, value).groupBy(*by).agg(F.map_from_entries(entries).alias("counts"))


def label_agreement(episodes: DataFrame) -> DataFrame:
    """Matches with the label per model and arm, overall and per task; abstentions and missing answers count as wrong."""
    counts = episodes.groupBy("model", "arm", "task").agg(F.count("*").alias("episodes"), F.count_if(is_correct()).alias("matches"))
    out = with_overall(counts, ["model", "arm"], "task", ["episodes", "matches"])
    return out.withColumn("accuracy", F.col("matches") / F.col("episodes"))


def majority_baseline(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Share of the most frequent label: what a constant answer would reach."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.max(F.struct(F.col("_n"), F.col(label))).alias("_m")
    ).select(*by, "rows", F.col(f"_m.{label}").alias("majority"), (F.col("_m._n") / F.col("rows")).alias("share"))


def selective_error(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Error among definite answers; null when nothing was answered."""
    wrong = F.when(is_definite(), F.when(is_correct(), 0.0).otherwise(1.0))
    return df.groupBy(*by).agg(F.count_if(is_definite()).alias("definite"), F.avg(wrong).alias("selective_error"))


def risk_coverage(df: DataFrame, by: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Share answered with confidence at or above each threshold, and the error among those.

    A row is counted once, under the number of thresholds it meets; the few counts are then spread over thresholds.
    """
    limits = sorted(thresholds)
    met = sum((F.when(F.col("confidence") >= t, 1).otherwise(0) for t in limits), F.lit(0))
    level = F.when(F.col("verdict").isNotNull() & (F.col("verdict") != UNDECIDED), met).otherwise(0)
    counts = df.groupBy(*by, level.alias("_level")).agg(F.count("*").alias("_n"), F.count_if(is_correct()).alias("_right"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(limits)])
    spread = counts.withColumn("_s", F.explode(steps))
    reached = F.col("_level") >= F.col("_s.i")
    out = spread.groupBy(*by, F.col("_s.threshold").alias("threshold")).agg(
        F.sum("_n").alias("_all"), F.sum(F.when(reached, F.col("_n")).otherwise(0)).alias("covered"),
        F.sum(F.when(reached, F.col("_right")).otherwise(0)).alias("_right"),
    )
    return out.select(
        *by, "threshold", "covered", (F.col("covered") / F.col("_all")).alias("coverage"),
        (1 - F.try_divide("_right", "covered")).alias("risk"),
    )


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group: the value at rank ``ceil(share * n)``, exact for groups of any size.

    Rows are counted per value first, so one very frequent value is one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_rows"))
    ranked = running_total(counts, by, [value], "_rows", "_rank", "_n")
    picks = [F.min(F.when(F.col("_rank") >= F.ceil(F.lit(share) * F.col("_n")), F.col(value))).alias(name) for name, share in shares.items()]
    return ranked.groupBy(*by).agg(*picks)


def efficiency(df: DataFrame, by: Sequence[str], wall: str, measures: Sequence[str]) -> DataFrame:
    """Mean cost per episode with median and 90th percentile of the wall time; all attempts stay in the denominator.

    Null group values are a group; a group without any wall time has null percentiles.
    """
    means = df.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.count_if(is_correct()).alias("correct"), F.avg(wall).alias(f"mean_{wall}"),
        *[F.avg(m).alias(f"mean_{m}") for m in measures],
    )
    names = {f"p50_{wall}": 0.5, f"p90_{wall}": 0.9}
    ranks = nearest_rank(df, by, wall, names).select(F.struct(*by).alias("_group"), *names)
    return means.withColumn("_group", F.struct(*by)).join(ranks, "_group", "left").drop("_group")


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n!, to double precision: Stirling's series eight places further on."""
    x = n.cast("double") + 1
    ahead = x + 8
    series = (ahead - 0.5) * F.log(ahead) - ahead + 0.5 * math.log(2 * math.pi) + 1 / (12 * ahead) - 1 / (360 * F.pow(ahead, 3.0)) + 1 / (1260 * F.pow(ahead, 5.0))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def mcnemar_p(gain: Column, loss: Column) -> Column:
    """Two-sided exact binomial test on discordant pairs; 1 when there are none.

    The sum runs downwards from its largest term. Ten standard deviations further terms are below double precision, so
    it takes about ten square roots of the number of pairs.
    """
    n, k = (gain + loss).cast("double"), F.least(gain, loss)
    largest = log_factorial(n) - log_factorial(k) - log_factorial(n - k.cast("double")) - n * math.log(2)
    width = F.least(k, F.ceil(10 * F.sqrt(n)).cast("bigint") + 100)
    steps = F.when(width > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(width, F.lit(1)).cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i) / (n - k + i + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.aggregate(steps, start, add, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(largest) * tail))


def paired(df: DataFrame, keys: Sequence[str], arm: str, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """Rows of two arms side by side (suffixes ``_a`` and ``_b``), keys present in both only.

    One conditional aggregation instead of a self-join: the rows are shuffled once.
    """
    def pick(name: str, suffix: str) -> list[Column]:
        return [F.max(F.when(F.col(arm) == name, F.struct(*columns))).alias(f"_{suffix}")]
    both = df.filter(F.col(arm).isin(a, b)).groupBy(*keys).agg(*pick(a, "a"), *pick(b, "b")).filter("_a IS NOT NULL AND _b IS NOT NULL")
    return both.select(*keys, *[F.col(f"_{s}.{c}").alias(f"{c}_{s}") for c in columns for s in ("a", "b")])


def paired_table(pairs: DataFrame, by: Sequence[str], before: Column, after: Column) -> DataFrame:
    """Both right, neither, gains and losses, with the difference and its exact test."""
    counts = pairs.withColumn("_x", before).withColumn("_y", after).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("_x") & F.col("_y")).alias("both"), F.count_if(~F.col("_x") & ~F.col("_y")).alias("neither"),
        F.count_if(~F.col("_x") & F.col("_y")).alias("gain"), F.count_if(F.col("_x") & ~F.col("_y")).alias("loss"),
    )
    return counts.withColumn("difference_pp", 100 * (F.col("gain") - F.col("loss")) / F.col("n")).withColumn(
        "p_value", mcnemar_p(F.col("gain"), F.col("loss"))
    )


def paired_changes(pairs: DataFrame, keys: Sequence[str], before: Column, after: Column) -> DataFrame:
    """Keys that were gained or lost, one row each; a report sorts them."""
    change = F.when(~before & after, "gain").when(before & ~after, "loss")
    return pairs.select(*keys, change.alias("change")).filter("change IS NOT NULL")


def answer_transitions(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of (answer before, answer after, match before, match after)."""
    def answer(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(NO_VERDICT))
    return pairs.groupBy(
        *by, answer("verdict_a").alias("before"), answer("verdict_b").alias("after"),
        F.col("verdict_a").eqNullSafe(F.col("source_label_a")).alias("match_before"),
        F.col("verdict_b").eqNullSafe(F.col("source_label_b")).alias("match_after"),
    ).agg(F.count("*").alias("n"))


CHANGES = ("maintained_correct", "corrected", "remained_wrong", "lost_no_valid_final", "lost_explicit_NME", "lost_valid_wrong_label")


def transition_counts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Six-way transition counts with net change, per group."""
    change = transition(F.col("verdict_a"), F.col("verdict_b"), F.col("source_label_a"))
    counts = pairs.withColumn("_c", change).groupBy(*by).agg(
        F.count("*").alias("episodes"), *[F.count_if(F.col("_c") == c).alias(c) for c in CHANGES]
    )
    return counts


def net_change(counts: DataFrame) -> DataFrame:
    lost = F.col("lost_no_valid_final") + F.col("lost_explicit_NME") + F.col("lost_valid_wrong_label")
    return counts.withColumn("lost", lost).withColumn("net_correct_change", F.col("corrected") - F.col("lost"))


def leaderboard(table: DataFrame, group: str, metric: str, label: str) -> DataFrame:
    """Display order (group, metric descending with nulls last, label) and a flag for the best of each group.

    ``table`` is a finished report with a handful of rows per group.
    """
    order = W.partitionBy(group).orderBy(F.desc_nulls_last(metric), F.asc(label))
    best = F.max(metric).over(W.partitionBy(group))
    return table.withColumn("position", F.row_number().over(order)).withColumn("best", F.coalesce(F.col(metric) == best, F.lit(False)))
