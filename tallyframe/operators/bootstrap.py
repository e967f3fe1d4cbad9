"""Deterministic bootstraps over statistical units (families, banks).

``draws`` resamples units with replacement, exactly as a seeded resampling would, through a table of hashed draws; its
size is replicates times units. ``counts`` is the same resampling without a row per draw: how often each distinct pair of
sums is drawn is multinomial, and a tree of hashed binomials splits the number of units down to the values; its size is
units plus replicates times distinct values. ``poisson`` gives every unit an independent Poisson(1) weight per replicate: a single
pass without any join, whose sums combine before the shuffle. It is a different resampling scheme with the same limit,
and the one to use for many units.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest_int
from ..session import materialize
from ..skew import ordered_index

# Replicates served by one digest: eight 32-bit fractions.
PER_DIGEST = 8
# Levels of the tree of counts planned as one job.
LEVELS_PER_JOB = 8


def poisson_thresholds() -> list[float]:
    """Cumulative probabilities of a Poisson(1) variable up to where a 32-bit fraction cannot reach."""
    term, total, out = math.exp(-1), 0.0, []
    for k in range(13):
        total += term
        out.append(total)
        term /= k + 1
    return out


def poisson_edges() -> list[str]:
    """``poisson_thresholds`` as eight hex digits: a 32-bit fraction is below a threshold exactly if its digits come before these."""
    edges = [math.ceil(limit * 2**32) for limit in poisson_thresholds()]
    return [f"{edge:08x}" for edge in edges if edge < 2**32]


def _weight(word: Column) -> Column:
    """Poisson number of a 32-bit fraction given as eight hex digits, which are compared as they are."""
    edges = poisson_edges()
    weight = F.when(word < edges[0], 0)
    for k, edge in enumerate(edges[1:], 1):
        weight = weight.when(word < edge, k)
    return weight.otherwise(len(edges))


def unit_sums(df: DataFrame, unit: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum and count of the value per unit, combined before the shuffle; null values do not count."""
    return df.groupBy(*by, unit).agg(F.sum(F.col(value).cast("double")).alias("num"), F.count(value).cast("double").alias("den")).filter("den > 0")


def poisson_replicates(units: DataFrame, unit: str, iterations: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Weighted ``num`` and ``den`` per replicate."""
    blocks = -(-iterations // PER_DIGEST)
    key = F.concat_ws("|", F.lit(str(seed)), F.col("_block").cast("string"), F.col(unit).cast("string"))
    rows = units.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_d", F.sha2(key, 256))
    # Each word is cut out once and then compared with about two edges.
    rows = rows.withColumns({f"_h{s}": F.substring("_d", 1 + 8 * s, 8) for s in range(PER_DIGEST)})
    rows = rows.withColumns({f"_w{s}": _weight(F.col(f"_h{s}")) for s in range(PER_DIGEST)})
    sums = [F.sum(F.col(f"_w{s}") * F.col(c)).alias(f"{c}{s}") for s in range(PER_DIGEST) for c in ("num", "den")]
    slots = F.array(*[
        F.struct((F.col("_block") * PER_DIGEST + s).alias("replicate"), F.col(f"num{s}").alias("num"), F.col(f"den{s}").alias("den"))
        for s in range(PER_DIGEST)
    ])
    out = rows.groupBy(*by, "_block").agg(*sums).select(*by, F.explode(slots).alias("z")).select(*by, "z.*")
    return out.filter(F.col("replicate") < iterations)


def draw_replicates(units: DataFrame, unit: str, iterations: int, seed: int) -> DataFrame:
    """``num`` and ``den`` of each replicate of exact resampling with replacement.

    The join meets a table of units; Spark broadcasts it when it is small enough and shuffles by index otherwise.
    """
    indexed = ordered_index(units, [], [unit], "_index").select("_index", "num", "den")
    n = indexed.count()
    draws = units.sparkSession.range(iterations * n).select(
        F.expr(f"id div {max(n, 1)}").alias("replicate"), (F.col("id") % max(n, 1)).alias("_draw")
    )
    key = F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_draw").cast("string"))
    drawn = draws.withColumn("_index", digest_int(F.sha2(key, 256)) % max(n, 1) + 1)
    return drawn.join(indexed, "_index").groupBy("replicate").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def binomial_draw(df: DataFrame, u: Column, n: str, left: str, right: str, name: str) -> DataFrame:
    """Adds ``name``: a Binomial(``n``, left / (left + right)) number, read off at ``u`` in [0, 1).

    Outcomes are laid out from the mode outwards, one up and one down in turn, with terms relative to the mode's. Nine
    standard deviations on are below what 52 bits of ``u`` can tell, so a draw costs about nine square roots of ``n``.
    """
    whole, share = F.col(left) + F.col(right), F.col(left) / (F.col(left) + F.col(right))
    rows = df.withColumn("_n", F.col(n).cast("double")).withColumn("_odds", F.try_divide(F.col(left), F.col(right))).withColumn("_against", F.try_divide(F.col(right), F.col(left)))
    rows = rows.withColumn("_mode", F.least(F.floor((F.col("_n") + 1) * F.col(left) / whole).cast("double"), F.col("_n")))
    width = F.ceil(9 * F.sqrt(F.col("_n") * share * (1 - share))).cast("int") + 20
    rows = rows.withColumn("_steps", F.sequence(F.lit(1), width))

    def terms(acc: Column, j: Column) -> tuple[Column, Column]:
        up = acc["up"] * (F.col("_n") - F.col("_mode") - j + 1) / (F.col("_mode") + j) * F.col("_odds")
        return up, acc["down"] * (F.col("_mode") - j + 1) / (F.col("_n") - F.col("_mode") + j) * F.col("_against")

    def add(acc: Column, j: Column) -> Column:
        up, down = terms(acc, j)
        return F.struct(up.alias("up"), down.alias("down"), (acc["total"] + up + down).alias("total"))

    def seek(acc: Column, j: Column) -> Column:
        up, down = terms(acc, j)
        place = F.when(acc["rest"] < up, F.col("_mode") + j).when(acc["rest"] < up + down, F.col("_mode") - j)
        return F.struct(
            up.alias("up"), down.alias("down"), (acc["rest"] - up - down).alias("rest"), F.coalesce(acc["place"], place).alias("place")
        )

    one = F.lit(1.0)
    total = F.aggregate("_steps", F.struct(one.alias("up"), one.alias("down"), one.alias("total")), add, lambda acc: acc["total"])
    rows = rows.withColumn("_rest", u * total - 1)
    start = F.struct(one.alias("up"), one.alias("down"), F.col("_rest").alias("rest"), F.when(F.col("_rest") < 0, F.col("_mode")).alias("place"))
    # Rounding may leave a last crumb of ``rest``; it belongs to the tail, and the mode takes it.
    drawn = F.coalesce(F.aggregate("_steps", start, seek, lambda acc: acc["place"]), F.col("_mode")).cast("long")
    certain = F.when(F.col(right) == 0, F.col(n)).when(F.col(left) == 0, 0)
    return rows.withColumn(name, F.coalesce(certain, drawn)).drop("_n", "_odds", "_against", "_mode", "_steps", "_rest")


def value_counts(units: DataFrame, iterations: int, seed: int) -> DataFrame:
    """How often each distinct (``num``, ``den``) is drawn per replicate: ``replicate``, ``num``, ``den``, ``drawn`` > 0.

    Values in their order are the leaves of a binary tree. A node's draws go to its left half by a binomial hashed from seed,
    replicate and node, the rest to its right half. Copies of a value are drawn as one, so no row stands for a draw.
    """
    values = units.groupBy("num", "den").agg(F.count("*").alias("weight"))
    values = materialize(ordered_index(values, [], ["num", "den"], "_index"), "values")
    many, n = values.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    depth = max(many - 1, 0).bit_length()
    leaves = values.withColumn("_leaf", F.col("_index") - 1 + 2**depth)
    counts = units.sparkSession.range(iterations).select(F.col("id").alias("replicate"), F.lit(1).cast("long").alias("_node"), F.lit(n).cast("long").alias("drawn"))
    for level in range(depth):
        up = depth - level
        first = F.shiftright("_leaf", up - 1) % 2 == 0
        halves = leaves.groupBy(F.shiftright("_leaf", up).alias("_node")).agg(
            F.sum(F.when(first, F.col("weight")).otherwise(0)).alias("_left"), F.sum(F.when(first, 0).otherwise(F.col("weight"))).alias("_right")
        )
        key = F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("_node").cast("string"))
        if level:
            known = counts.join(halves, "_node")
        else:
            # The root is one node: its two weights are numbers, not a table to join.
            known = counts.withColumns({c: F.lit(w) for c, w in halves.select("_left", "_right").first().asDict().items()})
        split = binomial_draw(known, digest_int(F.sha2(key, 256), 1, 13) / F.lit(float(2**52)), "drawn", "_left", "_right", "_first")
        sides = F.array(
            F.struct((F.col("_node") * 2).alias("_node"), F.col("_first").alias("drawn")),
            F.struct((F.col("_node") * 2 + 1).alias("_node"), (F.col("drawn") - F.col("_first")).alias("drawn")),
        )
        counts = split.select("replicate", F.explode(sides).alias("z")).select("replicate", "z.*").filter("drawn > 0")
        if level % LEVELS_PER_JOB == LEVELS_PER_JOB - 1:
            counts = materialize(counts, "counts")
    return counts.join(leaves.withColumnRenamed("_leaf", "_node"), "_node").select("replicate", "num", "den", "drawn")


def count_replicates(units: DataFrame, unit: str, iterations: int, seed: int) -> DataFrame:
    """``num`` and ``den`` of each replicate of exact resampling with replacement, by ``value_counts``."""
    drawn = value_counts(units, iterations, seed)
    return drawn.groupBy("replicate").agg(F.sum(F.col("drawn") * F.col("num")).alias("num"), F.sum(F.col("drawn") * F.col("den")).alias("den"))


def _interval(replicates: DataFrame, by: Sequence[str]) -> DataFrame:
    value = F.try_divide(F.col("num"), F.col("den"))
    bounds = replicates.withColumn("_v", value).groupBy(*by).agg(
        F.percentile("_v", F.lit(0.025)).alias("low"), F.percentile("_v", F.lit(0.975)).alias("high"), F.count("_v").alias("replicates")
    )
    return bounds


def ratio_interval(units: DataFrame, unit: str, iterations: int, seed: int, method: str) -> DataFrame:
    """Ratio of sums over units with its 95 % percentile interval; ``units`` has ``unit``, ``num`` and ``den``.

    ``method`` is draws, counts or poisson: the interval depends on it, so no size chooses it.
    """
    replicate = {"draws": draw_replicates, "counts": count_replicates, "poisson": poisson_replicates}[method]
    point = units.agg(F.count("*").alias("units"), F.try_divide(F.sum("num"), F.sum("den")).alias("estimate"))
    bounds = _interval(replicate(units, unit, iterations, seed), [])
    # Two single rows become one by aggregation; a join of them would have no key.
    both = point.unionByName(bounds, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("units", "estimate", "low", "high", "replicates")])


def bootstrap_ci(df: DataFrame, unit: str, value: str, iterations: int, seed: int, method: str) -> DataFrame:
    """Mean over units of the per-unit mean, with its interval: the unit is the family, not the row."""
    means = unit_sums(df, unit, value).select(unit, (F.col("num") / F.col("den")).alias("num"), F.lit(1.0).alias("den"))
    return ratio_interval(means, unit, iterations, seed, method)


def cluster_ratio_bootstrap(df: DataFrame, cluster: str, value: str, iterations: int, seed: int, method: str) -> DataFrame:
    """Resample whole clusters; the statistic is the ratio of their sums to their sizes."""
    return ratio_interval(unit_sums(df, cluster, value), cluster, iterations, seed, method)


def paired_units(df: DataFrame, unit: str, pair: Sequence[str], arm: str, a: str, b: str, value: str) -> DataFrame:
    """Per unit the mean of value(b) - value(a) over complete pairs only."""
    def side(name: str) -> Column:
        return F.avg(F.when(F.col(arm) == name, F.col(value).cast("double"))).alias(f"_{'a' if name == a else 'b'}")
    pairs = df.filter(F.col(arm).isin(a, b)).groupBy(unit, *pair).agg(side(a), side(b))
    return pairs.withColumn("delta", F.col("_b") - F.col("_a")).filter("delta IS NOT NULL").groupBy(unit).agg(
        F.avg("delta").alias("num"), F.lit(1.0).alias("den"), F.count("*").alias("pairs")
    )


def paired_delta(
    df: DataFrame, unit: str, pair: Sequence[str], arm: str, a: str, b: str, value: str, iterations: int, seed: int, method: str
) -> DataFrame:
    return ratio_interval(paired_units(df, unit, pair, arm, a, b, value).drop("pairs"), unit, iterations, seed, method)
