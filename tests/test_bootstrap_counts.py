"""Resampling by counts per distinct value: binomials against their distribution, counts against expectation, many units."""

import math
from fractions import Fraction

from pyspark.sql import functions as F

from tallyframe.operators import bootstrap


def outwards(n, left, right):
    """Outcomes from the mode outwards with their exact probabilities."""
    p, mode = Fraction(left, left + right), min(n, math.floor((n + 1.0) * left / (left + right)))
    order = [mode] + [k for j in range(1, n + 1) for k in (mode + j, mode - j) if 0 <= k <= n]
    return [(k, math.comb(n, k) * p**k * (1 - p) ** (n - k)) for k in order]


def test_binomial_is_read_off_its_distribution(spark):
    cases = [(1, 1, 1), (7, 1, 3), (40, 9, 1), (300, 5, 2), (1000, 1, 999), (5, 0, 4), (5, 4, 0)]
    us = [i / 97 for i in range(97)] + [1 - 2.0**-52]
    df = spark.createDataFrame([(n, a, b, u) for n, a, b in cases for u in us], "n bigint, a bigint, b bigint, u double")
    got = {(r.n, r.a, r.b, r.u): r.k for r in bootstrap.binomial_draw(df, F.col("u"), "n", "a", "b", "k").collect()}
    for n, a, b in cases:
        laid = outwards(n, a, b)
        for u in us[:-1]:
            upto, want = Fraction(0), None
            for k, p in laid:
                upto += p
                if Fraction(u) < upto:
                    want = k
                    break
            assert got[n, a, b, u] == want
        assert 0 <= got[n, a, b, us[-1]] <= n


def test_counts_add_up_and_follow_the_weights(spark):
    weights = {(0.0, 1.0): 50, (1.0, 1.0): 30, (2.0, 1.0): 1, (2.0, 3.0): 119, (5.0, 1.0): 400}
    units = spark.createDataFrame([(*v, i) for v, w in weights.items() for i in range(w)], "num double, den double, u int")
    rows = bootstrap.value_counts(units, 500, 5).collect()
    per, sums = {}, {}
    for r in rows:
        per[r.replicate] = per.get(r.replicate, 0) + r.drawn
        sums[r.num, r.den] = sums.get((r.num, r.den), 0) + r.drawn
    assert per == {i: 600 for i in range(500)}
    for value, w in weights.items():
        deviation = math.sqrt(500 * 600 * (w / 600) * (1 - w / 600))
        assert abs(sums[value] - 500 * w) < 5 * deviation
    spread = {}
    for r in rows:
        spread.setdefault((r.num, r.den), []).append(r.drawn)
    variance = sum((x - 400) ** 2 for x in spread[5.0, 1.0]) / 500
    assert 0.75 < variance / (600 * (2 / 3) * (1 / 3)) < 1.3


def test_distinct_values_everywhere_agree_with_draws(spark):
    df = spark.createDataFrame([(i, float(i * i % 401)) for i in range(401)], "u bigint, v double")
    a, b = (bootstrap.bootstrap_ci(df, "u", "v", 300, 3, m).first() for m in ("draws", "counts"))
    assert a.estimate == b.estimate and a.units == b.units == 401 and b.replicates == 300
    assert abs(a.low - b.low) < 3 and abs(a.high - b.high) < 3


def test_edges(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), (None, 1.0), ("c", None)], "u string, v double")
    row = bootstrap.bootstrap_ci(df.filter("u IS NOT NULL"), "u", "v", 400, 3, "counts").first()
    assert (row.units, row.estimate, row.low, row.high) == (2, 0.5, 0.0, 1.0)
    one = bootstrap.bootstrap_ci(df.filter("u = 'a'"), "u", "v", 9, 3, "counts").first()
    assert (one.units, one.low, one.high, one.replicates) == (1, 0.0, 0.0, 9)
    assert bootstrap.bootstrap_ci(df.limit(0), "u", "v", 9, 3, "counts").first().estimate is None


def test_three_million_units_need_no_row_per_draw(spark):
    df = spark.range(3_000_000).select("id", (F.col("id") % 5 < 2).cast("double").alias("v"))
    row = bootstrap.bootstrap_ci(df, "id", "v", 200, 3, "counts").first()
    width = 1.96 * math.sqrt(0.4 * 0.6 / 3e6)
    assert row.estimate == 0.4 and row.replicates == 200
    assert abs((row.high - row.low) / 2 - width) < 0.2 * width


def test_poisson_weights_read_off_hex_words(spark):
    edges = bootstrap.poisson_edges()
    numbers = sorted({0, 2**32 - 1, *[min(max(int(e, 16) + d, 0), 2**32 - 1) for e in edges for d in (-1, 0, 1)], *range(0, 2**32, 2**32 // 997)})
    df = spark.createDataFrame([(n, f"{n:08x}") for n in numbers], "n bigint, word string")
    got = {r.n: r.w for r in df.select("n", bootstrap._weight(F.col("word")).alias("w")).collect()}
    assert got == {n: sum(n / 2**32 >= limit for limit in bootstrap.poisson_thresholds()) for n in numbers}
