"""Sampling, spacing, splits and assignment against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.hashing import stable_hash
from tallyframe.operators import checks, curation, pairs, splits


def spaced_valid(flags, k):
    """Nearest valid index to each spread position, in turn; the earlier one on ties."""
    n, taken = len(flags), []
    for i in range(k):
        target = round(i * (n - 1) / (k - 1))
        for j in sorted(range(n), key=lambda j: abs(j - target)):
            if flags[j] and j not in taken:
                taken.append(j)
                break
        else:
            break
    return sorted(taken) if len(taken) >= 2 else []


def test_evenly_spaced_valid_equals_greedy_choice(spark):
    rng = random.Random(8)
    groups = {f"g{i}": [rng.random() < p for _ in range(rng.randrange(1, 60))] for i, p in enumerate([0.02, 0.1, 0.3, 0.5, 0.9, 1.0, 0.0, 0.2])}
    groups["hot"] = [rng.random() < 0.05 for _ in range(700)]
    rows = [(g, 10 * i, ok) for g, flags in groups.items() for i, ok in enumerate(flags)]
    df = spark.createDataFrame(rows, "g string, pos bigint, ok boolean").repartition(5)
    for k in (2, 5, 8):
        got = {}
        for r in curation.evenly_spaced_valid(df, ["g"], ["pos"], k, "ok").collect():
            got.setdefault(r.g, []).append(r.pos // 10)
        assert {g: sorted(v) for g, v in got.items()} == {g: s for g, flags in groups.items() if (s := spaced_valid(flags, k))}


def test_components_ignore_row_order_and_follow_chains(spark):
    chain = [(f"f{i:03}", f"a{j}") for i in range(60) for j in (i, i + 1)]
    rows = chain + [("solo", "b0")] + [(f"h{i}", "hub") for i in range(200)]
    out = []
    for data in (rows, rows[::-1]):
        df = spark.createDataFrame(data, "family string, asset string").repartition(3)
        out.append({r.family: (r.component, r.split) for r in splits.component_split(df.select("family"), df, "family", "asset", "s").collect()})
    assert out[0] == out[1]
    assert {out[0][f"f{i:03}"][0] for i in range(60)} == {"f000"}
    assert len({out[0][f"h{i}"] for i in range(200)}) == 1 and out[0]["solo"][0] == "solo"


def test_assignment_meets_quota_and_sources(spark):
    rows = [(f"f{i}", "state" if i < 24 else "identity", f"s{i // 2}") for i in range(48)]
    df = spark.createDataFrame(rows, "family string, task string, source string")
    slots = curation.assign_tasks(df, "task", "source", "family", ["a", "b", "c"], 2, 24, 7)
    assert slots.count() == 48 * 6
    assert checks.check_assignment(slots, "task", "family", "source", 2, people=slots.select("person").distinct().count()).count() == 0
    quota = slots.groupBy("task", "arm", "person").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(quota) == (2, 2)
    with pytest.raises(ValueError):
        curation.assign_tasks(df, "task", "source", "family", ["a", "b", "c"], 2, 20, 7)


def test_negative_pairs_cross_categories_without_repeats(spark):
    rows = [(i, "big" if i % 3 else f"c{i % 4}", "s") for i in range(120)]
    df = spark.createDataFrame(rows, "k bigint, c string, split string")
    out = pairs.negative_pairs(df, "split", "c", "k", 4, "x").collect()
    assert all(r.c != r.partner_category for r in out)
    assert len({(r.k, r.partner) for r in out}) == len(out) == 120 * 4


def test_signature_partner_finds_one_wherever_there_is_one(spark):
    rows = [(i, f"s{i % 3}", "only" if i % 3 == 0 else f"c{i % 5}") for i in range(90)]
    df = spark.createDataFrame(rows, "k bigint, sig string, c string")
    for r in pairs.signature_partner(df, "sig", "c", "k", "x").collect():
        assert (r.partner is None) == (r.sig == "s0")
        assert r.partner is None or (r.partner_category != r.c and r.partner % 3 == r.k % 3)


def test_balanced_sample_needs_two_labels(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "k bigint, label int")
    with pytest.raises(ValueError):
        curation.balanced_sample(df, "label", "k", 2, 1)


def test_samples_take_the_first_rows_in_hash_order(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(40)], "k bigint, g int").withColumn("h", stable_hash(F.col("k"), "s"))
    order = sorted(df.collect(), key=lambda r: r.h)
    want = {r.k for g in (0, 1) for r in [r for r in order if r.g == g][:7]}
    assert {r.k for r in curation.stratified_hash_sample(df, ["g"], "k", "s", 7).collect()} == want


def test_families_without_assets_are_split_on_their_own(spark):
    families = spark.createDataFrame([(c,) for c in "abcd"], "f string")
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y")], "f string, asset string")
    got = {r.f: r.component for r in splits.component_split(families, edges, "f", "asset", "s").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_common_cohort_of_many_cells(spark):
    df = spark.createDataFrame([(f, c) for f in range(3) for c in range(70) if not (f == 1 and c == 66)], "f int, c int")
    got = curation.common_cohort(df, "f", [F.col("c") == c for c in range(70)]).collect()
    assert sorted(r.f for r in got) == [0, 2]
