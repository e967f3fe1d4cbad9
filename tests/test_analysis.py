"""Statistics, checks, worlds, training tables and requests on small fixtures."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import bootstrap, checks, stats, traces, training, worlds
from tallyframe.schemas import EVIDENCE


def test_two_units_span_zero_to_one(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0)], "u string, v double")
    for method in ("draws", "poisson"):
        row = bootstrap.bootstrap_ci(df, "u", "v", 400, 3, method).first()
        assert (row.units, row.estimate, row.low, row.high) == (2, 0.5, 0.0, 1.0)


def test_poisson_and_draws_agree_on_many_units(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, float(rng.random() < 0.3)) for i in range(400)], "u bigint, v double")
    a, b = (bootstrap.bootstrap_ci(df, "u", "v", 400, 3, m).first() for m in ("draws", "poisson"))
    assert a.estimate == b.estimate
    assert abs(a.low - b.low) < 0.02 and abs(a.high - b.high) < 0.02
    width = 1.96 * math.sqrt(a.estimate * (1 - a.estimate) / 400)
    assert abs((a.high - a.low) / 2 - width) < 0.01


def test_mcnemar_matches_the_binomial_sum(spark):
    cases = [(0, 0), (1, 0), (5, 1), (10, 10), (38, 22), (3, 900), (2000, 2100)]
    df = spark.createDataFrame(cases, "gain bigint, loss bigint")
    for r in df.select("*", stats.mcnemar_p(F.col("gain"), F.col("loss")).alias("p")).collect():
        n, k = r.gain + r.loss, min(r.gain, r.loss)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert math.isclose(r.p, want, rel_tol=1e-7, abs_tol=1e-12)


def test_nearest_rank_percentiles(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 12)], "g string, v double")
    row = stats.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (row.p50, row.p90) == (6.0, 10.0)


def test_enforce_reports_and_raises(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "a int, b int")
    with pytest.raises(checks.CheckFailed, match="repeated"):
        checks.enforce(checks.check_unique(df, ["a"]), "repeated")
    checks.enforce(checks.check_unique(df.distinct(), ["a"]), "repeated")


def test_conflicting_replays_are_flagged(spark):
    rows = [("k", "x", "p2"), ("k", "x", "p1"), ("m", "x", "p1"), ("m", "y", "p3")]
    df = spark.createDataFrame(rows, "key string, value string, src string")
    out = {r.key: (r.copies, r.first_source, r.last_source, r.conflict) for r in checks.dedupe_replays(df, ["key"], F.col("value"), F.col("src")).collect()}
    assert out == {"k": (2, "p1", "p2", False), "m": (2, "p1", "p3", True)}


def test_novelty_needs_an_earlier_message(spark):
    rows = [("e", 1, "i1"), ("e", 2, "i1"), ("e", 2, "i2"), ("e", 3, "i1"), ("f", 1, "i1")]
    df = spark.createDataFrame(rows, "episode string, pos int, image string")
    out = {(r.episode, r.pos): (r.returned, r.novel, r.repeated_only) for r in traces.image_novelty(df).collect()}
    assert out == {("e", 1): (1, 1, False), ("e", 2): (2, 1, False), ("e", 3): (1, 0, True), ("f", 1): (1, 1, False)}


def test_advantages_keep_their_units(spark):
    rows = [("a", 1.0), ("a", -1.0), ("b", 0.5), ("b", 0.5), ("c", 1.0), ("d", 0.98), ("d", 1.0)]
    df = spark.createDataFrame(rows, "g string, reward double")
    out = {}
    for r in training.group_advantages(df, ["g"]).collect():
        out.setdefault(r.g, []).append(None if r.advantage is None else round(r.advantage, 6))
    assert sorted(out["a"]) == [-1.0, 1.0] and out["b"] == [0.0, 0.0] and out["c"] == [None] and sorted(out["d"]) == [-0.01, 0.01]


def test_preferences_count_copies_without_pairing_them(spark):
    base = {"origin": "o", "world": "w", "prefix_length": 1, "prefix_digest": "p", "failure_seen": False, "termination": "finished", "official_split": "train",
            "grounding_protocol": "evidence-chain-v1", "annotation_status": "reviewed", "unsupported_decision": False, "request_cost": 3, "tool_cost": 0}
    rows = [{**base, "first_action": "x", "verdict": "Supported", "grounded_correct": True}] * 3
    rows += [{**base, "first_action": "y", "verdict": "Refuted", "grounded_correct": False}] * 4
    rows += [{**base, "first_action": "x", "verdict": "Refuted", "grounded_correct": False}, {**base, "first_action": "z", "verdict": "Supported", "grounded_correct": True, "official_split": "test"}]
    out = training.preference_pairs(spark.createDataFrame(rows), "origin").collect()
    assert [(r.chosen_action, r.rejected_action, r.pairs) for r in out] == [("x", "y", 12)]


def clean_worlds(spark):
    grid = worlds.world_grid(spark.createDataFrame([("b",)], "k string"), "k")
    full = grid.withColumn("view", F.explode(F.array(*[F.lit(v) for v in worlds.VIEWS])))
    sig = (
        F.when(F.col("view") == "front_survey", F.col("permutation")).when(F.col("view") == "rear_left", F.col("states") % 2)
        .when(F.col("view") == "rear_center", F.floor(F.col("states") / 2) % 2).when(F.col("view") == "rear_right", F.floor(F.col("states") / 4)).otherwise(0)
    )
    return full.withColumn("sig", sig.cast("string")).withColumn("meta", F.lit("m"))


def test_clean_bank_needs_two_requests(spark):
    w = clean_worlds(spark)
    assert worlds.grid_problems(w).count() == 0
    assert worlds.certify_bank(w).count() == 0
    assert {r.min_requests for r in worlds.min_requests(worlds.world_views(w)).collect()} == {2}
    without_front = F.array(*[F.lit(v) for v in worlds.REQUEST_VIEWS if v != "front_survey"])
    # Without the front view only equal states in all three rear views settle the label.
    out = worlds.min_requests(worlds.world_views(w), without_front).collect()
    assert {r.min_requests for r in out if r.world_id % 8 in (0, 7)} == {3}
    assert {r.min_requests for r in out if r.world_id % 8 not in (0, 7)} == {None}


def test_an_incomplete_bank_is_not_certified(spark):
    rules = {r.rule for r in worlds.certify_bank(clean_worlds(spark).filter("world_id <> 9")).collect()}
    assert "wrong_world_count" in rules
    with pytest.raises(Exception, match="outside the grid"):
        worlds.world_masks(clean_worlds(spark).withColumn("world_id", F.col("world_id") + 30)).collect()


@pytest.mark.parametrize("view, rule", [("initial", "static_view_varies"), ("front_survey", "front_view_leak"), ("rear_left", "rear_view_leak")])
def test_leaks_are_found(spark, view, rule):
    leaked = clean_worlds(spark).withColumn("sig", F.when(F.col("view") == view, F.col("world_id").cast("string")).otherwise(F.col("sig")))
    assert rule in {r.rule for r in worlds.certify_bank(leaked).collect()}


def brute_requests(evidence, initial, options, targets, depth):
    calls = [q for q in itertools.product(*options)]
    queue, seen = [(frozenset(initial), 0)], {frozenset(initial)}
    while queue:
        shown, n = queue.pop(0)
        if any(set(t) <= shown for t in targets if t):
            return n
        if n == depth:
            continue
        for call in calls:
            match = sorted(e[0] for e in evidence if e[5] and (e[2], e[3], e[4]) == call)
            new = next((m for m in match if m not in shown), None)
            if new and shown | {new} not in seen:
                seen.add(shown | {new})
                queue.append((shown | {new}, n + 1))
    return None


def test_shortest_requests_equal_search(spark):
    rng = random.Random(4)
    rows, want = [], {}
    options = (["o1", "o2"], ["t"], ["v1", "v2"])
    for i in range(60):
        ids = [f"i{j}" for j in range(6)]
        evidence = [(j, j, rng.choice(["o1", "o2", "o3"]), "t", rng.choice(["v1", "v2"]), rng.random() < 0.8, None, None, None) for j in ids]
        initial = rng.sample(ids, rng.randrange(3))
        targets = [sorted(rng.sample(ids, rng.randrange(0, 4))) for _ in range(3)]
        want[i] = brute_requests(evidence, initial, options, targets, 3)
        rows.append((i, evidence, initial, options, targets))
    ddl = f"i int, evidence array<{EVIDENCE}>, initial array<string>, request_options struct<objects:array<string>,times:array<string>,views:array<string>>, targets array<array<string>>"
    df = spark.createDataFrame(rows, ddl)
    got = df.select("i", worlds.shortest_requests(F.col("targets"), F.lit(9), price=3, max_turns=8).alias("p")).collect()
    assert {r.i: r.p.requests for r in got} == want


def test_a_reused_call_id_answers_the_last_call_before(spark):
    ask = '{{"query": {{"view": "{}"}}}}'
    rows = [
        ("e", 1, "assistant", "request_photo", ask.format("side"), "c", None, None), ("e", 2, "tool", None, None, "c", '{"status": "provided"}', "i1"),
        ("e", 3, "assistant", "request_photo", "not json", "c", None, None), ("e", 4, "tool", None, None, "c", "text", "i1"),
        ("e", 5, "tool", None, None, "d", '{"status": "odd"}', None), ("e", 6, "assistant", "crop", "{}", "d", None, None), ("e", 7, "tool", "request_photo", None, None, '{"status": "x"}', None),
    ]
    log = spark.createDataFrame(rows, "episode string, pos long, role string, name string, arguments string, call_id string, text string, image string")
    got = {r.pos: (r.call_pos, r.call_name) for r in traces.call_responses(log).collect()}
    assert got == {2: (1, "request_photo"), 4: (3, "request_photo"), 5: (None, None), 7: (None, None)}
    records = {r.pos: (r.status, r.view, r.returned, r.novel, r.repeated_only) for r in traces.request_records(log).collect()}
    assert records == {2: ("provided", "side", 1, 1, False), 4: (None, None, 1, 0, True), 7: ("x", None, 0, 0, False)}
    excerpt = {r.pos: (r.status, r.responses) for r in traces.trace_excerpt(log).collect()}
    assert excerpt == {1: ("provided", 1), 3: (None, 1), 6: (None, 0)}


def test_exact_test_of_many_pairs(spark):
    from math import comb, erfc, sqrt

    cases = [(0, 0), (1, 0), (3, 9), (40, 55), (500, 430), (0, 1100), (1_500_000_000, 1_500_100_000)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, gain long, loss long")
    got = {r.i: r.p for r in df.select("i", stats.mcnemar_p(F.col("gain"), F.col("loss")).alias("p")).collect()}
    for i, (a, b) in enumerate(cases[:-1]):
        n = a + b
        want = min(1.0, 2 * sum(comb(n, k) for k in range(min(a, b) + 1)) / 2**n) if n else 1.0
        assert got[i] == pytest.approx(want, rel=1e-9)
    # The normal limit with continuity correction.
    assert got[6] == pytest.approx(erfc((100_000 - 1) / sqrt(3_000_100_000) / sqrt(2)), rel=1e-3)


def test_efficiency_keeps_groups_without_times(spark):
    rows = [("a", "Supported", 1.0), ("a", "Refuted", 3.0), ("a", None, 3.0), ("b", None, None), (None, "Supported", 5.0)]
    df = spark.createDataFrame(rows, "g string, verdict string, s double").withColumn("source_label", F.lit("Supported"))
    got = {r.g: (r.episodes, r.p50_s, r.p90_s) for r in stats.efficiency(df, ["g"], "s", []).collect()}
    assert got == {"a": (3, 3.0, 3.0), "b": (1, None, None), None: (1, 5.0, 5.0)}


def test_idle_people_make_a_quota_uneven(spark):
    slots = spark.createDataFrame([("t", "f1", "s1", "x", 1), ("t", "f2", "s2", "x", 1), ("t", "f3", "s3", "x", 2), ("t", "f4", "s4", "x", 2)], "task string, family string, source string, arm string, person int")
    rules = lambda n: [r.rule for r in checks.check_assignment(slots, "task", "family", "source", 1, people=n).collect()]
    assert rules(2) == [] and rules(3) == ["uneven_quota"]


def test_missing_verdicts_match_their_trace(spark):
    results = spark.createDataFrame([(1, None), (2, "a")], "case int, verdict string")
    found = spark.createDataFrame([(1, None, 7), (2, "b", 8)], "case int, verdict string, trace long")
    assert {r.case: r.trace for r in checks.match_traces(results, found, ["case", "verdict"], "trace").collect()} == {1: 7, 2: None}
