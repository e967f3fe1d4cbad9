"""Ranks, replay and digests against brute force, with one group that holds most rows."""

import hashlib
import random

from pyspark.sql import functions as F

from tallyframe.functions.hashing import row_digest, stable_hash
from tallyframe.operators.curation import cyclic_partner
from tallyframe.operators.traces import replay_actions, replay_summary
from tallyframe.skew import hash_ranked, multiset_digest, ordered_index, replay_states


def hot_rows(n=900, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", i) for i in rng.sample(range(10 * n), n)]


def test_hash_ranked_equals_sorting(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, k bigint").repartition(7)
    got = {(r.g, r.k): r["rank"] for r in hash_ranked(df, ["g"], stable_hash(F.col("k"), "s"), "rank", ["k"]).collect()}
    for group in {g for g, _ in rows}:
        keys = sorted((k for g, k in rows if g == group), key=lambda k: hashlib.sha256(f"s|{k}".encode()).hexdigest())
        assert [got[(group, k)] for k in keys] == list(range(1, len(keys) + 1))


def test_ordered_index_spans_partitions(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, k bigint").repartition(5)
    out = ordered_index(df, ["g"], ["k"], "rank", "size").collect()
    got = {(r.g, r.k): (r["rank"], r["size"]) for r in out}
    assert len(out) == len(rows)
    for group in {g for g, _ in rows}:
        keys = sorted(k for g, k in rows if g == group)
        assert [got[(group, k)] for k in keys] == [(i + 1, len(keys)) for i in range(len(keys))]


def test_ordered_index_without_group(spark):
    df = spark.createDataFrame([(k,) for _, k in hot_rows(200)], "k bigint")
    out = {r.k: r["rank"] for r in ordered_index(df, [], ["k"], "rank").collect()}
    assert [out[k] for k in sorted(out)] == list(range(1, 201))


def test_replay_composes_over_many_levels(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 5 else "cold", i, rng.randrange(3)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, pos bigint, op int").repartition(6)
    # A counter over 0..4: op 0 adds one (wraps), op 1 resets, op 2 keeps.
    step = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda s: F.when(F.col("op") == 0, (s + 1) % 5).when(F.col("op") == 1, 0).otherwise(s).cast("int"))
    got = {(r.g, r.pos): (r.state_before, r.state_after) for r in replay_states(df, ["g"], ["pos"], step, 5, 2, segment=4).collect()}
    for group in ("hot", "cold"):
        state = 2
        for g, pos, op in sorted(rows, key=lambda r: r[1]):
            if g != group:
                continue
            after = (state + 1) % 5 if op == 0 else 0 if op == 1 else state
            assert got[(group, pos)] == (state, after)
            state = after


def test_rejected_actions_are_not_charged(spark):
    acts = [("e", i, n) for i, n in enumerate(["request_photo", "request_photo", "crop", "ocr", "inspect", "finish", "crop"])]
    df = spark.createDataFrame(acts, "episode string, pos bigint, name string")
    replayed = replay_actions(df, 5)
    outcomes = [r.outcome for r in replayed.orderBy("pos").collect()]
    assert outcomes == ["accepted", "insufficient_budget", "accepted", "insufficient_budget", "accepted", "finished", "episode_finished"]
    row = replay_summary(replayed, 5).first()
    assert (row.calls, row.requests, row.request_cost, row.tool_cost, row.remaining, row.rejected, row.finished) == (3, 1, 3, 2, 0, 3, True)


def test_multiset_digest_ignores_order_not_content(spark):
    df = spark.createDataFrame(hot_rows(300), "g string, k bigint").withColumn("d", row_digest(F.col("k")))
    one = {r.g: r.digest for r in multiset_digest(df, ["g"], F.col("d")).collect()}
    two = {r.g: r.digest for r in multiset_digest(df.repartition(9).orderBy(F.desc("k")), ["g"], F.col("d")).collect()}
    assert one == two
    changed = {r.g: r.digest for r in multiset_digest(df.filter("k <> (SELECT 1)").union(df.limit(1)), ["g"], F.col("d")).collect()}
    assert changed != one


def test_rows_of_null_groups_are_kept(spark):
    rows = [(None if i % 3 else "g", i) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, k bigint").repartition(4)
    for out in (hash_ranked(df, ["g"], stable_hash(F.col("k"), "s"), "rank", ["k"]), ordered_index(df, ["g"], ["k"], "rank")):
        ranks = sorted(r["rank"] for r in out.filter("g IS NULL").collect())
        assert ranks == list(range(1, 61)) and out.count() == 90
    assert cyclic_partner(df, ["g"], ["k"], "k").count() == 90
    step = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda s: (1 - s).cast("int"))
    assert replay_states(df, ["g"], ["k"], step, 2, 0, segment=5).filter("g IS NULL AND state_after = 1").count() == 30
