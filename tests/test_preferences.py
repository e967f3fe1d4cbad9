"""Preference counts by running sums against all pairs of branches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import training

DDL = (
    "origin string, world string, prefix_length int, prefix_digest string, failure_seen boolean, termination string, official_split string, "
    "grounding_protocol string, annotation_status string, first_action string, verdict string, grounded_correct boolean, unsupported_decision boolean, "
    "request_cost int, tool_cost int"
)
NEED = "Need more evidence"


def all_pairs(rows):
    out = Counter()
    def score(r):
        return (r["grounded_correct"], not r["unsupported_decision"], -r["request_cost"], -r["tool_cost"])
    for a in rows:
        for b in rows:
            same = all(a[k] == b[k] and a[k] is not None for k in ("origin", "world", "prefix_length", "prefix_digest", "failure_seen"))
            blind = a["verdict"] == b["verdict"] == NEED and b["grounded_correct"] and not a["failure_seen"]
            if same and a["grounded_correct"] and score(a) > score(b) and a["first_action"] != b["first_action"] and not blind:
                out[a["origin"], a["first_action"], b["first_action"]] += 1
    return out


def branch(rng, **fixed):
    return {
        "origin": rng.choice("opq"), "world": rng.choice("wv"), "prefix_length": 2, "prefix_digest": "d", "failure_seen": rng.random() < 0.4,
        "termination": "finished", "official_split": "train", "grounding_protocol": "evidence-chain-v1", "annotation_status": "reviewed",
        "first_action": rng.choice("abcd"), "verdict": rng.choice([NEED, "Supported", "Refuted"]), "grounded_correct": rng.random() < 0.6,
        "unsupported_decision": rng.random() < 0.3, "request_cost": rng.randrange(4), "tool_cost": rng.randrange(3), **fixed,
    }


@pytest.mark.parametrize("heavy", [0, 60, 256])
def test_counts_equal_all_pairs(spark, heavy):
    rng = random.Random(9)
    rows = [branch(rng) for _ in range(300)] + [branch(rng, origin=None) for _ in range(5)] + [branch(rng, failure_seen=None) for _ in range(5)]
    out = training.preference_pairs(spark.createDataFrame(rows, DDL), "origin", heavy=heavy).collect()
    got = {(r.origin, r.chosen_action, r.rejected_action): r.pairs for r in out}
    assert len(out) == len(got) and got == dict(all_pairs(rows))


@pytest.mark.parametrize("heavy", [0, 256])
def test_unknown_verdicts_give_no_pair_that_may_be_hindsight(spark, heavy):
    rng = random.Random(1)
    better = branch(rng, origin="o", world="w", failure_seen=False, first_action="a", verdict=None, grounded_correct=True, unsupported_decision=False, request_cost=0)
    rows = [better, {**better, "first_action": "b", "verdict": NEED, "request_cost": 3}, {**better, "first_action": "c", "verdict": "Supported", "request_cost": 3}]
    out = training.preference_pairs(spark.createDataFrame(rows, DDL), "origin", heavy=heavy).collect()
    assert [(r.chosen_action, r.rejected_action, r.pairs) for r in out] == [("a", "c", 1)]


def test_hundred_thousand_kinds_at_one_origin(spark):
    # All pairs of kinds would be ten thousand millions.
    n = 100_000
    base = spark.range(n).select(
        F.lit("o").alias("origin"), F.lit("w").alias("world"), F.lit(1).alias("prefix_length"), F.lit("d").alias("prefix_digest"), F.lit(False).alias("failure_seen"),
        F.lit("finished").alias("termination"), F.lit("train").alias("official_split"), F.lit("evidence-chain-v1").alias("grounding_protocol"),
        F.lit("reviewed").alias("annotation_status"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("first_action"), F.lit("Supported").alias("verdict"),
        F.lit(True).alias("grounded_correct"), F.lit(False).alias("unsupported_decision"), F.col("id").alias("request_cost"), F.lit(0).alias("tool_cost"),
    )
    out = {(r.chosen_action, r.rejected_action): r.pairs for r in training.preference_pairs(base, "origin").collect()}
    half = n // 2
    assert out == {("x", "y"): half * (half + 1) // 2, ("y", "x"): half * (half - 1) // 2}
