"""Equal quotas and source-disjoint people; what cannot be dealt is refused."""

import random
from collections import Counter

import pytest

from tallyframe.operators.assignment import Infeasible, assign_disjoint
from tallyframe.operators.checks import check_assignment

ARMS = ["text", "full", "agent"]
SCHEMA = "family string, task string, sources array<string>, person_note string"


def assigned(spark, rows, **options):
    families = spark.createDataFrame([(*r, "n") for r in rows], SCHEMA)
    return assign_disjoint(families, "task", "sources", "family", ARMS, 2, **options)


def check(slots, rows, people):
    slots = [r.asDict() for r in slots.collect()]
    assert Counter((s["family"], s["arm"], s["repeat"]) for s in slots) == Counter((f, a, k) for f, _, _ in rows for a in ARMS for k in (0, 1))
    quotas = Counter((s["task"], s["arm"], s["person"]) for s in slots)
    tasks = Counter(t for _, t, _ in rows)
    assert quotas == {(t, a, p): n * 2 // people for t, n in tasks.items() for a in ARMS for p in range(people)}
    met = Counter((s["person"], g) for s in slots for g in {"=" + s["family"], *(g for g in s["sources"] or [] if g is not None)})
    assert max(met.values()) == 1


def test_crossing_groups_are_kept_apart(spark):
    rng = random.Random(1)
    rows = []
    for i in range(72):
        groups = [f"a{i // 3}", f"b{i % 24}"]
        if i % 5 == 0:
            groups.append("")
        rows.append((f"f{i}", "t1" if i % 3 else "t2", None if i == 7 else [g for g in groups if g]))
    rng.shuffle(rows)
    slots = assigned(spark, rows, people=48, seed=3).cache()
    check(slots, rows, 48)
    assert slots.columns == ["family", "task", "sources", "person_note", "arm", "repeat", "person"]
    flat = slots.selectExpr("family", "task", "family AS source", "arm", "repeat", "person")
    assert check_assignment(flat, "task", "family", "source", 2, 48).count() == 0


def test_a_group_that_needs_everybody(spark):
    rows = [(f"f{i}", "t", [f"g{i % 3}", None]) for i in range(12)]
    check(assigned(spark, rows, people=24, seed=1), rows, 24)


def test_infeasible_input_is_refused(spark):
    with pytest.raises(Infeasible, match="evenly"):
        assigned(spark, [(f"f{i}", "t", ["g"]) for i in range(7)], people=12, seed=1)
    with pytest.raises(Infeasible, match="has 30 slots"):
        assigned(spark, [(f"f{i}", "t", ["g"]) for i in range(5)], people=10, seed=1)
    with pytest.raises(Infeasible, match="has 12 slots"):
        # Any two of the families share a source, so a person could take one of their slots, not the three that are due.
        assigned(spark, [(f"f{i}", "t", [f"pair {min(i, j)} {max(i, j)}" for j in range(3) if j != i]) for i in range(3)], people=6, seed=1)


def test_many_conflicts_are_joined_by_shuffles(spark, monkeypatch):
    """Rows with arrays look small as files: where they are many, no round passes them through the driver."""
    from tallyframe.operators import assignment

    plans = {}

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    keep = assignment.materialize
    monkeypatch.setattr(assignment, "materialize", seen)
    monkeypatch.setattr(assignment, "MANY", 1)
    rows = [(f"f{i}", "t", [f"a{i // 3}", f"b{i % 12}"]) for i in range(36)]
    check(assigned(spark, rows, people=36, seed=2), rows, 36)
    assert len(plans["done"]) >= 1
    # Behind the deal itself, the numbers of slots by class alone are broadcast.
    assert all("BroadcastHashJoin" not in plan for name in ("met", "movers", "chosen", "done") for plan in plans[name])
    assert all("BroadcastHashJoin" not in plan for plan in plans["slots"][1:])
    assert all(plan.count("BroadcastHashJoin") <= 1 for plan in plans["swaps"])
