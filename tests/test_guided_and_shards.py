"""The annotation-guided schedule against breadth-first search, indexed shards, and groups of decision examples."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import training, worlds
from tallyframe.operators.checks import CheckFailed
from tallyframe.session import scratch_path
from tallyframe.sources import readers, writers

OPTIONS = (["x", "y"], ["before", "after"], ["near", "far"])
DDL = (
    "i int, case_id string, request_options struct<objects:array<string>,times:array<string>,views:array<string>>, "
    "evidence array<struct<id:string,object:string,time:string,view:string,available:boolean>>, initial array<string>, targets array<array<string>>"
)


def searched(evidence, initial, targets, depth):
    calls = [(o, t, v) for o in OPTIONS[0] for t in OPTIONS[1] for v in OPTIONS[2]]
    goals = [set(t) for t in targets if t]
    queue, seen = deque([(frozenset(initial), [])]), {frozenset(initial)}
    while queue:
        held, path = queue.popleft()
        if any(g <= held for g in goals):
            return path
        if len(path) >= depth:
            continue
        for c in calls:
            left = sorted(e[0] for e in evidence if e[4] and e[1:4] == c and e[0] not in held)
            if left and held | {left[0]} not in seen:
                seen.add(held | {left[0]})
                queue.append((held | {left[0]}, path + [c]))
    return []


def test_guided_schedule_is_the_first_shortest_path(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        evidence = [(f"e{k}", rng.choice("xyz"), rng.choice(OPTIONS[1]), rng.choice(OPTIONS[2]), rng.random() < 0.85) for k in range(7)]
        ids = [e[0] for e in evidence]
        targets = [sorted(rng.sample(ids, rng.randint(0, 3))) for _ in range(rng.randint(0, 3))]
        rows.append((i, f"c{i}-x", OPTIONS, evidence, rng.sample(ids, rng.randint(0, 2)), targets))
    out = worlds.request_schedule(spark.createDataFrame(rows, DDL), "annotation_guided", 0, ["i"], F.col("targets"), budget=12, price=3, max_turns=4).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.i, r.ordinal)):
        got.setdefault(r.i, []).append((r.object, r.time, r.view))
    want = {i: searched(e, initial, t, 3) for i, _, _, e, initial, t in rows}
    assert got == {i: p for i, p in want.items() if p} and len(got) > 40


def shards(spark):
    root = scratch_path(spark, "indexed")
    df = spark.createDataFrame([(f"c{i}", i % 3) for i in range(30)], "case_id string, shard int")
    writers.write_indexed_shards(df, root, "shard", ["case_id"])
    return root


def test_indexed_shards_come_back_whole(spark):
    root = shards(spark)
    out = readers.read_indexed_shards(spark, root, "case_id string").groupBy("directory").count().collect()
    assert {(r.directory, r["count"]) for r in out} == {(f"shard={k}", 10) for k in range(3)}


@pytest.mark.parametrize("change", ["manifest", "missing", "index", "nested", "unlisted"])
def test_changed_shards_are_refused(spark, change):
    root = shards(spark)
    with open(f"{root}/shard_index.json") as f:
        index = json.load(f)
    if change == "manifest":
        with open(f"{root}/shard=1/manifest.json", "a") as f:
            f.write(" ")
    elif change == "missing":
        import os
        os.rename(f"{root}/shard=1/manifest.json", f"{root}/shard=1/other.json")
    elif change == "index":
        index["shards"].pop()
    elif change == "nested":
        index["shards"][0]["directory"] = "a/shard=0"
    else:
        index["shards"] = index["shards"][:2]
    import os
    for name, value in (("shard_index.json", index), ("manifest.json", {"aggregation": index if change in ("nested", "unlisted") else None})):
        if change in ("index", "nested", "unlisted") and not (change == "index" and name == "manifest.json"):
            os.path.exists(f"{root}/.{name}.crc") and os.remove(f"{root}/.{name}.crc")
            with open(f"{root}/{name}", "w") as f:
                json.dump(value, f)
    if change == "manifest":
        os.remove(f"{root}/shard=1/.manifest.json.crc")
    if change == "unlisted":
        # A folder that both lists leave out is not read.
        assert readers.read_indexed_shards(spark, root, "case_id string").count() == 20
        return
    with pytest.raises(CheckFailed):
        readers.read_indexed_shards(spark, root, "case_id string")


def test_without_an_index_the_root_is_read(spark):
    root = scratch_path(spark, "plain")
    spark.createDataFrame([("a",), ("b",)], "case_id string").write.json(root)
    assert readers.read_indexed_shards(spark, root, "case_id string").count() == 2


def test_decision_examples_carry_their_group(spark):
    rows = [("e", "f1", True, [("user", "q"), ("assistant", "a"), ("tool", "t"), ("assistant", "b")])]
    df = spark.createDataFrame(rows, "episode string, family_id string, label boolean, messages array<struct<role:string,text:string>>")
    out = training.decision_examples(df, "episode", "pos", ["family_id", "label"]).orderBy("pos").collect()
    assert [(r.pos, len(r.prefix), r.target.text, r.group.family_id, r.group.label) for r in out] == [(1, 1, "a", "f1", True), (3, 3, "b", "f1", True)]
    flat = df.select("episode", "family_id", F.posexplode("messages").alias("pos", "m")).select("episode", "family_id", "pos", "m.role")
    assert [(r.target_pos, r.group.family_id) for r in training.decision_turns(flat, "episode", "pos", group=["family_id"]).collect()] == [(1, "f1"), (3, "f1")]


def test_schedules_search_ids_without_array_contains_and_once_for_all_budgets(spark):
    import __spark_entry__ as entry

    for name in ("schedule_audit", "request_schedule_annotation_guided"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "array_contains" not in plan and plan.count("array_min(") == 1
