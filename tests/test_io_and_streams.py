"""Readers, writers and streams; a stream gives the same tables however it is cut into batches."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.checks import CheckFailed
from tallyframe.session import scratch_path
from tallyframe.sources import readers, writers
from tallyframe.streaming import streams

DDL = "case_id string, family_id string"


def test_cases_from_array_and_wrapper(spark, tmp_path):
    cases = [{"case_id": "a", "family_id": "f"}, {"case_id": "b", "family_id": "f"}]
    (tmp_path / "array.json").write_text(json.dumps(cases, indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"cases": cases}))
    for name in ("array", "wrapped"):
        assert {r.case_id for r in readers.read_cases(spark, str(tmp_path / f"{name}.json"), DDL).collect()} == {"a", "b"}
    (tmp_path / "twice.json").write_text(json.dumps(cases + cases[:1]))
    with pytest.raises(CheckFailed):
        readers.read_cases(spark, str(tmp_path / "twice.json"), DDL)
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(CheckFailed):
        readers.read_cases(spark, str(tmp_path / "none.json"), DDL)


def test_results_skip_blank_lines_and_fail_on_broken_ones(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"case_id": "a"}\n\n{"case_id": "b"}\n')
    assert readers.read_results(spark, str(tmp_path / "ok.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"case_id": "a"}\n{"case_id": \n')
    with pytest.raises(Exception):
        readers.read_results(spark, str(tmp_path / "bad.jsonl")).collect()


def test_append_is_idempotent_and_refuses_unplanned(spark):
    path = scratch_path(spark, "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.append_missing(df, path, ["k"], df)
    assert writers.append_missing(df.withColumn("v", F.lit("new")), path, ["k"], df).orderBy("k").collect()[0].v == "a"
    with pytest.raises(CheckFailed):
        writers.append_missing(spark.createDataFrame([(3, "c")], "k int, v string"), path, ["k"], df)


def test_dataset_refuses_existing_output(spark):
    out = scratch_path(spark, "d")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = writers.write_dataset(df, out, ["v"], ["k"]).count()
    assert first == 2
    with pytest.raises(Exception, match="exist"):
        writers.write_dataset(df, out, ["v"], ["k"])


def test_images_are_stored_once(spark):
    rows = spark.createDataFrame([(1, "QUJD"), (2, "QUJD"), (3, None)], "pos int, image_png string")
    messages, blobs = writers.content_address(rows, "image_png")
    assert blobs.count() == 1 and bytes(blobs.first().content) == b"ABC"
    assert [r.image_ref is None for r in messages.orderBy("pos").collect()] == [False, False, True]


def sessions(spark, steps):
    rows = [(f"u{i % 4}", i, "finish" if i in (21, 40) else "request" if i % 3 else "look") for i in range(80)]
    log = spark.createDataFrame(rows, "actor string, seq bigint, action string")
    state = scratch_path(spark, "s")
    streams.stream_sessions(streams.staged_stream(log, "seq", steps, "log", "actor"), ["actor"], "seq", "action", state, scratch_path(spark, "c"))
    return {r.actor: tuple(r)[1:] for r in streams.session_state(spark, ["actor"], "actor string", state).collect()}


def test_sessions_do_not_depend_on_batches(spark):
    one, four = sessions(spark, 1), sessions(spark, 4)
    assert one == four
    assert one["u1"] == (6, 4, 14, 21) and one["u0"][3] == 40 and one["u2"][3] is None


def ledger(spark, steps):
    ops = [("a", "reserve", 800, None), ("a", "settle", None, 700), ("b", "reserve", 310, None), ("b", "settle", None, 300), ("a", "reserve", 5, None), ("c", "reserve", 100, None),
           ("d", "reserve", 10, None), ("c", "settle", None, 500), ("d", "reserve", 10, None)]
    rows = [(1, i, op, key, "paper", bound, charge) for i, (key, op, bound, charge) in enumerate(ops)]
    calls = spark.createDataFrame(rows, "ledger bigint, seq bigint, op string, key string, stage string, bound bigint, charge bigint")
    out = scratch_path(spark, "l")
    streams.stream_ledger(streams.staged_stream(calls, "seq", steps, "calls", "ledger"), 1000, 1000, out, scratch_path(spark, "c"))
    return [(r.key, r.outcome, r.accounted) for r in streams.ledger_outcomes(spark, out).orderBy("seq").collect()]


def test_ledger_blocks_and_caps(spark):
    want = [("a", "reserved", 800), ("a", "settled", 700), ("b", "over_cap", 700), ("b", "no_reservation", 700), ("a", "reused", 700), ("c", "reserved", 800), ("d", "blocked", 800),
            ("c", "unresolved", 800), ("d", "blocked", 800)]
    assert ledger(spark, 1) == want
    assert ledger(spark, 3) == want


def test_ledger_keeps_responses_and_seals(spark):
    ops = [("a", "reserve", 500, None), ("a", "respond", None, None), ("b", "reserve", 10, None), ("b", "respond", None, None), ("a", "settle", None, 400),
           ("", "seal", None, None), ("a", "reserve", 5, None), ("c", "reserve", 5, None)]
    rows = [(1, i, op, key, "paper", bound, charge) for i, (key, op, bound, charge) in enumerate(ops)]
    calls = spark.createDataFrame(rows, "ledger bigint, seq bigint, op string, key string, stage string, bound bigint, charge bigint")
    for steps in (1, 4):
        out = scratch_path(spark, "l")
        streams.stream_ledger(streams.staged_stream(calls, "seq", steps, "calls", "ledger"), 1000, 1000, out, scratch_path(spark, "c"))
        got = [r.outcome for r in streams.ledger_outcomes(spark, out).orderBy("seq").collect()]
        assert got == ["reserved", "responded", "blocked", "no_reservation", "settled", "sealed", "reused", "ledger_sealed"]


def test_merged_shards_are_computed_once(spark):
    rows = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    shards = [rows.filter(F.col("k") % 2 == i) for i in range(2)]
    out = readers.merge_shards(shards, ["k"], rows.select("k"), ["k"])
    assert [tuple(r) for r in out.collect()] == [(k, 2 * k) for k in range(20)]
    assert out.inputFiles() and all("/merged-" in f for f in out.inputFiles())
    for wrong, message in [([*shards, rows.limit(1)], "overlapping"), (shards[:1], "incomplete")]:
        with pytest.raises(CheckFailed, match=message):
            readers.merge_shards(wrong, ["k"], rows.select("k"), ["k"])
