"""Neighbouring ledgers share a key of the state: few calls and rows per batch, and nobody's outcomes change."""

import json

from test_ledger_state import Store, operations
from test_ledger_state import run as run_alone

from tallyframe.session import scratch_path
from tallyframe.streaming import streams
from tallyframe.streaming.processors import PackedLedgers
from tallyframe.streaming.state import state_table


def test_a_batch_of_a_run_takes_two_calls_and_one_row():
    rows = [r for r in operations(120) if r.op != "settle" or r.charge is not None]
    want, _ = run_alone(rows, len(rows), 64)
    store, got = Store(), []
    for start in range(0, len(rows), 40):
        processor = PackedLedgers(4000, 300)
        processor.init(store)
        packed = [("run", json.dumps({**r.asDict(), "ledger": ledger})) for ledger in (1, 2, None) for r in rows[start:start + 40]]
        out = list(processor.handleInputRows((0,), iter(packed), None))
        assert len(out) == 1
        got += zip(*out[0])
    assert store.calls == 2 * 3
    for ledger in (1, 2, None):
        assert [(1, *o[1:]) for o in got if o[0] == ledger] == want


def test_ledgers_that_a_batch_leaves_out_keep_their_accounts(spark):
    text = "k ü\"\\ \x1f"
    rows = []
    for ledger in (-17, -1, 0, 1, 2, 15, 16, 2**62, None):
        for seq in range(0, 40, 2):
            # A batch has some of the ledgers only.
            if ledger is None or (ledger + seq // 10) % 3:
                key = f"{text}{seq % 14}" if seq % 5 else None
                rows += [(ledger, seq, "reserve", key, "s" if seq % 4 else None, 2**53 + 1, None), (ledger, seq + 1, "settle", key, None, None, 2**53 - seq if seq % 38 else None)]
    calls = spark.createDataFrame(rows, "ledger bigint, seq bigint, op string, key string, stage string, bound bigint, charge bigint")

    def run(steps, together):
        out, checkpoint = scratch_path(spark, "l"), scratch_path(spark, "c")
        stream = streams.staged_steps(calls.selectExpr("*", f"CAST(floor(seq * {steps} / 40) AS INT) AS step"), "step", steps, "calls", "ledger")
        streams.stream_ledger(stream, 2**57, 2**56, out, checkpoint, together)
        return sorted((tuple(r) for r in streams.ledger_outcomes(spark, out).collect()), key=str), state_table(spark, checkpoint, "accounts").count()

    alone, keys = run(1, 1)
    assert keys == 9 and len(alone) == len(rows) and {r[3] for r in alone} >= {"reserved", "settled", "reused"}
    shared, keys = run(4, 16)
    # Division runs towards zero: -1 to 15 are one run.
    assert shared == alone and keys == 5


def test_a_large_append_is_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    log = spark.range(3000).selectExpr("id", "CAST(id % 3 AS INT) AS step")
    stream = streams.staged_steps(log, "step", 3, "log")
    steps = scratch_path(spark, "out"), scratch_path(spark, "c")
    query = stream.writeStream.option("checkpointLocation", steps[1]).trigger(availableNow=True).format("parquet").option("path", steps[0]).start()
    query.awaitTermination()
    assert spark.read.schema("id bigint").parquet(steps[0]).count() == 3000
    # Three batches, one append of ten files each.
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [1000, 1000, 1000]
