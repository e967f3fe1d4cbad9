"""State of an entry per row is written out batch by batch, within a share of the heap."""

import os

from pyspark.sql import functions as F

from tallyframe.session import scratch_path
from tallyframe.streaming import streams
from tallyframe.streaming.state import DISK_STATE, STATE_STORE, large_state


def test_ingest_leaves_no_log_of_changes(spark):
    path, out, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "o"), scratch_path(spark, "c")
    names = {*DISK_STATE, *large_state(spark)}
    before = {name: spark.conf.get(name, None) for name in names}
    # Replays and changed rows of a second run meet what the first one wrote.
    for low, high, said in [(0, 60, "x"), (30, 90, "y")]:
        rows = spark.range(low, high).select(F.col("id").alias("k"), F.lit(said).alias("v"), F.timestamp_seconds(F.col("id") + 1000).alias("at"))
        rows.coalesce(1).write.mode("append").parquet(path)
        streams.stream_ingest(streams.file_stream(spark, path, rows.schema), ["k"], "at", "1 hour", out, checkpoint)
    assert {name: spark.conf.get(name, None) for name in names} == before
    got = {route: sorted(r.k for r in streams.ingested(spark, out, rows.schema, route).collect()) for route in ("new", "conflict", "late")}
    assert got == {"new": [*range(90)], "conflict": [*range(30, 60)], "late": []}
    kinds = {os.path.splitext(name)[1] for operator in "01" for name in os.listdir(f"{checkpoint}/state/{operator}/0") if not name.startswith((".", "_"))}
    assert ".zip" in kinds and ".changelog" not in kinds


def test_memory_of_state_follows_the_heap(spark):
    # The tests' session has a heap of 4 GB.
    assert large_state(spark)[STATE_STORE + "rocksdb.maxMemoryUsageMB"] == "512"
