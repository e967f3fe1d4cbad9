"""Spark's own state for streams: the disk-backed store, event time with late rows set aside, and reading state as a table."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATE_STORE = "spark.sql.streaming.stateStore."
DISK_STATE = {
    STATE_STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    STATE_STORE + "rocksdb.changelogCheckpointing.enabled": "true",
    STATE_STORE + "rocksdb.boundedMemoryUsage": "true",
    STATE_STORE + "rocksdb.maxMemoryUsageMB": "256",
    # Otherwise every state partition reserves 4 MB of disk for a log.
    STATE_STORE + "rocksdb.allowFAllocate": "false",
    # Otherwise every write reads its key first, only to count rows; the state reader counts them where a number is wanted.
    STATE_STORE + "rocksdb.trackTotalNumberOfRows": "false",
}


def large_state(spark: SparkSession) -> dict[str, str]:
    """Settings for state of an entry per row, many times the memory: an eighth of the heap beside it, and batches that leave nothing in
    memory. With a log of changes, what the stores of all partitions have not written yet fills the bound, and each write that
    follows makes a small file."""
    name = "spark.driver.memory" if spark.sparkContext.master.startswith("local[") else "spark.executor.memory"
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.sparkContext.getConf().get(name, "1g").strip().lower()).groups()
    heap = int(number) * {"k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}.get(unit, 1) // 2**20
    return {STATE_STORE + "rocksdb.changelogCheckpointing.enabled": "false", STATE_STORE + "rocksdb.maxMemoryUsageMB": str(max(256, heap // 8))}


@contextmanager
def disk_state(spark: SparkSession, settings: dict[str, str] | None = None):
    """Streams started inside keep their state in RocksDB, with bounded memory per executor; ``settings`` differ from ``DISK_STATE``."""
    settings = {**DISK_STATE, **(settings or {})}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_stream(
    stream: DataFrame, checkpoint: str, each=None, table: str | None = None, mode: str = "append", settings: dict[str, str] | None = None,
) -> None:
    """Process everything available with state on disk, through ``each`` or into a Parquet table, and stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with disk_state(stream.sparkSession, settings):
        query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", table).start()
        query.awaitTermination()


def state_table(spark: SparkSession, checkpoint: str, variable: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """The state of a stopped stream: its key columns and its values, which ``names`` renames by position, since an aggregation calls
    the parts of several counts alike."""
    reader = spark.read.format("statestore")
    rows = (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)
    if names:
        kinds = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, rows.schema["value"].dataType.fields, strict=True)]
        rows = rows.withColumn("value", F.col("value").cast(f"struct<{', '.join(kinds).replace('` ', '`:')}>"))
    return rows.select("key.*", "value.*")


def late_bound(spark: SparkSession, checkpoint: str, batch: int) -> int:
    """Milliseconds of event time up to which Spark's stateful operators dropped rows of micro-batch ``batch``: the watermark of the
    batch before, as Spark logged it when it planned that batch. A batch that runs again finds the same bound."""
    if batch == 0:
        return 0
    lines = spark.read.text(f"{checkpoint}/offsets/{batch - 1}").collect()
    return json.loads(lines[1].value)["batchWatermarkMs"]


def with_late(result: DataFrame, rows: DataFrame) -> DataFrame:
    """One stream of both: what comes out of the stateful operators as ``out``, and the rows that went in as ``row``.

    Stateful operators drop late rows without a trace. The same micro-batch carries the input a second time, past them, so
    that ``route_batch`` can set the dropped ones aside.
    """
    def side(df: DataFrame, name: str, other: str, kind: StructType) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(name), F.lit(None).cast(kind).alias(other))

    return side(result, "out", "row", rows.schema).unionByName(side(rows, "row", "out", result.schema))


def late_rows(batch: DataFrame, time: str, bound: int) -> Column:
    """Rows of a batch from ``with_late`` that the watermark has passed, and rows without an event time."""
    at = F.col(f"row.{time}")
    return F.col("row").isNotNull() & (at.isNull() | (at <= F.timestamp_millis(F.lit(bound).cast("long"))))


def write_routes(rows: DataFrame, out: str, batch: int) -> None:
    """Write a batch once, split by its column ``route``. A batch that runs twice leaves the same files."""
    rows.write.mode("overwrite").partitionBy("route").parquet(f"{out}/batch={batch}")


def route_batches(out: str, time: str, checkpoint: str, routes: Column):
    """Batch function for a stream from ``with_late``: results go to the route named by ``routes`` (an expression over ``out``), late
    rows to ``late``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        late = late_rows(batch, time, late_bound(batch.sparkSession, checkpoint, batch_id))
        routed = batch.withColumn("route", F.when(late, "late").when(F.col("out").isNotNull(), routes))
        write_routes(routed.where("route IS NOT NULL"), out, batch_id)

    return each


def routed(spark: SparkSession, out: str, route: str, schema: StructType | str) -> DataFrame:
    """Rows of one route: late rows for ``late``, else results, with the number of their ``batch``."""
    side = "row" if route == "late" else "out"
    kind = schema.simpleString() if isinstance(schema, StructType) else StructType.fromDDL(schema).simpleString()
    rows = spark.read.schema(f"{side} {kind}, batch bigint, route string").option("basePath", out).parquet(out)
    return rows.where(F.col("route") == route).select(f"{side}.*", "batch")
