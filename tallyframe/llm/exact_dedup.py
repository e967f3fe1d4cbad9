"""Exact dedup as a stateful stream, with Spark expressions only.

The documents stream through one aggregation keyed by the digest of their text. Its state lives in the RocksDB state store,
on disk, has no watermark and so never expires: per digest the stable identifier of the row that stays (the largest id, then
the largest locator), the locator of that row's content (file and row in the file) and the number of rows. The state is read
back as a table by Spark's own state reader, and rows whose digest was seen before are checked against the whole bytes of the
row that stays; digests with different texts are split by the texts themselves.

A null text is empty. Rows that repeat an id and a text are rows of their own, of which one stays. A null id is smaller than
any other; where all ids of a group are null, ``keep_id`` is null and one row stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from ..sources.writers import _exists
from ..streaming.state import disk_state
from .keys import BROADCAST_ROWS, HOT_GROUPS, join_groups

# Copies of one text that are checked against the same copy of the kept text: a group of any size is spread in such shares.
SHARE = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``id``, ``text``, ``spot`` (locator: file and row in it) and ``digest`` of rows read from files, batch or stream."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spot = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select(F.col(id_col).alias("id"), text.alias("text"), spot.alias("spot"), digest(text).alias("digest"))


def absorb(
    spark: SparkSession, path: str, schema, checkpoint: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None,
) -> DataFrame:
    """Stream all files of ``path`` that ``checkpoint`` has not seen yet through the keyed state and return the state:
    ``digest``, ``keep_id``, ``keep_spot``, ``size``. Called again after new files came, it reads only those."""
    # A pattern also names a table that is a single file, which a streaming source takes only that way.
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = located(reader.parquet(f"{path[:-1]}[{path[-1]}]"), id_col, text_col, digest)
    seen = F.struct("id", "spot")
    held = rows.groupBy("digest").agg(F.max(seen).alias("held"), F.count("*").alias("size"))
    with disk_state(spark):
        stream = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
        if not _exists(spark, f"{checkpoint}/state"):
            return spark.createDataFrame([], held.schema).select("digest", F.col("held.id").alias("keep_id"), F.col("held.spot").alias("keep_spot"), "size")
        state = spark.read.format("statestore").load(checkpoint)
        return materialize(state.selectExpr("key.digest", "value.max.id AS keep_id", "value.max.spot AS keep_spot", "value.count AS size"), "digests")


def differing(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Digests of which some row has other bytes than the row that stays. Texts that occur once stay where they are."""
    large = F.col("size") * HOT_GROUPS > total
    if groups.count() <= BROADCAST_ROWS:
        hits = rows.join(F.broadcast(groups), "digest")
    else:
        # At most ten thousand groups are that large; all others are small enough to meet by a shuffle.
        hits = rows.join(F.broadcast(groups.where(large)), "digest").unionByName(rows.join(groups.where(~large), "digest"))
    shares = F.ceil(F.col("size") / SHARE).cast("int")
    stays = F.col("spot") == F.col("keep_spot")
    held = hits.where(stays).select("digest", F.col("text").alias("held"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    others = hits.where(~stays).select("digest", "text", F.pmod(F.xxhash64("spot"), shares.cast("long")).cast("int").alias("share"))
    return others.join(held, ["digest", "share"]).where("text <> held").select("digest").distinct()


def exact_duplicates(
    spark: SparkSession, path: str, schema, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """One row per row of the Parquet table at ``path``: its id (named ``id_col``), ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and ``spot``, the locator of its content. ``checkpoint`` keeps the state for a later call."""
    state = absorb(spark, path, schema, checkpoint or scratch_path(spark, "exact"), id_col, text_col, digest, files_per_batch)
    rows = located(spark.read.schema(schema).parquet(path), id_col, text_col, digest)
    total = state.agg(F.sum("size")).first()[0] or 0
    groups = state.where("size > 1")
    torn = materialize(differing(rows, groups, total), "torn")
    if not torn.isEmpty():
        # Different texts behind one digest: the text is appended to it.
        rows = rows.join(torn.withColumn("_torn", F.lit(True)), "digest", "left")
        rows = rows.withColumn("digest", F.when(F.col("_torn"), F.concat("digest", F.col("text").cast("binary"))).otherwise(F.col("digest")))
        held = rows.where("_torn").groupBy("digest").agg(F.max(F.struct("id", "spot")).alias("held"), F.count("*").alias("size"))
        held = held.select("digest", F.col("held.id").alias("keep_id"), F.col("held.spot").alias("keep_spot"), "size")
        groups = groups.join(torn, "digest", "left_anti").unionByName(materialize(held, "split").where("size > 1"))
    named = rows.select("id", "spot", "digest", F.sha2("text", 256).alias("text_sha256"))
    out = join_groups(named, groups, "digest", F.col("spot"), total)
    single = F.col("size").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("spot") == F.col("keep_spot"))).alias("kept"), "text_sha256", "spot",
    )
