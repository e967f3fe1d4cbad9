"""Queries of sources and sinks: tables are written and read back through the library's formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from ..skew import spread
from ..sources import readers, writers
from . import standins
from .queries_traces import word_sums_sql
from .registry import query, table
from .standins import CASES_SQL, EPISODES_SQL

CASES_DDL = "case_id string, family_id string, task string, initial array<string>, evidence array<struct<id:string,available:boolean>>"


@query("read_cases", f"""WITH {CASES_SQL} SELECT family_id || '-x' AS case_id, family_id, task, 'ref,b-preview' || CASE WHEN c_initial THEN ',c' ELSE '' END AS initial,
  (2 + b_ok::INTEGER + c_ok::INTEGER + d_ok::INTEGER)::INTEGER AS available FROM cases""")
def _(spark, sf):
    path = scratch_path(spark, "cases")
    rows = standins.cases(spark, sf).select(F.expr("family_id || '-x'").alias("case_id"), "family_id", "task", "initial", "evidence")
    rows.write.json(path)
    out = readers.read_cases(spark, path, CASES_DDL, lines=True)
    available = F.size(F.filter("evidence", lambda e: e["available"]))
    return out.select("case_id", "family_id", "task", F.array_join("initial", ",").alias("initial"), available.alias("available"))


RESULT_COLUMNS = "concat(family_id, '-', arm) AS case_id", "family_id", "task", "model", "arm", "verdict", "source_label", "termination", "requests", "tool_calls", "errors", "input_tokens", "output_tokens", "latency_s"


@query("read_results", f"""WITH {EPISODES_SQL} SELECT model, arm, task, count(*) AS n, count(verdict) AS answered, sum(requests)::BIGINT AS requests, round(sum(latency_s)::DOUBLE, 3) AS seconds FROM episodes GROUP BY 1, 2, 3""")
def _(spark, sf):
    path = scratch_path(spark, "results")
    standins.episodes(spark, sf).selectExpr(*RESULT_COLUMNS).write.json(path)
    return readers.read_results(spark, path).groupBy("model", "arm", "task").agg(
        F.count("*").alias("n"), F.count("verdict").alias("answered"), F.sum("requests").alias("requests"), F.round(F.sum("latency_s"), 3).alias("seconds")
    )


@query("read_episodes", f"""WITH {EPISODES_SQL} SELECT family_id AS case_id, model, arm, verdict, requests, d AS turns FROM episodes""")
def _(spark, sf):
    path = scratch_path(spark, "episodes")
    standins.episodes(spark, sf).select(
        F.col("family_id").alias("case_id"), F.concat_ws("/", "model", "arm").alias("arm"), F.to_json(F.struct("verdict", "requests")).alias("result"),
        F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.col("d") + 1), lambda i: F.struct(i.alias("turn"))).alias("messages"))).alias("trace"),
    ).write.parquet(path)
    out = readers.read_episodes(spark, path, "struct<verdict:string,requests:bigint>", "struct<messages:array<struct<turn:bigint>>>")
    return out.select(
        "case_id", F.split("arm", "/")[0].alias("model"), F.split("arm", "/")[1].alias("arm"), "result.verdict", "result.requests",
        (F.size("trace.messages") - 1).cast("bigint").alias("turns"),
    )


@query("read_shards", f"""WITH {EPISODES_SQL} SELECT (pk % 4)::INTEGER AS shard, count(*) AS n, count(DISTINCT family_id) AS families FROM episodes GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "shards")
    rows = standins.episodes(spark, sf)
    for shard in range(4):
        rows.filter(F.col("pk") % 4 == shard).selectExpr(*RESULT_COLUMNS).write.json(f"{path}/shard-{shard}")
    return readers.read_shards(spark, path).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("family_id").alias("families"))


@query("read_indexed_shards", f"""WITH {EPISODES_SQL} SELECT 'shard=' || (pk % 4) AS directory, count(*) AS n, count(DISTINCT family_id) AS families, sum(requests)::BIGINT AS requests FROM episodes GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "indexed")
    rows = standins.episodes(spark, sf).selectExpr(*RESULT_COLUMNS, "pk % 4 AS shard")
    writers.write_indexed_shards(rows, path, "shard", ["case_id", "verdict", "requests"])
    return readers.read_indexed_shards(spark, path).groupBy("directory").agg(
        F.count("*").alias("n"), F.count_distinct("family_id").alias("families"), F.sum("requests").alias("requests")
    )


@query("read_source_csv", "SELECT p_brand AS object, CASE WHEN p_size > 25 THEN 'anomaly' ELSE 'normal' END AS label, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "part").selectExpr(
        "p_brand AS object", "'train' AS split", "CASE WHEN p_size > 25 THEN 'anomaly' ELSE 'normal' END AS label", "concat('img/', p_partkey, ',x.png') AS image", "'' AS mask"
    ).write.option("header", True).csv(path)
    return readers.read_source_csv(spark, path).groupBy("object", "label").agg(F.count("*").alias("n"))


@query("read_frames", "SELECT 's' || user_id AS sequence_name, count(*) AS frames, max(event_id) AS last_frame, count(DISTINCT event_type) AS masks FROM events GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "frames")
    table(spark, sf, "events").selectExpr(
        "concat('s', user_id) AS sequence_name", "event_id AS frame_number", "named_struct('path', concat('i/', event_id), 'size', array(10L, 10L)) AS image", "named_struct('path', event_type) AS mask",
        "named_struct('R', array(array(1D, 0D, 0D)), 'T', array(0D)) AS viewpoint",
    ).write.option("compression", "gzip").json(path)
    return readers.read_frames(spark, path, lines=True).groupBy("sequence_name").agg(
        F.count("*").alias("frames"), F.max("frame_number").alias("last_frame"), F.count_distinct("mask.path").alias("masks")
    )


@query("hash_assets")
def _(spark, sf):
    return readers.hash_assets(spark, sf, sf, "*.parquet")


@query("hash_assets_written", "SELECT strlen(s_name) + 1 AS bytes, sha256(s_name || chr(10)) AS sha256 FROM supplier")
def _(spark, sf):
    path = scratch_path(spark, "assets")
    # Files come from many tasks, which commit their own, and lie in folders, which Spark lists side by side.
    names = spread(table(spark, sf, "supplier"), "s_suppkey").select("s_name", F.pmod("s_suppkey", F.lit(64)).alias("folder"))
    names.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("folder").text(path)
    return readers.hash_assets(spark, path, path, "*.txt").select("bytes", "sha256")


@query("append_missing", "SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS first FROM orders")
def _(spark, sf):
    path = scratch_path(spark, "append")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("first"))
    writers.append_missing(orders.filter("first"), path, ["o_orderkey"], orders)
    return writers.append_missing(orders, path, ["o_orderkey"], orders)


@query("write_content_addressed", "SELECT conv_id, turn, 'blobs/' || sha256(role) || '.png' AS image_ref FROM conversations")
def _(spark, sf):
    out = scratch_path(spark, "traces")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.base64(F.col("role").cast("binary")).alias("image_png"))
    writers.write_content_addressed(rows, "image_png", out)
    blobs = spark.read.parquet(f"{out}/blobs").select(F.concat(F.lit("blobs/"), "sha256", F.lit(".png")).alias("image_ref"))
    return spark.read.parquet(f"{out}/messages").join(blobs, "image_ref", "left_semi").select("conv_id", "turn", "image_ref")


@query("write_dataset", f"""SELECT o_orderstatus, count(*) AS rows, {word_sums_sql('h')} AS digest FROM (SELECT o_orderstatus, sha256('=' || o_orderkey || chr(31) || '=' || o_custkey) AS h FROM orders) GROUP BY 1""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_custkey")
    return writers.write_dataset(orders, scratch_path(spark, "dataset"), ["o_orderstatus"], ["o_orderkey", "o_custkey"])


@query("write_splits", "SELECT lang, count(*) AS rows FROM documents GROUP BY 1")
def _(spark, sf):
    return writers.write_splits(table(spark, sf, "documents").select("doc_id", "lang", "text"), scratch_path(spark, "splits"), "lang")


@query("merge_shards", f"WITH {EPISODES_SQL} SELECT family_id, model, arm, verdict FROM episodes")
def _(spark, sf):
    # Shards and grid are stored tables.
    eps = materialize(standins.episodes(spark, sf).select("family_id", "model", "arm", "verdict", "pk"), "episodes")
    shards = [eps.filter(F.col("pk") % 3 == i).drop("pk") for i in range(3)]
    keys = ["model", "family_id", "arm"]
    return readers.merge_shards(shards, keys, eps.select(*keys), ["model", "family_id", "arm"])
