"""Sinks: resumable appends, content-addressed images, data sets with a manifest, split folders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import check_unique, enforce, ordered_digest
from ..session import write_small_file


def missing_rows(df: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet; only key columns of the store are read."""
    return df.join(stored.select(*keys), list(keys), "left_anti")


def append_missing(df: DataFrame, target: str, keys: Sequence[str], planned: DataFrame | None = None) -> DataFrame:
    """Idempotent resume: append the rows whose key is not in ``target`` yet, and return the table.

    Keys outside the plan and repeated keys are refused before anything is written.
    """
    spark = df.sparkSession
    enforce(check_unique(df, keys), "repeated keys")
    if planned is not None:
        enforce(df.select(*keys).join(planned.select(*keys), list(keys), "left_anti"), "unplanned keys")
    exists = _exists(spark, target)
    fresh = missing_rows(df, spark.read.schema(df.schema).parquet(target), keys) if exists else df
    fresh.write.mode("append").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def content_address(messages: DataFrame, image: str) -> tuple[DataFrame, DataFrame]:
    """Messages with base64 images replaced by references, and each distinct image once as (sha256, content)."""
    data = F.unbase64(image)
    marked = messages.withColumn("_sha", F.sha2(data, 256))
    rows = marked.withColumn("image_ref", F.when(F.col(image).isNotNull(), F.concat(F.lit("blobs/"), "_sha", F.lit(".png")))).drop(image, "_sha")
    blobs = marked.filter(F.col(image).isNotNull()).select(F.col("_sha").alias("sha256"), data.alias("content")).dropDuplicates(["sha256"])
    return rows, blobs


def write_content_addressed(messages: DataFrame, image: str, out: str) -> None:
    """Write message rows and the blob table below ``out``."""
    rows, blobs = content_address(messages, image)
    blobs.write.mode("errorifexists").parquet(f"{out}/blobs")
    rows.write.mode("errorifexists").parquet(f"{out}/messages")


def dataset_manifest(df: DataFrame, groups: Sequence[str], digest_columns: Sequence[str]) -> DataFrame:
    """Rows and content digest per group; the digest does not depend on row order or partitioning."""
    return ordered_digest(df, groups, digest_columns)


def write_dataset(df: DataFrame, out: str, groups: Sequence[str], digest_columns: Sequence[str]) -> DataFrame:
    """Write a new data set with its manifest, refusing an existing one; returns the manifest.

    The manifest is computed from what was written, not from the plan that wrote it.
    """
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{out}/rows")
    stored = spark.read.schema(df.schema).parquet(f"{out}/rows")
    dataset_manifest(stored, groups, digest_columns).write.mode("errorifexists").parquet(f"{out}/manifest")
    return spark.read.parquet(f"{out}/manifest")


def write_indexed_shards(df: DataFrame, root: str, shard: str, digest_columns: Sequence[str]) -> None:
    """One folder of JSON lines per shard with a manifest of its own, and an index that pins the manifests by SHA-256.

    ``readers.read_indexed_shards`` refuses whatever changed since. A manifest holds the shard's rows and content digest as
    they were written.
    """
    spark = df.sparkSession
    df.write.mode("errorifexists").partitionBy(shard).json(root)
    stored = spark.read.schema(df.schema).option("mode", "FAILFAST").json(root)
    entries = []
    for row in dataset_manifest(stored, [shard], digest_columns).orderBy(shard).collect():
        name = f"{shard}={row[shard]}"
        manifest = json.dumps({"rows": row["rows"], "digest": row["digest"]}, sort_keys=True)
        write_small_file(spark, f"{root}/{name}/manifest.json", manifest)
        entries.append({"directory": name, "manifest_sha256": hashlib.sha256(manifest.encode()).hexdigest()})
    write_small_file(spark, f"{root}/manifest.json", json.dumps({"aggregation": {"shards": entries}}))
    write_small_file(spark, f"{root}/shard_index.json", json.dumps({"shards": entries}))


def write_splits(df: DataFrame, out: str, split: str) -> DataFrame:
    """One folder of JSON lines per split; returns the counts read back from the folders."""
    df.write.mode("errorifexists").partitionBy(split).json(out)
    back = df.sparkSession.read.schema(df.schema).json(out)
    return back.groupBy(split).agg(F.count("*").alias("rows"))
