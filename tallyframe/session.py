"""Session, scratch folder and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyframe", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """A session with the settings the operators expect; the cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A hot key is split even where that costs one more shuffle.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Small shuffles of CPU-heavy rows keep their parallelism.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Paths handed out in this process, for ``drop_staged``.
STAGED: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created."""
    STAGED.append(os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}"))
    return STAGED[-1]


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables staged so far. Results that were not written elsewhere cannot be read afterwards."""
    jvm = spark._jvm
    for name in STAGED:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    STAGED.clear()


def write_small_file(spark: SparkSession, path: str, text: str) -> None:
    """One new file of metadata; an existing one is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Lineage is cut in reliable storage, so a lost executor re-reads files instead of recomputing, and later
    passes over the table prune columns. Positions assigned before the write cannot change afterwards.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
