"""Models sent to tasks once per executor."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import SparkSession


# Texts are long: a batch of Spark's usual 10,000 rows would take tens of megabytes in every worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Let Arrow batches of this session have at most ``BATCH_ROWS`` rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return spark


def share(spark: SparkSession, value) -> Callable:
    """A function that gives ``value`` inside tasks. It travels with its classes, so executors need no copy of this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get():
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return get
