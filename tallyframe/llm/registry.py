"""Queries of this subpackage and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import table as read_table
from .shared import small_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(small_batches(spark), sf_dir, name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add
