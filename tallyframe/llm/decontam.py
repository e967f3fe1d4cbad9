"""Benchmark decontamination: containment search of short items in long documents, in Spark SQL expressions alone.

Items are partitioned by size. An item counts as leaked if four fifths of its shingles lie in a document, so at most a
fifth of them may be missing: the smallest hashes of an item, one more than a fifth of its partition's largest size,
cannot all be missing. Documents look up these MinHash values only; what they find is verified on the shingles themselves.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize
from .keys import document_key, lookup

WIDTH = 5
SPACES = " \t\n\x0b\f\r"


def word_array(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; empty for null and blank texts."""
    plain = F.btrim(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(SPACES))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[ \t\n\x0B\f\r]+"))


def shingle_rows(df: DataFrame, key: Column, text: str) -> DataFrame:
    """One row per shingle position: ``key``, ``hash``, ``gram``; fewer than five words are one shingle."""
    rows = df.select(key.alias("key"), word_array(F.col(text)).alias("words")).where(F.size("words") > 0)
    spots = F.sequence(F.lit(0), F.greatest(F.size("words") - WIDTH, F.lit(0)))
    rows = rows.select("key", "words", F.explode(spots).alias("spot"))
    # Beyond the end of a short text get() is null, which the hash and the concatenation skip.
    parts = [F.get("words", F.col("spot") + k) for k in range(WIDTH)]
    return rows.select("key", F.xxhash64(*parts).alias("hash"), F.concat_ws(" ", *parts).alias("gram"))


def find_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """Leaked items: one row per document and item with at least 0.8 of the item's distinct shingles in the document.

    Returns ``id_col``, ``item_id``, ``n_shared``, ``n_item`` (distinct shingles) and ``estimate`` (share of the item's
    MinHash values found, which made it a candidate). Null, empty and blank texts contain nothing and are contained in
    nothing; an item of fewer than five words is one shingle and is found only in a document that consists of it. Rows that
    repeat id and text are one document or item; rows with a null id take part, with a null id in the result. Other
    columns are ignored; empty tables give an empty result.
    """
    grams = shingle_rows(items, document_key(item_id, item_text), item_text).withColumnRenamed("key", "item").distinct()
    by_hash = W.partitionBy("item").orderBy("hash", "gram")
    grams = grams.withColumn("n_item", F.count("*").over(W.partitionBy("item"))).withColumn("place", F.row_number().over(by_hash))
    # The partition of sizes 2^c … 2^(c+1)-1 keeps one value more than a fifth of its largest size.
    largest = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    grams = materialize(grams.withColumn("n_sketch", F.least(F.floor(largest / 5) + 1, F.col("n_item"))), "items")
    sketch = grams.where("place <= n_sketch").select("item", "hash", "n_item", "n_sketch")
    found = lookup(shingle_rows(docs, document_key(id_col, text), text).select("key", "hash"), sketch, sketch.count(), "hash")
    candidates = found.groupBy("key", "item", "n_item", "n_sketch").agg(F.count_distinct("hash").alias("hits"))
    candidates = materialize(
        candidates.select("key", "item", "n_item", F.least(F.col("hits") / F.col("n_sketch"), F.lit(1.0)).alias("estimate")), "candidates"
    )
    few = docs.withColumn("_key", document_key(id_col, text)).join(candidates.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi")
    whole = grams.select("item", "hash", F.col("gram").alias("item_gram"))
    exact = lookup(shingle_rows(few, F.col("_key"), text), whole, whole.count(), "hash").where("gram = item_gram")
    shared = exact.groupBy("key", "item").agg(F.count_distinct("gram").alias("n_shared"))
    hits = candidates.join(shared, ["key", "item"]).where("5 * n_shared >= 4 * n_item")
    return hits.select(F.col("key.id").alias(id_col), F.col("item.id").alias(item_id), "n_shared", "n_item", "estimate")
