"""The corpus pipeline: language identification, line dedup, near-dedup, decontamination, packing.

Every stage reads what its predecessor kept, as Parquet, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.decontam import find_leaks
from tallyframe.llm.keys import document_key, lookup
from tallyframe.llm.langid import UNDETERMINED, fit_language_model, language_column
from tallyframe.llm.line_dedup import with_kept_lines
from tallyframe.llm.minhash import near_duplicates
from tallyframe.llm.packing import pack_documents
from tallyframe.llm.queries import TOKENIZER
from tallyframe.llm.shared import small_batches
from tallyframe.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Documents are near copies from this similarity of their shingle sets on; the 85 percent of op1 are that query's own.
NEAR_PERCENT = 80
# One stage has no SQL form (a fitted language model, a tokenizer), so the whole run has none; tests/llm has brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and those without a letter go. A missing language label gets the predicted one. Where
    no document has a label, none is predicted, and all texts with a letter stay."""
    small_batches(spark)
    model = fit_language_model(docs)
    if not model.languages:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    found = docs.select(*COLUMNS).withColumn("_lang", language_column(docs, F.col("text"), model)["lang_pred"])
    kept = found.where(F.col("_lang") != UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "_lang")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs of 20 characters or more, short lines or long; a document goes if
    no line of it is left. ``n_chars`` follows."""
    out = with_kept_lines(docs.select(*COLUMNS), short_runs=True).where("n_removed < n_lines")
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id, and one of rows that repeat id and text.

    A null id is replaced by a negative number from the text's hash while the groups are formed, so such documents take part;
    they come before others of their group. Rows that share an id are one document in this stage.
    """
    small_batches(spark)
    named = F.when(F.col("doc_id").isNull(), -1 - F.shiftrightunsigned(F.xxhash64("text"), 2)).otherwise(F.col("doc_id"))
    keyed = docs.select(*COLUMNS).withColumn("_id", named).withColumn("_key", document_key("_id", "text"))
    again = materialize(keyed.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"), "repeated")
    if (n_again := again.count()):
        once = lookup(keyed, again, n_again, "_key", "left_semi").dropDuplicates(["_key"])
        keyed = materialize(lookup(keyed, again, n_again, "_key", "left_anti").unionByName(once), "once")
    keyed = keyed.drop("_key")
    gone = materialize(near_duplicates(keyed, id_col="_id", percent=NEAR_PERCENT).where("NOT kept").select("_id").distinct(), "gone")
    return lookup(keyed, gone, gone.count(), "_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found. A document is its id and its text: one with a null id goes for its own hits
    only, and so does one that shares its id with others."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select(*COLUMNS).withColumn("_key", document_key("doc_id", "text"))
    gone = materialize(find_leaks(keyed, items, id_col="_key").select("_key").distinct(), "gone")
    return lookup(keyed, gone, gone.count(), "_key", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4,096 tokens."""
    small_batches(spark)
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage), ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
