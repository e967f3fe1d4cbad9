"""Exact dedup against brute force: nulls, repeats, weak digests, several batches, new files."""

import hashlib
import random

from pyspark.sql import functions as F

from tallyframe.llm.exact_dedup import exact_duplicates
from tallyframe.session import scratch_path
from tallyframe.streaming.state import DISK_STATE

SCHEMA = "doc_id long, text string, digest string, size long"


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out.append((doc_id, keep, len(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def stored(spark, rows, files=4):
    path = scratch_path(spark, "docs")
    spark.createDataFrame([(i, t, "d", 7) for i, t in rows], SCHEMA).repartition(files).write.parquet(path)
    return path


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    texts = ["", None, "a", "A", "a ", "é", "long " * 50_000, "x\ny", *(f"text {i}" for i in range(40))]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1000 + i, "copied everywhere") for i in range(200)]
    return rows + [(5, "twice"), (5, "twice"), (None, "nobody"), (None, "nobody"), (None, "a"), (9999, "one alone")]


def test_groups_against_brute_force(spark):
    rows = rows_of(1)
    before = {name: spark.conf.get(name, None) for name in DISK_STATE}
    out = exact_duplicates(spark, stored(spark, rows), SCHEMA, files_per_batch=1).cache()
    assert result(out) == brute(rows)
    kept = out.where("kept").groupBy("text_sha256").agg(F.count("*").alias("n"), F.max("doc_id").alias("id"), F.max("keep_id").alias("keep")).collect()
    assert all(r.n == 1 and r.id == r.keep for r in kept)
    assert len(kept) == len({t or "" for _, t in rows})
    assert {name: spark.conf.get(name, None) for name in DISK_STATE} == before


def test_colliding_digests_are_split_by_the_texts(spark):
    rows = rows_of(2)
    weak = lambda text: (F.crc32(text) % 7).cast("string").cast("binary")
    assert result(exact_duplicates(spark, stored(spark, rows), SCHEMA, digest=weak)) == brute(rows)


def test_new_files_meet_the_state_of_old_ones(spark):
    rows = rows_of(3)
    path, checkpoint = stored(spark, rows[:250]), scratch_path(spark, "state")
    assert result(exact_duplicates(spark, path, SCHEMA, checkpoint=checkpoint)) == brute(rows[:250])
    spark.createDataFrame([(i, t, "d", 7) for i, t in rows[250:]], SCHEMA).write.mode("append").parquet(path)
    assert result(exact_duplicates(spark, path, SCHEMA, checkpoint=checkpoint)) == brute(rows)


def test_empty_table(spark):
    assert exact_duplicates(spark, stored(spark, [], 1), SCHEMA).count() == 0
