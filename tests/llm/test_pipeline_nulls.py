"""Stages with null, shared and repeated ids and without labels; a sample that no id can blow up."""

import random

import corpus_pipeline as cp
from tallyframe.llm.langid import fit_language_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('ijklmnop')}{rng.choice('qrstuv')}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).repartition(3)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_null_shared_and_repeated_ids(spark, tmp_path):
    rng = random.Random(1)
    item, near = words(rng, 20), words(rng, 100)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, own = words(rng, 60), words(rng, 50)
    docs = [(None, f"intro {item} outro", "en"), (None, clean, "en"), (3, f"other {item} end", "en"), (3, own, "en"), (None, None, "en"), (9, "", "en")]
    assert texts(cp.decontamination_stage(spark, frame(spark, docs), str(tmp_path))) == sorted([(None, clean), (3, own), (None, None), (9, "")], key=str)
    docs = [(None, near, "en"), (None, near + " more", "en"), (None, clean, "en"), (None, clean, "en"), (5, own, "en"), (5, own, "en"), (6, own + " x", "en"), (None, None, None), (8, "", None)]
    kept = cp.near_dedup_stage(spark, frame(spark, docs), str(tmp_path))
    assert kept.columns == cp.COLUMNS
    got = texts(kept)
    assert len([t for _, t in got if t and t.startswith(near)]) == 1 and got.count((None, clean)) == 1
    assert [i for i, t in got if t and t.startswith(own)] == [5] and len(got) == 5


def test_no_labels_and_empty_tables(spark, tmp_path):
    docs = frame(spark, [(1, "some text", None), (2, "12 !!", None), (None, "ünï", None), (4, None, None), (5, "", None)])
    assert texts(cp.language_stage(spark, docs, str(tmp_path))) == sorted([(1, "some text"), (None, "ünï")], key=str)
    assert cp.language_stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert cp.near_dedup_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_sample_with_null_and_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(None, words(rng, 30), "xx") for _ in range(300)] + [(7, "die der das und", "de")] * 300 + [(i, f"the of and {i}", "en") for i in range(50)]
    model = fit_language_model(frame(spark, rows), sample_chars=2000)
    assert model.languages == ["de", "en", "xx"]
    assert fit_language_model(frame(spark, rows), sample_chars=2000, text_chars=10).languages == model.languages
