"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .chat import format_conversations, read_back
from .decontam import find_leaks
from .divergence import audit_sources
from .exact_dedup import exact_duplicates
from .langid import fit_language_model, identify_language
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .registry import ORACLES, QUERIES, query, table  # noqa: F401
from .secret_scan import BASE_KINDS, KINDS, SCOPE, find_secrets, span_text
from .substring_dedup import dedup_substrings
from .vector_codes import compress_vectors

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CHAT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# Words as in the contract: A-Z lower-cased, ASCII white space between them.
SQL_WORDS = """
words AS (SELECT *, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {0}),
grams AS (SELECT * EXCLUDE (w), unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS g FROM words)
"""


@query("op1_minhash_near_dedup", f"""
WITH RECURSIVE {SQL_WORDS.format("documents")},
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s >= 85 * (x.n + y.n - s)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.seen),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN roots r ON r.node = d.doc_id
""")
def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op3_benchmark_decontamination", f"""
WITH {SQL_WORDS.format("documents")},
item_words AS (SELECT *, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS g FROM item_words),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, n_item FROM grams JOIN items USING (g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
""")
def op3(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("estimate")


def sql_text(value: str) -> str:
    return value.replace("'", "''")


SECRET_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k[0]}', {k[1] == 'secret'}, {k[3]}, {k[4]})" for i, k in enumerate(KINDS))}) AS k(kind, name, secret, grp, least)),
found AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS kind, string_split_regex(text, '{sql_text(k[2])}') AS gaps, regexp_extract_all(text, '{sql_text(k[2])}') AS hits, regexp_extract_all(text, '{sql_text(k[2])}', {k[3]}) AS vals FROM docs" for i, k in enumerate(KINDS))}),
rows AS (SELECT doc_id, kind, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1 : len(hits)]) AS gap, generate_subscripts(hits, 1) AS turn FROM found WHERE len(hits) > 0),
placed AS (SELECT doc_id, kind, hit, val, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY turn) AS BIGINT) AS e FROM rows),
parts AS (SELECT doc_id, kind, name, secret, e - length(hit) AS s, e FROM placed JOIN kinds USING (kind) WHERE length(val) >= least),
weak AS (SELECT * FROM parts w WHERE kind >= {BASE_KINDS}
  AND EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = w.doc_id AND o.secret <> w.secret AND abs(o.s - w.s) <= {SCOPE})
  AND NOT (kind = {len(KINDS) - 1} AND EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = w.doc_id AND o.kind < {BASE_KINDS} AND o.s < w.e AND w.s < o.e))),
spans AS (SELECT * FROM parts WHERE kind < {BASE_KINDS} UNION ALL SELECT * FROM weak),
lists AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < {BASE_KINDS}) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN lists l ON l.doc_id = d.doc_id
"""


@query("op4_secret_scan", SECRET_SQL)
def op4(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(i)))).cast("long").alias(f"n_{k[0]}") for i, k in enumerate(KINDS[:BASE_KINDS])]
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query("op5_substring_dedup")
def op5(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


@query("op6_quality_classifier")
def op6(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit_quality(docs, labels.where(part != 1))
    scored = score_quality(docs, model).withColumn("held_out", F.coalesce(part == 1, F.lit(False)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit_language_model(docs.where(part != 0))
    return identify_language(docs, model).withColumn("held_out", F.coalesce(part == 0, F.lit(False)))


@query("op8_chat_formatting", """
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(role) + length(text) + 2 * length(role || text) - length(replace(replace(role || text, chr(92), ''), '<', '')) - length(replace(role || text, '[', ''))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
""")
def op8(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    told = read_back(*format_conversations(rows.unionByName(extra), CHAT_TOKENIZER))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("turns.loss", "")
    return told.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length(F.array_join(F.col("turns.formatted"), "")).cast("long").alias("formatted_chars"),
    )


@query("op9_nearest_neighbours")
def op9(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 100 = 0"))


@query("op10_line_dedup", """
WITH lines AS (SELECT doc_id, pos - 1 AS pos, line, length(line) >= 20 AS strong
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
near AS (SELECT *, min(CASE WHEN strong THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
  max(CASE WHEN strong THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lines),
texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
asked AS (SELECT doc_id, pos, pos AS start, 1 AS n FROM near WHERE strong
  UNION ALL SELECT doc_id, pos, pos, after - pos + 1 FROM near WHERE NOT strong AND after IS NOT NULL
  UNION ALL SELECT doc_id, pos, before, pos - before + 1 FROM near WHERE NOT strong AND before IS NOT NULL),
runs AS (SELECT a.doc_id, a.pos, a.start, a.n, array_to_string(l[a.start + 1 : a.start + a.n], chr(10)) AS run FROM asked a JOIN texts USING (doc_id)),
lengths AS (SELECT DISTINCT n FROM runs),
every AS (SELECT x.doc_id, x.pos AS start, n, array_to_string(l[x.pos + 1 : x.pos + n], chr(10)) AS run FROM lines x JOIN texts USING (doc_id), lengths WHERE x.pos + n <= len(l)),
firsts AS (SELECT n, run, min((doc_id, start)) AS f FROM every GROUP BY 1, 2),
gone AS (SELECT DISTINCT doc_id, pos FROM runs JOIN firsts USING (n, run) WHERE f < (doc_id, start)),
kept AS (SELECT x.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY x.pos) AS t
  FROM lines x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.pos = x.pos GROUP BY 1),
starts AS (SELECT g.doc_id, count(*) AS n_runs FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.pos = g.pos - 1) GROUP BY 1)
SELECT k.doc_id, n_lines, n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(t, '')) AS kept_sha256 FROM kept k LEFT JOIN starts s ON s.doc_id = k.doc_id
""")
def op10(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_lines", "n_removed", "n_runs")})


@query("op11_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op11(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    return exact_duplicates(spark, path, spark.read.parquet(path).schema).drop("spot")


def assigned(n: int) -> str:
    """SQL: nearest entry of codebook ``n`` for each part; then codebook ``n + 1``."""
    return f"""
a{n} AS (SELECT vec_id, label, p, x, min((d, e)) AS best FROM
  (SELECT vec_id, label, r.p, x, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS BIGINT) AS d FROM parts r JOIN b{n} USING (p)) GROUP BY 1, 2, 3, 4),
c{n} AS (SELECT vec_id, label, p, x, best[1] AS d, best[2] AS e FROM a{n}),
m{n} AS (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM c{n}, (SELECT unnest(range(1, w + 1)) AS i FROM width) GROUP BY 1, 2, 3),
u{n} AS (SELECT p, e, list(y ORDER BY i) AS y FROM m{n} GROUP BY 1, 2),
b{n + 1} AS (SELECT b.p, b.e, coalesce(u.y, b.y) AS y FROM b{n} b LEFT JOIN u{n} u ON u.p = b.p AND u.e = b.e)"""


@query("op12_vector_codes", f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(v)) // 16 AS w FROM kept),
parts AS (SELECT vec_id, label, p, v[p * w + 1 : p * w + w] AS x FROM kept, width, (SELECT unnest(range(16)) AS p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM parts QUALIFY e < 64),
{assigned(0)}, {assigned(1)}, {assigned(2)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM c2 GROUP BY 1, 2),
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
""")
def op12(spark, sf_dir):
    return compress_vectors(table(spark, sf_dir, "embeddings"))


@query("op13_source_divergence", """
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
found AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM docs),
kept AS (SELECT lang, t, count(*) AS ln FROM found GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
langs AS (SELECT lang, count(*) AS v, CAST(sum(ln) AS BIGINT) AS nl FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, t, count(*) AS n FROM found JOIN kept USING (lang, t) GROUP BY 1, 2, 3),
dense AS (SELECT g.lang, g.source, k.t, coalesce(n, 0) AS n, ln FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
shares AS (SELECT lang, source, t, n, 1 + 1000000000 * (n + 1) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS BIGINT) + v) AS p, 1 + 1000000000 * (ln + 1) // (nl + v) AS q FROM dense JOIN langs USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON b.lang = a.lang AND b.t = a.t AND b.source <> a.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
""")
def op13(spark, sf_dir):
    return audit_sources(table(spark, sf_dir, "documents"))
