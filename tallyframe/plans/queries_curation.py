"""Queries of curation, pair mining and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import row_digest, stable_hash
from ..operators import assignment, curation, pairs, splits
from . import standins
from .queries_functions import H, frac_sql
from .registry import query, table
from .standins import ARMS, CASES_SQL, EPISODES_SQL, MODELS


def h(x: str, salt: str) -> str:
    return H.format(salt=salt, x=x)


@query("expand_variants", f"""WITH {CASES_SQL}
SELECT family_id || '-' || v AS case_id, v AS variant,
  CASE WHEN v = 'Sufficient' THEN 'ref,b' ELSE 'ref,b-preview' END || CASE WHEN c_initial THEN ',c' ELSE '' END AS initial,
  CASE WHEN v = 'Missing' THEN 4 ELSE 5 END AS evidence_rows,
  CASE WHEN v IN ('Missing', 'Unavailable') THEN false ELSE b_ok END AS withheld_available
FROM cases, unnest(['Sufficient', 'Obtainable', 'Missing', 'Unavailable']) AS t(v)""")
def _(spark, sf):
    out = curation.expand_variants(standins.cases(spark, sf).withColumn("withheld", F.lit("b")))
    return out.select(
        "case_id", "variant", F.array_join("initial", ",").alias("initial"), F.size("evidence").alias("evidence_rows"),
        F.exists("evidence", lambda e: (e["id"] == "b") & e["available"]).alias("withheld_available"),
    )


LABELLED_SQL = "labelled AS (SELECT doc_id, lang, source, quality, toxic FROM labels JOIN documents USING (doc_id))"


def labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return table(spark, sf, "labels").join(docs, "doc_id")


def _ranked(group: str, key: str, salt: str, source: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {h(key, salt)}, {key}) AS rn FROM {source}"


@query("balanced_pairs", f"""WITH {LABELLED_SQL}, ranked AS ({_ranked('lang, quality', 'doc_id', 'pairs', 'labelled')})
SELECT a.lang, a.rn AS pair, a.doc_id AS positive, b.doc_id AS negative FROM ranked a JOIN ranked b ON a.lang = b.lang AND a.rn = b.rn
WHERE a.quality = 1 AND b.quality = 0""")
def _(spark, sf):
    return curation.balanced_pairs(labelled(spark, sf), ["lang"], F.col("quality") == 1, "doc_id", "pairs")


@query("stratified_hash_sample", f"""WITH ranked AS ({_ranked('lang, source', 'doc_id', 'v1', 'documents')})
SELECT lang, source, doc_id, rn AS rank FROM ranked WHERE rn <= 3""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return curation.stratified_hash_sample(docs, ["lang", "source"], "doc_id", "v1", 3).select("lang", "source", "doc_id", "rank")


@query("short_strata", "SELECT lang, source, count(*) AS rows FROM documents GROUP BY 1, 2 HAVING count(*) < 8")
def _(spark, sf):
    return curation.short_strata(table(spark, sf, "documents"), ["lang", "source"], 8)


@query("round_robin", f"""WITH ranked AS ({_ranked('source', 'doc_id', 'rr', 'documents')})
SELECT source, doc_id, rn AS rank FROM ranked ORDER BY rn, source LIMIT 50""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return curation.round_robin(docs, "source", stable_hash(F.col("doc_id"), "rr"), 50, ["doc_id"])


@query("balanced_sample", f"""WITH ranked AS ({_ranked('quality', 'doc_id', '17', 'labels')})
SELECT doc_id, quality, rn AS rank FROM ranked WHERE rn <= 25""")
def _(spark, sf):
    return curation.balanced_sample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 25, 17)


@query("undersample_to_minority", f"""WITH {LABELLED_SQL}, ranked AS ({_ranked('lang, quality', 'doc_id', 'visa', 'labelled')}),
sizes AS (SELECT lang, count(*) FILTER (quality = 0) AS few, count(*) FILTER (quality = 1) AS many FROM labelled GROUP BY 1)
SELECT * FROM (SELECT lang, doc_id, quality, CASE WHEN few = 0 OR many < few + 1 THEN 'short' WHEN quality = 0 THEN 'minority' WHEN rn = 1 THEN 'reference'
  WHEN rn <= few + 1 THEN 'majority' END AS role FROM ranked JOIN sizes USING (lang)) WHERE role IS NOT NULL""")
def _(spark, sf):
    out = curation.undersample_to_minority(labelled(spark, sf), "lang", F.col("quality") == 0, "doc_id", "visa")
    return out.select("lang", "doc_id", "quality", "role")


@query("evenly_spaced", """
WITH numbered AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, i + 1 AS rank FROM numbered
WHERE list_contains([round_even(j * (n - 1) / 11.0, 0)::BIGINT for j in range(12)], i)""")
def _(spark, sf):
    return curation.evenly_spaced(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 12)


@query("evenly_spaced_valid", """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value > 20 AS has_mask, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS size FROM events),
walk AS (SELECT user_id, max(size) AS size, coalesce(list(i ORDER BY i) FILTER (has_mask), []) AS free, 0 AS turn, []::BIGINT[] AS taken FROM e GROUP BY 1
  UNION ALL SELECT user_id, size, list_filter(free, lambda x: x <> pick), turn + 1, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END
  FROM (SELECT *, list_sort(list_transform(free, lambda x: {'gap': abs(x - round_even(turn * (size - 1) / 5.0, 0)::BIGINT), 'x': x}))[1].x AS pick FROM walk WHERE turn < 6)),
chosen AS (SELECT user_id, unnest(taken) AS i FROM walk WHERE turn = 6 AND len(taken) >= 2)
SELECT user_id, event_id, event_type, has_mask, i AS index FROM e JOIN chosen USING (user_id, i)""")
def _(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", "event_type", (F.col("value") > 20).alias("has_mask"))
    return curation.evenly_spaced_valid(log, ["user_id"], ["event_id"], 6, "has_mask")


@query("cyclic_partner", """
SELECT user_id, event_id, coalesce(lead(event_id) OVER w, first_value(event_id) OVER w) AS partner FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def _(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id")
    return curation.cyclic_partner(log, ["user_id"], ["event_id"], "event_id")


@query("signature_partner", f"""WITH base AS (SELECT doc_id, source, lang FROM documents), ranked AS ({_ranked('source, lang', 'doc_id', 'sig', 'base')}),
sizes AS (SELECT source, lang, count(*) AS n FROM base GROUP BY 1, 2),
ring AS (SELECT source, lang, count(*) OVER (PARTITION BY source) AS cats,
  coalesce(lead(lang) OVER (PARTITION BY source ORDER BY lang), first_value(lang) OVER (PARTITION BY source ORDER BY lang)) AS nl FROM sizes)
SELECT a.source, a.lang, a.doc_id, CASE WHEN cats > 1 THEN nl END AS partner_category, b.doc_id AS partner
FROM ranked a JOIN ring USING (source, lang) JOIN sizes s ON s.source = a.source AND s.lang = nl
LEFT JOIN ranked b ON cats > 1 AND b.source = a.source AND b.lang = nl AND b.rn = (a.rn - 1) % s.n + 1""")
def _(spark, sf):
    return pairs.signature_partner(table(spark, sf, "documents"), "source", "lang", "doc_id", "sig")


@query("positive_pairs", """
WITH numbered AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
spread AS (SELECT user_id, event_id FROM numbered WHERE n >= 12 AND list_contains([round_even(j * (n - 1) / 11.0, 0)::BIGINT for j in range(12)], i))
SELECT a.user_id, a.event_id AS first, b.event_id AS second FROM spread a JOIN spread b ON a.user_id = b.user_id AND b.event_id - a.event_id >= 30""")
def _(spark, sf):
    return pairs.positive_pairs(table(spark, sf, "events"), "user_id", "event_id", 30, frames=12)


NEGATIVE_SQL = f"""base AS (SELECT vec_id, label, vec_id % 3 AS split, {h('vec_id', 'neg')} AS hh FROM embeddings),
placed AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY label, hh, vec_id) AS place, count(*) OVER (PARTITION BY split) AS n,
  count(*) OVER (PARTITION BY split, label) AS own FROM base),
ranges AS (SELECT split, label, min(place) AS lo FROM placed GROUP BY 1, 2),
draws AS (SELECT p.*, lo, (('0x' || substr(hh, 1, 15))::BIGINT + t) % (n - own) + 1 AS draw
  FROM placed p JOIN ranges USING (split, label), unnest(range(3)) AS u(t) WHERE t < n - own),
negatives AS (SELECT d.split, d.vec_id, d.label, b.vec_id AS partner, b.label AS partner_category
  FROM draws d JOIN placed b ON b.split = d.split AND b.place = CASE WHEN draw < lo THEN draw ELSE draw + d.own END)"""


def negatives(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).alias("split"))
    return pairs.negative_pairs(emb, "split", "label", "vec_id", 3, "neg")


@query("negative_pairs", f"WITH {NEGATIVE_SQL} SELECT * FROM negatives")
def _(spark, sf):
    return negatives(spark, sf)


@query("dedupe_pairs", f"WITH {NEGATIVE_SQL} SELECT DISTINCT least(vec_id, partner) AS first, greatest(vec_id, partner) AS second FROM negatives")
def _(spark, sf):
    return pairs.dedupe_pairs(negatives(spark, sf), "vec_id", "partner")


@query("cap_per_group", f"""WITH ranked AS ({_ranked('user_id, event_type', 'event_id', 'cap', 'events')})
SELECT user_id, event_type, event_id FROM ranked WHERE rn <= 2""")
def _(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return pairs.cap_per_group(log, ["user_id", "event_type"], "event_id", 2, "cap")


@query("best_per_source", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return curation.best_per_source(orders, ["o_custkey"], F.col("o_totalprice"), "o_orderkey")


@query("material_sets", f"""WITH {CASES_SQL}
SELECT family_id, 'initial' AS unit, 'ref,b-preview' || CASE WHEN c_initial THEN ',c' ELSE '' END AS images FROM cases
UNION ALL SELECT family_id, 'candidate_pool', 'ref,b-preview' || CASE WHEN c_ok THEN ',c' ELSE '' END || CASE WHEN d_ok THEN ',d' ELSE '' END FROM cases
UNION ALL SELECT family_id, 'resolution_control', 'ref,b-preview' || CASE WHEN c_initial AND c_ok THEN ',c' ELSE '' END FROM cases
UNION ALL SELECT family_id, 'blocked_pool', 'ref,b-preview' || CASE WHEN c_ok THEN ',c' ELSE '' END || CASE WHEN d_ok THEN ',d' ELSE '' END FROM cases""")
def _(spark, sf):
    out = curation.material_sets(standins.cases(spark, sf), F.lit("b"))
    return out.select("family_id", "unit", F.array_join(F.transform("images", lambda e: e["id"]), ",").alias("images"))


EDGES_SQL = """edges AS (SELECT o_orderkey AS family, 'c' || o_custkey AS asset FROM orders
  UNION ALL SELECT o_orderkey, 'p' || ((o_custkey + CASE WHEN o_orderkey % 16 = 0 THEN 1 ELSE 0 END) // 5) FROM orders)"""
COMPONENTS_SQL = f"""WITH RECURSIVE {EDGES_SQL.replace('edges AS', 'all_edges AS', 1)}, edges AS (SELECT * FROM all_edges WHERE family % 10 > 0), links AS (SELECT DISTINCT a.asset AS x, b.asset AS y FROM edges a JOIN edges b USING (family)),
reach AS (SELECT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
mins AS (SELECT asset, min(family) AS m FROM edges GROUP BY 1),
roots AS (SELECT r.x AS asset, min(m) AS component FROM reach r JOIN mins ON mins.asset = r.y GROUP BY 1),
comps AS (SELECT o_orderkey AS family, coalesce(min(component), o_orderkey) AS component FROM orders LEFT JOIN edges ON family = o_orderkey LEFT JOIN roots USING (asset) GROUP BY o_orderkey)"""


def edges(spark, sf):
    assets = F.expr("array('c' || o_custkey, 'p' || ((o_custkey + CASE WHEN o_orderkey % 16 = 0 THEN 1 ELSE 0 END) div 5))")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("family"), F.explode(assets).alias("asset"))


@query("component_split", COMPONENTS_SQL + f"""
SELECT family, component, CASE WHEN {frac_sql('component', 'split-v1')} < 0.7 THEN 'train' WHEN {frac_sql('component', 'split-v1')} < 0.8 THEN 'val' ELSE 'test' END AS split FROM comps""")
def _(spark, sf):
    links = edges(spark, sf)
    families = table(spark, sf, "orders").select(F.col("o_orderkey").alias("family"))
    return splits.component_split(families, links.filter("family % 10 > 0"), "family", "asset", "split-v1")


@query("category_split", f"""WITH names AS (SELECT source, row_number() OVER (ORDER BY {h('source', '17')}) AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, CASE WHEN n <= 3 THEN 'validation' ELSE 'train' END AS split FROM documents JOIN names USING (source)""")
def _(spark, sf):
    return splits.category_split(table(spark, sf, "documents").select("doc_id", "source"), "source", 3, 17)


CELLS = [(m, a) for m in MODELS for a in ARMS]
COHORT_SQL = EPISODES_SQL + ", cohort AS (SELECT family_id FROM episodes GROUP BY 1 HAVING count(DISTINCT model || arm) = 9)"


def cohort(eps):
    return curation.common_cohort(eps, "family_id", [(F.col("model") == m) & (F.col("arm") == a) for m, a in CELLS])


@query("common_cohort", f"WITH {COHORT_SQL} SELECT family_id FROM cohort")
def _(spark, sf):
    return cohort(standins.raw_episodes(spark, sf).select("model", "arm", F.expr("'f' || pk").alias("family_id")))


@query("exclude_with_reason", """
SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too-short' WHEN lang NOT IN ('en', 'fr') THEN 'language' WHEN source = 'src0' THEN 'auxiliary-source' END AS reason FROM documents""")
def _(spark, sf):
    rules = [("too-short", F.col("n_chars") < 200), ("language", ~F.col("lang").isin("en", "fr")), ("auxiliary-source", F.col("source") == "src0")]
    return curation.exclude_with_reason(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), rules).select("doc_id", "reason")


def frozen(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "CAST(round(o_totalprice * 100) AS BIGINT) AS cents", "o_orderpriority")
    rows = rows.withColumn("digest", row_digest(F.col("cents"), F.col("o_orderpriority")))
    segment = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    dev = rows.join(segment, "o_custkey", "left_semi").filter("cents >= 1000000").withColumn(
        "digest", F.when(F.col("cents") > 45000000, F.lit("changed")).otherwise(F.col("digest"))
    )
    return rows, dev.select("o_orderkey", "o_custkey", "digest")


@query("exclude_frozen_groups", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND round(o_totalprice * 100) >= 1000000)""")
def _(spark, sf):
    rows, dev = frozen(spark, sf)
    return curation.exclude_frozen_groups(rows, dev, "o_custkey").select("o_orderkey", "o_custkey")


@query("frozen_group_problems", """
WITH b AS (SELECT o_orderkey, o_custkey, round(o_totalprice * 100) AS cents FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')
SELECT o_orderkey::VARCHAR AS key, 'changed_row' AS problem FROM b WHERE cents > 45000000
UNION ALL SELECT o_custkey::VARCHAR, 'partial_group' FROM b GROUP BY o_custkey HAVING bool_or(cents >= 1000000) AND bool_or(cents < 1000000)""")
def _(spark, sf):
    rows, dev = frozen(spark, sf)
    return curation.frozen_group_problems(rows, dev, "o_orderkey", "o_custkey", "digest")


@query("shard_families", """
WITH f AS (SELECT l_partkey, (row_number() OVER (ORDER BY l_partkey) - 1) % 8 AS shard FROM (SELECT DISTINCT l_partkey FROM lineitem))
SELECT l_partkey, shard::INTEGER AS shard, count(*) AS rows FROM lineitem JOIN f USING (l_partkey) GROUP BY ALL""")
def _(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey")
    return splits.shard_families(items, "l_partkey", 8).groupBy("l_partkey", "shard").agg(F.count("*").alias("rows"))


@query("cyclic_assign", f"""WITH ranked AS ({_ranked('source', 'doc_id', '5', 'documents')})
SELECT doc_id, source, ['Sufficient', 'Obtainable', 'Missing', 'Unavailable'][(rn - 1) % 4 + 1] AS variant FROM ranked""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return curation.cyclic_assign(docs, ["source"], "doc_id", ["Sufficient", "Obtainable", "Missing", "Unavailable"], 5, "variant")


@query("select_study", f"""WITH {LABELLED_SQL}, r AS ({_ranked('source, lang, quality', 'doc_id', '9', 'labelled')}),
p AS (SELECT a.source AS category, a.doc_id AS member, b.doc_id AS partner FROM r a JOIN r b ON a.source = b.source AND a.lang = b.lang AND a.rn = b.rn WHERE a.quality = 1 AND b.quality = 0),
c AS (SELECT o_orderpriority AS category, min(o_orderkey) FILTER (o_orderstatus = 'F') AS member, min(o_orderkey) FILTER (o_orderstatus = 'O') AS partner
  FROM orders GROUP BY o_orderpriority, o_custkey HAVING member IS NOT NULL AND partner IS NOT NULL),
u AS (SELECT o_orderpriority AS category, o_orderkey AS member, NULL::BIGINT AS partner FROM orders WHERE o_orderstatus = 'P'),
pr AS ({_ranked('category', 'member', '9', 'p')}), cr AS ({_ranked('category', 'member', '9', 'c')}), ur AS ({_ranked('category', 'member', '9', 'u')})
SELECT 'state' AS kind, category, member, partner FROM (SELECT * FROM pr ORDER BY rn, category LIMIT 12)
UNION ALL SELECT 'identity', category, member, partner FROM (SELECT * FROM cr ORDER BY rn, category LIMIT 16)
UNION ALL SELECT 'unknown', category, member, partner FROM (SELECT * FROM ur ORDER BY rn, category LIMIT 16)""")
def _(spark, sf):
    states = labelled(spark, sf).select(
        F.col("source").alias("category"), F.col("lang").alias("criterion"), (F.col("quality") == 1).alias("positive"), F.col("doc_id").alias("key")
    )
    orders = table(spark, sf, "orders")
    controls = orders.selectExpr(
        "o_orderpriority AS category", "o_custkey AS anchor", "o_orderkey AS key",
        "CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' END AS construction",
    )
    unknown = orders.filter("o_orderstatus = 'P'").selectExpr("o_orderpriority AS category", "o_orderkey AS key")
    return curation.select_study(states, controls, unknown, {"state": 12, "identity": 16, "unknown": 16}, 9)


STUDY_ARMS = ["initial", "full", "agent"]
TASKS_SQL = f"""families AS (SELECT p_partkey AS family, CASE WHEN (p_partkey // 2) % 3 < 2 THEN 'state' ELSE 'identity' END AS task, p_partkey // 2 AS source FROM part),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY task ORDER BY {h('source', '3')}, {h('family', '3')}) - 1) * 6 AS first FROM families),
assigned AS (SELECT family, task, source, ['initial', 'full', 'agent'][(slot // 2 + first // 24) % 3 + 1] AS arm, (slot % 2)::INTEGER AS repeat, ((first + slot) % 24)::INTEGER AS person
  FROM numbered, unnest(range(6)) AS t(slot))"""


def assigned(spark, sf):
    families = table(spark, sf, "part").selectExpr(
        "p_partkey AS family", "CASE WHEN (p_partkey div 2) % 3 < 2 THEN 'state' ELSE 'identity' END AS task", "p_partkey div 2 AS source"
    )
    return curation.assign_tasks(families, "task", "source", "family", STUDY_ARMS, 2, 24, 3)


@query("assign_tasks", f"WITH {TASKS_SQL} SELECT * FROM assigned")
def _(spark, sf):
    return assigned(spark, sf).select("family", "task", "source", "arm", "repeat", "person")


def _mix(task: str, source: str, key: str) -> str:
    return (
        f"SELECT {key} AS id, '{task}' AS task, {h(key, f'71|{task}|mix')} AS shuffle_key FROM (SELECT *, "
        f"row_number() OVER (ORDER BY {h(key, f'71|{task}')}, {key}) AS rn FROM {source}) WHERE rn <= 40"
    )


@query("mixture", f"{_mix('identity', 'documents', 'doc_id')} UNION ALL {_mix('state', 'pages', 'page_id')}")
def _(spark, sf):
    sources = {
        "identity": table(spark, sf, "documents").select(F.col("doc_id").alias("id")),
        "state": table(spark, sf, "pages").select(F.col("page_id").alias("id")),
    }
    return curation.mixture(sources, 40, "id", 71)


@query("keep_terminal", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 = 1 AND l_returnflag = 'A'""")
def _(spark, sf):
    calls = F.expr(
        "CASE WHEN l_linenumber % 2 = 1 THEN array(named_struct('name', CASE WHEN l_returnflag = 'A' THEN 'finish' ELSE 'crop' END)) "
        "ELSE array(named_struct('name', 'finish'), named_struct('name', 'finish')) END"
    )
    return curation.keep_terminal(table(spark, sf, "lineitem").withColumn("tool_calls", calls)).select("l_orderkey", "l_linenumber")


@query("blind_projection", f"""
WITH b AS (SELECT *, substr({h('doc_id', 'blind')}, 1, 20) AS u FROM documents)
SELECT u AS unit_id, lang, array_to_string([substr(x, 1, 20) for x in list_sort([sha256(u || '|' || i) for i in ['a' || doc_id, 'b' || doc_id, 'c' || doc_id]])], ',') AS images,
  lang = 'de' AS leaks FROM b""")
def _(spark, sf):
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id", "lang", "source", "array('a' || doc_id, 'b' || doc_id, 'c' || doc_id) AS images"
    )
    out = curation.blind_projection(docs, "doc_id", ["source"], "images", "blind", '"de"|src')
    return out.withColumn("images", F.array_join("images", ","))


@query("portable_projection", """
SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN 'absolute' WHEN page_id % 4 = 1 THEN 'parent' ELSE '' END AS problems FROM pages""")
def _(spark, sf):
    pages = table(spark, sf, "pages").selectExpr(
        "page_id", "url", "'host' AS machine", "array('/data/x', 'a/../x', 'x', 'a/x')[page_id % 4] AS path"
    )
    return curation.portable_projection(pages, ["machine"], ["path"]).select("page_id", "url", F.array_join("problems", ",").alias("problems"))


@query("shared_sequence_split", """
SELECT l_orderkey, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1""")
def _(spark, sf):
    return curation.shared_sequence_split(table(spark, sf, "lineitem"), "l_orderkey", "l_linestatus")


@query("training_cases", """
WITH r AS (SELECT p_brand AS brand, 'ref/' || min(p_partkey) AS reference FROM part GROUP BY 1)
SELECT 'fam-' || substr(sha256('img/' || p_partkey), 1, 20) AS family_id, p_brand AS category, CASE WHEN p_size > 25 THEN 'Supported' ELSE 'Refuted' END AS verdict,
  'photo-' || substr(sha256('img/' || p_partkey), 1, 20) || ',photo-' || substr(sha256(reference), 1, 20) AS initial, p_size::BIGINT AS width
FROM part JOIN r ON brand = p_brand""")
def _(spark, sf):
    part = table(spark, sf, "part")
    rows = part.selectExpr(
        "p_brand AS category", "'img/' || p_partkey AS image", "CASE WHEN p_size > 25 THEN 'anomaly' ELSE 'normal' END AS label",
        "array(0L, 0L, CAST(p_size AS BIGINT), 10L) AS box",
    )
    references = part.groupBy(F.col("p_brand").alias("category")).agg(F.expr("'ref/' || min(p_partkey)").alias("reference"))
    out = curation.training_cases(rows, references, "category")
    width = F.flatten(F.get(F.map_values("minimal_evidence_sets"), F.lit(0)))[0]["bbox"][2]
    return out.select("family_id", "category", "verdict", F.array_join("initial", ",").alias("initial"), width.alias("width"))


def _cohort_inputs(spark, sf):
    cases = standins.variant_episodes(spark, sf).select("pk", "family_id", "variant", "task")
    part = table(spark, sf, "part")
    plan = part.filter("p_size <= 40").selectExpr("'f' || p_partkey AS family_id")
    chosen = part.filter("p_type = 'ECONOMY'").selectExpr("'f' || p_partkey AS family_id")
    return cases, plan, chosen


COHORT_INPUTS_SQL = standins.VARIANT_EPISODES_SQL + """, plan AS (SELECT 'f' || p_partkey AS family_id FROM part WHERE p_size <= 40),
chosen AS (SELECT 'f' || p_partkey AS family_id FROM part WHERE p_type = 'ECONOMY')"""


@query("select_cohort", f"""WITH {COHORT_INPUTS_SQL}, c AS (SELECT * FROM variant_episodes WHERE variant IN ('Sufficient', 'Obtainable')
  AND family_id IN (SELECT family_id FROM chosen WHERE family_id IN (SELECT family_id FROM plan))),
few AS (SELECT family_id FROM c WHERE variant = 'Sufficient' QUALIFY row_number() OVER (PARTITION BY task ORDER BY family_id) <= 2)
SELECT family_id, variant, task, CASE variant WHEN 'Sufficient' THEN 1 ELSE 2 END AS variant_order FROM c WHERE family_id IN (SELECT family_id FROM few)""")
def _(spark, sf):
    cases, plan, chosen = _cohort_inputs(spark, sf)
    out = curation.select_cohort(cases, plan, chosen, ["Sufficient", "Obtainable"], pilot=2)
    return out.select("family_id", "variant", "task", "variant_order")


@query("cohort_problems", f"""WITH {COHORT_INPUTS_SQL}
SELECT family_id, 'outside_plan' AS problem FROM chosen WHERE family_id NOT IN (SELECT family_id FROM plan)
UNION ALL SELECT family_id, 'missing_' || v FROM chosen, unnest(['Sufficient', 'Obtainable']) AS t(v)
WHERE NOT EXISTS (SELECT 1 FROM variant_episodes e WHERE e.family_id = chosen.family_id AND e.variant = v)""")
def _(spark, sf):
    cases, plan, chosen = _cohort_inputs(spark, sf)
    return curation.cohort_problems(cases, plan, chosen, ["Sufficient", "Obtainable"])


# Families of two tasks with a source of three neighbours and one of four families far apart: six and eight of at most 60 slots a person.
DISJOINT_SQL = """WITH n AS (SELECT count(*) AS n FROM part)
SELECT CASE WHEN t = 0 THEN 'state' ELSE 'identity' END AS task, arm, CAST(p AS INTEGER) AS person, CAST(n // 2 * 2 // 40 AS BIGINT) AS slots, 0::BIGINT AS met_again
FROM n, (SELECT unnest([0, 1]) AS t), (SELECT unnest(['initial_text', 'full_available_text', 'interactive_agent']) AS arm), (SELECT unnest(range(40)) AS p)"""


@query("assign_disjoint", DISJOINT_SQL)
def _(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("family"))
    far = parts.count() // 4
    families = parts.selectExpr(
        "family", "CASE WHEN family % 2 = 0 THEN 'state' ELSE 'identity' END AS task", f"array('near' || family div 3, 'far' || family % {far}) AS sources"
    )
    arms = ["initial_text", "full_available_text", "interactive_agent"]
    slots = assignment.assign_disjoint(families, "task", "sources", "family", arms, 2, 40, 5)
    met = slots.select("task", "arm", "person", F.explode("sources").alias("source"))
    again = met.groupBy("person", "source").agg(F.count("*").alias("n"), F.min(F.struct("task", "arm")).alias("at")).where("n > 1")
    again = again.groupBy("at.task", "at.arm", "person").agg(F.count("*").alias("met_again"))
    counts = slots.groupBy("task", "arm", "person").agg(F.count("*").alias("slots"))
    return counts.join(again, ["task", "arm", "person"], "left").withColumn("met_again", F.coalesce("met_again", F.lit(0).cast("long")))
