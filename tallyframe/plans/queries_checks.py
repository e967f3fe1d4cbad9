"""Queries of the integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction, row_digest
from ..operators import checks
from ..operators.splits import split_by_fraction
from ..schemas import GENERATION
from . import standins
from .queries_curation import TASKS_SQL, assigned
from .queries_functions import frac_sql
from .queries_traces import word_sums_sql
from .registry import query, table
from .standins import ARMS, CASES_SQL, EPISODES_SQL, MODELS, pool_sql

RS, US = "chr(30)", "chr(31)"
BASE_SQL = """base AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*100) AS BIGINT) AS d FROM lineitem)"""


def base(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS ok", "l_linenumber AS ln", "l_partkey AS pk", "l_suppkey AS sk", "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_discount*100) AS BIGINT) AS d"
    )


def rules_sql(keys: str, source: str, rules: list[tuple[str, str]]) -> str:
    """SQL with one row per broken rule; each rule is the condition that breaks it."""
    return " UNION ALL ".join(f"SELECT {keys}, '{code}' AS rule FROM {source} WHERE {bad}" for code, bad in rules)


@query("check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return checks.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


GRID_SQL = standins.RAW_EPISODES_SQL + """, have AS (SELECT DISTINCT model, arm, pk FROM raw_episodes),
want AS (SELECT m AS model, a AS arm, p_partkey AS pk FROM part, unnest(['A', 'N', 'R']) AS t(m), unnest(['initial_text', 'full_available_text', 'interactive_agent']) AS u(a) WHERE p_size <= 40)"""


def grid(spark, sf):
    models, arms = (F.array(*[F.lit(v) for v in vs]) for vs in (MODELS, ARMS))
    planned = table(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("pk"), F.explode(models).alias("model"))
    return planned.select("model", F.explode(arms).alias("arm"), "pk")


@query("check_complete", f"""WITH {GRID_SQL}
SELECT model, arm, pk, 'missing' AS problem FROM want ANTI JOIN have USING (model, arm, pk) UNION ALL SELECT model, arm, pk, 'extra' FROM have ANTI JOIN want USING (model, arm, pk)""")
def _(spark, sf):
    return checks.check_complete(standins.raw_episodes(spark, sf), grid(spark, sf), ["model", "arm", "pk"])


@query("completeness", f"""WITH {GRID_SQL}
SELECT model, arm, (SELECT count(*) FROM want w WHERE w.model = x.model AND w.arm = x.arm) AS expected, count(*) FILTER (planned) AS found,
  (SELECT count(*) FROM want w WHERE w.model = x.model AND w.arm = x.arm) - count(*) FILTER (planned) AS missing, count(*) FILTER (NOT planned) AS extra,
  (SELECT count(*) FROM want w WHERE w.model = x.model AND w.arm = x.arm) = count(*) AND count(*) FILTER (NOT planned) = 0 AS complete
FROM (SELECT h.*, EXISTS (SELECT 1 FROM want w WHERE w.pk = h.pk) AS planned FROM have h) x GROUP BY model, arm""")
def _(spark, sf):
    keys = ["model", "arm", "pk"]
    return checks.completeness(standins.raw_episodes(spark, sf), grid(spark, sf), keys, ["model", "arm"])


@query("check_matches_cases", f"""WITH {EPISODES_SQL}, stored AS (SELECT model, arm, pk, source_label, verdict, CASE WHEN q = 11 THEN 'other' ELSE task END AS task, verdict IS NOT DISTINCT FROM source_label AND d > 0 AS m FROM episodes),
j AS (SELECT s.*, p_partkey IS NOT NULL AS known, CASE WHEN p_partkey % 3 < 2 THEN 'state' ELSE 'identity' END AS ctask, CASE WHEN p_size = 7 THEN 'Refuted' WHEN pk % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS clabel
  FROM stored s LEFT JOIN part ON p_partkey = pk AND p_retailprice > 950)
{rules_sql('model, arm, pk', 'j', [('unknown_case', 'NOT known'), ('changed_task', 'known AND task <> ctask'), ('changed_source_label', 'known AND source_label <> clabel'), ('wrong_match', 'm <> (verdict IS NOT DISTINCT FROM source_label)')])}""")
def _(spark, sf):
    eps = standins.episodes(spark, sf).withColumn("task", F.when(F.col("q") == 11, "other").otherwise(F.col("task"))).withColumn(
        "source_label_match", F.col("verdict").eqNullSafe(F.col("source_label")) & (F.col("d") > 0)
    )
    cases = table(spark, sf, "part").filter("p_retailprice > 950").selectExpr(
        "p_partkey AS pk", "CASE WHEN p_partkey % 3 < 2 THEN 'state' ELSE 'identity' END AS task",
        "CASE WHEN p_size = 7 THEN 'Refuted' WHEN p_partkey % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS source_label",
    )
    return checks.check_matches_cases(eps, cases, "pk", ["task", "source_label"], ["model", "arm", "pk"])


@query("match_traces", f"""WITH {EPISODES_SQL}, traces AS (SELECT model, arm, pk, ok * 10 + ln AS trace_id, q % 10 AS outcome FROM raw_episodes WHERE d < 8),
first AS (SELECT model, arm, pk, outcome, min(trace_id) AS trace_id FROM traces GROUP BY ALL)
SELECT model, arm, pk, outcome, trace_id FROM (SELECT model, arm, pk, q % 10 AS outcome FROM episodes) LEFT JOIN first USING (model, arm, pk, outcome)""")
def _(spark, sf):
    results = standins.episodes(spark, sf).selectExpr("model", "arm", "pk", "q % 10 AS outcome")
    traces = standins.raw_episodes(spark, sf).filter("d < 8").selectExpr("model", "arm", "pk", "q % 10 AS outcome", "ok * 10 + ln AS trace_id")
    return checks.match_traces(results, traces, ["model", "arm", "pk", "outcome"], "trace_id")


@query("check_config", """SELECT c_nationkey, 'different_configuration' AS rule FROM customer GROUP BY 1 HAVING count(DISTINCT c_acctbal < -900) > 1""")
def _(spark, sf):
    manifests = table(spark, sf, "customer").select("c_nationkey", F.expr(
        "map('budget', CASE WHEN c_acctbal < -900 THEN '6' ELSE '12' END, 'shard', CAST(c_custkey AS STRING), 'seed', '17')"
    ).alias("config"))
    return checks.check_config(manifests, "c_nationkey", "config", ["shard"])


@query("check_shards", """WITH have AS (SELECT o_custkey, o_orderkey % 5 AS shard, count(*) AS n FROM orders GROUP BY 1, 2),
runs AS (SELECT DISTINCT o_custkey FROM orders), want AS (SELECT o_custkey, s AS shard FROM runs, unnest(range(4)) AS t(s))
SELECT o_custkey, shard, CASE WHEN n IS NULL THEN 'missing' WHEN w IS NULL THEN 'outside' ELSE 'repeated' END AS rule
FROM (SELECT *, 1 AS w FROM want) FULL JOIN have USING (o_custkey, shard) WHERE n IS NULL OR w IS NULL OR n > 1""")
def _(spark, sf):
    manifests = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey % 5 AS shard", "4 AS shards")
    return checks.check_shards(manifests, "o_custkey", "shard", "shards")


@query("ordered_digest", f"""
SELECT o_orderpriority, count(*) AS rows, {word_sums_sql('h')} AS digest FROM (
  SELECT o_orderpriority, sha256('=' || o_orderkey || {US} || '=' || o_custkey || {US} || '=' || o_orderstatus) AS h FROM orders) GROUP BY 1""")
def _(spark, sf):
    return checks.ordered_digest(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("check_preserved", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'gone' ELSE 'changed' END AS rule FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 450000""")
def _(spark, sf):
    before = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    after = before.filter("o_orderstatus <> 'P'").withColumn("o_custkey", F.expr("CASE WHEN o_totalprice > 450000 THEN o_custkey + 1 ELSE o_custkey END"))
    return checks.check_preserved(before, after, "o_orderkey", ["o_custkey", "o_orderpriority"])


@query("leakage", f"""WITH m AS (
  SELECT CASE WHEN {frac_sql('doc_id', 'leak')} < 0.7 THEN 'train' WHEN {frac_sql('doc_id', 'leak')} < 0.8 THEN 'val' ELSE 'test' END AS split, text FROM documents
  UNION ALL SELECT 'frozen', text FROM benchmark),
v AS (SELECT split, 'exact' AS kind, sha256(text) AS value FROM m UNION ALL SELECT split, 'normalized', sha256(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) FROM m)
SELECT kind, value, rtrim(CASE WHEN bool_or(split = 'train') THEN 'train,' ELSE '' END || CASE WHEN bool_or(split = 'val') THEN 'val,' ELSE '' END ||
  CASE WHEN bool_or(split = 'test') THEN 'test,' ELSE '' END || CASE WHEN bool_or(split = 'frozen') THEN 'frozen,' ELSE '' END, ',') AS splits, count(*) AS rows
FROM v GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(split_by_fraction(hash_fraction(F.col("doc_id"), "leak")).alias("split"), "text")
    members = docs.unionByName(table(spark, sf, "benchmark").select(F.lit("frozen").alias("split"), "text"))
    plain = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")
    kinds = F.array(
        F.struct(F.lit("exact").alias("kind"), F.sha2("text", 256).alias("value")),
        F.struct(F.lit("normalized").alias("kind"), F.sha2(plain, 256).alias("value")),
    )
    return checks.leakage(members.select("split", F.explode(kinds).alias("k")).select("split", "k.*"), ["train", "val", "test", "frozen"])


@query("dedupe_replays", f"""
SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_partkey, l_suppkey)) AS l_partkey, count(*) AS copies, min(l_partkey) AS first_source, max(l_partkey) AS last_source,
  count(DISTINCT l_suppkey % 3) > 1 AS conflict FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = checks.dedupe_replays(items, ["l_orderkey", "l_linenumber"], row_digest(F.col("l_suppkey") % 3), F.col("l_partkey"))
    return out.drop("l_suppkey")


@query("replay_sources", "SELECT l_orderkey, l_linenumber, l_partkey % 7 AS source, count(*) AS copies FROM lineitem GROUP BY 1, 2, 3")
def _(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return checks.replay_sources(items, ["l_orderkey", "l_linenumber"], F.col("l_partkey") % 7)


@query("check_trace_totals", f"""WITH {BASE_SQL}
{rules_sql('ok, ln, pk', 'base', [('input_tokens', 'd = 4'), ('output_tokens', 'q = 9'), ('over_budget', 'q + ln > 50'), ('too_many_turns', 'ln * 3 > 16')])}""")
def _(spark, sf):
    df = base(spark, sf).withColumn("generation", F.expr(
        "array(named_struct('input_tokens', q, 'output_tokens', d, 'latency_s', 0D, 'halt', null, 'reasoning_tokens', null), "
        "named_struct('input_tokens', pk, 'output_tokens', 1L, 'latency_s', 0D, 'halt', null, 'reasoning_tokens', null))"
    ).cast(f"array<{GENERATION}>")).selectExpr(
        "*", "q + pk + CASE WHEN d = 4 THEN 1 ELSE 0 END AS input_tokens", "d + 1 + CASE WHEN q = 9 THEN 1 ELSE 0 END AS output_tokens",
        "q AS tool_cost", "ln AS request_cost", "ln * 3 AS turns",
    )
    return checks.check_trace_totals(df, ["ok", "ln", "pk"], 50, 16)


@query("check_metric_nesting", f"""WITH {BASE_SQL}, m AS (SELECT ok, ln, pk, d < 2 AS localized, d < 3 OR q = 5 AS chain, CASE WHEN q = 50 THEN NULL ELSE d < 4 END AS label_correct, q < 45 AS finished FROM base)
{rules_sql('ok, ln, pk', 'm', [('null_metric', 'label_correct IS NULL'), ('localized_without_chain', 'localized AND NOT chain'), ('chain_without_label', 'chain AND NOT coalesce(label_correct, false)'), ('correct_unfinished', 'coalesce(label_correct, false) AND NOT finished')])}""")
def _(spark, sf):
    df = base(spark, sf).selectExpr("ok", "ln", "pk", "d < 2 AS localized", "d < 3 OR q = 5 AS chain", "CASE WHEN q = 50 THEN NULL ELSE d < 4 END AS label_correct", "q < 45 AS finished")
    return checks.check_metric_nesting(df, ["ok", "ln", "pk"])


@query("check_partition", """WITH c AS (SELECT l_suppkey AS sk, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS gain, count(*) FILTER (l_returnflag = 'N') AS loss,
  count(*) FILTER (l_returnflag = 'R' AND l_quantity < 50) AS same, count(*) FILTER (l_linestatus = 'O') AS before FROM lineitem GROUP BY 1)
SELECT sk, 'parts_do_not_add_up' AS rule FROM c WHERE gain + loss + same <> n UNION ALL SELECT sk, 'net_change' FROM c WHERE sk % 5 = 0""")
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sk")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("gain"), F.count_if(F.col("l_returnflag") == "N").alias("loss"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 50)).alias("same"), F.count_if(F.col("l_linestatus") == "O").alias("before"),
    ).withColumn("after", F.expr("before + gain - loss + CASE WHEN sk % 5 = 0 THEN 1 ELSE 0 END"))
    return checks.check_partition(counts, ["sk"], ["gain", "loss", "same"], "n", "gain", "loss", "before", "after")


@query("check_weighted_mean", f"""WITH {EPISODES_SQL}, o AS (SELECT model, arm, count(*) FILTER (NOT (task = 'identity' AND verdict IS NULL)) AS n FROM episodes GROUP BY 1, 2), t AS (SELECT model, arm, count(*) AS n FROM episodes GROUP BY 1, 2)
SELECT model, arm, 'task_sizes' AS rule FROM o JOIN t USING (model, arm) WHERE o.n <> t.n""")
def _(spark, sf):
    eps = standins.episodes(spark, sf).withColumn("hit", F.col("verdict").eqNullSafe(F.col("source_label")).cast("int"))
    tasks = eps.groupBy("model", "arm", "task").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))
    kept = ~((F.col("task") == "identity") & F.col("verdict").isNull())
    overall = eps.groupBy("model", "arm").agg(F.count_if(kept).alias("n"), F.avg("hit").alias("accuracy"))
    return checks.check_weighted_mean(overall, tasks, ["model", "arm"], "n", "accuracy")


@query("check_published", """
SELECT l_suppkey, l_returnflag, CASE WHEN l_suppkey % 7 = 0 THEN 'vanished' ELSE 'changed' END AS rule FROM (
  SELECT l_suppkey, l_returnflag, count(*) AS n, count(*) FILTER (l_quantity < 50) AS m FROM lineitem GROUP BY 1, 2) WHERE l_suppkey % 7 = 0 OR n <> m""")
def _(spark, sf):
    grouped = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag")
    old = grouped.agg(F.count("*").alias("n"))
    new = grouped.agg(F.count_if(F.col("l_quantity") < 50).alias("n")).filter("l_suppkey % 7 <> 0")
    return checks.check_published(old, new, ["l_suppkey", "l_returnflag"], ["n"])


@query("check_reviewed", f"""WITH {CASES_SQL}, r AS (SELECT *, {pool_sql('b_ok', 'c_ok', 'd_ok')} AS pool, {pool_sql('false', 'c_initial', 'false')} AS init FROM cases)
{rules_sql('family_id', 'r', [('not_reviewed', 'pk % 11 = 0'), ('two_reviewers', 'pk % 13 = 0'), ('initial_verdict', "init <> 'Need more evidence'"), ('pool_verdict', "pool <> verdict")])}""")
def _(spark, sf):
    status = F.expr("CASE WHEN pk % 11 = 0 THEN 'draft' ELSE 'reviewed' END")
    review = F.expr(
        "named_struct('reviewers', array('a', CASE WHEN pk % 13 = 0 THEN 'a' ELSE 'b' END), 'initial_verdict', 'Need more evidence', 'pool_verdict', verdict)"
    )
    cases = standins.cases(spark, sf).withColumn("annotation", F.col("annotation").withField("status", status)).withColumn("review", review)
    return checks.check_reviewed(cases, ["family_id"])


@query("check_pairs", """WITH g AS (SELECT l_orderkey AS bank, count(*) AS n, count(DISTINCT l_partkey) AS f, count(DISTINCT l_suppkey % 3) AS t, count(DISTINCT l_returnflag) AS l, count(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY 1)
""" + rules_sql("bank", "g", [("two_members", "n <> 2"), ("same_family", "f = 1"), ("same_target", "t = 1"), ("same_label", "l = 1"), ("different_digest", "s > 1")]))
def _(spark, sf):
    cases = table(spark, sf, "lineitem").selectExpr("l_orderkey AS bank", "l_partkey AS family", "l_suppkey % 3 AS target", "l_returnflag AS label", "l_linestatus AS digest")
    return checks.check_pairs(cases, "bank", "family", "target", "label", "digest")


@query("shortcut_audit", """WITH c AS (SELECT lang, source, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS rows, max(n) AS most, min(n) AS least, count(*) AS labels FROM c GROUP BY 1, 2)
SELECT count(*) AS strata, sum(rows)::BIGINT AS rows, sum(most)::BIGINT AS majority_hits, round(sum(most) / sum(rows), 6) AS majority_accuracy, count(*) FILTER (labels = 2 AND most = least) AS balanced_strata FROM s""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return checks.shortcut_audit(table(spark, sf, "labels").join(docs, "doc_id"), ["lang", "source"], "quality")


@query("verify_files", """
SELECT 'd/' || doc_id AS path, CASE WHEN lang = 'de' THEN 'missing' WHEN source = 'src3' THEN 'size' ELSE 'digest' END AS rule FROM documents WHERE lang = 'de' OR source IN ('src3', 'src4')
UNION ALL SELECT 'p/' || page_id, 'unlisted' FROM pages""")
def _(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("'d/' || doc_id AS path", "n_chars AS bytes", "sha2(text, 256) AS sha256", "lang", "source")
    manifest = docs.selectExpr("path", "CASE WHEN source = 'src3' THEN bytes + 1 ELSE bytes END AS bytes", "CASE WHEN source = 'src4' THEN 'x' ELSE sha256 END AS sha256")
    extra = table(spark, sf, "pages").selectExpr("'p/' || page_id AS path", "1L AS bytes", "'y' AS sha256")
    return checks.verify_files(manifest, docs.filter("lang <> 'de'").select("path", "bytes", "sha256").unionByName(extra))


@query("check_endpoints", f"""WITH {standins.CLAIM_BOXES_SQL}, e AS (SELECT *, ['ref', 'b', 'c', 'zz'][ln % 4 + 1] AS image, ln % 4 = 3 AS unknown,
  CASE ln % 4 WHEN 1 THEN pk % 4 <> 0 WHEN 2 THEN pk % 3 <> 0 ELSE true END AS ok_, q % 9 = 0 AS late FROM claims JOIN part ON p_partkey = pk)
{rules_sql('ok, ln, pk, image', 'e', [('unknown_image', 'unknown'), ('unavailable', 'NOT unknown AND NOT ok_'), ('outside', 'NOT unknown AND NOT (rx1 <= 30 + pk % 30 AND ry1 <= 30)'), ('time', 'NOT unknown AND late')])}""")
def _(spark, sf):
    cited = standins.claims(spark, sf).selectExpr(
        "ok", "ln", "pk", "array('ref', 'b', 'c', 'zz')[ln % 4] AS image_id", "r AS bbox", "CASE WHEN q % 9 = 0 THEN 'after' ELSE 'before' END AS time"
    )
    rows = F.expr("array(named_struct('image_id', 'ref', 'available', true), named_struct('image_id', 'b', 'available', p_partkey % 4 <> 0), named_struct('image_id', 'c', 'available', p_partkey % 3 <> 0))")
    evidence = table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.explode(rows).alias("e")).selectExpr(
        "pk", "e.image_id", "e.available", "array(0L, 0L, 30 + pk % 30, 30L) AS bounds", "'before' AS taken"
    )
    return checks.check_endpoints(cited, evidence, "pk", ["ok", "ln", "pk", "image_id"]).withColumnRenamed("image_id", "image")


@query("access_audit", f"""WITH {CASES_SQL}
SELECT family_id, CASE WHEN t2 = 'uncertain' THEN CASE WHEN c_initial THEN 'b' ELSE 'b,c' END ELSE CASE WHEN c_initial THEN 'b,d' ELSE 'b,c,d' END END AS hidden,
  'b' AS source_visible, CASE WHEN c_ok AND NOT c_initial AND d_ok THEN 'c,d' WHEN c_ok AND NOT c_initial THEN 'c' WHEN d_ok THEN 'd' ELSE '' END AS new_frames,
  p_size % 10 > 5 AS different_view FROM cases JOIN part ON p_partkey = pk""")
def _(spark, sf):
    def turn(degrees):
        c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
        zero, one = F.lit(0.0), F.lit(1.0)
        return F.array(F.array(c, -s, zero), F.array(s, c, zero), F.array(zero, zero, one))
    part = table(spark, sf, "part").select(F.expr("'f' || p_partkey").alias("family_id"), (F.col("p_size") % 10).cast("double").alias("degrees"))
    poses = part.select("family_id", F.lit("original").alias("view"), turn(F.lit(0.0)).alias("rotation")).unionByName(
        part.select("family_id", F.lit("side").alias("view"), turn(F.col("degrees") + F.lit(1e-4)).alias("rotation"))
    )
    cases = standins.cases(spark, sf).withColumn("first", F.lit("original")).withColumn("second", F.lit("side"))
    out = checks.access_audit(cases, poses, "first", "second", 5.5)
    return out.select("family_id", *[F.array_join(c, ",").alias(c) for c in ("hidden", "source_visible", "new_frames")], "different_view")


@query("check_assignment", f"""WITH {TASKS_SQL}, moved AS (SELECT * REPLACE (CASE WHEN family % 50 = 0 AND arm = 'agent' THEN 0 ELSE person END AS person) FROM assigned),
q AS (SELECT task, arm, CASE WHEN count(*) < 25 THEN 0 ELSE min(n) END AS low, max(n) AS high FROM (SELECT task, arm, person, count(*) AS n FROM moved GROUP BY ALL) GROUP BY 1, 2)
SELECT 'person:' || person || ':' || source AS key, 'source_repeated' AS rule FROM moved GROUP BY person, source HAVING count(*) > 1
UNION ALL SELECT 'quota:' || task || ':' || arm, 'uneven_quota' FROM q WHERE high > low + 1""")
def _(spark, sf):
    moved = assigned(spark, sf).withColumn("person", F.expr("CASE WHEN family % 50 = 0 AND arm = 'agent' THEN 0 ELSE person END"))
    return checks.check_assignment(moved, "task", "family", "source", 2, people=25)


@query("reuse_subset", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN 'case_removed' WHEN p_type = 'STANDARD' THEN 'case_changed' ELSE 'reusable' END AS status
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 45) ON p_partkey = l_partkey""")
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_type", row_digest(F.col("p_name")).alias("digest"))
    old = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part.select("l_partkey", "digest"), "l_partkey")
    new = part.filter("p_size < 45").withColumn("digest", F.when(F.col("p_type") == "STANDARD", "changed").otherwise(F.col("digest")))
    return checks.reuse_subset(old, new, "l_partkey", "digest").select("l_orderkey", "l_linenumber", "l_partkey", "status")


@query("input_matching", """WITH g AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS t, count(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)
""" + rules_sql("o_custkey", "g", [("conditions", "n <> 3"), ("target_not_distinct", "t <> n"), ("o_orderstatus_differs", "s > 1")]))
def _(spark, sf):
    return checks.input_matching(table(spark, sf, "orders"), "o_custkey", ["o_orderstatus"], "o_orderpriority", 3)


@query("config_diff", """WITH d AS (SELECT a.o_orderkey, a.o_orderstatus AS s, b.o_orderstatus AS s2, a.o_orderpriority AS p, b.o_orderpriority AS p2 FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)
SELECT o_orderkey, 'o_orderstatus' AS field, s AS base, s2 AS other FROM d WHERE s <> s2 UNION ALL SELECT o_orderkey, 'o_orderpriority', p, p2 FROM d WHERE p <> p2""")
def _(spark, sf):
    runs = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return checks.config_diff(runs, runs.withColumn("o_orderkey", F.col("o_orderkey") - 1), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("check_requests", f"""WITH {BASE_SQL}
{rules_sql('ok, ln, pk', 'base', [('outside_options', 'q % 5 = 4'), ('unknown_status', 'd = 3 AND q % 3 > 0'), ('count_differs', 'ln % 4 <> q % 3'), ('too_many', 'q % 3 = 2')])}""")
def _(spark, sf):
    one = "named_struct('object', 'o', 'time', 't', 'view', concat('v', q % 5), 'status', CASE WHEN d = 3 THEN 'lost' ELSE 'provided' END, 'error', CAST(null AS STRING))"
    failed = "named_struct('object', 'o', 'time', 't', 'view', concat('v', q % 5), 'status', CAST(null AS STRING), 'error', 'budget')"
    df = base(spark, sf).withColumn("requests", F.expr(f"concat(array({failed}), CASE q % 3 WHEN 0 THEN slice(array({one}), 1, 0) WHEN 1 THEN array({one}) ELSE array({one}, {one}) END)"))
    df = df.withColumn("request_options", F.expr("named_struct('objects', array('o'), 'times', array('t'), 'views', array('v0', 'v1', 'v2', 'v3'))"))
    return checks.check_requests(df.withColumn("request_count", F.col("ln") % 4), ["ok", "ln", "pk"], max_requests=1)


@query("check_rescore", f"""WITH {EPISODES_SQL}
SELECT model, arm, pk, CASE WHEN task = 'identity' AND q = 3 THEN 'no_rescore' ELSE 'score_differs' END AS rule FROM episodes
WHERE (task = 'identity' AND q = 3) OR (d = 2)""")
def _(spark, sf):
    stored = standins.episodes(spark, sf).withColumn("score", F.col("verdict").eqNullSafe(F.col("source_label")))
    rescored = stored.filter("NOT (task = 'identity' AND q = 3)").withColumn("score", F.when(F.col("d") == 2, ~F.col("score")).otherwise(F.col("score")))
    return checks.check_rescore(stored, rescored, ["model", "arm", "pk"], "score")


@query("check_same_start", "SELECT o_custkey, 'initial_input_differs' AS rule FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def _(spark, sf):
    return checks.check_same_start(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")
