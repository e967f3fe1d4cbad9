"""Queries of the finite-world operators: one bank per supplier, some of them with a known flaw."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.evidence import annotation_image_sets, links_complete, minimal_image_sets
from ..functions.geometry import box_coverage, region_match
from ..operators import worlds as ops
from ..session import materialize
from ..skew import shuffled
from . import standins
from .queries_functions import DECISIONS_SQL, H, _area, _inter, _iou, _union
from .queries_stats import rounded
from .registry import query, table
from .standins import CASES_SQL

VIEW_LIST = "['reference', 'initial', 'original', 'front_survey', 'rear_left', 'rear_center', 'rear_right']"
FLAW = "bank % 9"
SIG = """CASE view WHEN 'front_survey' THEN 'front' || CASE WHEN flaw = 1 THEN world_id WHEN flaw = 2 THEN permutation {div} 2 ELSE permutation END
  WHEN 'rear_left' THEN 'l' || CASE WHEN flaw = 3 THEN 0 ELSE states % 2 END WHEN 'rear_center' THEN 'c' || (states {div} 2 % 2) WHEN 'rear_right' THEN 'r' || (states {div} 4 % 2)
  WHEN 'initial' THEN CASE WHEN flaw = 4 THEN 'i' || states ELSE 'i' END ELSE view END"""
META = "CASE WHEN flaw = 5 AND view = 'original' THEN 'm' || (world_id % 2) ELSE 'm' END"

GRID_SQL = """grid AS (SELECT bank, world_id, permutation, states, slot, CASE WHEN (states >> slot) % 2 = 1 THEN 'Supported' ELSE 'Refuted' END AS label,
    ['rear_left', 'rear_center', 'rear_right'][slot + 1] AS target
  FROM (SELECT s_suppkey AS bank, w::INTEGER AS world_id, (w // 8)::INTEGER AS permutation, (w % 8)::INTEGER AS states, [0, 0, 1, 2, 1, 2][w // 8 + 1] AS slot FROM supplier, unnest(range(48)) AS t(w)))"""
WORLDS_SQL = GRID_SQL + f""", worlds AS (SELECT bank, world_id, label, target, view, {SIG.format(div='//')} AS sig, {META} AS meta
  FROM (SELECT *, {FLAW} AS flaw FROM grid), unnest({VIEW_LIST}) AS t(view) WHERE NOT (flaw = 6 AND world_id = 7))"""
# World pairs that a set of views cannot tell apart, counted directly instead of with masks.
IDENT_SQL = WORLDS_SQL + """, subsets AS (SELECT s, list_filter(['original', 'front_survey', 'rear_left', 'rear_center', 'rear_right'], lambda v, i: (s >> (i - 1)) % 2 = 1) AS vs FROM unnest(range(32)) AS t(s)),
obs AS (SELECT bank, world_id, label, target, list(sig ORDER BY view) AS sigs, list(view ORDER BY view) AS vw FROM worlds GROUP BY ALL),
keys AS (SELECT bank, world_id, label, target, s, len(vs) AS size, array_to_string([sigs[list_position(vw, v)] for v in list_concat(['reference', 'initial'], vs)], ',') AS k, vs FROM obs, subsets),
ident AS (SELECT *, count(DISTINCT label) OVER (PARTITION BY bank, s, k) = 1 AS one, count(*) OVER (PARTITION BY bank, s, k) AS n FROM keys)"""


def worlds(spark, sf):
    grid = ops.world_grid(table(spark, sf, "supplier"), "s_suppkey").withColumn("flaw", F.expr(FLAW)).filter("NOT (flaw = 6 AND world_id = 7)")
    full = grid.withColumn("view", F.explode(F.array(*[F.lit(v) for v in ops.VIEWS])))
    return full.select("bank", "world_id", "label", "target", "view", F.expr(SIG.format(div="div")).alias("sig"), F.expr(META).alias("meta"))


@query("world_grid", f"WITH {GRID_SQL} SELECT bank, world_id, permutation, states, label, target FROM grid")
def _(spark, sf):
    return ops.world_grid(table(spark, sf, "supplier"), "s_suppkey")


@query("grid_problems", "SELECT s_suppkey AS bank, CASE WHEN s_suppkey % 9 = 6 OR s_nationkey = 3 THEN 'wrong_world_count' WHEN s_nationkey = 4 THEN 'missing_view' ELSE 'repeated_view' END AS rule FROM supplier WHERE s_nationkey IN (3, 4, 5) OR s_suppkey % 9 = 6")
def _(spark, sf):
    nation = table(spark, sf, "supplier").selectExpr("s_suppkey AS bank", "s_nationkey AS n")
    full = worlds(spark, sf).join(shuffled(nation), "bank")
    kept = full.filter("NOT (n = 3 AND world_id = 7) AND NOT (n = 4 AND world_id = 7 AND view = 'original')")
    return ops.grid_problems(kept.unionByName(full.filter("n = 5 AND world_id = 7 AND view = 'original'")))


HISTORY_SQL = WORLDS_SQL + """, episodes AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS bank, (l_partkey % 48)::INTEGER AS world_id, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*100) AS BIGINT) AS d FROM lineitem),
seen AS (SELECT *, list_filter(['reference', 'initial', CASE WHEN d % 2 = 1 THEN 'front_survey' END, CASE q % 4 WHEN 1 THEN 'rear_left' WHEN 2 THEN 'rear_center' WHEN 3 THEN 'rear_right' END], lambda v: v IS NOT NULL) AS vs FROM episodes),
kinds AS (SELECT DISTINCT bank, world_id, vs FROM seen), fit AS (SELECT k.bank, k.world_id, k.vs, b.world_id AS w, b.label FROM (SELECT *, unnest(vs) AS view FROM kinds) k JOIN worlds a ON a.bank = k.bank AND a.world_id = k.world_id AND a.view = k.view
  JOIN worlds b ON b.bank = k.bank AND b.view = k.view AND b.sig = a.sig GROUP BY ALL HAVING count(*) = len(k.vs)),
compat AS (SELECT bank, world_id, vs, count(*) AS worlds, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE 'Need more evidence' END AS verdict FROM fit GROUP BY 1, 2, 3)"""


def seen_episodes(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS ok", "l_linenumber AS ln", "l_partkey AS pk", "l_suppkey AS bank", "CAST(l_partkey % 48 AS INT) AS world_id", "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_discount*100) AS BIGINT) AS d"
    ).withColumn("views", F.expr(
        "array_compact(array('reference', 'initial', CASE WHEN d % 2 = 1 THEN 'front_survey' END, CASE q % 4 WHEN 1 THEN 'rear_left' WHEN 2 THEN 'rear_center' WHEN 3 THEN 'rear_right' END))"
    ))


@query("compatible_worlds", f"""WITH {HISTORY_SQL} SELECT bank, world_id, array_to_string(vs, ',') AS views, worlds, verdict, verdict <> 'Need more evidence' AS identified, count(*) AS episodes FROM seen JOIN compat USING (bank, world_id, vs) GROUP BY ALL""")
def _(spark, sf):
    w = worlds(spark, sf)
    # Equal histories are one history: what was seen of a world, counted.
    kinds = seen_episodes(spark, sf).withColumn("views", F.array_join("views", ",")).groupBy("bank", "world_id", "views").agg(F.count("*").alias("episodes"))
    history = kinds.withColumn("view", F.explode(F.split("views", ","))).join(shuffled(w.select("bank", "world_id", "view", "sig")), ["bank", "world_id", "view"])
    out = ops.compatible_worlds(history, w, ["world_id", "views", "episodes"])
    return out.select("bank", "world_id", "views", F.col("worlds").cast("bigint").alias("worlds"), "verdict", "identified", "episodes")


CERTIFY_SQL = f"""flawed AS (SELECT s_suppkey AS bank, s_suppkey % 9 AS flaw FROM supplier), certified AS (
  SELECT bank, 'metadata_leak' AS rule FROM worlds GROUP BY bank, view HAVING count(DISTINCT meta) > 1
  UNION SELECT bank, 'static_view_varies' FROM worlds WHERE view IN ('reference', 'initial', 'original') GROUP BY bank, view HAVING count(DISTINCT sig) > 1
  UNION SELECT bank, 'front_view_leak' FROM worlds WHERE view = 'front_survey' GROUP BY bank, world_id // 8 HAVING count(DISTINCT sig) > 1
  UNION SELECT bank, 'front_view_leak' FROM worlds WHERE view = 'front_survey' GROUP BY bank HAVING count(DISTINCT sig) <> 6
  UNION SELECT bank, 'rear_view_leak' FROM (SELECT *, ((world_id % 8) >> (CASE view WHEN 'rear_left' THEN 0 WHEN 'rear_center' THEN 1 ELSE 2 END)) % 2 AS st FROM worlds WHERE view LIKE 'rear%') GROUP BY bank, view, st HAVING count(DISTINCT sig) > 1
  UNION SELECT bank, 'rear_view_leak' FROM worlds WHERE view LIKE 'rear%' GROUP BY bank, view HAVING count(DISTINCT sig) < 2
  UNION SELECT bank, 'wrong_world_count' FROM worlds GROUP BY bank HAVING count(DISTINCT world_id) <> 48
  UNION SELECT bank, 'initial_identifies' FROM ident WHERE s = 0 AND one
  UNION SELECT bank, 'single_request_identifies' FROM ident WHERE size = 1 AND one
  UNION SELECT bank, 'second_view_is_not_target' FROM (SELECT bank, world_id, target, list(coalesce(vs[1], '') || '+' || coalesce(vs[2], '') ORDER BY s) FILTER (one) AS good, bool_or(one AND len(vs) = 1) AS single FROM ident WHERE list_contains(vs, 'front_survey') AND size <= 2 GROUP BY 1, 2, 3)
    WHERE single OR good IS DISTINCT FROM ['front_survey+' || target])"""


@query("certify_bank", f"WITH {IDENT_SQL}, {CERTIFY_SQL} SELECT * FROM certified")
def _(spark, sf):
    return ops.certify_bank(worlds(spark, sf))


@query("min_requests", f"WITH {IDENT_SQL} SELECT bank, world_id, label, min(size) FILTER (one)::INTEGER AS min_requests FROM ident GROUP BY 1, 2, 3")
def _(spark, sf):
    return ops.min_requests(ops.world_views(worlds(spark, sf))).select("bank", "world_id", "label", "min_requests")


@query("fixed_view_rate", f"""WITH {IDENT_SQL}, r AS (SELECT bank, vs[1] || '+' || vs[2] AS pair, round(avg(one::INTEGER), 6) AS rate FROM ident WHERE size = 2 GROUP BY 1, 2)
SELECT *, rate = max(rate) OVER (PARTITION BY bank) AS is_best FROM r""")
def _(spark, sf):
    return rounded(ops.fixed_view_rate(worlds(spark, sf)), "rate")


def _nib(pos: int, digits: int) -> str:
    return f"('0x' || substr(h, {pos}, {digits}))::BIGINT"


PAIRED_SQL = f"""banks AS (SELECT s_suppkey AS bank, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, {H.format(salt='7', x='s_suppkey')} AS h FROM supplier),
p AS (SELECT *, [0, 0, 1][i % 3 + 1] AS lft, [1, 2, 2][i % 3 + 1] AS rgt FROM banks),
s AS (SELECT *, CASE WHEN lft = 0 THEN i % 2 WHEN rgt = 0 THEN 1 - i % 2 ELSE {_nib(1, 1)} % 2 END AS s0, CASE WHEN lft = 1 THEN i % 2 WHEN rgt = 1 THEN 1 - i % 2 ELSE {_nib(2, 1)} % 2 END AS s1,
  CASE WHEN lft = 2 THEN i % 2 WHEN rgt = 2 THEN 1 - i % 2 ELSE {_nib(3, 1)} % 2 END AS s2 FROM p),
m AS (SELECT *, CASE WHEN member = 0 THEN lft ELSE rgt END AS pos, ({_nib(10, 8)} + member) % 2 AS which FROM s, unnest([0, 1]) AS t(member))"""


@query("paired_world_cases", f"""WITH {PAIRED_SQL}
SELECT bank, member, ([[0, 1], [2, 4], [3, 5]][pos + 1][which + 1] * 8 + s0 + 2 * s1 + 4 * s2)::INTEGER AS world_id, CASE WHEN [s0, s1, s2][pos + 1] = 1 THEN 'Supported' ELSE 'Refuted' END AS label,
  ['rear_left', 'rear_center', 'rear_right'][pos + 1] AS target FROM m""")
def _(spark, sf):
    return ops.paired_world_cases(table(spark, sf, "supplier"), "s_suppkey", 7)


# ---------------------------------------------------------------- schedules



def schedule_cases(spark, sf):
    cases = standins.cases(spark, sf).withColumn("case_id", F.concat_ws("-", "family_id", F.lit("Obtainable")))
    size = F.expr("CASE WHEN pk % 4 = 1 THEN array(20L, 16L) ELSE array(100L, 80L) END")
    evidence = F.transform("evidence", lambda e: e.withField("display_size", F.when(e["id"] == "b-preview", size).otherwise(e["source_size"])))
    return cases.withColumn("evidence", evidence)


VIEWS3 = "['original', 'side', 'rear']"


def product_sql(views: str, extra: str = "") -> str:
    return f"""SELECT family_id, (row_number() OVER (PARTITION BY family_id ORDER BY {extra or 'ti, vi'}) - 1)::INTEGER AS ordinal, 'target' AS object, ['before', 'after'][ti] AS time, {VIEWS3}[vi] AS view
FROM (SELECT pk, family_id FROM cases), unnest([1, 2]) AS a(ti), unnest({views}) AS b(vi)"""


@query("request_schedule_fixed_order", f"WITH {CASES_SQL} {product_sql('[1, 2, 3]')}")
def _(spark, sf):
    return ops.request_schedule(schedule_cases(spark, sf), "fixed_order", 0, ["family_id"])


@query("request_schedule_fixed_original", f"WITH {CASES_SQL} {product_sql('[1]')}")
def _(spark, sf):
    return ops.request_schedule(schedule_cases(spark, sf), "fixed_original", 0, ["family_id"])


RANDOM_KEY = f"sha256('5|' || family_id || '|target|' || ['before', 'after'][ti] || '|' || {VIEWS3}[vi])"


@query("request_schedule_random_order", f"WITH {CASES_SQL} {product_sql('[1, 2, 3]', RANDOM_KEY)}")
def _(spark, sf):
    return ops.request_schedule(schedule_cases(spark, sf), "random_order", 5, ["family_id"])


@query("request_schedule_restore_preview", f"WITH {CASES_SQL} SELECT family_id, 0 AS ordinal, 'target' AS object, 'before' AS time, CASE WHEN pk % 8 = 1 THEN 'side' ELSE 'original' END AS view FROM cases WHERE pk % 4 = 1")
def _(spark, sf):
    fewer = F.when(F.col("pk") % 8 == 1, F.array(F.lit("side"), F.lit("rear"))).otherwise(F.col("request_options.views"))
    cases = schedule_cases(spark, sf).withColumn("request_options", F.col("request_options").withField("views", fewer))
    return ops.request_schedule(cases, "restore_preview", 0, ["family_id"])


# Each letter is an image with a request of its own; b, c and d are offered in this order.
GUIDED_SQL = CASES_SQL + """, ways AS (SELECT *, unnest(CASE WHEN verdict = 'Supported' THEN ['c', 'bc', 'bd', 'cd'] WHEN verdict = 'Refuted' THEN list_concat(CASE WHEN t1 = 'Refuted' THEN ['b', 'c'] ELSE [] END, CASE WHEN t2 = 'Refuted' THEN ['c', 'd'] ELSE [] END) END) AS s FROM cases),
open AS (SELECT family_id, CASE WHEN c_initial THEN replace(s, 'c', '') ELSE s END AS p FROM ways WHERE (b_ok OR NOT contains(s, 'b')) AND (c_ok OR c_initial OR NOT contains(s, 'c')) AND (d_ok OR NOT contains(s, 'd'))),
way AS (SELECT family_id, arg_min(p, (len(p), p)) AS p FROM open GROUP BY 1)"""


@query("request_schedule_annotation_guided", f"""WITH {GUIDED_SQL} SELECT family_id, (i - 1)::INTEGER AS ordinal, 'target' AS object, 'before' AS time,
  CASE p[i] WHEN 'b' THEN 'original' WHEN 'c' THEN 'side' ELSE 'rear' END AS view FROM way, unnest(range(1, len(p) + 1)) AS x(i)""")
def _(spark, sf):
    targets = minimal_image_sets(F.col("annotation"))
    return ops.request_schedule(schedule_cases(spark, sf), "annotation_guided", 0, ["family_id"], targets, budget=30, price=3, max_turns=8)


# Requests for each target set, infinite when an image of it is unavailable.
PATH_SQL = CASES_SQL + """, cost AS (SELECT *, CASE WHEN b_ok THEN 1 END AS b, CASE WHEN c_initial THEN 0 WHEN c_ok THEN 1 END AS c, CASE WHEN d_ok THEN 1 END AS d FROM cases),
sets AS (SELECT pk, family_id, unnest(CASE WHEN verdict = 'Supported' THEN [c, b + c, b + d, c + d] WHEN verdict = 'Refuted' THEN list_concat(CASE WHEN t1 = 'Refuted' THEN [b, c] ELSE [] END, CASE WHEN t2 = 'Refuted' THEN [c, d] ELSE [] END) END) AS n FROM cost),
best AS (SELECT family_id, min(n) AS n FROM sets GROUP BY 1), plan AS (SELECT family_id, task, n FROM cases LEFT JOIN best USING (family_id))"""


@query("shortest_request_path", f"WITH {PATH_SQL} SELECT family_id, coalesce(n <= 1, false) AS reachable, CASE WHEN n <= 1 THEN n END::INTEGER AS requests FROM plan")
def _(spark, sf):
    cases = schedule_cases(spark, sf)
    plan = ops.shortest_requests(annotation_image_sets(F.col("annotation")), F.lit(5), price=3, max_turns=8)
    return cases.withColumn("p", plan).select("family_id", "p.reachable", "p.requests")


@query("schedule_audit", f"WITH {PATH_SQL} SELECT task, b AS budget, count(*) AS cases, count(*) FILTER (n <= b // 3) AS reachable, sum(n) FILTER (n <= b // 3)::BIGINT AS requests, max(n) FILTER (n <= b // 3)::INTEGER AS most_requests FROM plan, unnest([0, 3, 6]) AS t(b) GROUP BY 1, 2")
def _(spark, sf):
    return ops.schedule_audit(schedule_cases(spark, sf), annotation_image_sets(F.col("annotation")), [0, 3, 6], ["task"], price=3, max_turns=8)


@query("schedules_equal", f"WITH {CASES_SQL} SELECT family_id, false AS equal_calls FROM cases")
def _(spark, sf):
    cases = schedule_cases(spark, sf)
    fixed, original = (ops.request_schedule(cases, p, 0, ["family_id"]) for p in ("fixed_order", "fixed_original"))
    return ops.schedules_equal(fixed, original, ["family_id"])


# ---------------------------------------------------------------- scoring

SCORE_SQL = IDENT_SQL + ", " + HISTORY_SQL.replace(WORLDS_SQL + ", ", "") + f""", {CERTIFY_SQL}, mins AS (SELECT bank, world_id, label, min(size) FILTER (one) AS m_all, min(size) FILTER (one AND NOT list_contains(vs, 'rear_center') AND NOT list_contains(vs, 'rear_right')) AS m_few FROM ident GROUP BY 1, 2, 3), {DECISIONS_SQL}, facts AS (
  SELECT ok, ln, pk, sk AS bank, (pk % 48)::INTEGER AS world_id, q, d, CASE WHEN q % 11 = 0 THEN NULL ELSE verdict END AS v, d <> 8 AS cited, has_link AND link_ok AS links, {_union('t')} / ({_area('t')} + 0.0) AS cov,
    {_iou('t', 'p')} >= 0.25 AND {_inter('t', 'p')} / ({_area('p')} + 0.0) >= 0.25 AND {_inter('t', 'p')} / ({_area('t')} + 0.0) >= 0.5 AS localized,
    list_filter(['reference', 'initial', CASE WHEN d % 2 = 1 THEN 'front_survey' END, CASE q % 4 WHEN 1 THEN 'rear_left' WHEN 2 THEN 'rear_center' WHEN 3 THEN 'rear_right' END, CASE WHEN d = 9 THEN 'original' END], lambda x: x IS NOT NULL) AS vs FROM decisions),
j AS (SELECT f.*, m.label, CASE WHEN q % 6 = 0 THEN m_few ELSE m_all END AS m, CASE WHEN d = 7 THEN 1 ELSE 2 END AS cap, c.worlds, c.verdict AS cur, CASE WHEN m.label IS NULL THEN 'unknown_world' WHEN f.bank IN (SELECT bank FROM certified) THEN 'bank_not_certified' WHEN d = 10 THEN 'observation_mismatch' WHEN q % 6 = 0 AND (q % 4 = 2 OR q % 4 = 3) THEN 'unavailable_observation' WHEN len(f.vs) - 2 > CASE WHEN d = 7 THEN 1 ELSE 2 END THEN 'too_many_requests' END AS err
  FROM facts f LEFT JOIN mins m USING (bank, world_id) LEFT JOIN compat c ON c.bank = f.bank AND c.world_id = f.world_id AND c.vs = list_filter(f.vs, lambda x: x <> 'original')),
k AS (SELECT *, err IS NULL AS good, CASE WHEN m <= cap THEN label ELSE 'Need more evidence' END AS expected FROM j),
l AS (SELECT *, good AND v IS NOT NULL AND cited AND v = expected AS target, coalesce(good AND cur <> 'Need more evidence', false) AS enough FROM k),
n AS (SELECT *, target AND (v = 'Need more evidence' OR (enough AND links AND cov >= CASE WHEN label = 'Supported' THEN 0.5 ELSE 0.9 END)) AS chain FROM l)"""


@query("score_search", f"""WITH {SCORE_SQL}
SELECT ok, ln, pk, err AS audit_error, CASE WHEN good THEN worlds END AS compatible_worlds, CASE WHEN good THEN len(vs) - 2 END AS acquired, good AND v IS NOT NULL AS schema_valid_finish, coalesce(good AND cited AND v = label, false) AS source_label_correct,
  coalesce(target, false) AS episode_target_correct, coalesce(good AND cited AND v = cur, false) AS decision_matches_current_evidence, enough AS evidence_found, coalesce(chain, false) AS chain_grounded_correct, coalesce(chain AND (localized OR v = 'Need more evidence'), false) AS localized_grounded_correct,
  coalesce(chain AND v <> 'Need more evidence' AND NOT localized, false) AS unlocalized_definite, coalesce(good AND v <> 'Need more evidence' AND NOT coalesce(chain, false), false) AS unsupported_decision FROM n""")
def _(spark, sf):
    w = materialize(worlds(spark, sf), "worlds")
    out = ops.score_search(search_episodes(spark, sf, w), w, ["ok", "ln", "pk"])
    return out.withColumn("compatible_worlds", F.col("compatible_worlds").cast("bigint"))


def search_episodes(spark, sf, w):
    region = F.struct(F.lit("img-a").alias("image_id"), F.col("t").alias("bbox"), F.lit("before").alias("time"))
    cite = F.get("citations", F.lit(0))
    decided = standins.decisions(spark, sf).select(
        "ok", "ln", "pk", F.col("sk").alias("bank"), F.expr("CAST(pk % 48 AS INT)").alias("world_id"), "q", "d",
        F.expr("CASE WHEN q % 11 = 0 THEN NULL ELSE verdict END").alias("verdict"), (F.col("d") != 8).alias("citations_valid"),
        links_complete(F.array("expected"), F.col("links")).alias("links_complete"), box_coverage(F.col("t"), F.array("p", "s")).alias("coverage"),
        region_match(region, cite, F.lit("defect")).alias("localized"),
        F.expr("array_compact(array('reference', 'initial', CASE WHEN d % 2 = 1 THEN 'front_survey' END, CASE q % 4 WHEN 1 THEN 'rear_left' WHEN 2 THEN 'rear_center' WHEN 3 THEN 'rear_right' END, CASE WHEN d = 9 THEN 'original' END))").alias("views"),
    )
    few = F.expr("CASE WHEN q % 6 = 0 THEN array('original', 'front_survey', 'rear_left') END")
    decided = decided.withColumn("available_views", few).withColumn("cap", F.when(F.col("d") == 7, 1).otherwise(2))
    sigs = w.groupBy("bank", "world_id").agg(F.map_from_entries(F.collect_list(F.struct("view", "sig"))).alias("sigs"))
    observed = F.transform("views", lambda v: F.struct(v.alias("view"), F.when(F.col("d") == 10, "odd").otherwise(F.try_element_at("sigs", v)).alias("sig")))
    return decided.join(shuffled(sigs), ["bank", "world_id"], "left").withColumn("observed", observed)


# Requests needed from another start: cases also start with the front survey, with the left rear view, or with both.
@query("min_requests_initial", f"""WITH {IDENT_SQL}, starts AS (SELECT unnest([['front_survey'], ['rear_left'], ['front_survey', 'rear_left']]) AS start)
SELECT bank, world_id, array_to_string(start, '+') AS start, min(CASE WHEN one THEN len(list_filter(vs, lambda v: NOT list_contains(start, v))) END)::INTEGER AS min_requests
FROM ident, starts WHERE len(list_filter(start, lambda v: NOT list_contains(vs, v))) = 0 GROUP BY bank, world_id, start""")
def _(spark, sf):
    start = F.array(*[F.array(*[F.lit(v) for v in x]) for x in (["front_survey"], ["rear_left"], ["front_survey", "rear_left"])])
    views = ops.world_views(worlds(spark, sf)).withColumn("start", F.explode(start))
    views = views.withColumn("initial_views", F.concat(F.array(*[F.lit(v) for v in ops.INITIAL_VIEWS]), "start"))
    out = ops.min_requests(views, initial=F.col("initial_views"))
    return out.select("bank", "world_id", F.array_join("start", "+").alias("start"), "min_requests")


# The same episodes, of which every third starts with the front survey as well.
START_SQL = SCORE_SQL.replace("mins AS (SELECT bank, world_id, label, min(size) FILTER (one) AS m_all", """mins AS (SELECT bank, world_id, label,
  min(size - 1) FILTER (one AND list_contains(vs, 'front_survey')) AS f_all, min(size - 1) FILTER (one AND list_contains(vs, 'front_survey') AND NOT list_contains(vs, 'rear_center') AND NOT list_contains(vs, 'rear_right')) AS f_few, min(size) FILTER (one) AS m_all""")
START_SQL = START_SQL.replace("CASE WHEN q % 6 = 0 THEN m_few ELSE m_all END AS m,", "CASE WHEN pk % 3 = 0 THEN CASE WHEN q % 6 = 0 THEN f_few ELSE f_all END WHEN q % 6 = 0 THEN m_few ELSE m_all END AS m, 2 + CAST(pk % 3 = 0 AS INTEGER) AS base,")
START_SQL = START_SQL.replace("WHEN len(f.vs) - 2 > CASE", "WHEN pk % 3 = 0 AND d % 2 = 0 THEN 'initial_missing' WHEN len(f.vs) - 2 - CAST(pk % 3 = 0 AS INTEGER) > CASE")


@query("score_search_initial", f"""WITH {START_SQL}
SELECT ok, ln, pk, err AS audit_error, CASE WHEN good THEN worlds END AS compatible_worlds, CASE WHEN good THEN len(vs) - base END AS acquired,
  coalesce(target, false) AS episode_target_correct, coalesce(chain, false) AS chain_grounded_correct FROM n""")
def _(spark, sf):
    w = materialize(worlds(spark, sf), "worlds")
    usual = F.array(*[F.lit(v) for v in ops.INITIAL_VIEWS])
    episodes = search_episodes(spark, sf, w).withColumn("initial_views", F.when(F.col("pk") % 3 == 0, F.array_append(usual, F.lit("front_survey"))))
    out = ops.score_search(episodes, w, ["ok", "ln", "pk"]).withColumn("compatible_worlds", F.col("compatible_worlds").cast("bigint"))
    return out.select("ok", "ln", "pk", "audit_error", "compatible_worlds", "acquired", "episode_target_correct", "chain_grounded_correct")
