"""Queries of review, consensus and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.evidence import VARIANTS
from ..operators import curation, review, training
from ..schemas import REQ, SUBCLAIM
from . import standins
from .queries_functions import DECISIONS_SQL, H
from .queries_stats import rounded
from .registry import query, table
from .standins import CASES_SQL, EPISODES_SQL, VOTES_SQL, pool_sql

POOL_FULL = pool_sql("b_ok", "c_ok", "d_ok")
POOL_HELD = pool_sql("false", "c_ok", "d_ok")
INIT_SHOWN = pool_sql("true", "c_initial", "false")
INIT_HELD = pool_sql("false", "c_initial", "false")


def review_votes(spark, sf):
    """One or two votes per part; the second vote adds alternatives, and some pairs disagree in known ways."""
    cases = standins.cases(spark, sf).selectExpr(
        "*", "pk % 4 <> 0 AS b_ok", "pk % 3 <> 0 AS c_ok", "pk % 5 <> 0 AS d_ok", "pk % 6 = 1 AS c_initial"
    )
    nth = F.explode(F.expr("CASE WHEN pk % 8 = 0 THEN array(1) ELSE array(1, 2) END"))
    df = cases.withColumn("nth", nth)

    def maps(sufficient, obtainable, missing, unavailable):
        return F.create_map(*[v for name, sql in zip(VARIANTS, (sufficient, obtainable, missing, unavailable)) for v in (F.lit(name), F.expr(sql))])

    wrong = F.expr("CASE WHEN pk % 8 = 3 AND nth = 2 THEN 'Supported' WHEN pk % 8 = 5 THEN 'Need more evidence' END")
    pool = maps(POOL_FULL, POOL_FULL, POOL_HELD, POOL_HELD)
    pool = F.transform_values(pool, lambda k, v: F.when(k == "Obtainable", F.coalesce(wrong, v)).otherwise(v))
    sets = f"map<string,array<array<{REQ}>>>"

    def part(sub):
        groups = F.get(F.map_values(sub["minimal_evidence_sets"]), F.lit(0))
        cut = F.when(sub["id"] == "s1", F.slice(groups, F.col("nth"), F.lit(1))).otherwise(F.slice(groups, F.lit(1), F.col("nth")))
        return sub.withField("minimal_evidence_sets", F.when(groups.isNull(), F.create_map().cast(sets)).otherwise(F.create_map(sub["truth"], cut)))

    flipped = F.expr("CASE WHEN pk % 8 = 4 AND nth = 2 THEN true ELSE false END")
    subs = F.transform("annotation.subclaims", part)
    renamed = F.transform(subs, lambda s: s.withField("kind", F.when(flipped, F.lit("other")).otherwise(s["kind"])))
    annotation = F.col("annotation").withField("subclaims", renamed.cast(f"array<{SUBCLAIM}>"))
    return df.select(
        "family_id", "pk", "nth", F.lit("visual-review-v1").alias("protocol"), F.lit("human").alias("reviewer_type"),
        F.expr("CASE WHEN pk % 8 = 1 THEN 'r1' ELSE 'r' || nth END").alias("reviewer_id"), F.lit("seen").alias("reason"), F.sha2(F.lit("d"), 256).alias("dataset_sha256"),
        F.expr("NOT (pk % 8 = 2 AND nth = 2)").alias("claim_clear"), F.lit(True).alias("alternatives_checked"),
        maps(INIT_SHOWN, INIT_HELD, INIT_HELD, INIT_HELD).alias("initial_verdicts"), pool.alias("pool_verdicts"), annotation.alias("annotation"),
    )


MERGED_SQL = f"""{CASES_SQL}, merged AS (SELECT *, CASE WHEN pk % 8 IN (0, 1) THEN 'two_reviewers_needed' WHEN pk % 8 = 2 THEN 'unclear_or_unchecked'
  WHEN pk % 8 = 3 AND {POOL_FULL} <> 'Supported' THEN 'verdicts_differ' WHEN pk % 8 = 4 THEN 'subclaim_truths_differ' END AS reason FROM cases)"""


@query("validate_votes", f"""WITH {CASES_SQL}
SELECT family_id, n AS nth, CASE pk % 9 WHEN 1 THEN 'reviewer' WHEN 2 THEN 'reason' WHEN 3 THEN 'dataset' WHEN 4 THEN 'claim_clear' WHEN 5 THEN 'protocol' WHEN 6 THEN 'initial_verdicts' WHEN 7 THEN 'verdict_disagrees' ELSE '' END AS errors
FROM cases, unnest([1, 2]) AS t(n) WHERE n = 1 OR pk % 8 > 0""")
def _(spark, sf):
    bad = review_votes(spark, sf).withColumns({
        "reviewer_id": F.expr("CASE WHEN pk % 9 = 1 THEN '  ' ELSE reviewer_id END"), "reason": F.expr("CASE WHEN pk % 9 = 2 THEN '' ELSE reason END"),
        "dataset_sha256": F.expr("CASE WHEN pk % 9 = 3 THEN 'x' ELSE dataset_sha256 END"), "claim_clear": F.expr("CASE WHEN pk % 9 = 4 THEN null ELSE claim_clear END"),
        "protocol": F.expr("CASE WHEN pk % 9 = 5 THEN 'v0' ELSE protocol END"), "initial_verdicts": F.expr("CASE WHEN pk % 9 = 6 THEN map('Missing', 'Supported') ELSE initial_verdicts END"),
        "annotation": F.col("annotation").withField("verdict", F.expr("CASE WHEN pk % 9 = 7 THEN 'Maybe' ELSE annotation.verdict END")),
    })
    return bad.select("family_id", "nth", F.array_join(review.vote_errors(), ",").alias("errors"))


@query("validate_truth_votes", f"""WITH {VOTES_SQL}
SELECT family_id, ln, pk, CASE d WHEN 0 THEN 'protocol' WHEN 1 THEN 'scope' WHEN 2 THEN 'reviewer' WHEN 3 THEN 'availability_fields' WHEN 4 THEN 'verdict' ELSE '' END AS errors FROM votes""")
def _(spark, sf):
    df = standins.votes(spark, sf).withColumns({
        "protocol": F.expr("CASE WHEN d = 0 THEN 'v1' ELSE 'visual-truth-review-v3' END"), "scope": F.expr("CASE WHEN d = 1 THEN 'other' ELSE 'full_pool_only' END"),
        "reviewer_type": F.expr("CASE WHEN d = 2 THEN 'model' ELSE 'human' END"), "dataset_sha256": F.sha2(F.lit("d"), 256), "verdict": F.expr("CASE WHEN d = 4 THEN 'Yes' ELSE verdict END"),
        "initial_verdicts": F.expr("CASE WHEN d = 3 THEN map('Missing', 'Supported') END"), "pool_verdicts": F.expr("CAST(null AS map<string,string>)"),
    })
    return df.select("family_id", "ln", "pk", F.array_join(review.truth_vote_errors(), ",").alias("errors"))


@query("truth_consensus", f"""WITH {VOTES_SQL}, g AS (SELECT family_id, count(*) AS votes, count(DISTINCT reviewer_id) AS r, bool_and(claim_clear) AS c, count(DISTINCT verdict) AS v, min(verdict) AS verdict FROM votes GROUP BY 1)
SELECT family_id, votes, CASE WHEN votes = 2 AND r = 2 AND c AND v = 1 THEN verdict END AS verdict, CASE WHEN votes <> 2 OR r <> 2 THEN 'two_reviewers_needed' WHEN NOT c THEN 'claim_unclear' WHEN v > 1 THEN 'verdicts_differ' END AS reason FROM g""")
def _(spark, sf):
    return review.truth_consensus(standins.votes(spark, sf), "family_id")


@query("merge_votes", f"""WITH {MERGED_SQL}
SELECT family_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN t2 = 'uncertain' THEN 'b+ref|c+ref' ELSE 'b+ref|c+ref||ref+d|c' END END AS alternatives FROM merged""")
def _(spark, sf):
    out = review.merge_votes(review_votes(spark, sf), "nth")

    def ids(r):
        return F.when(r["relation"].isNotNull(), F.concat_ws("+", r["left"]["image_id"], r["right"]["image_id"])).otherwise(r["image_id"])

    def groups(s):
        sets = F.get(F.map_values(s["minimal_evidence_sets"]), F.lit(0))
        return F.array_join(F.transform(sets, lambda g: F.array_join(F.transform(g, ids), "+")), "|")

    text = F.array_join(F.filter(F.transform("merged.subclaims", groups), lambda t: t.isNotNull()), "||")
    return out.select("family_id", "reason", F.when(F.col("reason").isNull(), text).alias("alternatives"))


@query("admit", f"""WITH {MERGED_SQL}, v AS (SELECT *, CASE WHEN variant = 'Sufficient' THEN {INIT_SHOWN} ELSE {INIT_HELD} END AS ri, CASE WHEN variant = 'Missing' OR variant = 'Unavailable' THEN {POOL_HELD} ELSE {POOL_FULL} END AS rp,
  reason IS NULL AND (pk % 8 = 5 AND {POOL_FULL} <> 'Need more evidence') AS wrong FROM merged, unnest(['Sufficient', 'Obtainable', 'Missing', 'Unavailable']) AS t(variant))
SELECT family_id || '-' || variant AS case_id, variant AS release_configuration, coalesce(reason, CASE WHEN wrong THEN 'unexplained_verdicts' END) AS reason,
  CASE WHEN reason IS NULL AND NOT wrong THEN CASE WHEN ri <> 'Need more evidence' THEN 'Sufficient' WHEN rp <> 'Need more evidence' THEN 'Obtainable' WHEN verdict = 'Need more evidence' THEN 'Underdetermined'
    WHEN NOT (CASE variant WHEN 'Missing' THEN true WHEN 'Unavailable' THEN false ELSE b_ok END AND c_ok AND d_ok) THEN 'Unavailable' ELSE 'Missing' END END AS class FROM v""")
def _(spark, sf):
    cases = curation.expand_variants(standins.cases(spark, sf).drop("annotation", "verdict").withColumn("withheld", F.lit("b")))
    out = review.admit(cases, review_votes(spark, sf), "nth")
    return out.select("case_id", "release_configuration", "reason", F.col("variant").alias("class"))


@query("agreement", """WITH p AS (SELECT lang, quality AS a, toxic AS b FROM labels JOIN documents USING (doc_id)), n AS (SELECT lang, count(*) AS n, avg((a = b)::INTEGER) AS pa FROM p GROUP BY 1),
k AS (SELECT lang, v, count(*) AS m FROM (SELECT lang, a AS v FROM p UNION ALL SELECT lang, b FROM p) GROUP BY 1, 2), e AS (SELECT lang, sum((m / (2.0 * n)) ** 2) AS pe FROM k JOIN n USING (lang) GROUP BY 1)
SELECT lang, n, round(pa, 6) AS agreement, CASE WHEN pe < 1 THEN round((pa - pe) / (1 - pe), 6) END AS fleiss_kappa FROM n JOIN e USING (lang)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    pairs = table(spark, sf, "labels").join(docs, "doc_id")
    return rounded(review.agreement(pairs, ["lang"], "quality", "toxic"), "agreement", "fleiss_kappa")


ANSWERS_SQL = """answers AS (SELECT l_orderkey AS unit_id, 'r' || (l_suppkey % 7) AS reviewer_id, ['sufficient', 'insufficient', 'uncertain'][CAST(l_quantity AS BIGINT) % 3 + 1] AS sufficiency,
  CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN 'Supported' ELSE 'Need more evidence' END AS answer, round(l_tax*100) < 8 AS claim_clear, 'p' || (l_suppkey % 7) AS packet_id FROM lineitem),
adjudications AS (SELECT o_orderkey AS unit_id, 'r' || (o_custkey % 9) AS reviewer_id, ['sufficient', 'insufficient', 'uncertain'][o_custkey % 3 + 1] AS sufficiency, CASE o_custkey % 3 WHEN 0 THEN 'Refuted' ELSE 'Need more evidence' END AS answer, o_orderstatus <> 'P' AS claim_clear FROM orders)"""


def blind(spark, sf):
    answers = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS unit_id", "'r' || (l_suppkey % 7) AS reviewer_id", "array('sufficient', 'insufficient', 'uncertain')[CAST(l_quantity AS BIGINT) % 3] AS sufficiency",
        "CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN 'Supported' ELSE 'Need more evidence' END AS answer", "round(l_tax*100) < 8 AS claim_clear", "'p' || (l_suppkey % 7) AS packet_id",
    )
    third = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS unit_id", "'r' || (o_custkey % 9) AS reviewer_id", "array('sufficient', 'insufficient', 'uncertain')[o_custkey % 3] AS sufficiency",
        "CASE o_custkey % 3 WHEN 0 THEN 'Refuted' ELSE 'Need more evidence' END AS answer", "o_orderstatus <> 'P' AS claim_clear",
    )
    return answers, third


@query("blind_consensus", f"""WITH {ANSWERS_SQL}, u AS (SELECT unit_id, count(*) AS votes, count(DISTINCT reviewer_id) AS r, count(DISTINCT sufficiency) = 1 AND count(DISTINCT answer) = 1 AND bool_and(claim_clear) AND min(sufficiency) <> 'uncertain' AS ok,
  min(sufficiency) AS s, min(answer) AS a, list(reviewer_id) AS rs FROM answers GROUP BY 1),
st AS (SELECT *, CASE WHEN votes < 2 THEN 'waiting' WHEN votes > 2 OR r < 2 THEN 'invalid_votes' WHEN ok THEN 'consensus' ELSE 'queued' END AS state FROM u)
SELECT st.unit_id, votes, CASE WHEN state = 'queued' AND d.unit_id IS NOT NULL THEN 'adjudicated' ELSE state END AS state,
  CASE WHEN state = 'consensus' THEN s WHEN state = 'queued' THEN d.sufficiency END AS sufficiency, CASE WHEN state = 'consensus' THEN a WHEN state = 'queued' THEN d.answer END AS answer
FROM st LEFT JOIN adjudications d ON d.unit_id = st.unit_id AND d.claim_clear AND d.sufficiency <> 'uncertain' AND NOT list_contains(rs, d.reviewer_id)""")
def _(spark, sf):
    return review.blind_consensus(*blind(spark, sf))


@query("adjudication_problems", f"WITH {ANSWERS_SQL} SELECT unit_id, reviewer_id, 'not_independent' AS rule FROM adjudications d WHERE EXISTS (SELECT 1 FROM answers a WHERE a.unit_id = d.unit_id AND a.reviewer_id = d.reviewer_id)")
def _(spark, sf):
    answers, third = blind(spark, sf)
    return review.adjudication_problems(third, answers)


@query("packet_problems", f"""WITH {ANSWERS_SQL}, moved AS (SELECT * REPLACE (CASE WHEN sufficiency = 'uncertain' AND reviewer_id = 'r3' THEN 'r4' ELSE reviewer_id END AS reviewer_id) FROM answers),
want AS (SELECT 'p' || (o_custkey % 7) AS packet_id, o_orderkey AS unit_id FROM orders), got AS (SELECT packet_id, unit_id, count(*) AS n FROM moved GROUP BY 1, 2)
SELECT 'packet_id:' || packet_id AS key, 'packet_of_several_people' AS rule FROM moved GROUP BY packet_id HAVING count(DISTINCT reviewer_id) > 1
UNION ALL SELECT 'reviewer_id:' || reviewer_id, 'person_with_several_packets' FROM moved GROUP BY reviewer_id HAVING count(DISTINCT packet_id) > 1
UNION ALL SELECT 'unit:' || packet_id || ':' || unit_id, CASE WHEN n IS NULL THEN 'missing_answer' WHEN w IS NULL THEN 'unassigned_answer' ELSE 'repeated_answer' END
FROM (SELECT *, 1 AS w FROM want) FULL JOIN got USING (packet_id, unit_id) WHERE n IS NULL OR w IS NULL OR n > 1""")
def _(spark, sf):
    answers, _ = blind(spark, sf)
    moved = answers.withColumn("reviewer_id", F.expr("CASE WHEN sufficiency = 'uncertain' AND reviewer_id = 'r3' THEN 'r4' ELSE reviewer_id END"))
    assigned = table(spark, sf, "orders").selectExpr("'p' || (o_custkey % 7) AS packet_id", "o_orderkey AS unit_id")
    return review.packet_problems(moved, assigned)


@query("answer_problems", """WITH a AS (SELECT l_orderkey AS unit_id, l_linenumber AS packet_id, l_partkey % 9 AS v, l_suppkey % 2 AS w FROM lineitem)
SELECT packet_id, unit_id, CASE WHEN unit_id % 50 = 0 THEN 'unknown_unit' ELSE CASE v WHEN 1 THEN 'invalid_judgment' WHEN 2 THEN 'claim_clear_missing' WHEN 3 THEN 'invalid_citation' WHEN 4 THEN 'answer_contradicts_sufficiency'
  WHEN 5 THEN 'definite_without_citation' WHEN 6 THEN 'unknown_region' ELSE 'region_outside_image' END END AS rule FROM a WHERE unit_id % 50 = 0 OR v BETWEEN 1 AND 7""")
def _(spark, sf):
    region = "named_struct('image_id', CASE WHEN v = 6 THEN 'z' ELSE 'i0' END, 'bbox', CASE WHEN v <> 7 THEN array(0.1D, 0.2D, 0.5D, 1.0D) WHEN w = 0 THEN array(0.1D, 0.2D, 0.5D, 1.1D) ELSE array(0.1D, 0.2D) END)"
    answers = table(spark, sf, "lineitem").selectExpr("l_orderkey AS unit_id", "l_linenumber AS packet_id", "l_partkey % 9 AS v", "l_suppkey % 2 AS w").selectExpr(
        "unit_id", "packet_id", "CASE v WHEN 1 THEN CASE w WHEN 0 THEN 'maybe' END WHEN 4 THEN 'uncertain' WHEN 8 THEN 'insufficient' ELSE 'sufficient' END AS sufficiency",
        "CASE v WHEN 8 THEN 'Need more evidence' ELSE 'Refuted' END AS answer", "CASE WHEN v <> 2 THEN w = 0 END AS claim_clear",
        "CASE v WHEN 3 THEN CASE w WHEN 0 THEN array('i0', 'i0') ELSE array('q') END WHEN 5 THEN CASE w WHEN 0 THEN array() END ELSE array('i0') END AS citations",
        f"array({region}) AS regions",
    )
    units = table(spark, sf, "orders").filter("o_orderkey % 50 > 0").selectExpr("o_orderkey AS unit_id", "array('i0', 'i1') AS image_ids")
    return review.answer_problems(answers, units)


KINDS = "['initial', 'candidate_pool', 'resolution_control', 'blocked_pool']"


@query("material_gap", f"""WITH c AS (SELECT l_orderkey AS family_id, {KINDS}[l_linenumber % 4 + 1] AS unit, ['insufficient', 'sufficient'][CAST(l_quantity AS BIGINT) % 2 + 1] AS s, l_discount > 0.04 AS n FROM lineitem),
g AS (SELECT family_id, max(s) FILTER (unit = 'initial') AS i, max(s) FILTER (unit = 'candidate_pool') AS p, max(s) FILTER (unit = 'resolution_control') AS h, max(s) FILTER (unit = 'blocked_pool') AS b, bool_or(n) FILTER (unit = 'candidate_pool') AS nw FROM c GROUP BY 1)
SELECT family_id, i IS NOT NULL AND p IS NOT NULL AS main_review_complete, i = 'insufficient' AND p = 'sufficient' AS initial_to_pool_gap, h = 'insufficient' AND p = 'sufficient' AND coalesce(nw, false) AS different_frame_helpful, b = 'insufficient' AS blocked_pool_unresolved FROM g""")
def _(spark, sf):
    kinds = KINDS.replace("[", "array(").replace("]", ")")
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS family_id", f"{kinds}[l_linenumber % 4] AS unit", "array('insufficient', 'sufficient')[CAST(l_quantity AS BIGINT) % 2] AS sufficiency", "l_discount > 0.04 AS cited_new_source"
    )
    return review.material_gap(df)


OUTCOME_SQL = f"""{CASES_SQL}, e AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*100) AS BIGINT) AS d,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE ['Supported', 'Refuted', 'Need more evidence'][CAST(l_quantity AS BIGINT) % 3 + 1] END AS v FROM lineitem),
o AS (SELECT e.*, {pool_sql('(d % 2 = 1)', '(q % 2 = 1)', '(ln % 2 = 1)')} AS cur, {INIT_HELD} AS init, {POOL_FULL} AS pool FROM e JOIN cases USING (pk)),
out AS (SELECT *, v IS NOT DISTINCT FROM cur AS matches, init = 'Need more evidence' AND pool <> 'Need more evidence' AS opportunity, cur = 'Need more evidence' AND pool <> 'Need more evidence' AS unused, coalesce(v IN ('Supported', 'Refuted'), false) AND cur = 'Need more evidence' AS unsupported FROM o)"""


def outcomes(spark, sf):
    eps = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS ok", "l_linenumber AS ln", "l_partkey AS pk", "l_suppkey AS sk", "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_discount*100) AS BIGINT) AS d",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE array('Supported', 'Refuted', 'Need more evidence')[CAST(l_quantity AS BIGINT) % 3] END AS verdict",
    ).withColumn("released", F.expr(
        "array_compact(array('ref', CASE WHEN d % 2 = 1 THEN 'b' END, CASE WHEN q % 2 = 1 THEN 'c' END, CASE WHEN ln % 2 = 1 THEN 'd' END))"
    ))
    cases = standins.cases(spark, sf).selectExpr("*", "pk % 4 <> 0 AS b_ok", "pk % 3 <> 0 AS c_ok", "pk % 5 <> 0 AS d_ok", "pk % 6 = 1 AS c_initial")
    cases = cases.select("pk", "annotation", F.expr(INIT_HELD).alias("initial_verdict"), F.expr(POOL_FULL).alias("pool_verdict"))
    return review.reviewed_outcome(eps, cases, "pk")


@query("reviewed_outcome", f"""WITH {OUTCOME_SQL} SELECT ok, ln, pk, sk, cur AS current_evidence_verdict, matches AS decision_matches_current_evidence, opportunity AS acquisition_opportunity, unused AS unused_obtainable_evidence, unsupported AS unsupported_verdict FROM out""")
def _(spark, sf):
    return outcomes(spark, sf).drop("released", "verdict", "q", "d")


@query("review_summary", f"""WITH {OUTCOME_SQL}, g AS (SELECT *, CASE WHEN sk % 4 > 0 AND ln > 2 THEN d > 4 END AS gc FROM out)
SELECT sk % 8 AS actor, ln % 3 AS condition, count(*) AS reviewed_episodes, count(v) AS submitted, count(*) FILTER (matches) AS reasonable_verdicts, count(*) FILTER (unsupported) AS unsupported_verdicts,
  CASE WHEN count(gc) > 0 THEN count(*) FILTER (gc) END AS grounded_correct, count(gc) AS citation_scoring_available, count(*) FILTER (unused) AS unused_obtainable_evidence, sum(d % 3)::BIGINT AS requests FROM g GROUP BY 1, 2""")
def _(spark, sf):
    graded = outcomes(spark, sf).selectExpr(
        "*", "sk % 8 AS actor", "ln % 3 AS condition", "CASE WHEN sk % 4 > 0 AND ln > 2 THEN d > 4 END AS grounded_correct", "d % 3 AS requests"
    )
    return review.review_summary(graded, ["actor", "condition"])


@query("full_material_agreement", f"""WITH {VOTES_SQL}, c AS (SELECT family_id, min(verdict) AS verdict FROM votes GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT verdict) = 1)
SELECT o_orderpriority AS model, count(*) AS episodes, count(*) FILTER (o_orderstatus <> 'P') AS submitted, count(*) FILTER (verdict = CASE o_orderstatus WHEN 'F' THEN 'Supported' WHEN 'O' THEN 'Refuted' END) AS matches,
  round(count(*) FILTER (verdict = CASE o_orderstatus WHEN 'F' THEN 'Supported' WHEN 'O' THEN 'Refuted' END) / count(*), 6) AS label_agreement
FROM orders JOIN c ON family_id = o_orderkey WHERE o_custkey % 3 = o_orderkey % 3 GROUP BY 1""")
def _(spark, sf):
    v = standins.votes(spark, sf).groupBy("family_id").agg(F.count("*").alias("n"), F.min("verdict").alias("verdict"), F.max("verdict").alias("other")).filter("n = 2 AND verdict = other")
    consensus = v.selectExpr("family_id", "verdict", "array('b', 'a' || (family_id % 3)) AS full_pool_ids")
    eps = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS family_id", "o_orderpriority AS model", "CASE o_orderstatus WHEN 'F' THEN 'Supported' WHEN 'O' THEN 'Refuted' END AS verdict", "array('a' || (o_custkey % 3), 'b') AS available_ids"
    )
    return rounded(review.full_material_agreement(eps, consensus, ["model"]), "label_agreement")


@query("participant_progress", """
SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS submitted, count(*) FILTER (o_orderstatus = 'P') AS in_progress, count(*) FILTER (o_orderstatus = 'O') AS not_started, min(o_orderkey) FILTER (o_orderstatus <> 'F') AS first_open FROM orders GROUP BY 1""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return review.participant_progress(orders, orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus IN ('F', 'P')"), "o_custkey", "o_orderkey")


@query("export_answers", f"WITH {VOTES_SQL} SELECT family_id, ln, CASE WHEN claim_clear THEN verdict END AS verdict FROM votes WHERE claim_clear")
def _(spark, sf):
    answers = standins.votes(spark, sf).withColumn("verdict", F.expr("CASE WHEN claim_clear THEN verdict END"))
    return review.export_answers(answers, ["family_id", "ln"], "verdict", votes_only=True)


@query("grade_episodes", f"""WITH {DECISIONS_SQL}, s AS (SELECT *, t1 = verdict AND region_ok AS s1, t2 = verdict AND has_link AND link_ok AS s2, (q % 7 > 0 OR NOT has_link) AND pk % 13 > 0 AND px1 <= 40 AND py1 <= 40 AND sx1 <= 40 AND sy1 <= 40
    AND (NOT has_link OR (rx1 + q % 3 <= 40 AND ry1 + q % 3 <= 40 AND px1 + q % 3 <= 40 AND py1 + q % 3 <= 40)) AS valid,
  CASE WHEN t1 = 'Refuted' OR (t2 = 'Refuted' AND d % 4 > 0) THEN 'Refuted' WHEN t1 = 'Supported' AND t2 = 'Supported' AND d % 4 > 0 THEN 'Supported' ELSE 'Need more evidence' END AS expected FROM decisions),
g AS (SELECT *, valid AND CASE verdict WHEN 'Supported' THEN s1 AND s2 WHEN 'Refuted' THEN s1 OR s2 ELSE false END AND (NOT has_link OR link_ok) AS grounded, verdict = 'Need more evidence' AS abstains FROM s)
SELECT ok, ln, pk, expected AS expected_verdict, verdict = expected AS correct, verdict = expected AND valid AND (abstains OR grounded) AS grounded_correct, NOT abstains AND NOT grounded AS unsupported_decision, NOT abstains AS coverage FROM g""")
def _(spark, sf):
    df = standins.decisions(spark, sf).withColumn("available", F.expr("CASE WHEN d % 4 > 0 THEN array('img-a', 'img-b') ELSE array('img-a') END")).withColumn(
        "released", F.expr("CASE WHEN q % 7 > 0 THEN array('img-a', 'img-b') ELSE array('img-a') END")
    )
    shown = "named_struct('id', '{}', 'time', CASE WHEN pk % 13 = 0 AND '{}' = 'img-a' THEN 'after' ELSE 'before' END, 'source_bbox', array(0L, 0L, 40L, 40L))"
    images = F.expr(f"array({shown.format('img-a', 'img-a')}, {shown.format('img-b', 'img-b')})")
    return review.grade_episodes(df.withColumn("images", images), ["ok", "ln", "pk"])


# ---------------------------------------------------------------- training tables

BRANCH_SQL = """branches AS (SELECT l_orderkey AS origin, 'a' || (l_linenumber % 4) AS action, CAST(round(l_discount*100) AS BIGINT) % 3 > 0 AS g, CAST(round(l_tax*100) AS BIGINT) > 5 AS unsupported,
  CAST(l_quantity AS BIGINT) % 3 * 3 AS rc, l_suppkey % 2 AS tc, CASE WHEN CAST(l_quantity AS BIGINT) % 4 = 0 THEN 'Need more evidence' ELSE 'Supported' END AS verdict, l_orderkey % 3 = 0 AS seen, l_returnflag AS fl, l_linestatus AS st FROM lineitem)"""


def branches(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS origin", "'a' || (l_linenumber % 4) AS first_action", "CAST(round(l_discount*100) AS BIGINT) % 3 > 0 AS grounded_correct", "CAST(round(l_tax*100) AS BIGINT) > 5 AS unsupported_decision",
        "CAST(l_quantity AS BIGINT) % 3 * 3 AS request_cost", "l_suppkey % 2 AS tool_cost", "CASE WHEN CAST(l_quantity AS BIGINT) % 4 = 0 THEN 'Need more evidence' ELSE 'Supported' END AS verdict",
        "l_orderkey % 3 = 0 AS failure_seen", "'w' || l_orderkey AS world", "3 AS prefix_length", "'p' || l_orderkey AS prefix_digest", "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'finished' END AS termination",
        "CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'test' END AS official_split", "'evidence-chain-v1' AS grounding_protocol", "'reviewed' AS annotation_status", "l_linestatus", "l_linenumber", "l_partkey",
        "CAST(round(l_discount*100) AS BIGINT) % 2 AS errors",
    )


@query("sft_examples", "SELECT l_orderkey AS origin, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R' AND CAST(round(l_discount*100) AS BIGINT) % 3 > 0 AND CAST(round(l_discount*100) AS BIGINT) % 2 = 0")
def _(spark, sf):
    return training.sft_examples(branches(spark, sf), ["origin", "l_linenumber", "l_partkey"])


@query("preference_pairs", f"""WITH {BRANCH_SQL}, u AS (SELECT *, (g, NOT unsupported, -rc, -tc) AS score FROM branches WHERE fl <> 'R' AND st = 'O')
SELECT a.origin, a.action AS chosen_action, b.action AS rejected_action, count(*) AS pairs FROM u a JOIN u b USING (origin)
WHERE a.g AND a.score > b.score AND a.action <> b.action AND NOT (a.verdict = 'Need more evidence' AND b.verdict = 'Need more evidence' AND b.g AND NOT a.seen) GROUP BY ALL""")
def _(spark, sf):
    return training.preference_pairs(branches(spark, sf), "origin")


@query("preference_examples", f"""WITH {BRANCH_SQL}, u AS (SELECT *, (g, NOT unsupported, -rc, -tc) AS score FROM branches WHERE fl <> 'R' AND st = 'O' AND action <> 'a3'),
p AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations WHERE role <> 'assistant' GROUP BY 1)
SELECT a.origin, prompt, 'zoom,crop' AS tools, a.action AS chosen, b.action AS rejected, count(*) AS pairs FROM u a JOIN u b USING (origin) JOIN p ON conv_id = a.origin
WHERE a.g AND a.score > b.score AND a.action <> b.action AND NOT (a.verdict = 'Need more evidence' AND b.verdict = 'Need more evidence' AND b.g AND NOT a.seen) GROUP BY ALL""")
def _(spark, sf):
    role = F.when(F.col("first_action") == "a3", "tool").otherwise("assistant")
    forks = branches(spark, sf).withColumn("first_role", role).withColumn("tools", F.array(F.lit("zoom"), F.lit("crop")))
    said = table(spark, sf, "conversations").filter("role <> 'assistant'").groupBy(F.col("conv_id").alias("origin")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")
    )
    prompts = said.select("origin", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("prompt"))
    out = training.preference_examples(forks, prompts, "origin")
    text = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return out.withColumn("prompt", text).withColumn("tools", F.array_join("tools", ","))


@query("branch_problems", "SELECT l_orderkey AS origin, 'different_world' AS rule FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1")
def _(spark, sf):
    return training.branch_problems(branches(spark, sf).withColumn("world", F.col("l_linestatus")), "origin")


@query("rollout_groups", """SELECT user_id, count(*) AS rollouts, round(avg(value), 6) AS mean_reward, round(max(value) - min(value), 6) AS reward_range, round(avg((event_type = 'purchase')::INTEGER), 6) AS success, sum(event_id % 3)::BIGINT AS requests, sum(event_id % 100)::BIGINT AS tokens FROM events GROUP BY 1""")
def _(spark, sf):
    rollouts = table(spark, sf, "events").selectExpr("user_id", "value AS reward", "event_type = 'purchase' AS correct", "event_id % 3 AS requests", "event_id % 100 AS tokens")
    return rounded(training.rollout_groups(rollouts, ["user_id"]), "mean_reward", "reward_range", "success")


@query("group_advantages", """WITH g AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m, max(value) - min(value) AS r FROM events GROUP BY 1, 2)
SELECT user_id, event_type, event_id, CASE WHEN n < 2 THEN NULL WHEN r < 1e-6 THEN 0.0 ELSE round(value - m, 6) END AS advantage FROM events JOIN g USING (user_id, event_type)""")
def _(spark, sf):
    rollouts = table(spark, sf, "events").selectExpr("user_id", "event_type", "event_id", "value AS reward")
    return rounded(training.group_advantages(rollouts, ["user_id", "event_type"]).drop("reward"), "advantage")


@query("decision_turns", "SELECT conv_id, turn AS target_pos, turn AS prefix_length FROM conversations WHERE role = 'assistant'")
def _(spark, sf):
    return training.decision_turns(table(spark, sf, "conversations"), "conv_id", "turn")


@query("decision_examples", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), e AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)
SELECT doc_id, (i - 1)::INTEGER AS pos, lines[i] AS target, sha256(coalesce(array_to_string(lines[1:i - 1], chr(10)), '')) AS prefix FROM e WHERE i % 2 = 0""")
def _(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.when(i % 2 == 1, "assistant").otherwise("user").alias("role"), x.alias("text")))
    docs = table(spark, sf, "documents").select("doc_id", lines.alias("messages"))
    out = training.decision_examples(docs, "doc_id", "pos")
    prefix = F.sha2(F.array_join(F.transform("prefix", lambda m: m["text"]), "\n"), 256)
    return out.select("doc_id", "pos", F.col("target.text").alias("target"), prefix.alias("prefix"))


@query("decision_groups", """WITH first AS (SELECT conv_id, min(role) FILTER (turn = 0) AS opener, count(*) AS turns FROM conversations GROUP BY 1)
SELECT opener, turns, count(*) AS examples, sum(turn)::BIGINT AS prefix_messages FROM conversations JOIN first USING (conv_id) WHERE role = 'assistant' GROUP BY 1, 2""")
def _(spark, sf):
    messages = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    whole = messages.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("role"))).alias("opener"), F.count("*").alias("turns"))
    turns = training.decision_turns(messages.join(whole, "conv_id"), "conv_id", "turn", group=["opener", "turns"])
    return turns.groupBy("group").agg(F.count("*").alias("examples"), F.sum("prefix_length").cast("bigint").alias("prefix_messages")).select(
        "group.opener", "group.turns", "examples", "prefix_messages"
    )


@query("training_summary", f"""WITH {EPISODES_SQL} SELECT arm AS split, task, count(*) AS turns, count(DISTINCT family_id) AS families, count(*) FILTER (verdict = 'Supported') AS supported, count(*) FILTER (verdict = 'Refuted') AS refuted, count(*) FILTER (verdict = 'Need more evidence') AS undecided FROM episodes GROUP BY 1, 2""")
def _(spark, sf):
    return training.training_summary(standins.episodes(spark, sf).withColumn("split", F.col("arm")), "split", "family_id")


@query("validation_subset", f"""WITH {CASES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY task, verdict ORDER BY {H.format(salt='val', x='family_id')}, family_id) AS n FROM cases)
SELECT family_id || '-' || v AS case_id, task, verdict FROM r, unnest(['Sufficient', 'Obtainable', 'Missing', 'Unavailable']) AS t(v) WHERE n <= 2""")
def _(spark, sf):
    cases = curation.expand_variants(standins.cases(spark, sf).withColumn("withheld", F.lit("b"))).select("case_id", "family_id", "task", "verdict")
    return training.validation_subset(cases, 2, "val").select("case_id", "task", "verdict")
