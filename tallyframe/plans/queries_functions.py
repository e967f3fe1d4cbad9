"""Queries of the scalar functions, each over a whole driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions, evidence, geometry, hashing, text
from . import standins
from .registry import query, table
from .standins import CASES_SQL, CLAIM_BOXES_SQL, EPISODES_SQL, pool_sql

H = "sha256('{salt}|' || {x})"


def frac_sql(x: str, salt: str) -> str:
    return f"(('0x' || substr({H.format(salt=salt, x=x)}, 1, 13))::BIGINT / 4503599627370496.0)"


def _inter(*boxes: str) -> str:
    """SQL area of the intersection of boxes named by their column prefix."""
    width = f"least({', '.join(b + 'x1' for b in boxes)}) - greatest({', '.join(b + 'x0' for b in boxes)})"
    height = f"least({', '.join(b + 'y1' for b in boxes)}) - greatest({', '.join(b + 'y0' for b in boxes)})"
    return f"(greatest(0, {width}) * greatest(0, {height}))"


def _area(b: str) -> str:
    return f"(({b}x1 - {b}x0) * ({b}y1 - {b}y0))"


def _union(required: str) -> str:
    """SQL area of ``required`` covered by the two cited boxes, by inclusion and exclusion."""
    return f"({_inter(required, 'p')} + {_inter(required, 's')} - {_inter(required, 'p', 's')})"


def _iou(a: str, b: str) -> str:
    return f"({_inter(a, b)} / ({_area(a)} + {_area(b)} - {_inter(a, b)} + 0.0))"


@query("stable_hash", f"SELECT doc_id, substr({H.format(salt='sample', x='doc_id')}, 1, 20) AS h FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.stable_hash(F.col("doc_id"), "sample", 20).alias("h"))


@query("hash_fraction", f"SELECT event_id, {frac_sql('event_id', 'split')} AS fraction FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", hashing.hash_fraction(F.col("event_id"), "split").alias("fraction"))


@query("family_seed", f"SELECT doc_id, ('0x' || substr({H.format(salt='17', x='doc_id')}, 1, 15))::BIGINT AS seed FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hashing.family_seed(F.col("doc_id"), 17).alias("seed"))


@query("canonical_json", """
SELECT event_id, '{"a":"' || event_type || '","props":{"k":' || json_extract_string(props, '$.k') || '},"z":' || event_id || '}' AS doc
FROM events""")
def _(spark, sf):
    raw = F.expr("""concat('{"z": ', event_id, ', "props": ', props, ', "a": "', event_type, '"}')""")
    return table(spark, sf, "events").select("event_id", hashing.canonical_json(raw).alias("doc"))


@query("box_valid", """
SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey % 20 < CAST(l_quantity AS BIGINT) AND l_suppkey % 20 < l_linenumber * 4 AS valid,
  l_partkey % 20 < CAST(l_quantity AS BIGINT) AND l_suppkey % 20 < l_linenumber * 4 AND CAST(l_quantity AS BIGINT) <= 30 AND l_linenumber <= 5 AS inside
FROM lineitem""")
def _(spark, sf):
    b = F.expr("array(l_partkey % 20, l_suppkey % 20, CAST(l_quantity AS BIGINT), CAST(l_linenumber * 4 AS BIGINT))")
    frame = geometry.box(0, 0, 30, 20)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), geometry.box_valid(b).alias("valid"),
        geometry.box_inside(frame, b).alias("inside"),
    )


@query("iou", f"WITH {CLAIM_BOXES_SQL} SELECT ok, ln, round({_iou('r', 'p')}, 9) AS iou FROM claims")
def _(spark, sf):
    return standins.claims(spark, sf).select("ok", "ln", F.round(geometry.iou(F.col("r"), F.col("p")), 9).alias("iou"))


@query("box_coverage", f"""WITH {CLAIM_BOXES_SQL}
SELECT ok, ln, round({_union('r')} / ({_area('r')} + 0.0), 9) AS coverage, {_union('t')} >= {_area('t')} AS covered FROM claims""")
def _(spark, sf):
    boxes = F.array("p", "s")
    return standins.claims(spark, sf).select(
        "ok", "ln", F.round(geometry.box_coverage(F.col("r"), boxes), 9).alias("coverage"),
        geometry.covers(F.col("t"), boxes).alias("covered"),
    )


def _run_sql(y: str, x0: str, x1: str) -> str:
    def seg(*bs):
        hit = " AND ".join(f"{b}y0 <= {y} AND {y} < {b}y1" for b in bs)
        low = f"greatest({x0}, {', '.join(b + 'x0' for b in bs)})"
        high = f"least({x1}, {', '.join(b + 'x1' for b in bs)})"
        return f"(CASE WHEN {hit} THEN greatest(0, {high} - {low}) ELSE 0 END)"
    return f"({seg('p')} + {seg('s')} - {seg('p', 's')})"


@query("mask_coverage", f"""WITH {CLAIM_BOXES_SQL}
SELECT ok, ln, round(({_run_sql('ry0', 'rx0', 'rx1')} + {_run_sql('(ry0+1)', '(rx0+2)', 'rx1')} + {_run_sql('(ry0+2)', 'rx0', '(rx0+5)')})
  / ((rx1 - rx0) + (rx1 - rx0 - 2) + 5.0), 9) AS coverage FROM claims""")
def _(spark, sf):
    runs = F.expr("array(array(r[1], r[0], r[2]), array(r[1] + 1, r[0] + 2, r[2]), array(r[1] + 2, r[0], r[0] + 5))")
    return standins.claims(spark, sf).select(
        "ok", "ln", F.round(geometry.mask_coverage(runs, F.array("p", "s")), 9).alias("coverage")
    )


@query("mask_valid", f"""WITH {CLAIM_BOXES_SQL}
SELECT ok, ln, d > 0 AND q % 6 > 0 AND q % 7 > 0 AND rx1 <= 45 AND ry1 <= 40 AS valid FROM claims""")
def _(spark, sf):
    runs = F.expr(
        "array(array(r[1], r[0], r[0] + 4), array(r[1], r[0] + CASE WHEN q % 6 = 0 THEN 3L ELSE 4L END, r[0] + 7), "
        "array(CASE WHEN q % 7 = 0 THEN r[3] ELSE r[1] + 1 END, r[0], r[2]))"
    )
    size = F.expr("CASE WHEN d > 0 THEN array(45L, 40L) ELSE array(0L, 40L) END")
    return standins.claims(spark, sf).select("ok", "ln", geometry.mask_valid(size, runs, F.col("r")).alias("valid"))


@query("region_match", f"""WITH {CLAIM_BOXES_SQL}
SELECT ok, ln, pk % 3 = sk % 3 AND q % 4 > 0 AND CASE ln % 3
  WHEN 0 THEN {_iou('r', 'p')} >= 0.5
  WHEN 1 THEN {_iou('r', 'p')} >= 0.25 AND {_inter('r', 'p')} / ({_area('p')} + 0.0) >= 0.25 AND {_inter('r', 'p')} / ({_area('r')} + 0.0) >= 0.5
  ELSE {_iou('r', 'p')} >= 0.5 AND {_inter('r', 'p')} / ({_area('p')} + 0.0) >= 0.5 AND {_inter('r', 'p')} / ({_area('r')} + 0.0) >= 0.9
  END AS matched FROM claims""")
def _(spark, sf):
    req = F.expr("named_struct('image_id', 'm' || (pk % 3), 'bbox', r, 'time', 'before')")
    act = F.expr("named_struct('image_id', 'm' || (sk % 3), 'bbox', p, 'time', CASE WHEN q % 4 = 0 THEN 'after' ELSE 'before' END)")
    kind = F.expr("array('identity', 'defect', 'panel')[ln % 3]")
    return standins.claims(spark, sf).select("ok", "ln", geometry.region_match(req, act, kind).alias("matched"))


_SHIFT = ", ".join(f"{b}{e} + q % 3 AS {b}s{e}" for b in ("r", "p") for e in ("x0", "y0", "x1", "y1"))
DECISIONS_SQL = f"""{CLAIM_BOXES_SQL}, linked AS (
  SELECT *, CASE WHEN q % 2 = 0 THEN 0.3 ELSE 0.5 END AS lim FROM (SELECT *, {_SHIFT} FROM claims)), decisions AS (
  SELECT *, q % 5 > 0 AND {_iou('r', 'rs')} >= lim AND {_iou('p', 'ps')} >= lim
    AND (d % 2 = 0 OR ln % 4 < 3) AS link_ok,
    CASE WHEN pk % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS t1, CASE WHEN sk % 3 > 0 THEN 'Supported' ELSE 'Refuted' END AS t2,
    ['Supported', 'Refuted', 'Need more evidence'][q % 3 + 1] AS verdict, {_union('t')} >= {_area('t')} AS region_ok,
    q % 4 > 0 AS has_link FROM linked)"""


@query("link_match", f"WITH {DECISIONS_SQL} SELECT ok, ln, link_ok AS matched FROM decisions")
def _(spark, sf):
    return standins.decisions(spark, sf).select(
        "ok", "ln", evidence.link_match(F.col("expected"), F.col("given")).alias("matched")
    )


@query("requirement_met", f"""WITH {DECISIONS_SQL}
SELECT ok, ln, region_ok AS region, has_link AND link_ok AS relation, pk % 4 > 0 AS plain FROM decisions""")
def _(spark, sf):
    plain = F.expr("named_struct('image_id', CASE WHEN pk % 4 > 0 THEN 'img-a' ELSE 'img-z' END, 'bbox', null, 'time', null, "
                   "'relation', null, 'left', null, 'right', null, 'min_iou', null)").cast(standins.REQ)
    df = standins.decisions(spark, sf).withColumn("plain_req", plain)
    met = {n: evidence.requirement_met(F.col(c), F.col("citations"), F.col("links")).alias(n)
           for n, c in {"region": "region_req", "relation": "link_req", "plain": "plain_req"}.items()}
    return df.select("ok", "ln", *met.values())


@query("alternatives_met", f"""WITH {DECISIONS_SQL}
SELECT ok, ln, region_ok OR (has_link AND link_ok AND region_ok) AS any_met, region_ok AND has_link AND link_ok AS both_met,
  false AS none_met FROM decisions""")
def _(spark, sf):
    def met(alternatives: str):
        return evidence.alternatives_met(F.expr(alternatives), F.col("citations"), F.col("links"))
    return standins.decisions(spark, sf).select(
        "ok", "ln", met("array(array(region_req), array(link_req, region_req))").alias("any_met"),
        met("array(array(region_req, link_req))").alias("both_met"), met(f"CAST(array(array()) AS array<array<{standins.REQ}>>)").alias("none_met"),
    )


@query("chain_report", f"""WITH {DECISIONS_SQL}, seen AS (
  SELECT *, t1 = verdict AND region_ok AS s1, t2 = verdict AND has_link AND link_ok AS s2,
    CASE WHEN has_link THEN 1 ELSE 0 END AS predicted, CASE WHEN has_link AND link_ok THEN 1 ELSE 0 END AS valid FROM decisions)
SELECT ok, ln, CASE verdict WHEN 'Supported' THEN s1 AND s2 WHEN 'Refuted' THEN s1 OR s2 ELSE false END AND valid = predicted AS sufficient,
  s1 AS region_covered, s2 AS link_covered, valid AS valid_links, predicted AS predicted_links FROM seen""")
def _(spark, sf):
    report = evidence.chain_report(F.col("annotation"), F.col("verdict"), F.col("citations"), F.col("links"))
    return standins.decisions(spark, sf).withColumn("rep", report).select(
        "ok", "ln", "rep.sufficient", F.expr("rep.covered[0]").alias("region_covered"),
        F.expr("rep.covered[1]").alias("link_covered"), "rep.valid_links", "rep.predicted_links",
    )


@query("derived_verdict", f"WITH {CASES_SQL} SELECT family_id, verdict AS derived FROM cases")
def _(spark, sf):
    truths = F.transform("annotation.subclaims", lambda s: s["truth"])
    return standins.cases(spark, sf).select("family_id", evidence.derived_verdict(truths).alias("derived"))


@query("annotation_errors", """
WITH base AS (SELECT l_orderkey AS ok, l_linenumber AS ln, CAST(round(l_discount*100) AS BIGINT) AS d FROM lineitem)
SELECT ok, ln, CASE d WHEN 1 THEN 'duplicate_subclaims' WHEN 2 THEN 'verdict_disagrees' WHEN 3 THEN 'determinate_without_sets'
  WHEN 4 THEN 'empty_group' WHEN 5 THEN 'plain_image_requirement,invalid_region' WHEN 6 THEN 'unknown_relation' WHEN 7 THEN 'invalid_min_iou'
  WHEN 8 THEN 'same_image_relation' WHEN 9 THEN 'invalid_region' WHEN 10 THEN 'invalid_truth,verdict_disagrees' ELSE '' END AS errors FROM base""")
def _(spark, sf):
    req = f"cast(named_struct('image_id', image, 'bbox', bbox, 'time', 'before', 'relation', null, 'left', null, 'right', null, 'min_iou', null) AS {standins.REQ})"
    link = (
        "cast(named_struct('image_id', null, 'bbox', null, 'time', null, 'relation', CASE WHEN d = 6 THEN 'near' ELSE 'same_time' END, "
        "'left', named_struct('image_id', 'a', 'bbox', array(0L, 0L, 4L, 4L), 'time', 'before'), "
        "'right', named_struct('image_id', CASE WHEN d = 8 THEN 'a' ELSE 'b' END, 'bbox', array(0L, 0L, 4L, 4L), 'time', 'before'), "
        f"'min_iou', CASE WHEN d = 7 THEN 1.5D END) AS {standins.REQ})"
    )
    df = standins.claims(spark, sf).withColumn("image", F.lit("a")).withColumn(
        "bbox", F.expr("CASE WHEN d = 9 THEN array(4L, 0L, 4L, 4L) WHEN d = 5 THEN null ELSE array(0L, 0L, 4L, 4L) END")
    )
    sets = f"CASE WHEN d = 3 THEN map('Supported', array()) WHEN d = 4 THEN map('Supported', array(array({req}), array())) ELSE map('Supported', array(array({req}))) END"
    annotation = F.struct(
        F.lit("evidence-chain-v1").alias("protocol"), F.lit("x").alias("status"),
        F.expr("CASE WHEN d = 2 THEN 'Refuted' ELSE 'Supported' END").alias("verdict"),
        F.expr(
            "array(named_struct('id', 's1', 'kind', 'k', 'truth', 'Supported', 'minimal_evidence_sets', "
            f"{sets}), named_struct('id', CASE WHEN d = 1 THEN 's1' ELSE 's2' END, 'kind', 'k', "
            "'truth', CASE WHEN d = 10 THEN 'maybe' ELSE 'Supported' END, 'minimal_evidence_sets', "
            f"map(CASE WHEN d = 10 THEN 'maybe' ELSE 'Supported' END, array(array({link})))))"
        ).cast(f"array<{standins.SUBCLAIM}>").alias("subclaims"),
    )
    return df.select("ok", "ln", F.array_join(evidence.annotation_errors(annotation), ",").alias("errors"))


@query("pool_verdict", f"""WITH {CASES_SQL}
SELECT family_id, {pool_sql('b_ok', 'c_ok', 'd_ok')} AS pool, {pool_sql('false', 'c_initial', 'false')} AS initial FROM cases""")
def _(spark, sf):
    available = F.transform(F.filter("evidence", lambda e: e["available"]), lambda e: e["id"])
    return standins.cases(spark, sf).select(
        "family_id", evidence.pool_verdict(F.col("annotation"), available).alias("pool"),
        evidence.pool_verdict(F.col("annotation"), F.col("initial")).alias("initial"),
    )


@query("required_images", f"""WITH {CASES_SQL}
SELECT family_id, CASE WHEN t2 = 'uncertain' THEN 'b,c,ref' ELSE 'b,c,d,ref' END AS images FROM cases""")
def _(spark, sf):
    return standins.cases(spark, sf).select(
        "family_id", F.array_join(evidence.required_images(F.col("annotation")), ",").alias("images")
    )


@query("annotation_image_sets", f"""WITH {CASES_SQL}
SELECT family_id, CASE WHEN verdict = 'Supported' THEN 'c+ref|b+c+ref|b+d+ref|c+d+ref'
  WHEN verdict = 'Refuted' AND t1 = 'Refuted' AND t2 = 'Refuted' THEN 'c|b+ref|c+ref|d+ref'
  WHEN verdict = 'Refuted' AND t1 = 'Refuted' THEN 'b+ref|c+ref' WHEN verdict = 'Refuted' THEN 'c|d+ref' ELSE '' END AS sets FROM cases""")
def _(spark, sf):
    sets = F.transform(evidence.annotation_image_sets(F.col("annotation")), lambda s: F.array_join(s, "+"))
    return standins.cases(spark, sf).select("family_id", F.array_join(sets, "|").alias("sets"))


@query("minimal_image_sets", f"""WITH {CASES_SQL}
SELECT family_id, CASE WHEN verdict = 'Supported' THEN 'c+ref|b+d+ref'
  WHEN verdict = 'Refuted' AND t1 = 'Refuted' AND t2 = 'Refuted' THEN 'c|b+ref|d+ref'
  WHEN verdict = 'Refuted' AND t1 = 'Refuted' THEN 'b+ref|c+ref' WHEN verdict = 'Refuted' THEN 'c|d+ref' ELSE '' END AS sets FROM cases""")
def _(spark, sf):
    sets = F.transform(evidence.minimal_image_sets(F.col("annotation")), lambda s: F.array_join(s, "+"))
    return standins.cases(spark, sf).select("family_id", F.array_join(sets, "|").alias("sets"))


@query("availability_class", f"""WITH {CASES_SQL}, judged AS (
  SELECT *, {pool_sql('b_ok', 'c_ok', 'd_ok')} AS pool, {pool_sql('false', 'c_initial', 'false')} AS initial FROM cases)
SELECT family_id, CASE WHEN initial <> 'Need more evidence' THEN 'Sufficient' WHEN pool <> 'Need more evidence' THEN 'Obtainable'
  WHEN verdict = 'Need more evidence' THEN 'Underdetermined' WHEN NOT (b_ok AND c_ok AND d_ok) THEN 'Unavailable' ELSE 'Missing' END AS class FROM judged""")
def _(spark, sf):
    available = F.transform(F.filter("evidence", lambda e: e["available"]), lambda e: e["id"])
    return standins.cases(spark, sf).select("family_id", evidence.availability_class(
        evidence.pool_verdict(F.col("annotation"), F.col("initial")),
        evidence.pool_verdict(F.col("annotation"), available), F.col("verdict"), F.col("evidence"),
    ).alias("class"))


@query("transition", f"""WITH {EPISODES_SQL}
SELECT a.model, a.family_id, CASE WHEN a.verdict IS NOT DISTINCT FROM a.source_label AND b.verdict IS NOT DISTINCT FROM a.source_label THEN 'maintained_correct'
  WHEN b.verdict IS NOT DISTINCT FROM a.source_label THEN 'corrected' WHEN a.verdict IS DISTINCT FROM a.source_label THEN 'remained_wrong'
  WHEN b.verdict IS NULL THEN 'lost_no_valid_final' WHEN b.verdict = 'Need more evidence' THEN 'lost_explicit_NME' ELSE 'lost_valid_wrong_label' END AS change
FROM episodes a JOIN episodes b USING (model, family_id) WHERE a.arm = 'initial_text' AND b.arm = 'interactive_agent'""")
def _(spark, sf):
    eps = standins.episodes(spark, sf)
    a = eps.filter("arm = 'initial_text'").select("model", "family_id", "source_label", F.col("verdict").alias("before"))
    b = eps.filter("arm = 'interactive_agent'").select("model", "family_id", F.col("verdict").alias("after"))
    return a.join(b, ["model", "family_id"]).select(
        "model", "family_id", evidence.transition(F.col("before"), F.col("after"), F.col("source_label")).alias("change")
    )


@query("parse_verdict", """
SELECT l_orderkey AS ok, l_linenumber AS ln, CASE CAST(l_quantity AS BIGINT) % 7 WHEN 0 THEN 'Supported' WHEN 1 THEN 'Refuted'
  WHEN 2 THEN 'Need more evidence' WHEN 5 THEN 'Refuted' END AS verdict FROM lineitem""")
def _(spark, sf):
    raw = F.expr(
        "array('VERDICT: Supported.', '  Refuted ', 'Need more evidence!', 'I think Supported', 'supported', "
        "'VERDICT:Refuted', 'Supported or Refuted')[CAST(l_quantity AS BIGINT) % 7]"
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), text.parse_verdict(raw).alias("verdict")
    )


@query("parse_tool_call", """
WITH base AS (SELECT l_orderkey AS ok, l_linenumber AS ln, CAST(l_quantity AS BIGINT) % 8 AS v, l_partkey AS pk FROM lineitem)
SELECT ok, ln, CASE WHEN v < 2 THEN 'crop' END AS name, CASE WHEN v < 2 THEN '{"image_id":"i' || pk || '"}' END AS arguments FROM base""")
def _(spark, sf):
    raw = F.expr(
        """array(
        concat('<tool_call>{"name": "crop", "arguments": {"image_id": "i', l_partkey, '"}}</tool_call>'),
        concat('looking\n<tool_call>\n{"arguments": {"image_id": "i', l_partkey, '"}, "name": "crop"}\n</tool_call> done'),
        concat('{"name": "crop", "arguments": {"image_id": "i', l_partkey, '"}}'),
        '<tool_call>{"name": "crop"}</tool_call>',
        '<tool_call>{"name": "crop", "arguments": "x"}</tool_call>',
        '<tool_call>{"name": "crop", "arguments": {}</tool_call>',
        '<tool_call>{"name": "crop", "arguments": {}}</tool_call><tool_call>{"name": "crop", "arguments": {}}</tool_call>',
        '<tool_call>{"name": 3, "arguments": {}}</tool_call>')[CAST(l_quantity AS BIGINT) % 8]"""
    )
    return table(spark, sf, "lineitem").withColumn("call", text.parse_tool_call(raw)).select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), "call.name", "call.arguments"
    )


@query("parse_tool_call_transports", """
WITH base AS (SELECT l_orderkey AS ok, l_linenumber AS ln, CAST(l_quantity AS BIGINT) % 4 AS v, l_partkey AS pk FROM lineitem)
SELECT ok, ln, CASE WHEN v < 2 THEN 'crop' END AS name, CASE WHEN v < 2 THEN '{"image_id":"i' || pk || '"}' END AS arguments FROM base""")
def _(spark, sf):
    raw = F.expr(
        """array(
        concat(' {"name": "crop", "arguments": {"image_id": "i', l_partkey, '"}} '),
        concat('<tool_call>{"name": "crop", "arguments": {"image_id": "i', l_partkey, '"}}'),
        concat('{"name": "crop", "arguments": {"image_id": "i', l_partkey, '"}} and more'),
        concat('<tool_call>{"name": "crop", "arguments": {"image_id": "i', l_partkey))[CAST(l_quantity AS BIGINT) % 4]"""
    )
    call = text.parse_tool_call(raw, allow_bare=True, allow_unclosed=True)
    return table(spark, sf, "lineitem").withColumn("call", call).select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), "call.name", "call.arguments"
    )


@query("parse_xml_call", """
WITH base AS (SELECT l_orderkey AS ok, l_linenumber AS ln, CAST(l_quantity AS BIGINT) % 9 AS v, l_partkey AS pk FROM lineitem)
SELECT ok, ln, CASE WHEN v < 2 THEN 'zoom' END AS name, CASE WHEN v < 2 THEN 'i"' || pk END AS image_id, CASE v WHEN 0 THEN '2.5' END AS factor,
  CASE v WHEN 0 THEN '{"image_id": "i\\"' || pk || '", "factor": 2.5}' WHEN 1 THEN '{"image_id": "i\\"' || pk || '"}' END AS arguments, CASE v WHEN 0 THEN '' WHEN 1 THEN 'text' END AS content FROM base""")
def _(spark, sf):
    raw = F.expr(
        """array(
        concat('<tool_call><function=zoom><parameter=image_id> i"', l_partkey, ' </parameter><parameter=factor>2.5</parameter></function></tool_call>'),
        concat('text <tool_call>\n<function=zoom>\n<parameter=image_id>\ni"', l_partkey, '\n</parameter>\n</function>\n</tool_call>'),
        '<tool_call><function=zoom>stray<parameter=image_id>i</parameter></function></tool_call>',
        '<tool_call><function=zoom><parameter=image_id>i</parameter><parameter=image_id>j</parameter></function></tool_call>',
        '<tool_call>zoom</tool_call>',
        '<tool_call><function=paint><parameter=image_id>i</parameter></function></tool_call>',
        '<tool_call><function=zoom><parameter=colour>i</parameter></function></tool_call>',
        '<tool_call><function=zoom><parameter=factor>abc</parameter></function></tool_call>',
        '<tool_call><function=zoom><parameter=factor>1</parameter></function></tool_call> <tool_call><function=zoom></function></tool_call>')[CAST(l_quantity AS BIGINT) % 9]"""
    )
    call = text.parse_xml_call(raw, {"zoom": {"image_id": "string", "factor": "number"}})
    return table(spark, sf, "lineitem").withColumn("call", call).select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), "call.name",
        F.get_json_object("call.arguments", "$.image_id").alias("image_id"), F.get_json_object("call.arguments", "$.factor").alias("factor"), "call.arguments", "call.content",
    )


@query("validate_action", """
WITH base AS (SELECT l_orderkey AS ok, l_linenumber AS ln, CAST(l_quantity AS BIGINT) % 16 AS v FROM lineitem)
SELECT ok, ln, CASE v WHEN 13 THEN 'invalid:citations' WHEN 14 THEN 'invalid:links' WHEN 15 THEN 'invalid:bbox' WHEN 1 THEN 'missing:bbox' WHEN 2 THEN 'invalid:bbox' WHEN 3 THEN 'invalid:factor' WHEN 4 THEN 'unknown:note'
  WHEN 5 THEN 'invalid:image_ids' WHEN 6 THEN 'invalid:query' WHEN 8 THEN 'invalid:verdict,missing:citations' WHEN 9 THEN 'unknown_action'
  WHEN 10 THEN 'not_json' WHEN 11 THEN 'invalid:top_k' ELSE '' END AS errors FROM base""")
def _(spark, sf):
    cite = '{"image_id": "a", "bbox": [0, 0, 4, 4], "time": "t"}'
    calls = [
        ("crop", '{"image_id": "a", "bbox": [0, 0, 4, 4]}'), ("crop", '{"image_id": "a"}'),
        ("crop", '{"image_id": "a", "bbox": [0, 0, 4]}'), ("zoom", '{"image_id": "a", "factor": 9}'),
        ("inspect", '{"image_id": "a", "note": 1}'), ("compare", '{"image_ids": ["a", "a"]}'),
        ("request_photo", '{"query": {"object": "o", "time": "t", "view": ""}}'),
        ("request_photo", '{"query": {"object": "o", "time": "t", "view": "v"}}'), ("finish", '{"verdict": "Yes"}'),
        ("paint", '{"image_id": "a"}'), ("ocr", '{"image_id"'),
        ("ground_image_to_image", '{"query_image_id": "a", "target_image_id": "b", "top_k": 9}'),
        ("finish", f'{{"verdict": "Supported", "citations": [{cite}], "links": [{{"relation": "same_time", "left": {cite}, "right": {cite}}}]}}'),
        ("finish", '{"verdict": "Supported", "citations": [{"image_id": "a", "bbox": [0, 0, 4, 4]}]}'),
        ("finish", f'{{"verdict": "Refuted", "citations": [], "links": [{{"relation": "near", "left": {cite}, "right": {cite}}}]}}'),
        ("crop", '{"image_id": "a", "bbox": [0, 0, 4.5, 4]}'),
    ]
    pick = F.expr("CAST(l_quantity AS BIGINT) % 16").cast("int")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"),
        F.get(F.array(*[F.lit(n) for n, _ in calls]), pick).alias("name"),
        F.get(F.array(*[F.lit(a) for _, a in calls]), pick).alias("arguments"),
    )
    return df.select("ok", "ln", F.array_join(actions.action_errors(F.col("name"), F.col("arguments")), ",").alias("errors"))


@query("call_charge", f"""WITH {EPISODES_SQL}
SELECT model, arm, family_id, CAST(CAST(input_tokens * 1.25 + output_tokens * 10 AS DECIMAL(18, 2)) AS VARCHAR) AS micro_exact,
  CAST(ceil(CAST(input_tokens * 1.25 + output_tokens * 10 AS DECIMAL(18, 2))) AS BIGINT) AS micro FROM episodes""")
def _(spark, sf):
    charge = actions.call_charge(F.col("input_tokens"), F.col("output_tokens"), 1.25, 10)
    return standins.episodes(spark, sf).select(
        "model", "arm", "family_id", (charge * 1_000_000).cast("decimal(18,2)").cast("string").alias("micro_exact"),
        actions.microdollars(charge).alias("micro"),
    )


@query("vector_angle", """
WITH pairs AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(degrees(acos(greatest(-1.0, least(1.0,
  list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[]))))))), 6) AS angle FROM pairs""")
def _(spark, sf):
    emb = table(spark, sf, "embeddings")
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return emb.join(nxt, "vec_id").select("vec_id", F.round(geometry.vector_angle(F.col("embedding"), F.col("y")), 6).alias("angle"))


@query("rotation_angle", """
SELECT p_partkey, CAST(least(abs(p_size - p_partkey % 50) * 3 % 360, 360 - abs(p_size - p_partkey % 50) * 3 % 360) AS DOUBLE) AS angle FROM part""")
def _(spark, sf):
    def turn(degrees: str):
        c, s = F.cos(F.radians(F.expr(degrees))), F.sin(F.radians(F.expr(degrees)))
        zero, one = F.lit(0.0), F.lit(1.0)
        return F.array(F.array(c, -s, zero), F.array(s, c, zero), F.array(zero, zero, one))
    angle = geometry.rotation_angle(turn("3 * p_size"), turn("3 * (p_partkey % 50)"))
    return table(spark, sf, "part").select("p_partkey", (F.round(angle, 3) + F.lit(0.0)).alias("angle"))


@query("source_box", f"""WITH {CLAIM_BOXES_SQL}
SELECT ok, ln, CAST(least(floor(10 + rx0 * 90 / 50.0), 100) AS BIGINT) AS x0, CAST(least(floor(5 + ry0 * 70 / 40.0), 75) AS BIGINT) AS y0,
  CAST(least(ceil(10 + rx1 * 90 / 50.0), 100) AS BIGINT) AS x1, CAST(least(ceil(5 + ry1 * 70 / 40.0), 75) AS BIGINT) AS y1,
  CAST(floor(10 + d * 90 / 16.0) AS BIGINT) AS unit_x0 FROM claims""")
def _(spark, sf):
    source = geometry.box(10, 5, 100, 75)
    box = geometry.source_box(F.col("r"), source, F.array(F.lit(50.0), F.lit(40.0)))
    unit = geometry.normalized_box(F.expr("array(d / 16.0D, 0.0D, 1.0D, 1.0D)"), source)
    return standins.claims(spark, sf).withColumn("box", box).select(
        "ok", "ln", *[F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        F.get(unit, F.lit(0)).alias("unit_x0"),
    )


@query("trajectory_reward", f"""WITH {EPISODES_SQL}
SELECT model, arm, family_id, round(CAST(CASE WHEN verdict IS NOT DISTINCT FROM source_label THEN 1.0 ELSE -1.0 END - 0.01 * tool_calls - 0.02 * 3 * requests - 0.02 * errors AS DOUBLE), 6) AS reward FROM episodes""")
def _(spark, sf):
    correct = F.col("verdict").eqNullSafe(F.col("source_label"))
    reward = actions.trajectory_reward(correct, F.col("tool_calls"), F.col("requests") * 3, F.col("errors"))
    return standins.episodes(spark, sf).select("model", "arm", "family_id", F.round(reward, 6).alias("reward"))


@query("strip_variant", "SELECT p_partkey, 'f' || p_partkey AS family_id FROM part")
def _(spark, sf):
    case_id = F.expr("concat('f', p_partkey, array('-Sufficient', '-Obtainable', '-Missing', '-Unavailable', '')[p_partkey % 5])")
    return table(spark, sf, "part").select("p_partkey", text.strip_variant(case_id).alias("family_id"))


@query("observation_signature", """
SELECT doc_id, sha256(sha256(n_chars || 'x1|' || text) || '|' || sha256('{"lang":"' || lang || '","source":"' || source || '"}')) AS sig,
  CASE WHEN doc_id % 5 = 0 THEN 'target_bbox' ELSE '' END AS hidden FROM documents""")
def _(spark, sf):
    meta = F.expr("""concat('{"source": "', source, '", "lang": "', lang, '"}')""")
    leaky = F.expr("""concat('{"source": "', source, CASE WHEN doc_id % 5 = 0 THEN '", "target_bbox": "x' ELSE '' END, '"}')""")
    return table(spark, sf, "documents").select(
        "doc_id", hashing.observation_signature(F.col("text"), F.col("n_chars"), F.lit(1), meta).alias("sig"),
        F.array_join(hashing.hidden_metadata(leaky, ["source", "lang"]), ",").alias("hidden"),
    )


@query("nonpixel_hash", """
SELECT conv_id, turn, sha256(role || chr(31) || '=' || text || chr(30) || 'tool' || chr(31) || '~') AS h FROM conversations""")
def _(spark, sf):
    messages = F.expr(
        "array(named_struct('role', role, 'text', text, 'image_ref', 'blobs/' || conv_id), "
        "named_struct('role', 'tool', 'text', CAST(NULL AS STRING), 'image_ref', 'blobs/' || turn))"
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", hashing.nonpixel_hash(messages).alias("h"))


@query("path_errors", """
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'absolute' WHEN 2 THEN 'drive' WHEN 3 THEN 'parent' WHEN 4 THEN 'backslash'
  WHEN 5 THEN 'not_normalized' WHEN 6 THEN 'not_normalized' WHEN 7 THEN 'empty' ELSE 'parent,not_normalized' END AS errors FROM part""")
def _(spark, sf):
    path = F.expr(
        r"array('a/' || p_partkey || '.png', '/a/b', 'C:x', 'a/../b', r'a\b', 'a//b', 'a/./b', '', '../b/')[p_partkey % 9]"
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.path_errors(path), ",").alias("errors"))


@query("links_complete", f"""WITH {DECISIONS_SQL}
SELECT ok, ln, has_link AND link_ok AS complete, link_ok AND d < 5 AS complete_with_extra, false AS complete_of_none FROM decisions""")
def _(spark, sf):
    expected = F.array("expected")
    stray = F.expr("CASE WHEN d < 5 THEN array(given) ELSE array(given, struct('unrelated' AS relation, given.left, given.right, given.min_iou)) END").cast(f"array<{standins.LINK}>")
    return standins.decisions(spark, sf).select(
        "ok", "ln", evidence.links_complete(expected, F.col("links")).alias("complete"),
        evidence.links_complete(expected, stray).alias("complete_with_extra"),
        evidence.links_complete(F.slice(expected, 1, 0), F.col("links")).alias("complete_of_none"),
    )


@query("derive_link", f"""WITH {DECISIONS_SQL}
SELECT ok, ln, CASE WHEN ln % 2 = 0 AND verdict <> 'Need more evidence' AND d % 3 > 0
  THEN CASE verdict WHEN 'Supported' THEN 'same_object' ELSE 'different_object' END END AS relation FROM decisions""")
def _(spark, sf):
    task = F.expr("CASE WHEN ln % 2 = 0 THEN 'identity' ELSE 'state' END")
    objects = F.expr("CASE WHEN d % 3 > 0 THEN array('subject-B', 'subject-A') ELSE array('subject-A', 'subject-A') END")
    link = evidence.derive_link(F.col("citations"), objects, F.col("verdict"), task)
    return standins.decisions(spark, sf).select("ok", "ln", F.get(link, F.lit(0))["relation"].alias("relation"))
