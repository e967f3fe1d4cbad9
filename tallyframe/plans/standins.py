"""Evaluation records derived from the driver tables, each next to the SQL that derives the same rows.

Every derivation is a projection or one partial aggregation, so its work grows with the table it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BOX, CITATION, EVIDENCE, LINK, REQ, SUBCLAIM
from ..skew import spread
from .registry import table

ARMS = ("initial_text", "full_available_text", "interactive_agent")
MODELS = ("A", "N", "R")

# ---------------------------------------------------------------- episodes: one result per model, arm and family

RAW_EPISODES_SQL = """raw_episodes AS (
  SELECT l_returnflag AS model,
    CASE l_linenumber % 3 WHEN 0 THEN 'initial_text' WHEN 1 THEN 'full_available_text' ELSE 'interactive_agent' END AS arm,
    l_partkey AS pk, l_orderkey AS ok, l_linenumber AS ln, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q,
    l_extendedprice AS ep, CAST(round(l_discount*100) AS BIGINT) AS d, CAST(round(l_tax*100) AS BIGINT) AS t
  FROM lineitem)"""

EPISODES_SQL = RAW_EPISODES_SQL + """, episodes AS (
  SELECT model, arm, pk, 'f' || pk AS family_id, CASE WHEN pk % 3 < 2 THEN 'state' ELSE 'identity' END AS task,
    CASE WHEN pk % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS source_label,
    CASE WHEN q % 10 < 4 THEN 'Supported' WHEN q % 10 < 7 THEN 'Refuted' WHEN q % 10 < 9 THEN 'Need more evidence' END AS verdict,
    CASE WHEN q % 10 = 9 THEN 'context_limit' ELSE 'finished' END AS termination,
    CASE WHEN arm = 'interactive_agent' THEN sk % 4 ELSE 0 END AS requests,
    CASE WHEN arm = 'interactive_agent' THEN sk % 4 ELSE 0 END + ln % 3 AS tool_calls,
    d % 2 AS errors, CAST(floor(ep) AS BIGINT) % 5000 AS input_tokens, q * 7 AS output_tokens,
    CAST(floor(ep) AS BIGINT) % 977 / 8.0 AS latency_s, (q % 20) / 20.0 AS confidence,
    arm = 'interactive_agent' AND sk % 4 > 0 AND t > 2 AS new_image,
    arm = 'interactive_agent' AND sk % 4 > 0 AND t <= 2 AND d > 3 AS failed_request,
    arm = 'interactive_agent' AND sk % 4 > 0 AND t <= 2 AND d <= 3 AS repeated_only,
    ok, ln, sk, q, d, t
  FROM (SELECT * FROM raw_episodes
        QUALIFY row_number() OVER (PARTITION BY model, arm, pk ORDER BY ok, ln, sk, q, ep, d, t) = 1))"""


def raw_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows with replays: several rows per (model, arm, family)."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS model",
        "CASE l_linenumber % 3 WHEN 0 THEN 'initial_text' WHEN 1 THEN 'full_available_text' ELSE 'interactive_agent' END AS arm",
        "l_partkey AS pk", "l_orderkey AS ok", "l_linenumber AS ln", "l_suppkey AS sk", "CAST(l_quantity AS BIGINT) AS q",
        "l_extendedprice AS ep", "CAST(round(l_discount*100) AS BIGINT) AS d", "CAST(round(l_tax*100) AS BIGINT) AS t",
    )


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (model, arm, family): the first of its replays, combined before the shuffle."""
    first = (
        raw_episodes(spark, sf).groupBy("model", "arm", "pk")
        .agg(F.min(F.struct("ok", "ln", "sk", "q", "ep", "d", "t")).alias("r")).select("model", "arm", "pk", "r.*")
    )
    asked = "arm = 'interactive_agent' AND sk % 4 > 0"
    return first.selectExpr(
        "model", "arm", "pk", "'f' || pk AS family_id",
        "CASE WHEN pk % 3 < 2 THEN 'state' ELSE 'identity' END AS task",
        "CASE WHEN pk % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS source_label",
        "CASE WHEN q % 10 < 4 THEN 'Supported' WHEN q % 10 < 7 THEN 'Refuted' WHEN q % 10 < 9 THEN 'Need more evidence' END AS verdict",
        "CASE WHEN q % 10 = 9 THEN 'context_limit' ELSE 'finished' END AS termination",
        "CASE WHEN arm = 'interactive_agent' THEN sk % 4 ELSE 0 END AS requests",
        "CASE WHEN arm = 'interactive_agent' THEN sk % 4 ELSE 0 END + ln % 3 AS tool_calls",
        "d % 2 AS errors", "CAST(floor(ep) AS BIGINT) % 5000 AS input_tokens", "q * 7 AS output_tokens",
        "CAST(CAST(floor(ep) AS BIGINT) % 977 AS DOUBLE) / 8 AS latency_s", "CAST(q % 20 AS DOUBLE) / 20 AS confidence",
        f"{asked} AND t > 2 AS new_image", f"{asked} AND t <= 2 AND d > 3 AS failed_request",
        f"{asked} AND t <= 2 AND d <= 3 AS repeated_only", "ok", "ln", "sk", "q", "d", "t",
    )


# ---------------------------------------------------------------- variants: one agent episode per family and variant

VARIANT_EPISODES_SQL = """variant_episodes AS (
  SELECT pk, 'f' || pk AS family_id, ['Sufficient', 'Obtainable', 'Missing', 'Unavailable'][v + 1] AS variant,
    CASE WHEN pk % 3 < 2 THEN 'state' ELSE 'identity' END AS task,
    CASE WHEN pk % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS source_label,
    CASE WHEN q % 10 < 4 THEN 'Supported' WHEN q % 10 < 7 THEN 'Refuted' WHEN q % 10 < 9 THEN 'Need more evidence' END AS verdict,
    CASE WHEN q % 10 = 9 THEN 'context_limit' ELSE 'finished' END AS termination,
    sk % 3 AS requests, sk % 3 + ln % 3 AS tool_calls, CASE WHEN sk % 3 > 0 THEN d % 3 ELSE 0 END AS new_photos, d, q
  FROM (SELECT l_partkey AS pk, l_suppkey % 4 AS v, l_orderkey AS ok, l_linenumber AS ln, l_suppkey AS sk,
          CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*100) AS BIGINT) AS d FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY pk, v ORDER BY ok, ln, sk, q, d) = 1))"""


def variant_episodes(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS pk", "l_suppkey % 4 AS v", "l_orderkey AS ok", "l_linenumber AS ln", "l_suppkey AS sk",
        "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_discount*100) AS BIGINT) AS d",
    )
    first = raw.groupBy("pk", "v").agg(F.min(F.struct("ok", "ln", "sk", "q", "d")).alias("r")).select("pk", "v", "r.*")
    return first.selectExpr(
        "pk", "'f' || pk AS family_id", "array('Sufficient', 'Obtainable', 'Missing', 'Unavailable')[v] AS variant",
        "CASE WHEN pk % 3 < 2 THEN 'state' ELSE 'identity' END AS task",
        "CASE WHEN pk % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS source_label",
        "CASE WHEN q % 10 < 4 THEN 'Supported' WHEN q % 10 < 7 THEN 'Refuted' WHEN q % 10 < 9 THEN 'Need more evidence' END AS verdict",
        "CASE WHEN q % 10 = 9 THEN 'context_limit' ELSE 'finished' END AS termination",
        "sk % 3 AS requests", "sk % 3 + ln % 3 AS tool_calls", "CASE WHEN sk % 3 > 0 THEN d % 3 ELSE 0 END AS new_photos",
        "d", "q",
    )


# ---------------------------------------------------------------- messages: one row per trace message

MESSAGES_SQL = """messages AS (
  SELECT user_id AS episode, event_id AS pos, k, value,
    CASE event_type WHEN 'signup' THEN 'system' WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' ELSE 'tool' END AS role,
    CASE WHEN event_type = 'click' THEN ['request_photo', 'crop', 'ocr', 'finish'][k % 4 + 1] WHEN event_type = 'error' AND k % 11 = 0 THEN 'request_photo' END AS name,
    CASE WHEN event_type = 'click' THEN CASE WHEN k % 7 = 6 THEN '{"query": broken' ELSE '{"query": {"view": "v' || (k % 5) || '"}, "why": ' || k || '}' END END AS arguments,
    CASE event_type WHEN 'purchase' THEN '{"status": "provided", "images": 1}' WHEN 'error' THEN CASE WHEN k % 6 = 5 THEN 'status: none' ELSE '{"status": "unable_to_provide"}' END END AS text,
    CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'c' || (k // 4) END AS call_id,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'img-' || (k % 30) END AS image,
    CASE event_type WHEN 'purchase' THEN 'provided' WHEN 'error' THEN CASE WHEN k % 6 < 5 THEN 'unable_to_provide' END END AS status
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Trace messages in long form; the user is the episode and the event id the position."""
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.selectExpr(
        "user_id AS episode", "event_id AS pos", "k", "value",
        "CASE event_type WHEN 'signup' THEN 'system' WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' ELSE 'tool' END AS role",
        "CASE WHEN event_type = 'click' THEN array('request_photo', 'crop', 'ocr', 'finish')[k % 4] WHEN event_type = 'error' AND k % 11 = 0 THEN 'request_photo' END AS name",
        """CASE WHEN event_type = 'click' THEN CASE WHEN k % 7 = 6 THEN '{"query": broken' ELSE '{"query": {"view": "v' || (k % 5) || '"}, "why": ' || k || '}' END END AS arguments""",
        """CASE event_type WHEN 'purchase' THEN '{"status": "provided", "images": 1}' WHEN 'error' THEN CASE WHEN k % 6 = 5 THEN 'status: none' ELSE '{"status": "unable_to_provide"}' END END AS text""",
        "CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'c' || (k div 4) END AS call_id",
        "CASE WHEN event_type IN ('view', 'purchase') THEN 'img-' || (k % 30) END AS image",
        "CASE event_type WHEN 'purchase' THEN 'provided' WHEN 'error' THEN CASE WHEN k % 6 < 5 THEN 'unable_to_provide' END END AS status",
    )


# ---------------------------------------------------------------- claims: one nested decision per line item

CLAIM_BOXES_SQL = """claims AS (
  SELECT *, a AS rx0, b AS ry0, a + 10 + q % 10 AS rx1, b + 10 + ln AS ry1,
    a + q % 5 AS px0, b + ln % 3 AS py0, a + q % 5 + 8 + ln AS px1, b + ln % 3 + 6 + q % 9 AS py1,
    a + ln AS sx0, b + q % 4 AS sy0, a + ln + 5 + q % 11 AS sx1, b + q % 4 + 4 + ln AS sy1,
    a + 2 AS tx0, b + 2 AS ty0, a + 6 AS tx1, b + 6 AS ty1
  FROM (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_partkey % 20 AS a,
      l_suppkey % 20 AS b, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*100) AS BIGINT) AS d FROM lineitem))"""

_BOXES = {
    "r": "array(a, b, a + 10 + q % 10, b + 10 + ln)",
    "p": "array(a + q % 5, b + ln % 3, a + q % 5 + 8 + ln, b + ln % 3 + 6 + q % 9)",
    "s": "array(a + ln, b + q % 4, a + ln + 5 + q % 11, b + q % 4 + 4 + ln)",
    "t": "array(a + 2, b + 2, a + 6, b + 6)",
}


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Four boxes per line item: required ``r``, cited ``p`` and ``s``, small target ``t``."""
    base = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS ok", "l_linenumber AS ln", "l_partkey AS pk", "l_suppkey AS sk", "l_partkey % 20 AS a",
        "l_suppkey % 20 AS b", "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_discount*100) AS BIGINT) AS d",
    )
    return base.select("*", *[F.expr(e).cast("array<bigint>").alias(n) for n, e in _BOXES.items()])


def shifted(name: str) -> str:
    return f"transform({name}, v -> v + q % 3)"


RELATION_SQL = "['same_object', 'different_object', 'same_time', 'earlier_than']"


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with an expected and a given link, citations, a verdict and a two-part chain annotation."""
    relations = RELATION_SQL.replace("[", "array(").replace("]", ")")
    end = "named_struct('image_id', '{i}', 'bbox', {b}, 'time', 'before')"
    r, p = end.format(i="img-a", b="r"), end.format(i="img-b", b="p")
    r2, p2 = end.format(i="img-a", b=shifted("r")), end.format(i="img-b", b=shifted("p"))
    df = claims(spark, sf).withColumn(
        "expected",
        F.expr(
            f"named_struct('relation', {relations}[ln % 4], 'left', {r}, 'right', {p}, "
            "'min_iou', CASE WHEN q % 2 = 0 THEN 0.3D END)"
        ),
    ).withColumn(
        "given",
        F.expr(
            f"named_struct('relation', {relations}[(ln + CASE WHEN q % 5 = 0 THEN 1 ELSE 0 END) % 4], "
            f"'left', CASE WHEN d % 2 = 1 THEN {p2} ELSE {r2} END, 'right', CASE WHEN d % 2 = 1 THEN {r2} ELSE {p2} END, "
            "'min_iou', CAST(NULL AS DOUBLE))"
        ),
    )
    # Nulls are typed: a cast to REQ would take every record apart and copy its strings.
    region = (
        "named_struct('image_id', 'img-a', 'bbox', t, 'time', 'before', 'relation', CAST(null AS STRING), "
        f"'left', CAST(null AS {CITATION}), 'right', CAST(null AS {CITATION}), 'min_iou', CAST(null AS DOUBLE))"
    )
    linked = (
        f"named_struct('image_id', CAST(null AS STRING), 'bbox', CAST(null AS {BOX}), 'time', CAST(null AS STRING), 'relation', expected.relation, "
        "'left', expected.left, 'right', expected.right, 'min_iou', expected.min_iou)"
    )
    return (
        df.withColumn("citations", F.expr(
            "array(named_struct('image_id', 'img-a', 'bbox', p, 'time', 'before'), "
            "named_struct('image_id', 'img-a', 'bbox', s, 'time', 'before'))"))
        .withColumn("links", F.expr("CASE WHEN q % 4 > 0 THEN array(given) ELSE slice(array(given), 1, 0) END"))
        .withColumn("verdict", F.expr("array('Supported', 'Refuted', 'Need more evidence')[q % 3]"))
        .withColumn("t1", F.expr("CASE WHEN pk % 2 = 0 THEN 'Supported' ELSE 'Refuted' END"))
        .withColumn("t2", F.expr("CASE WHEN sk % 3 > 0 THEN 'Supported' ELSE 'Refuted' END"))
        .withColumn("region_req", F.expr(region)).withColumn("link_req", F.expr(linked))
        .withColumn("annotation", F.struct(
            F.lit("evidence-chain-v1").alias("protocol"), F.lit("reviewed").alias("status"),
            F.expr("CASE WHEN t1 = 'Refuted' OR t2 = 'Refuted' THEN 'Refuted' ELSE 'Supported' END").alias("verdict"),
            F.expr(
                "array(named_struct('id', 'region', 'kind', 'condition', 'truth', t1, 'minimal_evidence_sets', "
                "map(t1, array(array(region_req)))), named_struct('id', 'link', 'kind', 'identity', 'truth', t2, "
                "'minimal_evidence_sets', map(t2, array(array(link_req)))))"
            ).cast(f"array<{SUBCLAIM}>").alias("subclaims"),
        ))
    )


# ---------------------------------------------------------------- cases: one nested family per part

CASES_SQL = """cases AS (
  SELECT pk, 'f' || pk AS family_id, category, task, verdict, t1, t2, b_ok, c_ok, d_ok, pk % 6 = 1 AS c_initial
  FROM (SELECT *, CASE WHEN t1 = 'Refuted' OR t2 = 'Refuted' THEN 'Refuted' WHEN t2 = 'uncertain' THEN 'Need more evidence'
          ELSE 'Supported' END AS verdict
    FROM (SELECT p_partkey AS pk, p_brand AS category, CASE WHEN p_partkey % 3 < 2 THEN 'state' ELSE 'identity' END AS task,
      CASE WHEN p_partkey % 3 = 0 THEN 'Refuted' ELSE 'Supported' END AS t1,
      CASE p_partkey % 7 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'Refuted' ELSE 'Supported' END AS t2,
      p_partkey % 4 <> 0 AS b_ok, p_partkey % 3 <> 0 AS c_ok, p_partkey % 5 <> 0 AS d_ok FROM part)))"""


def pool_sql(b: str, c: str, d: str) -> str:
    """SQL of the verdict reachable with images b, c and d (the reference photo is always there)."""
    r1, r2 = f"({b} OR {c})", f"({c} OR {d})"
    return (
        f"CASE WHEN (t1 = 'Refuted' AND {r1}) OR (t2 = 'Refuted' AND {r2}) THEN 'Refuted' "
        f"WHEN t1 = 'Supported' AND {r1} AND t2 = 'Supported' AND {r2} THEN 'Supported' ELSE 'Need more evidence' END"
    )


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Nested families: evidence rows, initial images, request options and a two-part annotation."""
    # A part is a short row, its case a long one: parts of one file are dealt out first.
    part = spread(table(spark, sf, "part"), "p_partkey").selectExpr(
        "p_partkey AS pk", "'f' || p_partkey AS family_id", "p_brand AS category",
        "CASE WHEN p_partkey % 3 < 2 THEN 'state' ELSE 'identity' END AS task",
        "CASE WHEN p_partkey % 3 = 0 THEN 'Refuted' ELSE 'Supported' END AS t1",
        "CASE p_partkey % 7 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'Refuted' ELSE 'Supported' END AS t2",
    )

    def row(i: str, view: str, ok: str, source: str | None = None) -> str:
        return (
            f"named_struct('id', '{i}', 'source_id', '{source or i}', 'object', 'target', 'time', 'before', "
            f"'view', '{view}', 'available', {ok}, 'source_size', array(100L, 80L), 'source_bbox', array(0L, 0L, 100L, 80L), "
            f"'camera_view', CASE WHEN '{view}' = 'preview' THEN 'side' END)"
        )

    evidence = ", ".join([
        row("ref", "reference", "true"), row("b-preview", "preview", "true", "b"), row("b", "original", "pk % 4 <> 0"),
        row("c", "side", "pk % 3 <> 0"), row("d", "rear", "pk % 5 <> 0"),
    ])

    def req(i: str) -> str:
        return (
            f"named_struct('image_id', '{i}', 'bbox', array(0L, 0L, 10L, 10L), 'time', 'before', "
            "'relation', null, 'left', null, 'right', null, 'min_iou', null)"
        )

    end = "named_struct('image_id', '{}', 'bbox', array(0L, 0L, 10L, 10L), 'time', 'before')"
    link = (
        "named_struct('image_id', null, 'bbox', null, 'time', null, 'relation', 'same_object', "
        f"'left', {end.format('ref')}, 'right', {end.format('d')}, 'min_iou', 0.5D)"
    )
    groups = f"array<array<{REQ}>>"
    first = F.expr(f"array(array({req('b')}, {req('ref')}), array({req('c')}, {req('ref')}))").cast(groups)
    second = F.expr(f"array(array({link}), array({req('c')}))").cast(groups)
    none = F.create_map().cast(f"map<string,{groups}>")
    subclaims = F.array(
        F.struct(F.lit("s1").alias("id"), F.lit("condition").alias("kind"), F.col("t1").alias("truth"),
                 F.create_map("t1", first).alias("minimal_evidence_sets")),
        F.struct(F.lit("s2").alias("id"), F.lit("identity").alias("kind"), F.col("t2").alias("truth"),
                 F.when(F.col("t2") == "uncertain", none).otherwise(F.create_map("t2", second)).alias("minimal_evidence_sets")),
    )
    return part.withColumn("evidence", F.expr(f"array({evidence})").cast(f"array<{EVIDENCE}>")).withColumn(
        "initial", F.expr("CASE WHEN pk % 6 = 1 THEN array('ref', 'b-preview', 'c') ELSE array('ref', 'b-preview') END")
    ).withColumn("verdict", F.expr(
        "CASE WHEN t1 = 'Refuted' OR t2 = 'Refuted' THEN 'Refuted' WHEN t2 = 'uncertain' THEN 'Need more evidence' ELSE 'Supported' END"
    )).withColumn("annotation", F.struct(
        F.lit("evidence-chain-v1").alias("protocol"), F.lit("reviewed").alias("status"), F.col("verdict"),
        subclaims.cast(f"array<{SUBCLAIM}>").alias("subclaims"),
    )).withColumn("request_options", F.expr(
        "named_struct('objects', array('target'), 'times', array('before', 'after'), 'views', array('original', 'side', 'rear'))"
    ))


# ---------------------------------------------------------------- votes: reviewers of an order

VOTES_SQL = """votes AS (
  SELECT l_orderkey AS family_id, 'r' || (l_suppkey % 7) AS reviewer_id, l_linenumber AS ln,
    ['Supported', 'Refuted', 'Need more evidence'][CAST(l_quantity AS BIGINT) % 3 + 1] AS verdict,
    round(l_tax*100) < 8 AS claim_clear, CAST(round(l_discount*100) AS BIGINT) AS d, l_suppkey AS sk, l_partkey AS pk,
    CAST(l_quantity AS BIGINT) AS q
  FROM lineitem)"""


def votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS family_id", "'r' || (l_suppkey % 7) AS reviewer_id", "l_linenumber AS ln",
        "array('Supported', 'Refuted', 'Need more evidence')[CAST(l_quantity AS BIGINT) % 3] AS verdict",
        "round(l_tax*100) < 8 AS claim_clear", "CAST(round(l_discount*100) AS BIGINT) AS d", "l_suppkey AS sk",
        "l_partkey AS pk", "CAST(l_quantity AS BIGINT) AS q",
    )
