"""Queries of the trace operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tables
from ..operators import traces
from ..schemas import GENERATION
from . import standins
from .registry import query, table
from .standins import MESSAGES_SQL


@query("trace_messages", """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, lines[i] AS line FROM (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("messages"))
    return traces.explode_messages(docs, ["doc_id"]).withColumnRenamed("message", "line")


PARTS_SQL = """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, 0 AS part, 'text' AS type, CASE k % 3 WHEN 0 THEN 'say ' || k WHEN 1 THEN 't' || k ELSE '[{"type": ' || k END AS text, NULL::VARCHAR AS image_ref FROM e
UNION ALL SELECT event_id, 1, 'image', NULL, 'blobs/' || k FROM e WHERE k % 3 = 1"""


def contents(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").withColumn("k", k).withColumn("content", F.expr(
        """CASE k % 3 WHEN 0 THEN 'say ' || k
        WHEN 1 THEN '[{"type": "text", "text": "t' || k || '"}, {"type": "image", "image_ref": "blobs/' || k || '"}]'
        ELSE '[{"type": ' || k END"""
    ))


@query("content_parts", PARTS_SQL)
def _(spark, sf):
    return traces.content_parts(contents(spark, sf), ["event_id"])


@query("content_parts_lateral", PARTS_SQL)
def _(spark, sf):
    tables.register(spark)
    return spark.sql("SELECT m.event_id, p.* FROM {messages} m, LATERAL content_parts(m.content) p", messages=contents(spark, sf))


CALLS_SQL = MESSAGES_SQL + """, calls AS (SELECT episode, call_id, pos, name, arguments FROM messages WHERE role = 'assistant'), answered AS (
  SELECT m.episode, m.pos, m.call_id, m.name, m.status, m.image, d.pos AS call_pos, d.name AS call_name, d.arguments AS call_arguments
  FROM (SELECT * FROM messages WHERE role = 'tool') m ASOF LEFT JOIN calls d ON m.episode = d.episode AND m.call_id = d.call_id AND m.pos > d.pos), novelty AS (
  SELECT episode, pos, 1::BIGINT AS returned, CASE WHEN pos = min(pos) OVER (PARTITION BY episode, image) THEN 1::BIGINT ELSE 0::BIGINT END AS novel
  FROM messages WHERE image IS NOT NULL), asked AS (SELECT * FROM answered WHERE call_name = 'request_photo' OR name = 'request_photo'), requests AS (
  SELECT a.episode, a.pos, a.status, CASE WHEN json_valid(a.call_arguments) THEN json_extract_string(a.call_arguments, '$.query.view') END AS view,
    coalesce(n.returned, 0) AS returned, coalesce(n.novel, 0) AS novel, coalesce(n.novel = 0, false) AS repeated_only
  FROM asked a LEFT JOIN novelty n USING (episode, pos))"""


@query("call_responses", f"WITH {CALLS_SQL} SELECT * FROM answered")
def _(spark, sf):
    return traces.call_responses(standins.messages(spark, sf))


@query("image_novelty", f"WITH {CALLS_SQL} SELECT *, novel = 0 AS repeated_only FROM novelty")
def _(spark, sf):
    return traces.image_novelty(standins.messages(spark, sf))


@query("request_records", f"WITH {CALLS_SQL} SELECT * FROM requests")
def _(spark, sf):
    return traces.request_records(standins.messages(spark, sf))


@query("action_sequence", f"""WITH {MESSAGES_SQL}
SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY pos) AS ordinal, name, name = 'finish' AS is_finish FROM messages WHERE role = 'assistant'""")
def _(spark, sf):
    return traces.action_sequence(standins.messages(spark, sf))


@query("tool_errors", f"""WITH {MESSAGES_SQL}, codes AS (
  SELECT episode, 'E' || (k % 3) AS code FROM messages WHERE role = 'tool' AND k % 4 > 0
  UNION ALL SELECT episode, 'late' FROM messages WHERE role = 'tool' AND k % 4 = 3
  UNION ALL SELECT episode, 'format_correction' FROM messages WHERE role = 'user' AND k % 5 = 0)
SELECT episode, code, count(*) AS n FROM codes GROUP BY ALL""")
def _(spark, sf):
    text = F.expr(
        """CASE WHEN role = 'user' AND k % 5 = 0 THEN 'Invalid tool format. Try again'
        WHEN role = 'user' THEN 'hello' WHEN k % 4 = 0 THEN 'fine\n{"status": "ok"}'
        WHEN k % 4 = 3 THEN '{"error": "E' || (k % 3) || '"}\nnot json {\n{"error": "late"}'
        ELSE 'first\n{"error": "E' || (k % 3) || '"}' END"""
    )
    return traces.tool_errors(standins.messages(spark, sf).withColumn("text", text))


def word_sums_sql(h: str) -> str:
    """SQL of the multiset digest over row digests ``h``."""
    words = " || ':' || ".join(
        f"coalesce(sum(('0x' || substr({h}, {s}, 15))::BIGINT), 0)::VARCHAR" for s in (1, 16, 31, 46)
    )
    return f"sha256(count({h})::VARCHAR || ':' || {words})"


PROMPTS_SQL = f"""firsts AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE role = 'assistant' GROUP BY 1), prompts AS (
  SELECT conv_id, count(*) AS rows, {word_sums_sql('h')} AS prompt_digest FROM (
    SELECT conv_id, sha256('=' || turn || chr(31) || '=' || role || chr(31) || '=' || text) AS h
    FROM conversations LEFT JOIN firsts USING (conv_id) WHERE f IS NULL OR turn < f) GROUP BY conv_id)"""


@query("initial_prompt", f"WITH {PROMPTS_SQL} SELECT * FROM prompts")
def _(spark, sf):
    return traces.initial_prompt(table(spark, sf, "conversations"), ["conv_id"])


@query("prefix_parity", f"""WITH {PROMPTS_SQL}
SELECT pair, CASE WHEN n <> 2 THEN 'missing_side' ELSE 'different_prompt' END AS reason FROM (
  SELECT conv_id // 2 AS pair, count(*) AS n, min(prompt_digest) AS lo, max(prompt_digest) AS hi FROM prompts GROUP BY 1) WHERE n <> 2 OR lo <> hi""")
def _(spark, sf):
    prompts = traces.initial_prompt(table(spark, sf, "conversations"), ["conv_id"])
    return traces.prefix_parity(prompts.withColumn("pair", F.expr("conv_id div 2")), "pair", "conv_id")


@query("first_success_prefix", f"""WITH {CALLS_SQL}, stops AS (
  SELECT episode, min(pos) AS stop FROM requests WHERE status = 'provided' AND novel > 0 GROUP BY 1)
SELECT m.episode, m.pos, m.role, s.stop FROM messages m JOIN stops s USING (episode) WHERE m.pos <= s.stop""")
def _(spark, sf):
    return traces.first_success_prefix(standins.messages(spark, sf)).select("episode", "pos", "role", "stop")


@query("public_state", "SELECT user_id, event_type, arg_max(props, event_id) AS value, max(event_id) AS at FROM events GROUP BY 1, 2")
def _(spark, sf):
    return traces.public_state(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", "props")


BUDGET = 60
REPLAY_SQL = f"""WITH RECURSIVE acts AS (
  SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
    CASE WHEN k = 99 THEN 'finish' WHEN k = 98 THEN 'paint' ELSE ['request_photo', 'crop', 'ocr', 'compare'][k % 4 + 1] END AS name,
    CASE WHEN k = 99 THEN 0 WHEN k = 98 THEN NULL ELSE [3, 1, 2, 2][k % 4 + 1] END AS price
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)), run AS (
  SELECT episode, 0::BIGINT AS rn, NULL::VARCHAR AS name, {BUDGET}::BIGINT AS left_, false AS done, NULL::VARCHAR AS outcome, NULL::INTEGER AS price
  FROM acts WHERE rn = 1
  UNION ALL
  SELECT a.episode, a.rn, a.name, CASE WHEN NOT r.done AND a.name <> 'finish' AND a.price <= r.left_ THEN r.left_ - a.price ELSE r.left_ END,
    r.done OR a.name = 'finish',
    CASE WHEN r.done THEN 'episode_finished' WHEN a.name = 'finish' THEN 'finished' WHEN a.price IS NULL THEN 'unknown_action'
      WHEN a.price <= r.left_ THEN 'accepted' ELSE 'insufficient_budget' END, a.price
  FROM run r JOIN acts a ON a.episode = r.episode AND a.rn = r.rn + 1)
SELECT episode, count(*) FILTER (outcome = 'accepted') AS calls, count(*) FILTER (outcome = 'accepted' AND name = 'request_photo') AS requests,
  coalesce(sum(price) FILTER (outcome = 'accepted' AND name = 'request_photo'), 0)::BIGINT AS request_cost,
  coalesce(sum(price) FILTER (outcome = 'accepted' AND name <> 'request_photo'), 0)::BIGINT AS tool_cost,
  count(*) FILTER (outcome IN ('insufficient_budget', 'episode_finished', 'unknown_action')) AS rejected, min(left_) AS remaining,
  bool_or(outcome = 'finished') AS finished
FROM run WHERE rn > 0 GROUP BY episode"""


@query("replay_actions", REPLAY_SQL)
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    acts = table(spark, sf, "events").withColumn("k", k).selectExpr(
        "user_id AS episode", "event_id AS pos",
        "CASE WHEN k = 99 THEN 'finish' WHEN k = 98 THEN 'paint' ELSE array('request_photo', 'crop', 'ocr', 'compare')[k % 4] END AS name",
    )
    return traces.replay_summary(traces.replay_actions(acts, BUDGET), BUDGET)


# Images 0 to 19 of each episode; every tenth is out from the start, a fourth is never available. Everything but a request looks at one.
RELEASE_SQL = f"""WITH RECURSIVE acts AS (
  SELECT user_id AS episode, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, k % 5 AS view, (k * 7 + event_id) % 20 AS image,
    CASE WHEN k = 99 THEN 'finish' WHEN k = 98 THEN 'paint' ELSE ['request_photo', 'crop', 'ocr', 'request_photo'][k % 4 + 1] END AS name,
    CASE WHEN k = 99 THEN 0 WHEN k = 98 THEN NULL ELSE [2, 1, 4, 2][k % 4 + 1] END AS price
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
full_acts AS (SELECT *, list_filter(range(20), lambda i: (i + episode) % 4 > 0 AND i % 5 = view) AS stock FROM acts),
run AS (
  SELECT episode, 0::BIGINT AS rn, NULL::BIGINT AS pos, NULL::VARCHAR AS outcome, NULL::BIGINT AS given, false AS is_new, {BUDGET}::BIGINT AS left_, false AS done, [0::BIGINT, 10] AS out_ FROM acts WHERE rn = 1
  UNION ALL
  SELECT episode, rn, pos, outcome, CASE WHEN gives THEN coalesce(fresh, stock[1]) END, gives AND fresh IS NOT NULL,
    CASE WHEN outcome = 'accepted' THEN left_ - price ELSE left_ END, done OR outcome = 'finished', CASE WHEN gives AND fresh IS NOT NULL THEN list_append(out_, fresh) ELSE out_ END
  FROM (SELECT *, name = 'request_photo' AND outcome = 'accepted' AS gives, list_filter(stock, lambda i: NOT list_contains(out_, i))[1] AS fresh
    FROM (SELECT a.*, r.left_, r.done, r.out_, CASE WHEN r.done THEN 'episode_finished' WHEN a.name = 'finish' AND list_contains(r.out_, a.image) THEN 'finished'
        WHEN a.price IS NULL THEN 'unknown_action' WHEN a.price > r.left_ THEN 'insufficient_budget'
        WHEN a.name <> 'request_photo' AND NOT list_contains(r.out_, a.image) THEN 'unreleased_image' ELSE 'accepted' END AS outcome
      FROM run r JOIN full_acts a ON a.episode = r.episode AND a.rn = r.rn + 1)))
SELECT episode, pos, outcome, given, is_new, CAST(len(out_) AS BIGINT) AS n_released, left_ AS remaining FROM run WHERE rn > 0"""


@query("replay_releases", RELEASE_SQL)
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    acts = table(spark, sf, "events").withColumn("k", k).selectExpr(
        "user_id AS episode", "event_id AS pos", "k % 5 AS view", "(k * 7 + event_id) % 20 AS image",
        "CASE WHEN k = 99 THEN 'finish' WHEN k = 98 THEN 'paint' ELSE array('request_photo', 'crop', 'ocr', 'request_photo')[k % 4] END AS name",
    )
    images = table(spark, sf, "events").select(F.col("user_id").alias("episode")).distinct().withColumn("image", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<long>")))
    evidence = images.selectExpr("episode", "image % 5 AS view", "image", "(image + episode) % 4 > 0 AS available", "image % 10 = 0 AS released")
    replayed = traces.replay_releases(acts, evidence, BUDGET, costs={"request_photo": 2, "ocr": 4})
    # The last state of a finished episode stands for what was left when it ended.
    left = F.min(F.when(F.col("state_after") <= BUDGET, F.col("state_after"))).over(W.partitionBy("episode").orderBy("pos"))
    return replayed.select("episode", "pos", "outcome", "given", "is_new", "n_released", F.coalesce(left, F.lit(BUDGET)).cast("long").alias("remaining"))


@query("resolve_request", f"""WITH {MESSAGES_SQL}, ev AS (
  SELECT episode, k % 5 AS view, k AS id, bool_or(value < 60) AS available, k % 10 = 0 AS released FROM messages WHERE role = 'user' GROUP BY episode, k),
fresh AS (SELECT episode, view, id, row_number() OVER (PARTITION BY episode, view ORDER BY id) AS turn FROM ev WHERE available AND NOT released),
small AS (SELECT episode, view, min(id) AS smallest FROM ev WHERE available GROUP BY 1, 2),
asked AS (SELECT episode, k % 5 AS view, pos, row_number() OVER (PARTITION BY episode, k % 5 ORDER BY pos) AS turn FROM messages WHERE role = 'assistant')
SELECT episode, view, pos, coalesce(id, smallest) AS given, id IS NOT NULL AS is_new,
  CASE WHEN coalesce(id, smallest) IS NULL THEN 'unable_to_provide' ELSE 'provided' END AS status
FROM asked LEFT JOIN fresh USING (episode, view, turn) LEFT JOIN small USING (episode, view)""")
def _(spark, sf):
    log = standins.messages(spark, sf).withColumn("view", F.expr("k % 5"))
    evidence = log.filter("role = 'user'").groupBy("episode", "view", F.col("k").alias("id")).agg(
        F.bool_or(F.col("value") < 60).alias("available")
    ).withColumn("released", F.col("id") % 10 == 0)
    requests = log.filter("role = 'assistant'").select("episode", "view", "pos")
    return traces.resolve_requests(requests, evidence, ["episode", "view"])


ZOOMS = "CASE event_type WHEN 'click' THEN 'zoom' WHEN 'view' THEN 'zoom' WHEN 'purchase' THEN 'show' WHEN 'error' THEN 'request' ELSE 'other' END AS kind, CAST([0.125, 0.5, 0.75, 1.5, 2.0, 4.0][k % 6 + 1] AS DOUBLE) AS factor"


@query("replay_sessions", f"""WITH RECURSIVE acts AS (
  SELECT user_id AS actor, k % 3 AS source, row_number() OVER (PARTITION BY user_id, k % 3 ORDER BY event_id) AS rn, {ZOOMS}
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)), run AS (
  SELECT actor, source, 0::BIGINT AS rn, NULL::VARCHAR AS kind, 1.0::DOUBLE AS scale FROM acts WHERE rn = 1
  UNION ALL
  SELECT a.actor, a.source, a.rn, a.kind, CASE a.kind WHEN 'zoom' THEN least(4.0, greatest(0.25, r.scale * a.factor)) WHEN 'show' THEN 1.0 ELSE r.scale END::DOUBLE
  FROM run r JOIN acts a ON a.actor = r.actor AND a.source = r.source AND a.rn = r.rn + 1)
SELECT actor, source, round(arg_max(scale, rn), 9) AS display_scale, count(*) FILTER (kind <> 'zoom') AS turns,
  count(*) FILTER (kind = 'zoom') AS presentation_events, count(*) FILTER (kind = 'request') AS requests
FROM run WHERE rn > 0 GROUP BY 1, 2""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    zooms = ZOOMS.replace("[0.125, 0.5, 0.75, 1.5, 2.0, 4.0][k % 6 + 1]", "array(0.125, 0.5, 0.75, 1.5, 2.0, 4.0)[k % 6]").split(", CAST")
    log = table(spark, sf, "events").withColumn("k", k).selectExpr("user_id AS actor", "k % 3 AS source", "event_id AS pos", zooms[0], "CAST" + zooms[1])
    return traces.replay_sessions(log, ["actor", "source"]).withColumn("display_scale", F.round("display_scale", 9))


@query("visible_images", f"""WITH {MESSAGES_SQL}, first AS (
  SELECT episode, image, min((CASE WHEN role = 'tool' THEN 0 ELSE 1 END)::BIGINT * 1000000000000 + pos) AS o FROM messages WHERE image IS NOT NULL GROUP BY 1, 2)
SELECT episode, image, row_number() OVER (PARTITION BY episode ORDER BY o) AS ordinal FROM first""")
def _(spark, sf):
    rank = F.when(F.col("role") == "tool", 0).otherwise(1)
    return traces.visible_images(standins.messages(spark, sf), ["episode"], "image", rank, "pos")


@query("generation_usage", """
WITH base AS (SELECT l_orderkey AS ok, l_linenumber AS ln, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*100) AS BIGINT) AS d FROM lineitem)
SELECT ok, ln, q * 10 + CASE WHEN ln % 3 = 0 THEN 0 ELSE q END AS input_tokens, CASE WHEN d = 9 THEN NULL ELSE q END + CASE WHEN ln % 3 = 0 THEN 0 ELSE d END AS output_tokens,
  d / 8.0 + CASE WHEN ln % 3 = 0 THEN 0 ELSE 0.5 END AS model_s, CASE WHEN ln % 3 = 0 THEN 1 ELSE 2 END AS model_calls,
  CASE WHEN ln % 3 = 0 THEN 1 ELSE 0 END AS rejected_calls,
  CASE WHEN d = 9 THEN 'invalid_measure' WHEN q IN (7, 8) THEN 'latency_mismatch' END AS problem FROM base""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS ok", "l_linenumber AS ln", "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_discount*100) AS BIGINT) AS d"
    )
    generation = F.expr(
        "array(named_struct('input_tokens', q * 10, 'output_tokens', CASE WHEN d = 9 THEN NULL ELSE q END, 'latency_s', d / 8.0D, 'halt', null, 'reasoning_tokens', null), "
        "named_struct('input_tokens', q, 'output_tokens', CASE WHEN ln % 3 = 0 THEN NULL ELSE d END, 'latency_s', 0.5D, "
        "'halt', CASE WHEN ln % 3 = 0 THEN 'context' END, 'reasoning_tokens', null))"
    ).cast(f"array<{GENERATION}>")
    wall = F.expr("CAST(d AS DOUBLE)")
    wall = F.when(F.col("q") == 8, float("nan")).otherwise(wall)
    usage = traces.generation_usage(generation, wall, F.when(F.col("q") == 7, wall + 1).otherwise(wall))
    return df.withColumn("u", usage).select("ok", "ln", "u.*")


@query("api_usage", """
WITH g AS (SELECT o_orderkey AS ok, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS v FROM orders)
SELECT ok, 2 * v + 5 AS input_tokens, v % 100 + 7 AS output_tokens, v % 10 AS reasoning_tokens,
  (CASE WHEN ok % 3 = 0 THEN 4.5 ELSE v / 8.0 END + 0.25)::DOUBLE AS model_s,
  CASE WHEN ok % 3 = 0 THEN 1::BIGINT ELSE 0::BIGINT END AS replayed_calls, 2::BIGINT AS model_calls FROM g""")
def _(spark, sf):
    base = table(spark, sf, "orders").selectExpr("o_orderkey AS ok", "CAST(floor(o_totalprice) AS BIGINT) % 1000 AS v")
    runs = base.select("ok", F.expr(
        "array(named_struct('input_tokens', v * 2, 'output_tokens', v % 100, 'latency_s', v / 8.0D, 'halt', null, 'reasoning_tokens', v % 10), "
        "named_struct('input_tokens', 5L, 'output_tokens', 7L, 'latency_s', 0.25D, 'halt', null, 'reasoning_tokens', null))"
    ).cast(f"array<{GENERATION}>").alias("generation"))
    pilot = base.filter("ok % 3 = 0").selectExpr("ok", "0 AS call", "4.5D AS original_s")
    return traces.api_usage(runs, pilot, ["ok"])


@query("image_refs", """
SELECT doc_id, 'blobs/' || sha256(text) || '.png' AS image_ref, true AS content_addressed FROM documents
UNION ALL SELECT doc_id, '/tmp/' || doc_id || '.png', false FROM documents WHERE doc_id % 3 = 0""")
def _(spark, sf):
    doc = F.expr(
        """concat('{"a": [{"image_ref": "blobs/', sha2(text, 256), '.png"}, {"b": {"image_ref":"',
        CASE WHEN doc_id % 3 = 0 THEN '/tmp/' || doc_id ELSE 'blobs/' || sha2(text, 256) END, '.png"}}]}')"""
    )
    return traces.image_refs(table(spark, sf, "documents").withColumn("doc", doc), ["doc_id"], "doc")


@query("trace_excerpt", f"""WITH {CALLS_SQL}, answers AS (
  SELECT episode, call_id, call_pos AS pos, arg_max_null(status, pos) AS status, count(*) AS responses FROM answered WHERE call_pos IS NOT NULL GROUP BY 1, 2, 3)
SELECT m.episode, m.pos, m.name, a.status, coalesce(a.responses, 0) AS responses FROM messages m LEFT JOIN answers a USING (episode, call_id, pos) WHERE m.role = 'assistant'""")
def _(spark, sf):
    return traces.trace_excerpt(standins.messages(spark, sf))


@query("request_events", f"WITH {CALLS_SQL} SELECT episode, pos, status, image AS returned FROM asked")
def _(spark, sf):
    return traces.request_events(standins.messages(spark, sf))


@query("episode_rows", """
WITH base AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*100) AS BIGINT) AS d FROM lineitem)
SELECT ok, ln, pk, ['Supported', 'Refuted', 'Need more evidence'][q % 3 + 1] AS verdict, d / 8.0 AS wall_latency_s, p_brand AS category,
  CASE WHEN pk % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS source_label, ['Supported', 'Refuted', 'Need more evidence'][q % 3 + 1] = CASE WHEN pk % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS source_label_match,
  q * 10 + d AS input_tokens, q + d AS output_tokens, 2 AS model_calls, greatest(q * 100, 3000 - q) AS peak_memory_mb,
  'img-' || (pk % 4) = 'img-' || (q % 4) AS received_target FROM base JOIN part ON p_partkey = pk""")
def _(spark, sf):
    records = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS ok", "l_linenumber AS ln", "l_partkey AS pk", "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_discount*100) AS BIGINT) AS d"
    ).selectExpr(
        "ok", "ln", "pk", "array('Supported', 'Refuted', 'Need more evidence')[q % 3] AS verdict", "d / 8.0D AS wall_latency_s",
        "array(named_struct('input_tokens', q * 10, 'output_tokens', q, 'latency_s', 0.5D, 'halt', CAST(null AS STRING), 'memory_mb', q * 100), "
        "named_struct('input_tokens', d, 'output_tokens', d, 'latency_s', 0.5D, 'halt', null, 'memory_mb', 3000 - q)) AS generation",
        "array('img-' || (q % 4), 'ref') AS released",
    )
    cases = table(spark, sf, "part").selectExpr(
        "p_partkey AS pk", "p_brand AS category", "CASE WHEN p_partkey % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS source_label",
        "'img-' || (p_partkey % 4) AS target",
    )
    return traces.episode_rows(records, cases, "pk")


@query("branch_audit", """
WITH base AS (SELECT l_orderkey AS origin, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
worlds AS (SELECT origin, count(DISTINCT CASE WHEN q = 50 THEN 'changed' ELSE 'same' END) = 1 AS world_unchanged FROM base GROUP BY 1)
SELECT origin, ln, pk, CASE WHEN pk % 3 > 0 THEN 'p' || (pk % 3) ELSE '' END AS first_action_releases,
  CASE WHEN pk % 3 > 0 THEN 'p' || (pk % 3) ELSE '' END || CASE WHEN pk % 3 > 0 AND sk % 2 = 0 THEN ',' ELSE '' END || CASE WHEN sk % 2 = 0 THEN 's' ELSE '' END AS branch_releases,
  world_unchanged FROM base JOIN worlds USING (origin)""")
def _(spark, sf):
    branches = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS origin", "l_linenumber AS ln", "l_partkey AS pk", "array('ref', 'p0') AS released_base",
        "array('ref', 'p0', 'p' || (l_partkey % 3)) AS released_first",
        "CASE WHEN l_suppkey % 2 = 0 THEN array('ref', 'p0', 'p' || (l_partkey % 3), 's') ELSE array('ref', 'p0', 'p' || (l_partkey % 3)) END AS released_all",
        "CASE WHEN CAST(l_quantity AS BIGINT) = 50 THEN 'changed' ELSE 'same' END AS fingerprint",
    )
    return traces.branch_audit(branches).select(
        "origin", "ln", "pk", F.array_join("first_action_releases", ",").alias("first_action_releases"),
        F.array_join("branch_releases", ",").alias("branch_releases"), "world_unchanged",
    )
