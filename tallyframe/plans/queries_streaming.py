"""Queries of the streaming operators: a table is staged as ordered files and streamed batch by batch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import streams
from . import standins
from .registry import query, table
from .standins import EPISODES_SQL


# Longer than all the log: repeats are known however far apart they are.
HORIZON = "3650 days"


def second(place: str) -> Column:
    """Event time of a row of the log: one second per step of its order."""
    return F.timestamp_seconds(F.col(place) + 1_000_000_000).alias("at")


@query("stream_ingest", """SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_returnflag)) > 1 AS conflicted FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", second("l_partkey"))
    keys = ["l_orderkey", "l_linenumber"]
    out = scratch_path(spark, "ingest")
    # A replay is a row of its own here, with its own time, which is not part of what it says.
    stream = streams.staged_stream(rows, "l_partkey", 3, "log")
    streams.stream_ingest(stream, keys, "at", HORIZON, out, scratch_path(spark, "checkpoint"))
    done = streams.ingested(spark, out, rows.schema).select(*keys)
    bad = streams.ingested(spark, out, rows.schema, "conflict").select(*keys).distinct().withColumn("_bad", F.lit(True))
    return done.join(bad, keys, "left").select(*keys, F.coalesce("_bad", F.lit(False)).alias("conflicted"))


# Arrivals: every row once; rows of orders in tens again, unchanged, and of orders in thirteens changed, one append later. The clock
# of some parts is a month behind: what comes of them after the first watermark took hold is late, replays included.
LATE_SQL = """WITH first AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS step, l_partkey % 50 = 7 AS behind FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)
SELECT l_orderkey, l_linenumber, NOT (behind AND step = 2) AS appended, l_orderkey % 13 = 0 AND step < 2 AND NOT (behind AND step = 1) AS conflicted,
  CAST(behind AND step = 2 AS BIGINT) + CAST(behind AND step = 1 AND l_orderkey % 10 = 0 AS BIGINT) + CAST(behind AND step = 1 AND l_orderkey % 13 = 0 AS BIGINT) AS late FROM first"""


@query("stream_ingest_late", LATE_SQL)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    first = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("r"))
    first = first.selectExpr("l_orderkey", "l_linenumber", "r.l_partkey % 3 AS step", "r.l_partkey % 50 = 7 AS behind", "'as it was' AS said")
    again = first.where("l_orderkey % 10 = 0 AND step < 2").withColumn("step", F.expr("step + 1"))
    changed = first.where("l_orderkey % 13 = 0 AND step < 2").withColumns({"step": F.expr("step + 1"), "said": F.lit("changed")})
    start = "CASE WHEN behind THEN 1000000000 ELSE 1002592000 END"
    # Replays carry the record time of the row that they repeat.
    log = first.withColumn("day", F.expr("step")).unionByName(again.withColumn("day", F.expr("step - 1"))).unionByName(changed.withColumn("day", F.expr("step - 1")))
    log = log.selectExpr("step", "l_orderkey", "l_linenumber", "said", f"timestamp_seconds({start} + 86400 * day + l_orderkey % 80000) AS at")
    keys, out = ["l_orderkey", "l_linenumber"], scratch_path(spark, "ingest")
    stream = streams.staged_steps(log, "step", 3, "log")
    streams.stream_ingest(stream, keys, "at", "3 days", out, scratch_path(spark, "checkpoint"))
    routes = {route: streams.ingested(spark, out, stream.schema, route).select(*keys, F.lit(route).alias("route")) for route in ("new", "conflict", "late")}
    rows = routes["new"].unionByName(routes["conflict"]).unionByName(routes["late"])
    return rows.groupBy(*keys).agg(
        F.max(F.col("route") == "new").alias("appended"), F.max(F.col("route") == "conflict").alias("conflicted"), F.count_if(F.col("route") == "late").alias("late")
    )


@query("stream_progress", """SELECT l_suppkey, count(DISTINCT l_partkey) AS done, count(DISTINCT l_partkey) = (SELECT count(*) FROM part) // 4 + l_suppkey % 3 AS ready FROM lineitem GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    parts = table(spark, sf, "part").count()
    expected = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.lit(parts // 4) + F.col("s_suppkey") % 3).alias("expected"))
    out = scratch_path(spark, "progress")
    stream = streams.staged_stream(rows.withColumn("at", second("l_orderkey")), "l_orderkey", 3, "runs")
    streams.stream_progress(stream, expected, "l_suppkey", ["l_partkey"], "at", HORIZON, out, scratch_path(spark, "checkpoint"))
    last = streams.routed(spark, out, "progress", streams.progress_schema(stream, "l_suppkey")).groupBy("l_suppkey").agg(F.max("done").alias("done"), F.max("expected").alias("expected"))
    return last.select("l_suppkey", "done", (F.col("done") == F.col("expected")).alias("ready"))


SESSIONS_SQL = """log AS (SELECT user_id AS actor, event_id AS seq, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) = 42 THEN 'finish' WHEN event_type = 'click' THEN 'request' ELSE event_type END AS action FROM events),
ends AS (SELECT actor, min(seq) AS e FROM log WHERE action = 'finish' GROUP BY 1)"""


@query("stream_sessions", f"""WITH {SESSIONS_SQL}
SELECT actor, count(*) FILTER (e IS NULL OR seq <= e) AS turns, count(*) FILTER ((e IS NULL OR seq <= e) AND action = 'request') AS requests, count(*) FILTER (seq > e) AS rejected, min(e) AS finished_at FROM log LEFT JOIN ends USING (actor) GROUP BY 1""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    log = table(spark, sf, "events").withColumn("k", k).selectExpr(
        "user_id AS actor", "event_id AS seq", "CASE WHEN k = 42 THEN 'finish' WHEN event_type = 'click' THEN 'request' ELSE event_type END AS action"
    )
    state = scratch_path(spark, "sessions")
    streams.stream_sessions(streams.staged_stream(log, "seq", 3, "log", "actor"), ["actor"], "seq", "action", state, scratch_path(spark, "checkpoint"))
    return streams.session_state(spark, ["actor"], "actor bigint", state)


CAP, STAGE_CAP = 60_000_000, 25_000_000
LEDGER_SQL = f"""WITH RECURSIVE ops AS (SELECT o_custkey AS ledger, o_orderkey AS k, o_orderpriority AS stage, CAST(round(o_totalprice * 100) AS BIGINT) AS bound,
    CASE WHEN o_orderkey % 29 > 0 THEN CAST(floor(o_totalprice * 80) AS BIGINT) END AS charge, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
run AS (SELECT ledger, 0::BIGINT AS rn, NULL::BIGINT AS k, 0::BIGINT AS total, MAP {{}}::MAP(VARCHAR, BIGINT) AS used, NULL::BIGINT AS open_, 0::BIGINT AS ob, NULL::VARCHAR AS o1, NULL::VARCHAR AS o2, 0::BIGINT AS a1, 0::BIGINT AS a2 FROM ops WHERE rn = 1
  UNION ALL SELECT ledger, rn, k, CASE WHEN takes AND charge <= bound THEN total + charge ELSE total END,
    CASE WHEN takes AND charge <= bound THEN map_concat(used, MAP {{stage: su + charge}}) ELSE used END,
    CASE WHEN takes AND (charge IS NULL OR charge > bound) THEN k ELSE open_ END, CASE WHEN takes AND (charge IS NULL OR charge > bound) THEN bound ELSE ob END,
    CASE WHEN takes THEN 'reserved' WHEN open_ IS NOT NULL THEN 'blocked' ELSE 'over_cap' END,
    CASE WHEN takes AND charge <= bound THEN 'settled' WHEN takes THEN 'unresolved' ELSE 'no_reservation' END,
    CASE WHEN takes THEN total + bound ELSE total + ob END, CASE WHEN takes AND charge <= bound THEN total + charge WHEN takes THEN total + bound ELSE total + ob END
  FROM (SELECT o.*, r.total, r.used, r.open_, r.ob, coalesce(r.used[o.stage], 0) AS su, r.open_ IS NULL AND r.total + o.bound <= {CAP} AND coalesce(r.used[o.stage], 0) + o.bound <= {STAGE_CAP} AS takes
    FROM run r JOIN ops o ON o.ledger = r.ledger AND o.rn = r.rn + 1))
SELECT ledger, k * 2 AS seq, 'k' || k AS key, o1 AS outcome, a1 AS accounted FROM run WHERE rn > 0 UNION ALL SELECT ledger, k * 2 + 1, 'k' || k, o2, a2 FROM run WHERE rn > 0"""


@query("stream_ledger", LEDGER_SQL)
def _(spark, sf):
    calls = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("ledger"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "o_orderkey", F.expr("'k' || o_orderkey").alias("key"),
        F.col("o_orderpriority").alias("stage"), F.expr("CAST(round(o_totalprice * 100) AS BIGINT)").alias("bound"),
        F.expr("CASE WHEN o_orderkey % 29 > 0 THEN CAST(floor(o_totalprice * 80) AS BIGINT) END").alias("charge"),
    ).selectExpr("ledger", "o_orderkey * 2 + side AS seq", "CASE side WHEN 0 THEN 'reserve' ELSE 'settle' END AS op", "key", "stage", "bound", "charge")
    out = scratch_path(spark, "ledger")
    streams.stream_ledger(streams.staged_stream(calls, "seq", 3, "calls", "ledger"), CAP, STAGE_CAP, out, scratch_path(spark, "checkpoint"))
    return streams.ledger_outcomes(spark, out)


@query("stream_live_counters", f"""WITH {EPISODES_SQL}
SELECT model, arm, count(*) AS episodes, count(*) FILTER (termination = 'finished') AS finished, sum(errors)::BIGINT AS errors, sum(requests)::BIGINT AS requests, count(*) FILTER (d <> 5) AS known_labels,
  count(*) FILTER (d <> 5 AND verdict IS NOT DISTINCT FROM source_label) AS matches FROM episodes GROUP BY 1, 2""")
def _(spark, sf):
    eps = standins.episodes(spark, sf).selectExpr("model", "arm", "pk", "termination", "errors", "requests", "verdict", "CASE WHEN d <> 5 THEN source_label END AS source_label")
    stream = streams.staged_stream(eps.withColumn("at", second("pk")), "pk", 3, "episodes")
    return streams.stream_live_counters(stream, ["model", "arm"], "at", "1 minute", "2 minutes", scratch_path(spark, "counters"), scratch_path(spark, "checkpoint"))


@query("import_settled", """WITH s AS (SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN 5::BIGINT END AS charge FROM orders)
SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'import' WHEN o_orderpriority = '1-URGENT' THEN 'skip' ELSE 'conflict' END AS action,
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 0 ELSE charge END AS charge FROM s WHERE charge IS NOT NULL""")
def _(spark, sf):
    source = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderpriority", "CASE WHEN o_orderstatus <> 'P' THEN 5L END AS charge")
    target = source.filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").withColumn("o_custkey", F.expr("CASE WHEN o_orderpriority = '2-HIGH' THEN -1 ELSE o_custkey END"))
    return streams.import_settled(source, target, ["o_orderkey"], F.col("o_custkey")).select("o_orderkey", "action", "charge")
