"""Queries of statistics, bootstraps and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap, reports, stats
from . import standins
from .queries_curation import COHORT_SQL, cohort
from .registry import query, table
from .standins import EPISODES_SQL, VARIANT_EPISODES_SQL

OK = "(verdict IS NOT DISTINCT FROM source_label)"
DEF = "coalesce(verdict IN ('Supported', 'Refuted'), false)"
ARM0, ARM1 = "initial_text", "interactive_agent"


def rate_sql(condition: str, name: str) -> str:
    return f"round(avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS {name}"


def rounded(df, *names, digits=6):
    """Round the named columns; the rest stays."""
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("label_agreement", f"""WITH {COHORT_SQL}
SELECT model, arm, coalesce(task, 'overall') AS task, count(*) AS episodes, count(*) FILTER {OK} AS matches,
  round(count(*) FILTER {OK} / count(*), 6) AS accuracy
FROM episodes WHERE family_id IN (SELECT family_id FROM cohort) GROUP BY GROUPING SETS ((model, arm), (model, arm, task))""")
def _(spark, sf):
    eps = standins.episodes(spark, sf)
    kept = eps.join(cohort(eps), "family_id", "left_semi")
    return rounded(stats.label_agreement(kept), "accuracy")


@query("metric_means", f"""WITH {EPISODES_SQL}
SELECT model, arm, count(*) AS episodes, count(DISTINCT family_id) AS families, round(avg(CASE WHEN new_image THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS new_image,
  round(avg(requests), 6) AS requests, round(avg(latency_s)::DOUBLE, 6) AS latency_s, max(input_tokens) AS max_input_tokens FROM episodes GROUP BY 1, 2""")
def _(spark, sf):
    metrics = ["new_image", "requests", "latency_s"]
    return rounded(stats.metric_means(standins.episodes(spark, sf), ["model", "arm"], metrics, "family_id", "input_tokens"), *metrics)


@query("counter", f"""WITH {EPISODES_SQL}, c AS (SELECT model, arm, coalesce(verdict, 'No submitted verdict') AS answer, count(*) AS n FROM episodes GROUP BY ALL)
SELECT model, arm, string_agg(answer || '=' || n, ',' ORDER BY answer) AS counts FROM c GROUP BY 1, 2""")
def _(spark, sf):
    counts = stats.counter_map(standins.episodes(spark, sf), ["model", "arm"], "verdict")
    text = F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return counts.select("model", "arm", F.array_join(text, ",").alias("counts"))


@query("counter_rows", f"""WITH {EPISODES_SQL} SELECT model, arm, coalesce(verdict, 'No submitted verdict') AS answer, count(*) AS n FROM episodes GROUP BY ALL""")
def _(spark, sf):
    return stats.counter(standins.episodes(spark, sf), ["model", "arm"], "verdict")


@query("majority_baseline", """WITH c AS (SELECT lang, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS rows, arg_max(quality, (n, quality)) AS majority, round(max(n) / sum(n), 6) AS share FROM c GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return rounded(stats.majority_baseline(table(spark, sf, "labels").join(docs, "doc_id"), ["lang"], "quality"), "share")


@query("selective_error", f"""WITH {EPISODES_SQL}
SELECT model, arm, count(*) FILTER ({DEF}) AS definite, round((1 - avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) FILTER ({DEF}))::DOUBLE, 6) AS selective_error FROM episodes GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(stats.selective_error(standins.episodes(spark, sf), ["model", "arm"]), "selective_error")


@query("risk_coverage", f"""WITH {EPISODES_SQL}, t AS (SELECT unnest([0.0, 0.5, 0.7, 0.8, 0.9, 0.95])::DOUBLE AS threshold),
x AS (SELECT *, verdict IS NOT NULL AND verdict <> 'Need more evidence' AND confidence >= threshold AS c FROM episodes, t)
SELECT model, arm, threshold, count(*) FILTER (c) AS covered, round(count(*) FILTER (c) / count(*), 6) AS coverage,
  round(1 - count(*) FILTER (c AND {OK}) / nullif(count(*) FILTER (c), 0), 6) AS risk FROM x GROUP BY ALL""")
def _(spark, sf):
    out = stats.risk_coverage(standins.episodes(spark, sf), ["model", "arm"], [0, 0.5, 0.7, 0.8, 0.9, 0.95])
    return rounded(out, "coverage", "risk")


@query("efficiency", f"""WITH {EPISODES_SQL}
SELECT model, arm, count(*) AS episodes, count(*) FILTER {OK} AS correct, round(avg(latency_s)::DOUBLE, 6) AS mean_latency_s, round(avg(input_tokens), 6) AS mean_input_tokens,
  round(avg(output_tokens), 6) AS mean_output_tokens, round(avg(requests), 6) AS mean_requests, quantile_disc(latency_s, 0.5)::DOUBLE AS p50_latency_s, quantile_disc(latency_s, 0.9)::DOUBLE AS p90_latency_s
FROM episodes GROUP BY 1, 2""")
def _(spark, sf):
    out = stats.efficiency(standins.episodes(spark, sf), ["model", "arm"], "latency_s", ["input_tokens", "output_tokens", "requests"])
    return rounded(out, "mean_latency_s", "mean_input_tokens", "mean_output_tokens", "mean_requests")


# ---------------------------------------------------------------- bootstraps

REPLICATES = 200


def _draw_sql(units: str, seed: int) -> str:
    """SQL of the exact draws over ``units(unit, num, den)``."""
    return f"""idx AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS i FROM {units}), size AS (SELECT count(*) AS n FROM idx),
draws AS (SELECT r, ('0x' || substr(sha256('{seed}|' || r || '|' || d), 1, 15))::BIGINT % n AS i FROM size, unnest(range({REPLICATES})) AS a(r), unnest(range(n)) AS b(d)),
reps AS (SELECT r, sum(num) / sum(den) AS v FROM draws JOIN idx USING (i) GROUP BY r)"""


def _poisson_sql(units: str, seed: int) -> str:
    steps = " + ".join(f"(CASE WHEN u >= {t!r} THEN 1 ELSE 0 END)" for t in bootstrap.poisson_thresholds())
    return f"""weights AS (SELECT num, den, b * 8 + s AS r, ('0x' || substr(h, 1 + 8 * s, 8))::BIGINT / 4294967296.0 AS u
  FROM (SELECT *, sha256('{seed}|' || b || '|' || unit) AS h FROM {units}, unnest(range({REPLICATES} // 8)) AS x(b)), unnest(range(8)) AS y(s)),
reps AS (SELECT r, sum(w * num) / sum(w * den) AS v FROM (SELECT *, {steps} AS w FROM weights) GROUP BY r)"""


def _interval_sql(units: str) -> str:
    return f"""SELECT (SELECT count(*) FROM {units}) AS units, round((SELECT sum(num) / sum(den) FROM {units}), 6) AS estimate,
  round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS replicates FROM reps"""


LABEL_UNITS = "units AS (SELECT doc_id AS unit, quality::DOUBLE AS num, 1.0::DOUBLE AS den FROM labels)"
FAMILY_UNITS = EPISODES_SQL + f", units AS (SELECT pk AS unit, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END)::DOUBLE AS num, 1.0::DOUBLE AS den FROM episodes GROUP BY 1)"
PAIR_UNITS = EPISODES_SQL + f""", units AS (SELECT a.pk AS unit, avg((CASE WHEN b.verdict IS NOT DISTINCT FROM b.source_label THEN 1.0 ELSE 0.0 END) - (CASE WHEN a.verdict IS NOT DISTINCT FROM a.source_label THEN 1.0 ELSE 0.0 END))::DOUBLE AS num, 1.0::DOUBLE AS den
  FROM episodes a JOIN episodes b USING (model, pk) WHERE a.arm = '{ARM0}' AND b.arm = '{ARM1}' GROUP BY 1)"""
BANK_UNITS = EPISODES_SQL + f", units AS (SELECT pk // 2 AS unit, sum(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END)::DOUBLE AS num, count(*)::DOUBLE AS den FROM episodes GROUP BY 1)"
CI = ("estimate", "low", "high")


def hits(spark, sf):
    return standins.episodes(spark, sf).withColumn("hit", F.when(stats.is_correct(), 1.0).otherwise(0.0))


@query("bootstrap_ci", f"WITH {LABEL_UNITS}, {_draw_sql('units', 7)} {_interval_sql('units')}")
def _(spark, sf):
    return rounded(bootstrap.bootstrap_ci(table(spark, sf, "labels"), "doc_id", "quality", REPLICATES, 7, "draws"), *CI)


def _count_sql(units: str, seed: int) -> str:
    """SQL of drawn counts over ``units`` with the values 0 and 1: one binomial a replicate, laid out from its mode outwards."""
    return f"""w AS (SELECT count(*) AS n, count(*) FILTER (num = 0) AS a, count(*) FILTER (num = 1) AS b FROM {units}),
terms AS (SELECT k, k - least(floor((n + 1.0) * a / n), n)::BIGINT AS off, -lgamma(k + 1) - lgamma(n - k + 1) + k * ln(a) + (n - k) * ln(b) AS l FROM w, unnest(range(n + 1)) AS x(k)),
laid AS (SELECT k, sum(exp(l - top)) OVER (ORDER BY abs(off), off DESC) / sum(exp(l - top)) OVER () AS upto FROM terms, (SELECT max(l) AS top FROM terms)),
us AS (SELECT r, ('0x' || substr(sha256('{seed}|' || r || '|1'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM unnest(range({REPLICATES})) AS y(r)),
reps AS (SELECT r, (n - arg_min(k, upto)) / n::DOUBLE AS v FROM us JOIN laid ON upto > u, w GROUP BY r, n)"""


@query("bootstrap_ci_counts", f"WITH {LABEL_UNITS}, {_count_sql('units', 7)} {_interval_sql('units')}")
def _(spark, sf):
    return rounded(bootstrap.bootstrap_ci(table(spark, sf, "labels"), "doc_id", "quality", REPLICATES, 7, "counts"), *CI)


@query("bootstrap_ci_poisson", f"WITH {FAMILY_UNITS}, {_poisson_sql('units', 7)} {_interval_sql('units')}")
def _(spark, sf):
    return rounded(bootstrap.bootstrap_ci(hits(spark, sf), "pk", "hit", REPLICATES, 7, "poisson"), *CI)


@query("paired_delta", f"WITH {PAIR_UNITS}, {_poisson_sql('units', 11)} {_interval_sql('units')}")
def _(spark, sf):
    out = bootstrap.paired_delta(hits(spark, sf), "pk", ["model"], "arm", ARM0, ARM1, "hit", REPLICATES, 11, "poisson")
    return rounded(out, *CI)


@query("cluster_ratio_bootstrap", f"WITH {BANK_UNITS}, {_poisson_sql('units', 13)} {_interval_sql('units')}")
def _(spark, sf):
    rows = hits(spark, sf).withColumn("bank", F.expr("pk div 2"))
    return rounded(bootstrap.cluster_ratio_bootstrap(rows, "bank", "hit", REPLICATES, 13, "poisson"), *CI)


# ---------------------------------------------------------------- pairs

PAIRS_SQL = EPISODES_SQL + f""", pairs AS (SELECT a.model, a.pk, a.task, a.source_label, a.verdict AS va, b.verdict AS vb, b.requests,
  a.verdict IS NOT DISTINCT FROM a.source_label AS x, b.verdict IS NOT DISTINCT FROM a.source_label AS y
  FROM episodes a JOIN episodes b USING (model, pk) WHERE a.arm = '{ARM0}' AND b.arm = '{ARM1}')"""


def pairs(spark, sf):
    return stats.paired(standins.episodes(spark, sf), ["model", "pk"], "arm", ARM0, ARM1, ["verdict", "source_label", "task"])


def match(side: str):
    return F.col(f"verdict_{side}").eqNullSafe(F.col(f"source_label_{side}"))


TABLE_SQL = PAIRS_SQL + """, t AS (SELECT model, count(*) AS n, count(*) FILTER (x AND y) AS both, count(*) FILTER (NOT x AND NOT y) AS neither,
  count(*) FILTER (NOT x AND y) AS gain, count(*) FILTER (x AND NOT y) AS loss FROM pairs GROUP BY 1)"""


@query("mcnemar_exact", "WITH " + TABLE_SQL + """
SELECT model, gain, loss, CASE WHEN gain + loss = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(gain + loss + 1) - lgamma(k + 1) - lgamma(gain + loss - k + 1) - (gain + loss) * ln(2)))
  FROM unnest(range(least(gain, loss) + 1)) AS u(k))), 6) END AS p_value FROM t""")
def _(spark, sf):
    counts = stats.paired_table(pairs(spark, sf), ["model"], match("a"), match("b"))
    return rounded(counts.select("model", "gain", "loss", "p_value"), "p_value")


@query("paired_table", f"WITH {TABLE_SQL} SELECT *, round(100 * (gain - loss) / n, 6) AS difference_pp FROM t")
def _(spark, sf):
    counts = stats.paired_table(pairs(spark, sf), ["model"], match("a"), match("b"))
    return rounded(counts.drop("p_value"), "difference_pp")


@query("paired_changes", f"WITH {PAIRS_SQL} SELECT model, pk, CASE WHEN y THEN 'gain' ELSE 'loss' END AS change FROM pairs WHERE x <> y")
def _(spark, sf):
    return stats.paired_changes(pairs(spark, sf), ["model", "pk"], match("a"), match("b"))


@query("answer_transitions", f"""WITH {PAIRS_SQL}
SELECT model, coalesce(va, 'No submitted verdict') AS before, coalesce(vb, 'No submitted verdict') AS after, x AS match_before, y AS match_after, count(*) AS n FROM pairs GROUP BY ALL""")
def _(spark, sf):
    return stats.answer_transitions(pairs(spark, sf), ["model"])


CHANGE_SQL = """count(*) AS episodes, count(*) FILTER (x AND y) AS maintained_correct, count(*) FILTER (NOT x AND y) AS corrected, count(*) FILTER (NOT x AND NOT y) AS remained_wrong,
  count(*) FILTER (x AND NOT y AND vb IS NULL) AS "lost_no_valid_final", count(*) FILTER (x AND NOT y AND vb = 'Need more evidence') AS "lost_explicit_NME",
  count(*) FILTER (x AND NOT y AND vb IN ('Supported', 'Refuted')) AS "lost_valid_wrong_label" """
NET_SQL = ', count(*) FILTER (x AND NOT y) AS lost, count(*) FILTER (NOT x AND y) - count(*) FILTER (x AND NOT y) AS net_correct_change'


@query("stratified_pairs", f"""WITH {PAIRS_SQL}, s AS (SELECT *, CASE WHEN requests > 0 THEN 'requested' ELSE 'no_request' END AS stratum FROM pairs UNION ALL SELECT *, 'all' FROM pairs)
SELECT model, stratum, coalesce(task, 'overall') AS task, {CHANGE_SQL}{NET_SQL} FROM s GROUP BY GROUPING SETS ((model, stratum), (model, stratum, task))""")
def _(spark, sf):
    return reports.stratified_pairs(standins.episodes(spark, sf), "arm", ARM0, ARM1, ["model", "pk"])


@query("tool_regressions", f"""WITH {PAIRS_SQL}, f AS (SELECT model, pk, sum(ln % 2)::BIGINT AS fa, sum(CASE WHEN t > 5 THEN 1 ELSE 0 END)::BIGINT AS rf, sum(CASE WHEN d = 7 THEN 1 ELSE 0 END)::BIGINT AS fc, sum(d % 2)::BIGINT AS te
  FROM raw_episodes WHERE arm = '{ARM1}' GROUP BY 1, 2), j AS (SELECT * FROM pairs LEFT JOIN f USING (model, pk))
SELECT model, coalesce(task, 'overall') AS task, {CHANGE_SQL}{NET_SQL}, count(*) FILTER (x AND NOT y AND fa > 0) AS lost_with_finish_attempts, count(*) FILTER (x AND NOT y AND rf > 0) AS lost_with_rejected_finishes,
  count(*) FILTER (x AND NOT y AND fc > 0) AS lost_with_format_corrections, count(*) FILTER (x AND NOT y AND te > 0) AS lost_with_tool_errors
FROM j GROUP BY GROUPING SETS ((model), (model, task))""")
def _(spark, sf):
    facts = standins.raw_episodes(spark, sf).filter(F.col("arm") == ARM1).groupBy("model", "pk").agg(
        F.expr("sum(ln % 2)").alias("finish_attempts"), F.expr("count_if(t > 5)").alias("rejected_finishes"),
        F.expr("count_if(d = 7)").alias("format_corrections"), F.expr("sum(d % 2)").alias("tool_errors"),
    )
    return reports.tool_regressions(standins.episodes(spark, sf), facts, "arm", ARM0, ARM1, ["model", "pk"])


RECORDS_SQL = f"""records AS (SELECT model, pk, CASE WHEN t > 2 THEN 'provided' ELSE 'unable_to_provide' END AS status, CASE WHEN t > 2 THEN d % 3 ELSE 0 END AS novel, t > 2 AND d % 3 = 0 AS repeated_only
  FROM raw_episodes WHERE arm = '{ARM1}' AND sk % 4 > 0)"""


@query("request_stages", f"""WITH {EPISODES_SQL}, {RECORDS_SQL}, per AS (SELECT model, pk, count(*) AS responses, sum(novel) AS novel, count(*) FILTER (repeated_only) AS repeats,
  count(*) FILTER (status = 'provided') AS provided, count(*) FILTER (status <> 'provided') AS unable FROM records GROUP BY 1, 2)
SELECT model, count(*) AS episodes, count(*) FILTER (requests > 0) AS episodes_with_request, sum(requests)::BIGINT AS request_calls, coalesce(sum(responses), 0)::BIGINT AS request_responses,
  count(*) FILTER (novel > 0) AS episodes_with_new_pixels, coalesce(sum(novel), 0)::BIGINT AS new_pixel_images, count(*) FILTER (repeats > 0) AS episodes_with_repeated_request,
  coalesce(sum(repeats), 0)::BIGINT AS repeated_request_calls, coalesce(sum(provided), 0)::BIGINT AS provided, coalesce(sum(unable), 0)::BIGINT AS unable_to_provide,
  count(*) FILTER (termination = 'finished' AND verdict IS NOT NULL) AS finished, count(*) FILTER ({DEF}) AS definite, count(*) FILTER (verdict = 'Need more evidence') AS abstained, count(*) FILTER {OK} AS source_label_correct
FROM episodes LEFT JOIN per USING (model, pk) WHERE arm = '{ARM1}' GROUP BY model""")
def _(spark, sf):
    records = standins.raw_episodes(spark, sf).filter((F.col("arm") == ARM1) & (F.col("sk") % 4 > 0)).selectExpr(
        "model", "pk", "CASE WHEN t > 2 THEN 'provided' ELSE 'unable_to_provide' END AS status", "CASE WHEN t > 2 THEN d % 3 ELSE 0 END AS novel", "t > 2 AND d % 3 = 0 AS repeated_only"
    )
    eps = standins.episodes(spark, sf).filter(F.col("arm") == ARM1)
    return reports.request_stages(eps, records, ["model"], ["model", "pk"])


CONTROL = {
    "source_label_accuracy": OK, "completion_rate": "termination = 'finished'", "request_rate": "requests > 0", "new_image_rate": "new_image",
    "new_released_record_rate": "new_image AND d > 1", "repeated_image_request_rate": "repeated_only", "failed_request_rate": "failed_request",
    "definite_after_failed_request_rate": f"failed_request AND {DEF}", "definite_rate": DEF, "need_more_evidence_rate": "verdict = 'Need more evidence'",
    "failure_rate": "termination <> 'finished'", "fixed_original_not_offered_rate": "t = 0",
}


@query("control_metrics", f"""WITH {EPISODES_SQL}
SELECT model, arm, count(*) AS episodes, {', '.join(rate_sql(c, n) for n, c in CONTROL.items())},
  round(avg(CASE WHEN {DEF} THEN 1.0 ELSE 0.0 END) FILTER (failed_request)::DOUBLE, 6) AS definite_given_failed_request, round(avg(latency_s)::DOUBLE, 6) AS mean_wall_s, round(avg(input_tokens), 6) AS mean_input_tokens,
  round(avg(output_tokens), 6) AS mean_output_tokens, round(avg(ln), 6) AS mean_assistant_turns, round(avg(requests), 6) AS mean_request_calls FROM episodes GROUP BY 1, 2""")
def _(spark, sf):
    df = standins.episodes(spark, sf).withColumn("new_record", F.expr("new_image AND d > 1")).withColumn("original_not_offered", F.expr("t = 0")).withColumn("assistant_turns", F.col("ln"))
    out = reports.control_metrics(df, ["model", "arm"])
    return rounded(out, *[c for c in out.columns if c not in ("model", "arm", "episodes")])


@query("evidence_sensitive", f"""WITH {EPISODES_SQL}, w AS (SELECT model, pk, task, max(CASE WHEN arm = '{ARM0}' AND {OK} THEN 1 ELSE 0 END) FILTER (arm = '{ARM0}') AS i,
  max(CASE WHEN {OK} THEN 1 ELSE 0 END) FILTER (arm = 'full_available_text') AS f, max(CASE WHEN {OK} THEN 1 ELSE 0 END) FILTER (arm = '{ARM1}') AS g FROM episodes GROUP BY 1, 2, 3)
SELECT model, task, count(*) AS families, sum(g)::BIGINT AS interactive_agent_correct FROM w WHERE i = 0 AND f = 1 GROUP BY 1, 2""")
def _(spark, sf):
    return reports.evidence_sensitive(standins.episodes(spark, sf), ["model", "pk", "task"], ["model", "task"], ARM0, "full_available_text", [ARM1])


@query("acquisition_behavior", f"""WITH {VARIANT_EPISODES_SQL}
SELECT variant, coalesce(task, 'overall') AS task, count(*) AS episodes, count(*) FILTER (termination = 'finished') AS finished, count(*) FILTER (requests > 0) AS episodes_with_request,
  count(*) FILTER (new_photos > 0) AS episodes_with_new_photo, sum(new_photos)::BIGINT AS new_photos, sum(requests)::BIGINT AS requests, count(*) FILTER (verdict = 'Need more evidence') AS abstained,
  round(avg(tool_calls), 6) AS mean_tool_calls FROM variant_episodes GROUP BY GROUPING SETS ((variant), (variant, task))""")
def _(spark, sf):
    return rounded(reports.acquisition_behavior(standins.variant_episodes(spark, sf)), "mean_tool_calls")


@query("release_without_request", f"WITH {VARIANT_EPISODES_SQL} SELECT family_id, variant FROM variant_episodes WHERE d > 6 AND requests = 0")
def _(spark, sf):
    df = standins.variant_episodes(spark, sf).withColumn("new_photos", F.expr("CASE WHEN d > 6 THEN 1 ELSE 0 END"))
    return reports.release_without_request(df, ["family_id", "variant"])


@query("leaderboard", f"""WITH {EPISODES_SQL}, t AS (SELECT arm, model, CASE WHEN model = 'R' AND arm = '{ARM0}' THEN NULL ELSE round(count(*) FILTER {OK} / count(*), 6) END AS accuracy FROM episodes GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY arm ORDER BY accuracy DESC NULLS LAST, model)::INTEGER AS position, coalesce(accuracy = max(accuracy) OVER (PARTITION BY arm), false) AS best FROM t""")
def _(spark, sf):
    acc = F.when(~((F.col("model") == "R") & (F.col("arm") == ARM0)), F.round(F.count_if(stats.is_correct()) / F.count("*"), 6)).alias("accuracy")
    report = standins.episodes(spark, sf).groupBy("arm", "model").agg(acc)
    return stats.leaderboard(report, "arm", "accuracy", "model")


def _cell(arm, task):
    task_rule = "" if task == "overall" else f" AND task = '{task}'"
    rule = f"arm = '{arm}'{task_rule}"
    return f"round(count(*) FILTER ({rule} AND {OK}) / nullif(count(*) FILTER ({rule}), 0), 6) AS {arm}_{task}"


TABLE_ARMS = (ARM0, ARM1)


@query("comparison_table", f"""WITH {EPISODES_SQL}
SELECT model, {', '.join(_cell(a, t) for a in TABLE_ARMS for t in ('overall', 'state', 'identity'))},
  {', '.join(f"round(avg({c}) FILTER (arm = '{a}')::DOUBLE, 6) AS {a}_mean_{c}" for a in TABLE_ARMS for c in ('latency_s', 'output_tokens'))}, true AS counts_agree FROM episodes GROUP BY 1""")
def _(spark, sf):
    eps = standins.episodes(spark, sf)
    cost = eps.groupBy("model", "arm").agg(F.count("*").alias("episodes"), F.avg("latency_s").alias("mean_latency_s"), F.avg("output_tokens").alias("mean_output_tokens"))
    out = reports.comparison_table(stats.label_agreement(eps), cost, ["model"], TABLE_ARMS)
    return rounded(out, *[c for c in out.columns if c not in ("model", "counts_agree")])


@query("search_policy_metrics", f"""WITH {EPISODES_SQL}
SELECT arm, task, count(*) AS episodes, count(*) FILTER (new_image) AS new_image_count, count(*) FILTER (d > 5) AS evidence_found_count, {rate_sql('new_image', 'new_image_rate')}, {rate_sql('d > 5', 'evidence_found_rate')},
  round(avg(requests), 6) AS mean_requests, CASE WHEN bool_and(task = 'state' OR d < 10) THEN round(avg(input_tokens), 6) END AS mean_input_tokens, CASE WHEN bool_and(task = 'state' OR d < 10) THEN round(avg(output_tokens), 6) END AS mean_output_tokens,
  round(avg(latency_s)::DOUBLE, 6) AS mean_latency_s, bool_and(task = 'state' OR d < 10) AS token_accounting_complete, count(*) FILTER (d > 5) AS evidence_found_episodes,
  round(avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) FILTER (d > 5)::DOUBLE, 6) AS accuracy_when_found FROM episodes GROUP BY 1, 2""")
def _(spark, sf):
    df = standins.episodes(spark, sf).withColumn("evidence_found", F.col("d") > 5).withColumn("accounting_complete", F.expr("task = 'state' OR d < 10"))
    out = reports.search_policy_metrics(df, ["arm", "task"], ["new_image", "evidence_found"])
    return rounded(out, *[c for c in out.columns if c.startswith("mean_") or c.endswith("_rate") or c == "accuracy_when_found"])


VIEWS_SQL = "['front_survey', 'rear_left', 'rear_right', 'front_survey']"
BEHAVIOR_SQL = EPISODES_SQL + f""", b AS (SELECT model, arm, pk // 2 AS bank, pk % 2 AS member, d > 5 AS found, {VIEWS_SQL}[q % 4 + 1] AS v1, {VIEWS_SQL}[sk % 4 + 1] AS v2, d % 3 AS len, CASE WHEN t > 4 THEN 'rear_left' ELSE 'rear_right' END AS target FROM episodes),
j AS (SELECT a.model, a.arm, a.found AS fa, z.found AS fz, CASE WHEN a.len > 0 THEN a.v1 END AS a1, CASE WHEN z.len > 0 THEN z.v1 END AS z1, CASE WHEN a.len = 2 THEN a.v2 END AS a2, CASE WHEN z.len = 2 THEN z.v2 END AS z2,
  a.target AS ta, z.target AS tz FROM b a JOIN b z USING (model, arm, bank) WHERE a.member = 0 AND z.member = 1)"""


def behavior(spark, sf):
    views = "array('front_survey', 'rear_left', 'rear_right', 'front_survey')"
    return standins.episodes(spark, sf).selectExpr(
        "model", "arm", "pk div 2 AS bank", "pk % 2 AS member", "d > 5 AS found", f"slice(array({views}[q % 4], {views}[sk % 4]), 1, CAST(d % 3 AS INT)) AS views",
        "CASE WHEN t > 4 THEN 'rear_left' ELSE 'rear_right' END AS target",
    )


@query("paired_behavior", f"""WITH {BEHAVIOR_SQL}, k AS (SELECT *, coalesce(a1 = 'front_survey' AND z1 = 'front_survey', false) AS front, coalesce(a2 <> z2, false) AS differ FROM j), m AS (SELECT *, front AND differ AND a2 = ta AND z2 = tz AS hit FROM k)
SELECT model, arm, count(*) AS banks, count(*) FILTER (fa AND fz) AS both_found, count(*) FILTER (a1 = z1) AS same_first_request, count(*) FILTER (front) AS both_first_front, count(*) FILTER (differ) AS second_views_differ,
  count(*) FILTER (hit) AS both_match_target, round(count(*) FILTER (hit) / nullif(count(*) FILTER (front), 0), 6) AS switch_given_front FROM m GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(reports.paired_behavior(behavior(spark, sf), ["model", "arm", "bank"], ["model", "arm"]), "switch_given_front")


@query("duplicate_requests", "WITH " + EPISODES_SQL + f""", v AS (SELECT model, arm, pk, {VIEWS_SQL}[q % 4 + 1] AS v1, {VIEWS_SQL}[sk % 4 + 1] AS v2, d % 3 AS len, CASE WHEN t > 4 THEN 'rear_left' ELSE 'rear_right' END AS target FROM episodes)
SELECT model, arm, pk, CASE WHEN len = 2 AND v1 = v2 THEN 1 ELSE 0 END AS duplicates, len = 2 AND v1 = 'front_survey' AND v2 = target AS front_then_target FROM v""")
def _(spark, sf):
    df = behavior(spark, sf).withColumn("r", reports.duplicate_requests(F.col("views"), F.col("target")))
    return df.select("model", "arm", F.expr("bank * 2 + member").alias("pk"), "r.*")


@query("availability_feedback", f"""WITH {VARIANT_EPISODES_SQL}, asked AS (SELECT family_id FROM variant_episodes WHERE variant = 'Obtainable' AND requests > 0)
SELECT variant, coalesce(verdict, 'No submitted verdict') AS answer, CASE WHEN requests = 0 THEN 'none' WHEN d > 4 THEN 'provided' ELSE 'unable_to_provide' END AS first_status, count(*) AS n
FROM variant_episodes WHERE variant <> 'Sufficient' AND family_id IN (SELECT family_id FROM asked) GROUP BY ALL""")
def _(spark, sf):
    eps = standins.variant_episodes(spark, sf)
    first = eps.filter("requests > 0").select("family_id", "variant", F.expr("CASE WHEN d > 4 THEN 'provided' ELSE 'unable_to_provide' END").alias("status"))
    return reports.availability_feedback(eps.select("family_id", "variant", "verdict", "requests"), first, "family_id")


@query("condition_summary", f"""WITH {EPISODES_SQL}
SELECT arm, count(*) AS episodes, count(*) FILTER {OK} AS matches, count(*) FILTER (d > 0) AS valid_finishes, count(*) FILTER (d > 0 AND verdict = 'Need more evidence') AS abstained, count(*) FILTER (d > 0 AND {DEF}) AS definite,
  round(avg(input_tokens), 6) AS mean_input_tokens, round(avg(output_tokens), 6) AS mean_output_tokens, round(avg(latency_s)::DOUBLE, 6) AS mean_latency_s FROM episodes GROUP BY 1""")
def _(spark, sf):
    out = reports.condition_summary(standins.episodes(spark, sf).withColumn("schema_valid_finish", F.col("d") > 0), ["arm"])
    return rounded(out, "mean_input_tokens", "mean_output_tokens", "mean_latency_s")


@query("compare_stages", f"""WITH {COHORT_SQL}, j AS (SELECT a.arm, a.task, a.verdict IS NOT DISTINCT FROM a.source_label AS x, b.verdict IS NOT DISTINCT FROM b.source_label AS y, a.latency_s AS la, b.latency_s AS lb, a.output_tokens AS oa, b.output_tokens AS ob
  FROM episodes a JOIN episodes b USING (arm, family_id) WHERE a.model = 'A' AND b.model = 'R' AND family_id IN (SELECT family_id FROM cohort))
SELECT arm, task, count(*) AS episodes, count(*) FILTER (x) AS base_correct, count(*) FILTER (y) AS adapted_correct, count(*) FILTER (NOT x AND y) AS gained, count(*) FILTER (x AND NOT y) AS lost,
  round(avg(la)::DOUBLE, 6) AS base_mean_latency_s, round(avg(oa), 6) AS base_mean_output_tokens, round(avg(lb)::DOUBLE, 6) AS adapted_mean_latency_s, round(avg(ob), 6) AS adapted_mean_output_tokens FROM j GROUP BY 1, 2""")
def _(spark, sf):
    eps = standins.episodes(spark, sf)
    out = reports.compare_stages(eps.filter("model = 'A'"), eps.filter("model = 'R'"), cohort(eps), ["arm", "family_id"], ["arm", "task"])
    return rounded(out, *[c for c in out.columns if "_mean_" in c])


@query("select_checkpoint", """WITH g AS (SELECT o_custkey, o_orderkey, (o_totalprice > 200000)::INTEGER AS success, CAST(floor(o_totalprice / 10000) AS BIGINT) AS reward FROM orders)
SELECT o_custkey, arg_max(o_orderkey, (success, reward, -o_orderkey)) AS best, max(o_orderkey) AS final FROM g GROUP BY 1""")
def _(spark, sf):
    metrics = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey", "CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS success", "CAST(floor(o_totalprice / 10000) AS BIGINT) AS reward")
    return reports.select_checkpoint(metrics, ["o_custkey"], "o_orderkey")


@query("ledger_status", """WITH c AS (SELECT o_custkey, o_orderpriority AS stage, CAST(round(o_totalprice * 100) AS BIGINT) AS bound, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice * 80) AS BIGINT) END AS charge FROM orders)
SELECT o_custkey, stage, coalesce(sum(coalesce(charge, bound)), 0)::BIGINT AS accounted, coalesce(sum(bound) FILTER (charge IS NULL), 0)::BIGINT AS unresolved, count(*) FILTER (charge IS NULL) AS pending, count(*) AS requests,
  100000000 - coalesce(sum(coalesce(charge, bound)), 0)::BIGINT AS available FROM c GROUP BY 1, 2""")
def _(spark, sf):
    calls = table(spark, sf, "orders").selectExpr(
        "o_custkey", "o_orderpriority AS stage", "CAST(round(o_totalprice * 100) AS BIGINT) AS bound", "CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice * 80) AS BIGINT) END AS charge"
    )
    return reports.ledger_status(calls, ["o_custkey", "stage"], F.lit(100_000_000))


@query("study_progress", f"""WITH {EPISODES_SQL}, p AS (SELECT m AS model, a AS arm, (SELECT count(*) FROM part) AS expected FROM unnest(['A', 'N', 'R', 'Z']) AS t(m), unnest(['{ARM0}', '{ARM1}']) AS u(a))
SELECT p.model, p.arm, expected, count(e.pk) AS completed, count(*) FILTER (termination <> 'finished') AS unfinished, coalesce(sum(errors), 0)::BIGINT AS errors, coalesce(sum(requests), 0)::BIGINT AS photo_requests,
  round(sum(latency_s)::DOUBLE, 1) AS wall_latency_s, count(e.pk) = expected AS complete FROM p LEFT JOIN episodes e USING (model, arm) GROUP BY 1, 2, 3""")
def _(spark, sf):
    models, arms = (F.explode(F.array(*[F.lit(v) for v in vs])) for vs in (("A", "N", "R", "Z"), (ARM0, ARM1)))
    plan = table(spark, sf, "part").agg(F.count("*").alias("expected")).withColumn("model", models).withColumn("arm", arms)
    return reports.study_progress(plan, standins.episodes(spark, sf), ["model", "arm"])


@query("interface_checks", f"""WITH {EPISODES_SQL}, i AS (SELECT task AS kind, arm AS transport, verdict, CASE WHEN d = 5 THEN NULL ELSE source_label END AS l, d, q FROM episodes)
SELECT kind, transport, count(*) AS records, count(*) FILTER (q > 25) AS exact_copies, count(*) FILTER (d > 3) AS valid_calls, count(l) AS scored, count(*) FILTER (l IS NOT NULL AND verdict IS NOT DISTINCT FROM l) AS label_matches, count(*) FILTER (verdict IS NULL) AS parse_errors FROM i GROUP BY 1, 2""")
def _(spark, sf):
    df = standins.episodes(spark, sf).selectExpr(
        "task AS kind", "arm AS transport", "verdict", "CASE WHEN d = 5 THEN NULL ELSE source_label END AS source_label", "q > 25 AS exact_copy", "d > 3 AS valid_call", "verdict IS NULL AS parse_error"
    )
    return reports.interface_checks(df, ["kind", "transport"])
