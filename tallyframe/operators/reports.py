"""Reports over episodes: request funnels, control metrics, stratified pairs, stages and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import UNDECIDED
from .stats import CHANGES, NO_VERDICT, is_correct, is_definite, net_change, paired, rate, transition_counts, with_overall


def request_stages(episodes: DataFrame, records: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Funnel of an interactive arm: attempted, requested, new images, finished, definite or abstained, correct.

    ``records`` (one row per request response: keys, status, novel, repeated_only) is summed per episode before it
    meets the episodes.
    """
    per = records.groupBy(*keys).agg(
        F.count("*").alias("responses"), F.sum("novel").alias("novel"), F.count_if("repeated_only").alias("repeats"),
        F.count_if(F.col("status") == "provided").alias("provided"), F.count_if(F.col("status") == "unable_to_provide").alias("unable"),
    )
    joined = episodes.join(per, list(keys), "left").fillna(0, ["responses", "novel", "repeats", "provided", "unable"])
    return joined.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.count_if(F.col("requests") > 0).alias("episodes_with_request"),
        F.sum("requests").alias("request_calls"), F.sum("responses").alias("request_responses"),
        F.count_if(F.col("novel") > 0).alias("episodes_with_new_pixels"), F.sum("novel").alias("new_pixel_images"),
        F.count_if(F.col("repeats") > 0).alias("episodes_with_repeated_request"), F.sum("repeats").alias("repeated_request_calls"),
        F.sum("provided").alias("provided"), F.sum("unable").alias("unable_to_provide"),
        F.count_if((F.col("termination") == "finished") & F.col("verdict").isNotNull()).alias("finished"),
        F.count_if(is_definite()).alias("definite"), F.count_if(F.col("verdict") == UNDECIDED).alias("abstained"),
        F.count_if(is_correct()).alias("source_label_correct"),
    )


def control_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates and means of a control arm; every planned episode is in the denominator."""
    failed, definite = F.col("failed_request"), is_definite()
    rates = {
        "source_label_accuracy": is_correct(), "completion_rate": F.col("termination") == "finished",
        "request_rate": F.col("requests") > 0, "new_image_rate": F.col("new_image"), "new_released_record_rate": F.col("new_record"),
        "repeated_image_request_rate": F.col("repeated_only"), "failed_request_rate": failed,
        "definite_after_failed_request_rate": failed & definite, "definite_rate": definite,
        "need_more_evidence_rate": F.col("verdict") == UNDECIDED, "failure_rate": F.col("termination") != "finished",
        "fixed_original_not_offered_rate": F.col("original_not_offered"),
    }
    means = {"mean_wall_s": "latency_s", "mean_input_tokens": "input_tokens", "mean_output_tokens": "output_tokens",
             "mean_assistant_turns": "assistant_turns", "mean_request_calls": "requests"}
    given = F.avg(F.when(failed, F.when(definite, 1.0).otherwise(0.0)))
    return df.groupBy(*by).agg(
        F.count("*").alias("episodes"), *[rate(c).alias(n) for n, c in rates.items()], given.alias("definite_given_failed_request"),
        *[F.avg(c).alias(n) for n, c in means.items()],
    )


def stratified_pairs(episodes: DataFrame, arm: str, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Transitions between two arms for all, requested and not requested families, overall and per task.

    The strata follow what the interactive arm did; they describe and do not identify an effect of requests.
    """
    pairs = paired(episodes, keys, arm, a, b, ["verdict", "source_label", "task", "requests"])
    pairs = pairs.withColumn("task", F.col("task_a")).withColumn("stratum", F.when(F.col("requests_b") > 0, "requested").otherwise("no_request"))
    counts = transition_counts(pairs, ["model", "task", "stratum"])
    sums = ["episodes", *CHANGES]
    strata = counts.unionByName(counts.withColumn("stratum", F.lit("all")))
    return net_change(with_overall(strata, ["model", "stratum"], "task", sums))


def tool_regressions(episodes: DataFrame, facts: DataFrame, arm: str, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Transitions per model and task, with trace facts of the lost answers.

    ``facts`` has the keys, finish_attempts, rejected_finishes, format_corrections and tool_errors of the second arm.
    """
    pairs = paired(episodes, keys, arm, a, b, ["verdict", "source_label", "task"]).join(facts, list(keys), "left")
    pairs = pairs.withColumn("task", F.col("task_a"))
    lost = F.col("verdict_a").eqNullSafe(F.col("source_label_a")) & ~F.col("verdict_b").eqNullSafe(F.col("source_label_a"))
    flags = ["finish_attempts", "rejected_finishes", "format_corrections", "tool_errors"]
    extra = pairs.groupBy("model", "task").agg(*[F.count_if(lost & (F.col(f) > 0)).alias(f"lost_with_{f}") for f in flags])
    counts = transition_counts(pairs, ["model", "task"]).join(extra, ["model", "task"])
    sums = ["episodes", *CHANGES, *[f"lost_with_{f}" for f in flags]]
    return net_change(with_overall(counts, ["model"], "task", sums))


def evidence_sensitive(episodes: DataFrame, keys: Sequence[str], by: Sequence[str], initial: str, full: str, arms: Sequence[str]) -> DataFrame:
    """Families wrong at first and right with full evidence, and how each arm answers them."""
    def right(name: str) -> Column:
        return F.max(F.when(F.col("arm") == name, F.when(is_correct(), 1).otherwise(0)))
    wide = episodes.groupBy(*keys).agg(*[right(a).alias(f"_{a}") for a in {initial, full, *arms}])
    sensitive = wide.filter((F.col(f"_{initial}") == 0) & (F.col(f"_{full}") == 1))
    return sensitive.groupBy(*by).agg(F.count("*").alias("families"), *[F.sum(f"_{a}").cast("bigint").alias(f"{a}_correct") for a in arms])


def acquisition_behavior(episodes: DataFrame) -> DataFrame:
    """Actions of the agent per variant, overall and per task; a new photo is not called sufficient evidence."""
    counts = episodes.groupBy("variant", "task").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("termination") == "finished").alias("finished"),
        F.count_if(F.col("requests") > 0).alias("episodes_with_request"), F.count_if(F.col("new_photos") > 0).alias("episodes_with_new_photo"),
        F.sum("new_photos").alias("new_photos"), F.sum("requests").alias("requests"), F.count_if(F.col("verdict") == UNDECIDED).alias("abstained"),
        F.sum("tool_calls").alias("tool_calls"),
    )
    sums = [c for c in counts.columns if c not in ("variant", "task")]
    out = with_overall(counts, ["variant"], "task", sums)
    return out.withColumn("mean_tool_calls", F.col("tool_calls") / F.col("episodes")).drop("tool_calls")


def release_without_request(episodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Episodes that show a new photo although they made no request."""
    return episodes.filter((F.col("new_photos") > 0) & (F.col("requests") == 0)).select(*keys)


def comparison_table(accuracy: DataFrame, cost: DataFrame, keys: Sequence[str], arms: Sequence[str]) -> DataFrame:
    """One row per key: accuracy per arm and task, time and tokens per arm, and whether both sources count the same episodes."""
    def of(column: str, arm: str, task: str | None = None) -> Column:
        rule = F.col("arm") == arm
        return F.max(F.when(rule if task is None else rule & (F.col("task") == task), F.col(column)))
    left = accuracy.groupBy(*keys).agg(
        *[of("accuracy", a, t).alias(f"{a}_{t}") for a in arms for t in ("overall", "state", "identity")],
        *[of("episodes", a, "overall").alias(f"_{a}_n") for a in arms],
    )
    right = cost.groupBy(*keys).agg(
        *[of(c, a).alias(f"{a}_{c}") for a in arms for c in ("mean_latency_s", "mean_output_tokens")],
        *[of("episodes", a).alias(f"_{a}_m") for a in arms],
    )
    agree = F.lit(True)
    for a in arms:
        agree = agree & F.col(f"_{a}_n").eqNullSafe(F.col(f"_{a}_m"))
    joined = left.join(right, list(keys), "left").withColumn("counts_agree", agree)
    return joined.drop(*[f"_{a}_{s}" for a in arms for s in "nm"])


def search_policy_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Counts, rates and means per policy; token means are null when any accounting is incomplete, and the quality of
    decisions is also given among episodes that found the evidence."""
    complete = F.bool_and("accounting_complete")
    tokens = {"input_tokens", "output_tokens"}
    means = ["requests", "input_tokens", "output_tokens", "latency_s"]
    found = F.col("evidence_found")
    return df.groupBy(*by).agg(
        F.count("*").alias("episodes"), *[F.count_if(m).alias(f"{m}_count") for m in metrics], *[rate(F.col(m)).alias(f"{m}_rate") for m in metrics],
        *[(F.when(complete, F.avg(m)) if m in tokens else F.avg(m)).alias(f"mean_{m}") for m in means],
        complete.alias("token_accounting_complete"), F.count_if(found).alias("evidence_found_episodes"),
        F.avg(F.when(found, F.when(is_correct(), 1.0).otherwise(0.0))).alias("accuracy_when_found"),
    )


def paired_behavior(df: DataFrame, bank: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per policy over banks of two members: both found, same first view, second views differ, both match their target.

    ``df`` has member (0 or 1), found, views (array) and target.
    """
    def member(i: int) -> Column:
        return F.max(F.when(F.col("member") == i, F.struct("found", "views", "target"))).alias(f"m{i}")
    banks = df.groupBy(*bank).agg(member(0), member(1)).filter("m0 IS NOT NULL AND m1 IS NOT NULL")
    a, b = F.col("m0.views"), F.col("m1.views")
    def view(v: Column, i: int) -> Column:
        return F.get(v, F.lit(i))
    front = F.coalesce((view(a, 0) == "front_survey") & (view(b, 0) == "front_survey"), F.lit(False))
    differ = (F.size(a) == 2) & (F.size(b) == 2) & (view(a, 1) != view(b, 1))
    match = front & differ & (view(a, 1) == F.col("m0.target")) & (view(b, 1) == F.col("m1.target"))
    out = banks.groupBy(*by).agg(
        F.count("*").alias("banks"), F.count_if(F.col("m0.found") & F.col("m1.found")).alias("both_found"),
        F.count_if(F.coalesce(view(a, 0) == view(b, 0), F.lit(False))).alias("same_first_request"), F.count_if(front).alias("both_first_front"),
        F.count_if(F.coalesce(differ, F.lit(False))).alias("second_views_differ"), F.count_if(F.coalesce(match, F.lit(False))).alias("both_match_target"),
    )
    return out.withColumn("switch_given_front", F.try_divide(F.col("both_match_target"), F.col("both_first_front")))


def duplicate_requests(views: Column, target: Column) -> Column:
    """Struct(duplicates beyond the first per view, front view then target view)."""
    pattern = views == F.array(F.lit("front_survey"), target)
    return F.struct((F.size(views) - F.size(F.array_distinct(views))).alias("duplicates"), F.coalesce(pattern, F.lit(False)).alias("front_then_target"))


def availability_feedback(episodes: DataFrame, first_status: DataFrame, family: str) -> DataFrame:
    """For families that asked in the Obtainable variant: answers per variant and status of the first response."""
    asked = episodes.filter((F.col("variant") == "Obtainable") & (F.col("requests") > 0)).select(family)
    chosen = episodes.filter(F.col("variant").isin("Obtainable", "Missing", "Unavailable")).join(asked, family, "left_semi")
    joined = chosen.join(first_status, [family, "variant"], "left")
    answer = F.coalesce(F.col("verdict"), F.lit(NO_VERDICT)).alias("answer")
    return joined.groupBy("variant", answer, F.coalesce("status", F.lit("none")).alias("first_status")).agg(F.count("*").alias("n"))


def condition_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per input condition: matches, valid finishes, abstentions, definite answers and mean tokens; invalid answers count."""
    return df.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.count_if(is_correct()).alias("matches"), F.count_if("schema_valid_finish").alias("valid_finishes"),
        F.count_if(F.col("schema_valid_finish") & (F.col("verdict") == UNDECIDED)).alias("abstained"),
        F.count_if(F.col("schema_valid_finish") & is_definite()).alias("definite"),
        F.avg("input_tokens").alias("mean_input_tokens"), F.avg("output_tokens").alias("mean_output_tokens"), F.avg("latency_s").alias("mean_latency_s"),
    )


def compare_stages(base: DataFrame, adapted: DataFrame, cohort: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A base run against an adapted one on the same cohort: accuracies, gains, losses and mean cost of both."""
    def cut(df: DataFrame, s: str) -> DataFrame:
        kept = df.join(cohort, cohort.columns, "left_semi")
        columns = [is_correct().alias(f"right_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("latency_s", "output_tokens")]]
        return kept.select(*keys, *(["task"] if s == "base" else []), *columns)
    pairs = cut(base, "base").join(cut(adapted, "adapted"), list(keys))
    x, y = F.col("right_base"), F.col("right_adapted")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.count_if(x).alias("base_correct"), F.count_if(y).alias("adapted_correct"),
        F.count_if(~x & y).alias("gained"), F.count_if(x & ~y).alias("lost"),
        *[F.avg(f"{c}_{s}").alias(f"{s}_mean_{c}") for s in ("base", "adapted") for c in ("latency_s", "output_tokens")],
    )


def select_checkpoint(metrics: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """The group with the best (success, reward), the earliest on ties, and the last group as fixed alternative."""
    return metrics.groupBy(*by).agg(
        F.max_by(group, F.struct(F.col("success"), F.col("reward"), -F.col(group))).alias("best"), F.max(group).alias("final")
    )


def ledger_status(calls: DataFrame, by: Sequence[str], cap: Column) -> DataFrame:
    """Accounted upper bound (a pending call counts with its bound), pending amount, request count and what is left."""
    out = calls.groupBy(*by).agg(
        F.coalesce(F.sum(F.coalesce("charge", "bound")), F.lit(0)).cast("bigint").alias("accounted"),
        F.coalesce(F.sum(F.when(F.col("charge").isNull(), F.col("bound"))), F.lit(0)).cast("bigint").alias("unresolved"),
        F.count_if(F.col("charge").isNull()).alias("pending"), F.count("*").alias("requests"),
    )
    return out.withColumn("available", cap - F.col("accounted"))


def study_progress(plan: DataFrame, results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Completed against expected per worker and arm, with errors and seconds; a worker without results still shows."""
    done = results.groupBy(*by).agg(
        F.count("*").alias("completed"), F.count_if(F.col("termination") != "finished").alias("unfinished"), F.sum("errors").alias("errors"),
        F.sum("requests").alias("photo_requests"), F.round(F.sum("latency_s"), 1).alias("wall_latency_s"),
    )
    joined = plan.join(done, list(by), "left").fillna(0, ["completed", "unfinished", "errors", "photo_requests"])
    return joined.withColumn("complete", F.col("completed") == F.col("expected"))


def interface_checks(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per check kind and transport: records, exact copies, valid calls, label matches and parse errors; an unknown
    label is not scored."""
    known = F.col("source_label").isNotNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_if("exact_copy").alias("exact_copies"), F.count_if("valid_call").alias("valid_calls"),
        F.count_if(known).alias("scored"), F.count_if(known & is_correct()).alias("label_matches"), F.count_if("parse_error").alias("parse_errors"),
    )
