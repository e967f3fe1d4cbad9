"""Integrity checks. Each returns rows that break a rule; ``enforce`` turns any such row into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import pool_verdict, required_images
from ..functions.geometry import box_inside, rotation_angle
from ..functions.hashing import row_digest
from ..skew import multiset_digest, shuffled


class CheckFailed(ValueError):
    """A gate found rows that break a rule."""


def enforce(violations: DataFrame, name: str, shown: int = 5) -> None:
    """Raise when there is any violation; only a few rows reach the driver."""
    rows = violations.limit(shown).collect()
    if rows:
        raise CheckFailed(f"{name}: " + "; ".join(str(r.asDict()) for r in rows))


def _rules(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per key and broken rule; an unknown outcome of a rule counts as broken."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules]))
    return df.select(*keys, F.explode(codes).alias("rule"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_complete(actual: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned keys that are missing and keys that were never planned."""
    have = actual.select(*keys).distinct().withColumn("_have", F.lit(True))
    want = grid.select(*keys).withColumn("_want", F.lit(True))
    joined = want.join(have, list(keys), "full_outer")
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "extra")
    return joined.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")


def completeness(actual: DataFrame, grid: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Progress against the plan: expected, found, missing and extra keys, and whether scores may be shown."""
    have = actual.select(*keys).distinct().withColumn("_have", F.lit(True))
    want = grid.select(*keys).withColumn("_want", F.lit(True))
    joined = want.join(have, list(keys), "full_outer")
    found = F.col("_have").isNotNull() & F.col("_want").isNotNull()
    out = joined.groupBy(*by).agg(
        F.count("_want").alias("expected"), F.count_if(found).alias("found"),
        F.count_if(F.col("_have").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("extra"),
    )
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0))


def check_matches_cases(episodes: DataFrame, cases: DataFrame, key: str, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Episodes whose stored fields differ from the frozen case, or whose stored match differs from a recomputed one."""
    frozen = cases.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_known"))
    joined = episodes.join(frozen, key, "left")
    rules = [("unknown_case", F.col("_known"))]
    rules += [(f"changed_{f}", F.col("_known").isNull() | F.col(f).eqNullSafe(F.col(f"_{f}"))) for f in fields]
    match = F.col("verdict").eqNullSafe(F.col("source_label"))
    rules.append(("wrong_match", F.col("source_label_match").eqNullSafe(match)))
    return _rules(joined, keys, rules)


def match_traces(results: DataFrame, traces: DataFrame, on: Sequence[str], trace_id: str) -> DataFrame:
    """The first trace that agrees with each result on every matched column, null values included; null when there is none."""
    first = traces.groupBy(F.struct(*on).alias("_on")).agg(F.min(trace_id).alias(trace_id))
    return results.withColumn("_on", F.struct(*on)).join(first, "_on", "left").drop("_on")


def check_config(manifests: DataFrame, run: str, config: str, ignore: Sequence[str]) -> DataFrame:
    """Runs whose shards differ in any setting outside the ignored ones."""
    kept = F.map_filter(config, lambda k, v: ~k.isin(*ignore))
    text = F.to_json(F.array_sort(F.map_entries(kept)))
    ends = manifests.select(run, text.alias("_c")).groupBy(run).agg(F.min("_c").alias("_low"), F.max("_c").alias("_high"))
    return ends.filter(F.col("_low") != F.col("_high")).select(run, F.lit("different_configuration").alias("rule"))


def check_shards(manifests: DataFrame, run: str, shard: str, shards: str) -> DataFrame:
    """Shard numbers of each run that are missing from 0..n-1, repeated, or outside."""
    have = manifests.groupBy(run, F.col(shard).alias("shard")).agg(F.count("*").alias("_n"), F.max(shards).alias("_of"))
    want = manifests.groupBy(run).agg(F.max(shards).alias("_all")).select(
        run, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_all").cast("bigint") - 1)).alias("shard"), F.lit(True).alias("_want")
    )
    joined = want.join(have, [run, "shard"], "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "outside").when(F.col("_n") > 1, "repeated")
    return joined.select(run, "shard", problem.alias("rule")).filter("rule IS NOT NULL")


def ordered_digest(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Content digest per group which does not depend on row order."""
    return multiset_digest(df.withColumn("_row", row_digest(*[F.col(c) for c in columns])), by, F.col("_row"))


def check_preserved(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Earlier rows which are gone or changed."""
    old = before.select(key, row_digest(*[F.col(c) for c in columns]).alias("_old"))
    new = after.select(key, row_digest(*[F.col(c) for c in columns]).alias("_new"))
    joined = old.join(new, key, "left").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return joined.select(key, F.when(F.col("_new").isNull(), "gone").otherwise("changed").alias("rule"))


def leakage(members: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Values (of a kind: source group, content hash, ...) present in more than one split.

    ``members`` has split, kind and value. One flag per split replaces a join per pair of splits.
    """
    flags = [F.coalesce(F.bool_or(F.col("split") == name), F.lit(False)).alias(f"_in{i}") for i, name in enumerate(splits)]
    found = members.groupBy("kind", "value").agg(*flags, F.count("*").alias("rows"))
    names = F.array_compact(F.array(*[F.when(F.col(f"_in{i}"), n) for i, n in enumerate(splits)]))
    return found.filter(F.size(names) > 1).select("kind", "value", F.array_join(names, ",").alias("splits"), "rows")


def dedupe_replays(df: DataFrame, keys: Sequence[str], sig: Column, source: Column) -> DataFrame:
    """One row per key: the copy from the first source, how many copies there were, and whether they disagree.

    Provenance is kept as first source, last source and count here, and row by row by ``replay_sources``.
    """
    rows = df.withColumn("_sig", sig).withColumn("_source", source)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(F.col("_source"), F.col("_sig"), *[F.col(c) for c in rest])
    out = rows.groupBy(*keys).agg(
        F.min(row).alias("_r"), F.count("*").alias("copies"), F.min("_source").alias("first_source"),
        F.max("_source").alias("last_source"), (F.min("_sig") != F.max("_sig")).alias("conflict"),
    )
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], "copies", "first_source", "last_source", "conflict")


def replay_sources(df: DataFrame, keys: Sequence[str], source: Column) -> DataFrame:
    """The whole provenance of ``dedupe_replays``: one row per key and source, with the copies that came from it."""
    return df.withColumn("source", source).groupBy(*keys, "source").agg(F.count("*").alias("copies"))


def check_trace_totals(df: DataFrame, keys: Sequence[str], budget: int, max_turns: int) -> DataFrame:
    """Stored token sums differ from the generation array, costs exceed the budget, or turns exceed the cap."""
    def total(field: str) -> Column:
        return F.aggregate(F.transform("generation", lambda g: g[field]), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return _rules(df, keys, [
        ("input_tokens", F.col("input_tokens") == total("input_tokens")),
        ("output_tokens", F.col("output_tokens") == total("output_tokens")),
        ("over_budget", F.col("tool_cost") + F.col("request_cost") <= budget),
        ("too_many_turns", F.col("turns") <= max_turns),
    ])


def check_metric_nesting(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Localized implies chain, chain implies label-correct, correct implies finished; none may be null."""
    flags = ["localized", "chain", "label_correct", "finished"]
    known = F.forall(F.array(*[F.col(f) for f in flags]), lambda v: v.isNotNull())
    def implies(a: str, b: str) -> Column:
        return ~F.coalesce(F.col(a), F.lit(False)) | F.coalesce(F.col(b), F.lit(False))
    return _rules(df, keys, [
        ("null_metric", known), ("localized_without_chain", implies("localized", "chain")),
        ("chain_without_label", implies("chain", "label_correct")), ("correct_unfinished", implies("label_correct", "finished")),
    ])


def check_partition(counts: DataFrame, keys: Sequence[str], parts: Sequence[str], total: str, gain: str, loss: str, before: str, after: str) -> DataFrame:
    """Outcomes must add up to the cohort, and the net change must be gains less losses."""
    added = sum((F.col(p) for p in parts), F.lit(0))
    return _rules(counts, keys, [
        ("parts_do_not_add_up", added == F.col(total)),
        ("net_change", F.col(after) - F.col(before) == F.col(gain) - F.col(loss)),
    ])


def check_weighted_mean(overall: DataFrame, tasks: DataFrame, keys: Sequence[str], n: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Overall means that are not the size-weighted mean of their tasks, or sizes that do not add up."""
    pooled = tasks.groupBy(*keys).agg(F.sum(n).alias("_n"), F.try_divide(F.sum(F.col(n) * F.col(value)), F.sum(n)).alias("_v"))
    joined = overall.join(pooled, list(keys), "left")
    return _rules(joined, keys, [
        ("task_sizes", F.col(n) == F.col("_n")), ("weighted_mean", F.abs(F.col(value) - F.col("_v")) <= tolerance),
    ])


def check_published(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Published measurements that vanished or changed; new keys are allowed."""
    current = new.select(*keys, F.struct(*values).alias("_new"))
    joined = old.select(*keys, F.struct(*values).alias("_old")).join(current, list(keys), "left")
    rule = F.when(F.col("_new").isNull(), "vanished").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return joined.select(*keys, rule.alias("rule")).filter("rule IS NOT NULL")


def check_reviewed(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reviewed status, two distinct reviewers, and verdicts that still follow from the annotation."""
    available = F.transform(F.filter("evidence", lambda e: e["available"]), lambda e: e["id"])
    reviewers = F.col("review.reviewers")
    return _rules(cases, keys, [
        ("not_reviewed", F.col("annotation.status") == "reviewed"),
        ("two_reviewers", F.size(F.array_distinct(reviewers)) == 2),
        ("initial_verdict", pool_verdict(F.col("annotation"), F.col("initial")) == F.col("review.initial_verdict")),
        ("pool_verdict", pool_verdict(F.col("annotation"), available) == F.col("review.pool_verdict")),
    ])


def check_pairs(cases: DataFrame, bank: str, family: str, target: str, label: str, digest: str) -> DataFrame:
    """Banks must have two members of different families, targets and labels, and one digest."""
    def ends(c: str) -> list[Column]:
        return [F.min(c).alias(f"_{c}_low"), F.max(c).alias(f"_{c}_high")]
    grouped = cases.groupBy(bank).agg(F.count("*").alias("_n"), *[e for c in (family, target, label, digest) for e in ends(c)])
    def differ(c: str) -> Column:
        return F.col(f"_{c}_low") != F.col(f"_{c}_high")
    return _rules(grouped, [bank], [
        ("two_members", F.col("_n") == 2), ("same_family", differ(family)), ("same_target", differ(target)),
        ("same_label", differ(label)), ("different_digest", ~differ(digest)),
    ])


def shortcut_audit(df: DataFrame, strata: Sequence[str], label: str) -> DataFrame:
    """How often the majority label of each stratum alone gives the label, over all rows."""
    counts = df.groupBy(*strata, label).agg(F.count("*").alias("_n"))
    per = counts.groupBy(*strata).agg(F.sum("_n").alias("rows"), F.max("_n").alias("most"), F.min("_n").alias("least"), F.count("*").alias("labels"))
    return per.agg(
        F.count("*").alias("strata"), F.sum("rows").alias("rows"), F.sum("most").alias("majority_hits"),
        F.round(F.sum("most") / F.sum("rows"), 6).alias("majority_accuracy"),
        F.count_if((F.col("labels") == 2) & (F.col("most") == F.col("least"))).alias("balanced_strata"),
    )


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are missing, unlisted, or differ in size or digest from the manifest (path, bytes, sha256)."""
    left = manifest.select("path", F.struct("bytes", "sha256").alias("_m"))
    right = files.select("path", F.struct("bytes", "sha256").alias("_f"))
    rule = (
        F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "unlisted")
        .when(F.col("_m.bytes") != F.col("_f.bytes"), "size").when(F.col("_m.sha256") != F.col("_f.sha256"), "digest")
    )
    return left.join(right, "path", "full_outer").select("path", rule.alias("rule")).filter("rule IS NOT NULL")


def check_endpoints(endpoints: DataFrame, evidence: DataFrame, case: str, keys: Sequence[str]) -> DataFrame:
    """Cited regions on unknown or unavailable images, outside the visible area, or at another time.

    ``endpoints`` has the case, image_id, bbox and time; ``evidence`` the case, image_id, available, bounds and taken.
    """
    joined = endpoints.join(shuffled(evidence.withColumn("_known", F.lit(True))), [case, "image_id"], "left")
    known = F.coalesce(F.col("_known"), F.lit(False))
    return _rules(joined, keys, [
        ("unknown_image", known), ("unavailable", ~known | F.col("available")),
        ("outside", ~known | box_inside(F.col("bounds"), F.col("bbox"))), ("time", ~known | (F.col("time") == F.col("taken"))),
    ])


def access_audit(cases: DataFrame, poses: DataFrame, first: str, second: str, angle: float = 5.0) -> DataFrame:
    """Per case: required images that are hidden, hidden ones whose source is already visible, new frames that are
    available, and whether two views differ by more than ``angle`` degrees."""
    def where(test) -> Column:
        return F.filter("evidence", test)
    sources = F.transform(where(lambda e: F.array_contains("initial", e["id"])), lambda e: e["source_id"])
    hidden = F.array_sort(F.array_except(required_images(F.col("annotation")), F.col("initial")))
    visible = F.transform(
        where(lambda e: F.array_contains(hidden, e["id"]) & F.array_contains(sources, e["source_id"])), lambda e: e["id"]
    )
    fresh = F.transform(where(lambda e: e["available"] & ~F.array_contains(sources, e["source_id"])), lambda e: e["id"])
    left = poses.select("family_id", F.col("view").alias(first), F.col("rotation").alias("_a"))
    right = poses.select("family_id", F.col("view").alias(second), F.col("rotation").alias("_b"))
    # Only short results of the nested cases are shuffled.
    found = cases.select(
        "family_id", first, second, hidden.alias("hidden"), F.array_sort(visible).alias("source_visible"), F.array_sort(fresh).alias("new_frames"),
    )
    posed = found.join(shuffled(left), ["family_id", first], "left").join(shuffled(right), ["family_id", second], "left")
    return posed.select(
        "family_id", "hidden", "source_visible", "new_frames",
        (rotation_angle(F.col("_a"), F.col("_b")) > angle).alias("different_view"),
    )


def check_assignment(slots: DataFrame, task: str, family: str, source: str, repeats: int, people: int) -> DataFrame:
    """Problems of an assignment: a person who meets a source twice in different families or a family twice, slots
    without the exact repeats, and uneven quotas of (task, arm) between all ``people``, those without a slot included."""
    per_person = slots.groupBy("person", source).agg(F.count("*").alias("n"))
    met = per_person.filter("n > 1").select(
        F.concat_ws(":", F.lit("person"), "person", source).alias("key"), F.lit("source_repeated").alias("rule")
    )
    cells = slots.groupBy(family, "arm").agg(F.count("*").alias("n")).filter(F.col("n") != repeats).select(
        F.concat_ws(":", F.lit("family"), family, "arm").alias("key"), F.lit("wrong_repeats").alias("rule")
    )
    quota = slots.groupBy(task, "arm", "person").agg(F.count("*").alias("n")).groupBy(task, "arm").agg(
        F.when(F.count("*") < people, 0).otherwise(F.min("n")).alias("low"), F.max("n").alias("high")
    ).filter("high > low + 1").select(F.concat_ws(":", F.lit("quota"), task, "arm").alias("key"), F.lit("uneven_quota").alias("rule"))
    return met.unionByName(cells).unionByName(quota)


def reuse_subset(old: DataFrame, new_cases: DataFrame, case: str, digest: str) -> DataFrame:
    """Old results with ``status``: reusable when the case digest is unchanged in the new dataset (failures included)."""
    now = new_cases.select(case, F.col(digest).alias("_now"))
    status = F.when(F.col("_now").isNull(), "case_removed").when(F.col("_now") != F.col(digest), "case_changed").otherwise("reusable")
    return old.join(now, case, "left").withColumn("status", status).drop("_now")


def input_matching(audits: DataFrame, family: str, fields: Sequence[str], target: str, conditions: int) -> DataFrame:
    """Across the conditions of a family only the target block may differ, and it must differ in every pair."""
    ends = [e for f in fields for e in (F.min(f).alias(f"_{f}_low"), F.max(f).alias(f"_{f}_high"))]
    grouped = audits.groupBy(family).agg(F.count("*").alias("_n"), F.count_distinct(target).alias("_targets"), *ends)
    rules = [("conditions", F.col("_n") == conditions), ("target_not_distinct", F.col("_targets") == F.col("_n"))]
    rules += [(f"{f}_differs", F.col(f"_{f}_low").eqNullSafe(F.col(f"_{f}_high"))) for f in fields]
    return _rules(grouped, [family], rules)


def config_diff(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Named settings on which two runs disagree, with both values."""
    right = b.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    entries = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("base"), F.col(f"_{f}").cast("string").alias("other"))
        for f in fields
    ])
    rows = a.select(key, *fields).join(right, key).select(key, F.explode(entries).alias("e")).select(key, "e.*")
    return rows.filter(~F.col("base").eqNullSafe(F.col("other")))


def check_requests(episodes: DataFrame, keys: Sequence[str], max_requests: int) -> DataFrame:
    """Executed requests outside the public options, without a known status, or not as many as stored.

    ``requests`` is an array of (object, time, view, status, error) and ``request_options`` the allowed values.
    """
    options = F.col("request_options")
    inside = F.forall(
        "requests",
        lambda r: F.array_contains(options["objects"], r["object"]) & F.array_contains(options["times"], r["time"])
        & F.array_contains(options["views"], r["view"]),
    )
    executed = F.filter("requests", lambda r: r["error"].isNull())
    known = F.forall(executed, lambda r: F.coalesce(r["status"].isin("provided", "unable_to_provide"), F.lit(False)))
    return _rules(episodes, keys, [
        ("outside_options", inside), ("unknown_status", known), ("count_differs", F.size(executed) == F.col("request_count")),
        ("too_many", F.size(executed) <= max_requests),
    ])


def check_rescore(stored: DataFrame, rescored: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Stored scores that differ from recomputed ones, and results without a recomputed score."""
    new = rescored.select(*keys, F.col(score).alias("_new"), F.lit(True).alias("_known"))
    rule = F.when(F.col("_known").isNull(), "no_rescore").when(~F.col(score).eqNullSafe(F.col("_new")), "score_differs")
    return stored.join(new, list(keys), "left").select(*keys, rule.alias("rule")).filter("rule IS NOT NULL")


def check_same_start(df: DataFrame, case: str, digest: str) -> DataFrame:
    """Cases whose first input differs between policies."""
    ends = df.groupBy(case).agg(F.min(digest).alias("_low"), F.max(digest).alias("_high"))
    return ends.filter(~F.col("_low").eqNullSafe(F.col("_high"))).select(case, F.lit("initial_input_differs").alias("rule"))
