"""Votes, consensus, adjudication and admission.

Two reviewers are the first and the last vote of a unit, found by minima and maxima: no vote list is gathered, and a
unit with too many votes costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import (
    CHAIN_PROTOCOL, UNDECIDED, VARIANTS, VERDICTS, annotation_errors, availability_class, chain_report, pool_verdict,
)
from ..functions.geometry import box_inside
from ..skew import among, shuffled, spread

# Protocol names of stored reviews.
REVIEW_PROTOCOL = "visual-review-v1"
TRUTH_PROTOCOLS = ("visual-truth-review-v2", "visual-truth-review-v3")


def _filled(c: str) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def _codes(rules: Sequence[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules]))


def vote_errors() -> Column:
    """Codes of everything wrong with a full review vote."""
    def judged(c: str) -> Column:
        keys = F.array_sort(F.map_keys(c)) == F.array_sort(F.array(*[F.lit(v) for v in VARIANTS]))
        return keys & F.forall(F.map_values(c), lambda v: v.isin(*VERDICTS))
    return F.concat(
        _codes([
            ("protocol", F.col("protocol") == REVIEW_PROTOCOL), ("reviewer", (F.col("reviewer_type") == "human") & _filled("reviewer_id")),
            ("reason", _filled("reason")), ("dataset", F.length("dataset_sha256") == 64), ("claim_clear", F.col("claim_clear").isNotNull()),
            ("alternatives_checked", F.col("alternatives_checked").isNotNull()), ("initial_verdicts", judged("initial_verdicts")),
            ("pool_verdicts", judged("pool_verdicts")), ("annotation", F.col("annotation.protocol") == CHAIN_PROTOCOL),
        ]),
        F.coalesce(annotation_errors(F.col("annotation")), F.array().cast("array<string>")),
    )


def truth_vote_errors() -> Column:
    """Codes of everything wrong with a full-material truth vote; availability judgments are not its business."""
    return _codes([
        ("protocol", F.col("protocol").isin(*TRUTH_PROTOCOLS)), ("scope", F.col("scope") == "full_pool_only"),
        ("reviewer", (F.col("reviewer_type") == "human") & _filled("reviewer_id")), ("dataset", F.length("dataset_sha256") == 64),
        ("claim_clear", F.col("claim_clear").isNotNull()), ("verdict", F.col("verdict").isin(*VERDICTS)),
        ("availability_fields", F.col("initial_verdicts").isNull() & F.col("pool_verdicts").isNull()),
    ])


def truth_consensus(votes: DataFrame, unit: str) -> DataFrame:
    """Accepted verdict, or the reason a unit is pending: two reviewers, a clear claim, then one verdict."""
    groups = votes.groupBy(unit).agg(
        F.count("*").alias("votes"), F.min("reviewer_id").alias("_r1"), F.max("reviewer_id").alias("_r2"),
        F.bool_and("claim_clear").alias("_clear"), F.min("verdict").alias("_v1"), F.max("verdict").alias("_v2"),
    )
    reason = (
        F.when((F.col("votes") != 2) | (F.col("_r1") == F.col("_r2")), "two_reviewers_needed")
        .when(~F.col("_clear"), "claim_unclear").when(F.col("_v1") != F.col("_v2"), "verdicts_differ")
    )
    return groups.select(unit, "votes", F.when(reason.isNull(), F.col("_v1")).alias("verdict"), reason.alias("reason"))


def _truths(annotation: Column) -> Column:
    return F.struct(
        annotation["verdict"],
        F.array_sort(F.transform(annotation["subclaims"], lambda s: F.struct(s["id"], s["kind"], s["truth"]))),
    )


def _union_annotation(first: Column, second: Column) -> Column:
    """Alternatives of both annotations per subclaim and verdict, those of the first vote first."""
    def merge(s: Column) -> Column:
        other = F.get(F.filter(second["subclaims"], lambda o: o["id"] == s["id"]), F.lit(0))["minimal_evidence_sets"]
        sets = F.map_zip_with(
            s["minimal_evidence_sets"], other,
            lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_distinct(F.concat(a, b))),
        )
        return s.withField("minimal_evidence_sets", sets)
    return first.withField("subclaims", F.transform(first["subclaims"], merge)).withField("status", F.lit("reviewed"))


def merge_votes(votes: DataFrame, order: str) -> DataFrame:
    """Merged annotation per family with the verdict maps, or the reason it cannot be merged."""
    vote = F.struct("reviewer_id", "claim_clear", "alternatives_checked", "initial_verdicts", "pool_verdicts", "annotation")
    # Votes are wide and their sort for the minima is the work: it takes one task's share of families, not of files.
    both = spread(votes, "family_id").groupBy("family_id").agg(
        F.count("*").alias("votes"), F.min_by(vote, order).alias("a"), F.max_by(vote, order).alias("b")
    )

    def same_map(c: str) -> Column:
        return F.array_sort(F.map_entries(F.col(f"a.{c}"))) == F.array_sort(F.map_entries(F.col(f"b.{c}")))

    merged = _union_annotation(F.col("a.annotation"), F.col("b.annotation"))
    attested = F.col("a.claim_clear") & F.col("b.claim_clear") & F.col("a.alternatives_checked") & F.col("b.alternatives_checked")
    reason = (
        F.when((F.col("votes") != 2) | (F.trim("a.reviewer_id") == F.trim("b.reviewer_id")), "two_reviewers_needed")
        .when(~attested, "unclear_or_unchecked")
        .when(~(same_map("initial_verdicts") & same_map("pool_verdicts")), "verdicts_differ")
        .when(_truths(F.col("a.annotation")) != _truths(F.col("b.annotation")), "subclaim_truths_differ")
        .when(F.size(annotation_errors(F.col("merged"))) > 0, "invalid_annotation")
    )
    return both.withColumn("merged", merged).select(
        "family_id", "votes", "merged", F.col("a.initial_verdicts").alias("initial_verdicts"), F.col("a.pool_verdicts").alias("pool_verdicts"),
        F.array("a.reviewer_id", "b.reviewer_id").alias("reviewers"), reason.alias("reason"),
    )


def admit(cases: DataFrame, votes: DataFrame, order: str) -> DataFrame:
    """Every case with its review, re-derived class and release configuration, or with the reason its family is pending.

    The merged alternatives must explain the reviewed verdicts of every variant of the family.
    """
    merged = merge_votes(votes, order).drop("votes")
    joined = cases.join(shuffled(merged), "family_id", "left")
    available = F.transform(F.filter("evidence", lambda e: e["available"]), lambda e: e["id"])
    joined = joined.withColumn("reviewed_initial", F.try_element_at("initial_verdicts", F.col("variant"))).withColumn(
        "reviewed_pool", F.try_element_at("pool_verdicts", F.col("variant"))
    )
    explained = (pool_verdict(F.col("merged"), available) == F.col("reviewed_pool")) & (
        pool_verdict(F.col("merged"), F.col("initial")) == F.col("reviewed_initial")
    )
    flagged = joined.withColumn("_explained", F.coalesce(explained, F.lit(False)))
    whole = flagged.groupBy("family_id").agg(F.bool_and("_explained").alias("_whole"))
    out = flagged.join(shuffled(whole), "family_id")
    reason = (
        F.when(F.col("reviewers").isNull(), "two_reviewers_needed").when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~F.col("_whole"), "unexplained_verdicts")
    )
    cls = availability_class(F.col("reviewed_initial"), F.col("reviewed_pool"), F.col("merged.verdict"), F.col("evidence"))
    return out.select(
        "case_id", "family_id", F.col("variant").alias("release_configuration"), reason.alias("reason"),
        F.when(reason.isNull(), cls).alias("variant"), F.when(reason.isNull(), F.col("merged")).alias("annotation"),
        F.when(reason.isNull(), F.struct(
            F.lit(REVIEW_PROTOCOL).alias("protocol"), "reviewers", F.col("reviewed_initial").alias("initial_verdict"), F.col("reviewed_pool").alias("pool_verdict")
        )).alias("review"),
    )


def agreement(pairs: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Raw agreement and Fleiss kappa of two raters; kappa is null when chance agreement is certain.

    Pairs are counted first, so only the small table of answer pairs is opened up for the pooled shares.
    """
    counts = pairs.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    raw = counts.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum(F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("_n")).otherwise(0)).alias("_same")
    )
    pooled = counts.select(*by, "_n", F.explode(F.array("_a", "_b")).alias("_k")).groupBy(*by, "_k").agg(F.sum("_n").alias("_m"))
    chance = pooled.groupBy(*by).agg(
        (F.sum(F.col("_m").cast("double") * F.col("_m")) / (F.sum("_m").cast("double") * F.sum("_m"))).alias("_pe")
    )
    joined = raw.join(chance, list(by))
    share = F.col("_same") / F.col("n")
    return joined.select(*by, "n", share.alias("agreement"), F.try_divide(share - F.col("_pe"), 1 - F.col("_pe")).alias("fleiss_kappa"))


def packet_problems(answers: DataFrame, assigned: DataFrame) -> DataFrame:
    """Packets with several people, people with several packets, and unit answers missing, repeated or unassigned."""
    def several(key: str, other: str, rule: str) -> DataFrame:
        ends = answers.groupBy(key).agg(F.min(other).alias("_l"), F.max(other).alias("_h")).filter("_l <> _h")
        return ends.select(F.concat_ws(":", F.lit(key), key).alias("key"), F.lit(rule).alias("rule"))
    got = answers.groupBy("packet_id", "unit_id").agg(F.count("*").alias("_n"))
    want = assigned.select("packet_id", "unit_id", F.lit(True).alias("_want"))
    joined = want.join(got, ["packet_id", "unit_id"], "full_outer")
    rule = F.when(F.col("_n").isNull(), "missing_answer").when(F.col("_want").isNull(), "unassigned_answer").when(F.col("_n") > 1, "repeated_answer")
    units = joined.select(F.concat_ws(":", F.lit("unit"), "packet_id", "unit_id").alias("key"), rule.alias("rule")).filter("rule IS NOT NULL")
    return several("packet_id", "reviewer_id", "packet_of_several_people").unionByName(
        several("reviewer_id", "packet_id", "person_with_several_packets")
    ).unionByName(units)


# Judgments of a blind review.
SUFFICIENCIES = ("sufficient", "insufficient", "uncertain")
ANSWERS = ("Supported", "Refuted", UNDECIDED)


def answer_problems(answers: DataFrame, units: DataFrame) -> DataFrame:
    """Answers of a blind review that may not count, by the first rule they break.

    ``answers`` has packet_id, unit_id, sufficiency, answer, claim_clear, citations (image ids) and regions (image_id and
    bbox as shares of the image); ``units`` has unit_id and ``image_ids``. A null list counts as empty.
    """
    cited, regions = F.coalesce("citations", F.array().cast("array<string>")), F.col("regions")
    definite = F.col("answer") != UNDECIDED

    def inside(r: Column) -> Column:
        box = r["bbox"]
        low, high = F.get(box, F.lit(0)), F.get(box, F.lit(2))
        left, right = F.get(box, F.lit(1)), F.get(box, F.lit(3))
        return F.coalesce((F.size(box) == 4) & (low >= 0) & (low < high) & (high <= 1) & (left >= 0) & (left < right) & (right <= 1), F.lit(False))

    def known(r: Column) -> Column:
        return F.array_contains("image_ids", r["image_id"])

    rule = (
        F.when(F.col("image_ids").isNull(), "unknown_unit")
        .when(~F.coalesce(F.col("sufficiency").isin(*SUFFICIENCIES) & F.col("answer").isin(*ANSWERS), F.lit(False)), "invalid_judgment")
        .when(F.col("claim_clear").isNull(), "claim_clear_missing")
        .when((F.size(F.array_distinct(cited)) < F.size(cited)) | (F.size(F.array_except(cited, "image_ids")) > 0), "invalid_citation")
        .when(definite != (F.col("sufficiency") == "sufficient"), "answer_contradicts_sufficiency")
        .when(definite & (F.size(cited) == 0), "definite_without_citation")
        .when(F.exists(regions, lambda r: ~F.coalesce(known(r), F.lit(False))), "unknown_region")
        .when(F.exists(regions, lambda r: ~inside(r)), "region_outside_image")
    )
    joined = answers.join(units.select("unit_id", "image_ids"), "unit_id", "left")
    return joined.select("packet_id", "unit_id", rule.alias("rule")).filter("rule IS NOT NULL")


def blind_consensus(answers: DataFrame, adjudications: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """State of every unit: consensus of two, adjudicated by a third person, queued, or not yet answered twice.

    With ``units`` (see ``answer_problems``) answers that may not count have no vote; a unit with no other one is ``waiting``.

    Consensus needs equal, clear and certain answers. An adjudication counts only for a queued unit, by a person who did
    not rate it, when it is clear and certain; the first such record by reviewer counts.
    """
    if units is not None:
        refused = answer_problems(answers, units).select(F.struct("packet_id", "unit_id").alias("_key")).distinct()
        sound = answers.withColumn("_key", F.struct("packet_id", "unit_id")).join(refused, "_key", "left_anti").drop("_key")
        empty = answers.select("unit_id").distinct().join(sound.select("unit_id"), "unit_id", "left_anti").withColumn("votes", F.lit(0).cast("bigint"))
        found = blind_consensus(sound, adjudications)
        none = F.lit(None).cast("string")
        return found.unionByName(empty.select("unit_id", "votes", F.lit("waiting").alias("state"), none.alias("sufficiency"), none.alias("answer")))
    fields = ("sufficiency", "answer", "claim_clear")
    ends = [e for f in fields for e in (F.min(f).alias(f"_{f}_l"), F.max(f).alias(f"_{f}_h"))]
    units = answers.groupBy("unit_id").agg(F.count("*").alias("votes"), F.min("reviewer_id").alias("_r1"), F.max("reviewer_id").alias("_r2"), *ends)
    same = F.lit(True)
    for f in fields:
        same = same & (F.col(f"_{f}_l") == F.col(f"_{f}_h"))
    settled = same & F.col("_claim_clear_l") & (F.col("_sufficiency_l") != "uncertain")
    state = (
        F.when(F.col("votes") < 2, "waiting").when((F.col("votes") > 2) | (F.col("_r1") == F.col("_r2")), "invalid_votes")
        .when(settled, "consensus").otherwise("queued")
    )
    units = units.withColumn("_state", state)
    queue = units.filter("_state = 'queued'").select("unit_id", "_r1", "_r2")
    usable = adjudications.join(queue, "unit_id").filter(
        (F.col("reviewer_id") != F.col("_r1")) & (F.col("reviewer_id") != F.col("_r2")) & F.col("claim_clear") & (F.col("sufficiency") != "uncertain")
    )
    third = usable.groupBy("unit_id").agg(F.min(F.struct("reviewer_id", "sufficiency", "answer")).alias("_t"))
    joined = units.join(third, "unit_id", "left")
    def pick(f: str) -> Column:
        return F.when(F.col("_state") == "consensus", F.col(f"_{f}_l")).otherwise(F.col(f"_t.{f}"))
    final = F.when(F.col("_t").isNotNull(), "adjudicated").otherwise(F.col("_state"))
    return joined.select("unit_id", "votes", final.alias("state"), pick("sufficiency").alias("sufficiency"), pick("answer").alias("answer"))


def adjudication_problems(adjudications: DataFrame, answers: DataFrame) -> DataFrame:
    """Adjudications by a person who already rated the unit."""
    raters = answers.select("unit_id", "reviewer_id").distinct()
    return adjudications.join(raters, ["unit_id", "reviewer_id"], "left_semi").select("unit_id", "reviewer_id", F.lit("not_independent").alias("rule"))


def material_gap(consensus: DataFrame) -> DataFrame:
    """Per family: initial material insufficient while the pool suffices, a cited frame from a new source, and whether
    the blocked pool stays unresolved. ``consensus`` has family_id, unit (kind), sufficiency and cited_new_source."""
    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("unit") == kind, F.col(column)))
    wide = consensus.groupBy("family_id").agg(
        of("initial", "sufficiency").alias("_i"), of("candidate_pool", "sufficiency").alias("_p"), of("resolution_control", "sufficiency").alias("_h"),
        of("blocked_pool", "sufficiency").alias("_b"), of("candidate_pool", "cited_new_source").alias("_new"),
    )
    low, high = "insufficient", "sufficient"
    return wide.select(
        "family_id", (F.col("_i").isNotNull() & F.col("_p").isNotNull()).alias("main_review_complete"),
        ((F.col("_i") == low) & (F.col("_p") == high)).alias("initial_to_pool_gap"),
        ((F.col("_h") == low) & (F.col("_p") == high) & F.coalesce(F.col("_new"), F.lit(False))).alias("different_frame_helpful"),
        (F.col("_b") == low).alias("blocked_pool_unresolved"),
    )


def reviewed_outcome(episodes: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Verdict against the evidence in hand: whether it matches, whether asking could help, and unused evidence.

    ``episodes`` has released (array) and verdict; ``cases`` the annotation, initial_verdict and pool_verdict.
    """
    joined = episodes.join(cases.select(key, "annotation", "initial_verdict", "pool_verdict"), key)
    current = F.col("current_evidence_verdict")
    return joined.withColumn("current_evidence_verdict", pool_verdict(F.col("annotation"), F.col("released"))).select(
        *episodes.columns, "current_evidence_verdict", F.col("verdict").eqNullSafe(current).alias("decision_matches_current_evidence"),
        ((F.col("initial_verdict") == UNDECIDED) & (F.col("pool_verdict") != UNDECIDED)).alias("acquisition_opportunity"),
        ((current == UNDECIDED) & (F.col("pool_verdict") != UNDECIDED)).alias("unused_obtainable_evidence"),
        (F.coalesce(F.col("verdict").isin("Supported", "Refuted"), F.lit(False)) & (current == UNDECIDED)).alias("unsupported_verdict"),
    )


def review_summary(graded: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per actor and condition; grounded counts are null where citation scoring was available nowhere."""
    scored = F.count("grounded_correct")
    return graded.groupBy(*by).agg(
        F.count("*").alias("reviewed_episodes"), F.count("verdict").alias("submitted"), F.count_if("decision_matches_current_evidence").alias("reasonable_verdicts"),
        F.count_if("unsupported_verdict").alias("unsupported_verdicts"), F.when(scored > 0, F.count_if("grounded_correct")).alias("grounded_correct"),
        scored.alias("citation_scoring_available"), F.count_if("unused_obtainable_evidence").alias("unused_obtainable_evidence"), F.sum("requests").alias("requests"),
    )


def full_material_agreement(episodes: DataFrame, consensus: DataFrame, by: Sequence[str]) -> DataFrame:
    """Agreement with the human verdict over episodes whose available pool is exactly the reviewed pool."""
    human = consensus.select("family_id", F.col("verdict").alias("_human"), F.array_sort("full_pool_ids").alias("_pool"))
    same = episodes.join(human, "family_id").filter(F.array_sort("available_ids") == F.col("_pool"))
    out = same.groupBy(*by).agg(
        F.count("*").alias("episodes"), F.count("verdict").alias("submitted"), F.count_if(F.col("verdict") == F.col("_human")).alias("matches")
    )
    return out.withColumn("label_agreement", F.col("matches") / F.col("episodes"))


def participant_progress(tasks: DataFrame, answers: DataFrame, starts: DataFrame, actor: str, idx: str) -> DataFrame:
    """Submitted, started and untouched tasks per person, and the first one still open."""
    keys = [actor, idx]
    done = answers.select(*keys).distinct().withColumn("_done", F.lit(True))
    begun = starts.select(*keys).distinct().withColumn("_begun", F.lit(True))
    joined = tasks.select(*keys).join(done, keys, "left").join(begun, keys, "left")
    open_ = F.col("_done").isNull()
    return joined.groupBy(actor).agg(
        F.count("*").alias("total"), F.count("_done").alias("submitted"), F.count_if(open_ & F.col("_begun").isNotNull()).alias("in_progress"),
        F.count_if(open_ & F.col("_begun").isNull()).alias("not_started"), F.min(F.when(open_, F.col(idx))).alias("first_open"),
    )


def export_answers(answers: DataFrame, order: Sequence[str], vote: str, votes_only: bool = False) -> DataFrame:
    """Flat export in order, or only the votes."""
    chosen = answers.filter(F.col(vote).isNotNull()).select(*order, vote) if votes_only else answers
    return chosen.orderBy(*order)


def grade_episodes(episodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correctness, grounding and support of each decision against its annotated case.

    ``episodes`` has annotation, available (ids), released (ids), images (id, time and source_bbox of each), verdict,
    citations and links. A decision is invalid, not correct, if it cites an image that was not released, another time than
    the image's, or a box outside of what the image shows, or if both ends of a link lie on one image. Null citations or links
    are none.
    """
    empty = {c: F.coalesce(F.col(c), F.array().cast(episodes.schema[c].dataType)) for c in ("citations", "links")}
    episodes = episodes.withColumns(empty)

    def seen(c: Column) -> Column:
        shown = F.exists("images", lambda i: (i["id"] == c["image_id"]) & (i["time"] == c["time"]) & box_inside(i["source_bbox"], c["bbox"]))
        return among(c["image_id"], F.col("released")) & F.coalesce(shown, F.lit(False))
    apart = F.forall("links", lambda link: seen(link["left"]) & seen(link["right"]) & (link["left"]["image_id"] != link["right"]["image_id"]))
    valid = F.forall("citations", seen) & apart
    report = chain_report(F.col("annotation"), F.col("verdict"), F.col("citations"), F.col("links"))
    base = episodes.withColumn("_valid", valid).withColumn("_grounded", valid & report["sufficient"]).withColumn(
        "expected_verdict", pool_verdict(F.col("annotation"), F.col("available"))
    )
    abstains = F.col("verdict") == UNDECIDED
    correct = F.col("verdict") == F.col("expected_verdict")
    return base.select(
        *keys, "expected_verdict", correct.alias("correct"), (correct & F.col("_valid") & (abstains | F.col("_grounded"))).alias("grounded_correct"),
        (~abstains & ~F.col("_grounded")).alias("unsupported_decision"), (~abstains).alias("coverage"),
    )
