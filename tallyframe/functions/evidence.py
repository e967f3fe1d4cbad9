"""Evidence requirements, chains and availability, as column expressions over nested records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import REQ
from ..skew import among, let
from .geometry import box_valid, covers, iou

# Verdicts, relations and the relations whose ends may be swapped.
SUPPORTED, REFUTED, UNDECIDED = "Supported", "Refuted", "Need more evidence"
VERDICTS = (SUPPORTED, REFUTED, UNDECIDED)
RELATIONS = ("same_object", "different_object", "same_time", "earlier_than")
SYMMETRIC = ("same_object", "different_object", "same_time")
CHAIN_PROTOCOL = "evidence-chain-v1"
VARIANTS = ("Sufficient", "Obtainable", "Missing", "Unavailable")


def _end_match(expected: Column, actual: Column, limit: Column) -> Column:
    same = (expected["image_id"] == actual["image_id"]) & (expected["time"] == actual["time"])
    return same & (iou(expected["bbox"], actual["bbox"]) >= limit)


def link_match(expected: Column, actual: Column) -> Column:
    """Same relation and both ends overlap enough; symmetric relations also match with swapped ends."""
    limit = F.coalesce(expected["min_iou"], F.lit(0.5))
    direct = _end_match(expected["left"], actual["left"], limit) & _end_match(expected["right"], actual["right"], limit)
    swapped = _end_match(expected["left"], actual["right"], limit) & _end_match(expected["right"], actual["left"], limit)
    same = expected["relation"] == actual["relation"]
    return F.coalesce(same & (direct | (expected["relation"].isin(*SYMMETRIC) & swapped)), F.lit(False))


def requirement_met(req: Column, citations: Column, links: Column) -> Column:
    """A relation needs a matching link, a region needs its union covered, a plain id needs a citation."""
    cited = F.filter(citations, lambda c: (c["image_id"] == req["image_id"]) & (c["time"] == req["time"]))
    return (
        F.when(req["relation"].isNotNull(), F.exists(links, lambda link: link_match(req, link)))
        .when(req["bbox"].isNull(), F.exists(citations, lambda c: c["image_id"] == req["image_id"]))
        .otherwise(covers(req["bbox"], F.transform(cited, lambda c: c["bbox"])))
    )


def _any_group_met(alternatives: Column, citations: Column, links: Column) -> Column:
    met = F.exists(
        alternatives, lambda g: (F.size(g) > 0) & F.forall(g, lambda r: requirement_met(r, citations, links))
    )
    return F.coalesce(met, F.lit(False))


def alternatives_met(alternatives: Column, citations: Column, links: Column) -> Column:
    """Any non-empty group with every requirement met.

    Bodies of lambda functions are not compiled. Up to two groups of up to two requirements are therefore written out
    without them; more take the general way.
    """
    def group(g: Column) -> Column:
        first, second = (requirement_met(F.get(g, F.lit(i)), citations, links) for i in range(2))
        return (F.size(g) > 0) & first & ((F.size(g) < 2) | second)

    groups = [F.get(alternatives, F.lit(i)) for i in range(2)]
    few = F.size(alternatives).between(0, 2)
    for i, g in enumerate(groups):
        few = few & ((F.size(alternatives) <= i) | F.size(g).between(0, 2))
    met = ((F.size(alternatives) > 0) & group(groups[0])) | ((F.size(alternatives) > 1) & group(groups[1]))
    return F.when(few, F.coalesce(met, F.lit(False))).otherwise(_any_group_met(alternatives, citations, links))


def _groups(sets: Column) -> Column:
    """All alternative groups of a verdict → alternatives map."""
    return F.flatten(F.map_values(sets))


def requirements(annotation: Column) -> Column:
    """Every requirement of every subclaim, in order, with repeats."""
    return F.flatten(F.flatten(F.transform(annotation["subclaims"], lambda s: _groups(s["minimal_evidence_sets"]))))


def chain_report(annotation: Column, verdict: Column, citations: Column, links: Column) -> Column:
    """Struct(sufficient, covered, valid_links, predicted_links).

    Support needs every subclaim covered, refutation needs one; every given link must match an annotated one.
    """
    def audit(a: Column) -> Column:
        covered = F.transform(
            a["annotation"]["subclaims"],
            lambda s: (s["truth"] == verdict)
            & _any_group_met(F.try_element_at(s["minimal_evidence_sets"], verdict), a["citations"], a["links"]),
        )
        expected = F.filter(requirements(a["annotation"]), lambda r: r["relation"].isNotNull())
        valid = F.size(F.filter(a["links"], lambda link: F.exists(expected, lambda e: link_match(e, link))))
        return let(F.struct(covered.alias("covered"), valid.alias("valid"), F.size(a["links"]).alias("given")), report)

    def report(r: Column) -> Column:
        seen, valid, given = r["covered"], r["valid"], r["given"]
        enough = (
            F.when(verdict == SUPPORTED, F.forall(seen, lambda c: c))
            .when(verdict == REFUTED, F.exists(seen, lambda c: c))
            .otherwise(False)
        )
        return F.struct(
            (enough & (valid == given)).alias("sufficient"), seen.alias("covered"),
            valid.alias("valid_links"), given.alias("predicted_links"),
        )

    return let(F.struct(annotation.alias("annotation"), citations.alias("citations"), links.alias("links")), audit)


def derived_verdict(truths: Column) -> Column:
    """Any refuted part refutes; all parts supported support; anything else is undecided."""
    return (
        F.when(F.exists(truths, lambda t: t == REFUTED), REFUTED)
        .when(F.forall(truths, lambda t: t == SUPPORTED), SUPPORTED)
        .otherwise(UNDECIDED)
    )


def _endpoints(req: Column) -> Column:
    region = F.struct(req["image_id"].alias("image_id"), req["bbox"].alias("bbox"), req["time"].alias("time"))
    return F.when(req["relation"].isNotNull(), F.array(req["left"], req["right"])).otherwise(F.array(region))


def annotation_errors(annotation: Column) -> Column:
    """Codes of every violated rule of a chain annotation; an empty array for a sound one."""
    none = F.array().cast("array<string>")

    def structure(a: Column) -> Column:
        parts = a["subclaims"]
        truths = F.transform(parts, lambda s: s["truth"])
        bare = F.exists(
            parts,
            lambda s: (s["truth"] != "uncertain")
            & (F.coalesce(F.size(F.try_element_at(s["minimal_evidence_sets"], s["truth"])), F.lit(0)) <= 0),
        )
        return _broken([
            (F.size(parts) <= 0, "no_subclaims"),
            (F.size(F.array_distinct(F.transform(parts, lambda s: s["id"]))) != F.size(parts), "duplicate_subclaims"),
            (F.exists(truths, lambda t: ~t.isin(SUPPORTED, REFUTED, "uncertain")), "invalid_truth"),
            (a["verdict"] != derived_verdict(truths), "verdict_disagrees"), (bare, "determinate_without_sets"),
        ])

    def groups_of(a: Column) -> Column:
        return F.flatten(F.transform(a["subclaims"], lambda s: _groups(s["minimal_evidence_sets"])))

    def content(groups: Column) -> Column:
        empty = _broken([(F.exists(groups, lambda g: F.size(g) == 0), "empty_group")])
        return F.concat(empty, let(F.flatten(groups), _requirement_errors))

    def check(a: Column) -> Column:
        return F.when(a["protocol"] == CHAIN_PROTOCOL, F.concat(structure(a), let(groups_of(a), content))).otherwise(none)

    return let(annotation, check)


def _broken(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for bad, code in rules]))


def _requirement_errors(reqs: Column) -> Column:
    def related(r: Column) -> Column:
        return r["relation"].isNotNull()

    def bad_end(e: Column) -> Column:
        return ~box_valid(e["bbox"]) | (F.coalesce(e["image_id"], F.lit("")) == "") | (F.coalesce(e["time"], F.lit("")) == "")

    return _broken([
        (F.exists(reqs, lambda r: ~related(r) & r["bbox"].isNull()), "plain_image_requirement"),
        (F.exists(reqs, lambda r: related(r) & ~r["relation"].isin(*RELATIONS)), "unknown_relation"),
        (F.exists(reqs, lambda r: related(r) & ~F.coalesce(r["min_iou"], F.lit(0.5)).between(1e-12, 1.0)), "invalid_min_iou"),
        (F.exists(reqs, lambda r: related(r) & (r["left"]["image_id"] == r["right"]["image_id"])), "same_image_relation"),
        (F.exists(reqs, lambda r: F.exists(_endpoints(r), bad_end)), "invalid_region"),
    ])


def requirement_images(req: Column) -> Column:
    return F.transform(_endpoints(req), lambda e: e["image_id"])


def pool_verdict(annotation: Column, available: Column) -> Column:
    """The verdict reachable from a set of available image ids; not the physical truth."""
    def held(r: Column) -> Column:
        ends = among(r["left"]["image_id"], available) & among(r["right"]["image_id"], available)
        return F.when(r["relation"].isNotNull(), ends).otherwise(among(r["image_id"], available))

    def reachable(s: Column, verdict: str) -> Column:
        sets = F.try_element_at(s["minimal_evidence_sets"], F.lit(verdict))
        ready = F.exists(sets, lambda g: (F.size(g) > 0) & F.forall(g, held))
        return (s["truth"] == verdict) & F.coalesce(ready, F.lit(False))

    def verdict_of(a: Column) -> Column:
        return (
            F.when(a["protocol"] != CHAIN_PROTOCOL, a["verdict"])
            .when(F.exists(a["subclaims"], lambda s: reachable(s, REFUTED)), REFUTED)
            .when(F.forall(a["subclaims"], lambda s: reachable(s, SUPPORTED)), SUPPORTED)
            .otherwise(UNDECIDED)
        )

    return let(annotation, verdict_of)


def required_images(annotation: Column) -> Column:
    """Sorted distinct image ids of all minimal sets, through relations."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(requirements(annotation), requirement_images))))


def _part_sets(annotation: Column) -> Column:
    """Per subclaim the image sets of the alternatives for the annotation's verdict."""
    def part_sets(s: Column) -> Column:
        groups = F.coalesce(
            F.try_element_at(s["minimal_evidence_sets"], annotation["verdict"]), F.array().cast(f"array<array<{REQ}>>")
        )
        return F.transform(
            groups, lambda g: F.array_sort(F.array_distinct(F.flatten(F.transform(g, requirement_images))))
        )

    return F.transform(annotation["subclaims"], part_sets)


def _by_size(sets: Column) -> Column:
    """Distinct image sets, smaller ones first."""
    sized = F.array_sort(
        F.transform(sets, lambda s: F.struct(F.size(s).alias("size"), F.array_sort(s).alias("images")))
    )
    return F.transform(F.array_distinct(sized), lambda s: s["images"])


NO_SETS = "array<array<string>>"


def annotation_image_sets(annotation: Column) -> Column:
    """Image sets that decide a definite verdict: one alternative per part for support, any part's for refutation.

    Equal unions become one after every part, so the work follows the distinct sets. Where only the cheapest sets count,
    ``minimal_image_sets`` also drops those that contain another one.
    """
    verdict = annotation["verdict"]
    per_part = _part_sets(annotation)
    product = F.aggregate(
        per_part, F.array(F.array().cast("array<string>")),
        lambda acc, sets: F.array_distinct(
            F.flatten(F.transform(acc, lambda a: F.transform(sets, lambda s: F.array_sort(F.array_union(a, s)))))
        ),
    )
    return _by_size(
        F.when(verdict == SUPPORTED, product).when(verdict == REFUTED, F.flatten(per_part)).otherwise(F.array().cast(NO_SETS))
    )


# Images per word of a set's bit mask.
WORD = 62


def minimal_image_sets(annotation: Column) -> Column:
    """Those of ``annotation_image_sets`` that contain no other one, in the same order.

    A set is a bit mask in words of 62 images. Parts are merged one by one, and what contains another mask is dropped at
    once: a superset stays one whatever is added, so parts that share images keep the list short.
    """
    verdict = annotation["verdict"]

    def bit(position: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (position % WORD).cast("int"))

    def leanest(masks: Column) -> Column:
        def inside(y: Column, x: Column) -> Column:
            return F.forall(F.zip_with(y, x, lambda a, b: a.bitwiseAND(b) == a), lambda ok: ok)
        return let(F.array_distinct(masks), lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y != x) & inside(y, x))))

    def of_masks(bound: Column) -> Column:
        images, parts = bound["images"], bound["parts"]
        words = F.sequence(F.lit(0), F.floor(F.size(images) / WORD).cast("int"))

        def mask(s: Column) -> Column:
            places = F.transform(s, lambda i: F.array_position(images, i) - 1)
            return F.transform(words, lambda w: F.aggregate(
                F.filter(places, lambda p: F.floor(p / WORD) == w), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(bit(p))
            ))

        def joined(acc: Column, sets: Column) -> Column:
            both = F.transform(acc, lambda a: F.transform(sets, lambda s: F.zip_with(a, s, lambda x, y: x.bitwiseOR(y))))
            return leanest(F.flatten(both))

        masked = F.transform(parts, lambda sets: leanest(F.transform(sets, mask)))
        empty = F.array(F.transform(words, lambda w: F.lit(0).cast("long")))
        found = F.when(verdict == SUPPORTED, F.aggregate(masked, empty, joined)).otherwise(leanest(F.flatten(masked)))
        return F.transform(found, lambda m: F.filter(images, lambda _, i: F.get(m, F.floor(i / WORD).cast("int")).bitwiseAND(bit(i)) != 0))

    per_part = _part_sets(annotation)
    bound = F.struct(F.array_sort(F.array_distinct(F.flatten(F.flatten(per_part)))).alias("images"), per_part.alias("parts"))
    return _by_size(F.when(verdict.isin(SUPPORTED, REFUTED), let(bound, of_masks)).otherwise(F.array().cast(NO_SETS)))


def availability_class(initial: Column, pool: Column, oracle: Column, evidence: Column) -> Column:
    """Class of a case by what its material can decide, in the order of the checks."""
    return (
        F.when(initial != UNDECIDED, "Sufficient")
        .when(pool != UNDECIDED, "Obtainable")
        .when(oracle == UNDECIDED, "Underdetermined")
        .when(F.exists(evidence, lambda e: ~e["available"]), "Unavailable")
        .otherwise("Missing")
    )


def transition(before: Column, after: Column, label: Column) -> Column:
    """Six-way change of an answer between two arms of one family; answers may be null."""
    was, now = before.eqNullSafe(label), after.eqNullSafe(label)
    return (
        F.when(was & now, "maintained_correct").when(now, "corrected").when(~was, "remained_wrong")
        .when(~F.coalesce(after.isin(*VERDICTS), F.lit(False)), "lost_no_valid_final")
        .when(after == UNDECIDED, "lost_explicit_NME").otherwise("lost_valid_wrong_label")
    )


def links_complete(expected: Column, actual: Column) -> Column:
    """Every expected link is given and every given link is expected; false when nothing is expected."""
    found = F.forall(expected, lambda e: F.exists(actual, lambda a: link_match(e, a)))
    known = F.forall(actual, lambda a: F.exists(expected, lambda e: link_match(e, a)))
    return (F.size(expected) > 0) & found & known


def derive_link(citations: Column, objects: Column, verdict: Column, task: Column) -> Column:
    """The one link implied by an identity answer with exactly two regions, one on each subject; else no link."""
    fits = (
        (task == "identity") & (verdict != UNDECIDED) & (F.size(citations) == 2)
        & (F.array_sort(F.array_distinct(objects)) == F.array(F.lit("subject-A"), F.lit("subject-B")))
    )
    link = F.struct(
        F.when(verdict == SUPPORTED, "same_object").otherwise("different_object").alias("relation"),
        F.get(citations, F.lit(0)).alias("left"), F.get(citations, F.lit(1)).alias("right"),
    )
    return F.when(fits, F.array(link)).otherwise(F.slice(F.array(link), 1, 0))
