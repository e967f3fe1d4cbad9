"""Dataset curation: variants, samples, cohorts and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.evidence import VARIANTS
from ..functions.hashing import row_digest, stable_hash
from ..functions.text import path_errors
from ..skew import hash_ranked, ordered_index



def first_per_group(df: DataFrame, group: Sequence[str], digest: Column, limit: int, tie: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` rows of each group in digest order."""
    return hash_ranked(df, group, digest, "rank", tie).filter(F.col("rank") <= limit)


def expand_variants(families: DataFrame, withheld: str = "withheld") -> DataFrame:
    """Four availability variants per family.

    Sufficient shows the withheld image at once, Missing has no row for it, Unavailable keeps the row but marks it.
    """
    held, variant = F.col(withheld), F.col("variant")
    swapped = F.transform(
        "initial",
        lambda i: F.when(i == F.concat(held, F.lit("-preview")), held)
        .when((i == "preview") & (held == "original"), F.lit("original")).otherwise(i),
    )
    marked = F.transform("evidence", lambda e: e.withField("available", e["available"] & (e["id"] != held)))
    evidence = (
        F.when(variant == "Missing", F.filter("evidence", lambda e: e["id"] != held))
        .when(variant == "Unavailable", marked).otherwise(F.col("evidence"))
    )
    return (
        families.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))
        .withColumn("initial", F.when(variant == "Sufficient", swapped).otherwise(F.col("initial")))
        .withColumn("evidence", evidence)
        .withColumn("case_id", F.concat_ws("-", "family_id", "variant"))
    )


def balanced_pairs(df: DataFrame, group: Sequence[str], positive: Column, key: str, salt: str) -> DataFrame:
    """Positives and negatives of each group zipped in hash order; the surplus is left out."""
    ranked = hash_ranked(
        df.select(*group, key, positive.alias("_positive")), [*group, "_positive"], stable_hash(F.col(key), salt), "pair", [key]
    )
    sides = {flag: ranked.filter(F.col("_positive") == flag).drop("_positive") for flag in (True, False)}
    return (
        sides[True].withColumnRenamed(key, "positive")
        .join(sides[False].withColumnRenamed(key, "negative"), [*group, "pair"])
    )


def stratified_hash_sample(df: DataFrame, strata: Sequence[str], key: str, salt: str, n: int) -> DataFrame:
    """First ``n`` rows of every stratum in salted hash order."""
    return first_per_group(df, strata, stable_hash(F.col(key), salt), n, [key])


def short_strata(df: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """Strata that cannot supply ``n`` rows; a sample of them must be refused."""
    return df.groupBy(*strata).agg(F.count("*").alias("rows")).filter(F.col("rows") < n)


def round_robin(df: DataFrame, group: str, digest: Column, limit: int, tie: Sequence[str] = ()) -> DataFrame:
    """Interleave groups in hash order and cut after ``limit`` rows, so that no group dominates.

    No group can contribute more than ``limit`` rows, so every group is cut before the one global top-k.
    """
    ranked = first_per_group(df, [group], digest, limit, tie)
    return ranked.orderBy("rank", group).limit(limit)


def balanced_sample(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows per label; exactly two labels are required."""
    labels = df.select(label).distinct().limit(3).count()
    if labels != 2:
        raise ValueError(f"expected two labels, found {'more' if labels > 2 else labels}")
    return stratified_hash_sample(df, [label], key, str(seed), n)


def undersample_to_minority(df: DataFrame, group: str, minority: Column, key: str, salt: str) -> DataFrame:
    """All minority rows, as many majority rows, and one more majority row per group as reference (column ``role``).

    A group without minority rows, or with too few majority rows, has role ``short`` and must be refused.
    """
    flagged = df.withColumn("_minority", minority)
    sizes = flagged.groupBy(group).agg(
        F.count_if("_minority").alias("_few"), F.count_if(~F.col("_minority")).alias("_many")
    )
    ranked = hash_ranked(flagged, [group, "_minority"], stable_hash(F.col(key), salt), "rank", [key]).join(sizes, group)
    short = (F.col("_few") == 0) | (F.col("_many") < F.col("_few") + 1)
    role = (
        F.when(short, "short").when(F.col("_minority"), "minority").when(F.col("rank") == 1, "reference")
        .when(F.col("rank") <= F.col("_few") + 1, "majority")
    )
    return ranked.withColumn("role", role).filter("role IS NOT NULL").drop("_minority", "_few", "_many", "rank")


def _spread(size: Column, k: int) -> Column:
    """Indices ``round(i * (size - 1) / (k - 1))``, halves to even."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (size - 1) / F.lit(float(k - 1)), 0).cast("long")
    )


def evenly_spaced(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Rows at ``k`` evenly spread positions of each ordered group (fewer when the group is smaller)."""
    indexed = ordered_index(df, group, order, "rank", "size")
    return indexed.filter(F.array_contains(_spread(F.col("size"), k), F.col("rank") - 1)).drop("size")


def evenly_spaced_valid(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int, valid: str) -> DataFrame:
    """Like ``evenly_spaced``, but each position takes the nearest valid row not taken yet (the earlier one on ties).

    A group with fewer than two rows to take gives none. Only the ``k`` nearest valid rows on either side of a position can be chosen, which bounds what a group gathers.
    """
    group = list(group)
    indexed = ordered_index(df, group, order, "rank", "size").withColumn("index", F.col("rank") - 1)
    good = ordered_index(indexed.filter(valid).select(*group, "index"), group, ["index"], "nth", "valid_rows")
    sizes = indexed.groupBy(*group).agg(F.max("size").alias("size"))
    spots = sizes.select(*group, F.posexplode(_spread(F.col("size"), k)).alias("turn", "target"))
    marks = (
        spots.select(*group, "turn", "target", F.lit(None).cast("long").alias("nth"), F.col("target").alias("at"))
        .unionByName(good.select(*group, F.lit(None).cast("int").alias("turn"), F.lit(None).cast("long").alias("target"),
                                 "nth", F.col("index").alias("at")))
    )
    placed = ordered_index(marks.withColumn("_kind", F.col("turn").isNotNull()), group, ["at", "_kind", "turn"], "place")
    # Valid rows at or before a position: its place among all marks less the positions before it.
    before = placed.filter("turn IS NOT NULL").withColumn("passed", F.col("place") - F.col("turn") - 1)
    near = F.explode(F.sequence(F.col("passed") - (k - 1), F.col("passed") + k))
    offers = (
        before.select(*group, "turn", "target", near.alias("nth")).join(good.select(*group, "nth", "index"), [*group, "nth"])
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(
            F.struct("turn", F.abs(F.col("index") - F.col("target")).alias("gap"), F.col("index"))
        )).alias("offers"))
    )
    start = F.struct(F.lit(-1).alias("turn"), F.array().cast("array<bigint>").alias("taken"))
    chosen = F.aggregate(
        "offers", start,
        lambda acc, o: F.when((o["turn"] == acc["turn"]) | F.array_contains(acc["taken"], o["index"]), acc).otherwise(
            F.struct(o["turn"].alias("turn"), F.concat(acc["taken"], F.array(o["index"])).alias("taken"))
        ),
    )["taken"]
    picked = offers.withColumn("chosen", chosen).filter(F.size("chosen") >= 2).select(*group, F.explode("chosen").alias("index"))
    return indexed.join(picked, [*group, "index"], "left_semi").drop("rank", "size")


def cyclic_partner(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Each row with the next row of its group; the last one wraps to the first."""
    indexed = ordered_index(df, group, order, "rank", "size").withColumn("_group", F.struct(*group))
    partners = indexed.select("_group", F.col("rank").alias("_next"), F.col(value).alias("partner"))
    return (
        indexed.withColumn("_next", F.col("rank") % F.col("size") + 1)
        .join(partners, ["_group", "_next"]).drop("_group", "_next", "rank", "size")
    )


def best_per_source(df: DataFrame, source: Sequence[str], area: Column, key: str) -> DataFrame:
    """The largest row of each source; the smallest key wins a tie."""
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in source]), F.struct(area, (-F.col(key)).alias("_k")))
    return df.groupBy(*source).agg(best.alias("_best")).select(*source, "_best.*")


def _largest_per_source(evidence: Column) -> Column:
    """Evidence array with one row per source: the first of the largest area, in source order of appearance."""
    def pixels(e: Column) -> Column:
        return e["source_size"][0] * e["source_size"][1]
    return F.filter(
        evidence,
        lambda e, i: ~F.exists(
            F.transform(evidence, lambda o, j: F.struct(o.alias("o"), j.alias("j"))),
            lambda z: (z["o"]["source_id"] == e["source_id"])
            & ((pixels(z["o"]) > pixels(e)) | ((pixels(z["o"]) == pixels(e)) & (z["j"] < i))),
        ),
    )


def material_sets(cases: DataFrame, withheld: Column) -> DataFrame:
    """Four reading materials per family: initial, candidate pool, resolution control and blocked pool."""
    pool = F.filter("evidence", lambda e: e["available"])
    initial = F.filter("evidence", lambda e: F.array_contains("initial", e["id"]))
    sources = F.transform(initial, lambda e: e["source_id"])
    control = F.filter(pool, lambda e: F.array_contains(sources, e["source_id"]))
    blocked = F.filter(pool, lambda e: e["id"] != withheld)
    kinds = {"initial": initial, "candidate_pool": pool, "resolution_control": control, "blocked_pool": blocked}
    units = F.array(*[F.struct(F.lit(k).alias("unit"), _largest_per_source(v).alias("images")) for k, v in kinds.items()])
    return cases.select("family_id", F.explode(units).alias("u")).select("family_id", "u.*")


def common_cohort(episodes: DataFrame, family: str, cells: Sequence[Column]) -> DataFrame:
    """Families with at least one row in every cell (model and arm).

    Each cell is one bit, so the test is a bitwise OR that combines before its shuffle; no distinct count is needed.
    Every 62 cells share a mask.
    """
    masks, full = [], F.lit(True)
    for at in range(0, len(cells), 62):
        some = cells[at : at + 62]
        bits = F.lit(0).cast("long")
        for i, cell in enumerate(some):
            bits = bits.bitwiseOR(F.when(cell, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        masks.append(F.bit_or(bits).alias(f"_mask{at}"))
        full = full & (F.col(f"_mask{at}") == (1 << len(some)) - 1)
    return episodes.groupBy(family).agg(*masks).filter(full).select(family)


def exclude_with_reason(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Every row with the first reason to exclude it, or null to keep it."""
    reason = None
    for code, rule in rules:
        reason = F.when(rule, code) if reason is None else reason.when(rule, code)
    return df.withColumn("reason", reason)


def frozen_group_problems(df: DataFrame, dev: DataFrame, key: str, group: str, digest: str) -> DataFrame:
    """What forbids excluding a development cohort: changed or unknown rows, and groups that it holds only in part."""
    now = df.select(key, F.col(digest).alias("_now"))
    rows = dev.join(now, key, "left").select(
        F.col(key).cast("string").alias("key"),
        F.when(F.col("_now").isNull(), "unknown_row").when(~F.col("_now").eqNullSafe(F.col(digest)), "changed_row").alias("problem"),
    ).filter("problem IS NOT NULL")
    held = dev.groupBy(group).agg(F.count("*").alias("_held"))
    whole = df.groupBy(group).agg(F.count("*").alias("_whole"))
    groups = held.join(whole, group).filter("_held < _whole").select(
        F.col(group).cast("string").alias("key"), F.lit("partial_group").alias("problem")
    )
    return rows.unionByName(groups)


def exclude_frozen_groups(df: DataFrame, dev: DataFrame, group: str) -> DataFrame:
    """Rows of all groups which the development cohort does not touch."""
    return df.join(dev.select(group).distinct(), group, "left_anti")


def cyclic_assign(df: DataFrame, bucket: Sequence[str], key: str, values: Sequence[str], seed: int, name: str) -> DataFrame:
    """The i-th row of a hash-shuffled bucket gets value ``i mod k``."""
    ranked = hash_ranked(df, bucket, stable_hash(F.col(key), str(seed)), "_rank", [key])
    pick = F.get(F.array(*[F.lit(v) for v in values]), ((F.col("_rank") - 1) % len(values)).cast("int"))
    return ranked.withColumn(name, pick).drop("_rank")


def select_study(
    states: DataFrame, controls: DataFrame, unknown: DataFrame, quotas: dict[str, int], seed: int
) -> DataFrame:
    """Rows ``(kind, category, member, partner)`` of a balanced study.

    ``states`` has category, criterion, positive flag and key; opposite labels pair up per criterion. ``controls`` has
    category, anchor, construction (positive or negative) and key; an anchor counts only with both. ``unknown`` has
    category and key. Each kind is drawn round-robin over categories up to its quota.
    """
    def draw(df: DataFrame, kind: str) -> DataFrame:
        digest = stable_hash(F.col("member"), str(seed))
        return round_robin(df, "category", digest, quotas[kind], ["member"]).select(
            F.lit(kind).alias("kind"), "category", "member", "partner"
        )
    pairs = balanced_pairs(states, ["category", "criterion"], F.col("positive"), "key", str(seed)).select(
        "category", F.col("positive").alias("member"), F.col("negative").alias("partner")
    )
    both = controls.groupBy("category", "anchor").agg(
        F.min(F.when(F.col("construction") == "positive", F.col("key"))).alias("member"),
        F.min(F.when(F.col("construction") == "negative", F.col("key"))).alias("partner"),
    ).filter("member IS NOT NULL AND partner IS NOT NULL").select("category", "member", "partner")
    lone = unknown.select("category", F.col("key").alias("member"), F.lit(None).cast("bigint").alias("partner"))
    return draw(pairs, "state").unionByName(draw(both, "identity")).unionByName(draw(lone, "unknown"))


def assign_tasks(
    families: DataFrame, task: str, source: str, key: str, arms: Sequence[str], repeats: int, people: int, seed: int
) -> DataFrame:
    """Every (family, arm, repeat) slot with a person.

    Families of a task are numbered with members of one source side by side, and a family's slots take consecutive
    people. Any ``people`` consecutive slots then go to different people, so one person meets a source at most once
    whenever that is possible, and arms rotate once per round, which balances them. Whether an input was feasible is
    for ``check_assignment`` to say.
    """
    width = len(arms) * repeats
    if people % width:
        raise ValueError("people must be a multiple of arms times repeats")
    ordered = families.withColumn("_source", stable_hash(F.col(source), str(seed))).withColumn(
        "_family", stable_hash(F.col(key), str(seed))
    )
    numbered = ordered_index(ordered, [task], ["_source", "_family"], "_rank")
    first = (F.col("_rank") - 1) * width
    slots = numbered.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    turn = (F.floor(F.col("_slot") / repeats) + F.floor(first / people)) % len(arms)
    return slots.withColumn("arm", F.get(F.array(*[F.lit(a) for a in arms]), turn.cast("int"))).withColumn(
        "repeat", (F.col("_slot") % repeats).cast("int")
    ).withColumn("person", ((first + F.col("_slot")) % people).cast("int")).drop("_source", "_family", "_rank", "_slot")


def mixture(sources: dict[str, DataFrame], n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows from each task's source with one shuffle key for all of them; sort by it to write the mixture."""
    parts = None
    for task, df in sources.items():
        salt = f"{seed}|{task}"
        part = first_per_group(df.withColumn("task", F.lit(task)), ["task"], stable_hash(F.col(key), salt), n, [key])
        part = part.withColumn("shuffle_key", stable_hash(F.col(key), salt + "|mix"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.drop("rank")


def keep_terminal(df: DataFrame, calls: str = "tool_calls") -> DataFrame:
    """Rows whose target is exactly one finish call."""
    return df.filter((F.size(calls) == 1) & (F.get(F.col(calls), F.lit(0))["name"] == "finish"))


def blind_projection(df: DataFrame, key: str, private: Sequence[str], images: str, salt: str, banned: str) -> DataFrame:
    """Opaque unit ids, private columns dropped, images in hash order; ``leaks`` marks rows with a banned token left."""
    unit = stable_hash(F.col(key), salt, 20)
    shuffled = F.transform(
        F.array_sort(F.transform(images, lambda i: F.struct(F.sha2(F.concat(unit, F.lit("|"), i), 256).alias("h"), i.alias("i")))),
        lambda s: F.substring(s["h"], 1, 20),
    )
    out = df.withColumn("unit_id", unit).withColumn(images, shuffled).drop(key, *private)
    return out.withColumn("leaks", F.to_json(F.struct(*out.columns)).rlike(banned))


def portable_projection(df: DataFrame, machine: Sequence[str], strings: Sequence[str]) -> DataFrame:
    """Rows without machine columns; ``problems`` lists path errors of any remaining string column."""
    codes = F.array_distinct(F.flatten(F.array(*[
        F.filter(path_errors(F.coalesce(F.col(s), F.lit("-"))), lambda c: c.isin("absolute", "drive", "parent", "backslash"))
        for s in strings
    ])))
    return df.drop(*machine).withColumn("problems", codes)


def shared_sequence_split(df: DataFrame, sequence: str, split: str) -> DataFrame:
    """Split of each sequence that appears in exactly one official split."""
    ends = df.groupBy(sequence).agg(F.min(split).alias("low"), F.max(split).alias("high"))
    return ends.filter(F.col("low") == F.col("high")).select(sequence, F.col("low").alias(split))


def training_cases(rows: DataFrame, references: DataFrame, category: str) -> DataFrame:
    """Nested cases from flat image rows and one reference per category."""
    def evidence(image: str, slot: str) -> Column:
        return F.struct(
            F.concat(F.lit("photo-"), F.substring(F.sha2(F.col(image), 256), 1, 20)).alias("id"), F.lit(slot).alias("object"),
            F.lit("capture").alias("time"), F.lit("original").alias("view"), F.col(image).alias("path"), F.lit(True).alias("available"),
        )
    label = F.when(F.col("label") == "anomaly", "Supported").otherwise("Refuted")
    full = rows.join(references.select(category, "reference"), category)
    full = full.withColumn("evidence", F.array(evidence("image", "target"), evidence("reference", "reference")))
    cite = F.struct(F.col("evidence")[0]["id"].alias("image_id"), F.col("box").alias("bbox"), F.lit("capture").alias("time"))
    return full.select(
        F.concat(F.lit("fam-"), F.substring(F.sha2("image", 256), 1, 20)).alias("family_id"), category, label.alias("verdict"),
        "evidence", F.transform("evidence", lambda e: e["id"]).alias("initial"),
        F.create_map(label, F.array(F.array(cite))).alias("minimal_evidence_sets"),
    )


def select_cohort(
    cases: DataFrame, plan: DataFrame, cohort: DataFrame, variants: Sequence[str], pilot: int | None = None
) -> DataFrame:
    """Cases of the cohort's families in the wanted variants, with their order keys; a pilot keeps the smallest ids per task.

    Cohort families outside the plan drop out here and are listed by ``cohort_problems``.
    """
    wanted = cohort.select("family_id").join(plan.select("family_id"), "family_id", "left_semi")
    rank = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("variant"))
    chosen = cases.filter(F.col("variant").isin(*variants)).join(wanted, "family_id", "left_semi")
    if pilot is not None:
        families = chosen.filter(F.col("variant") == variants[0]).select("task", "family_id")
        few = ordered_index(families.distinct(), ["task"], ["family_id"], "_n").filter(F.col("_n") <= pilot).select("family_id")
        chosen = chosen.join(few, "family_id", "left_semi")
    return chosen.withColumn("variant_order", rank.cast("int"))


def cohort_problems(cases: DataFrame, plan: DataFrame, cohort: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Cohort families outside the plan, and family and variant cells that do not hold exactly one case."""
    outside = cohort.select("family_id").join(plan.select("family_id"), "family_id", "left_anti").select(
        "family_id", F.lit("outside_plan").alias("problem")
    )
    grid = cohort.select("family_id", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))
    counts = cases.groupBy("family_id", "variant").agg(F.count("*").alias("n"))
    cells = grid.join(counts, ["family_id", "variant"], "left").filter("n IS NULL OR n > 1").select(
        "family_id", F.concat(F.when(F.col("n").isNull(), "missing_").otherwise("repeated_"), F.col("variant")).alias("problem")
    )
    return outside.unionByName(cells)
