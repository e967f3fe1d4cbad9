"""Finite-world identifiability over a long table ``worlds(bank, world_id, label, target, view, sig, meta)``.

A bank has 48 worlds, so any set of its worlds is one 64-bit mask. The worlds that show a signature in a view
become a mask once; what a history leaves possible is then a bitwise AND, and no history ever meets single worlds.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.evidence import REFUTED, SUPPORTED, UNDECIDED
from ..functions.hashing import digest_int, stable_hash
from ..functions.text import strip_variant
from ..session import materialize
from ..skew import among, let, ordered_index, shuffled, spread

# Views of a bank.
INITIAL_VIEWS = ("reference", "initial")
REAR_VIEWS = ("rear_left", "rear_center", "rear_right")
REQUEST_VIEWS = ("original", "front_survey", *REAR_VIEWS)
VIEWS = (*INITIAL_VIEWS, *REQUEST_VIEWS)

ORDERS = list(permutations(range(3)))
WORLDS = len(ORDERS) * 8
TARGET_SLOTS = [order.index(0) for order in ORDERS]


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def world_grid(banks: DataFrame, bank: str) -> DataFrame:
    """All orders of three objects times all states of three slots, per bank, with label and useful rear view."""
    grid = spread(banks.select(F.col(bank).alias("bank")), "bank").select("bank", F.explode(F.sequence(F.lit(0), F.lit(WORLDS - 1))).alias("world_id"))
    order, states = F.floor(F.col("world_id") / 8).cast("int"), F.col("world_id") % 8
    slot = _pick(TARGET_SLOTS, order)
    hit = F.shiftright(states, 0).bitwiseAND(_pick([1, 2, 4], slot)) > 0
    return grid.select(
        "bank", "world_id", order.alias("permutation"), states.cast("int").alias("states"), F.when(hit, SUPPORTED).otherwise(REFUTED).alias("label"),
        _pick(list(REAR_VIEWS), slot).alias("target"),
    )


def grid_problems(worlds: DataFrame) -> DataFrame:
    """Banks without exactly the full grid of worlds and views."""
    per = worlds.groupBy("bank", "world_id").agg(F.count("*").alias("_rows"), F.count_distinct("view").alias("_views"))
    banks = per.groupBy("bank").agg(F.count("*").alias("_worlds"), F.min("_views").alias("_few"), F.max("_rows").alias("_many"))
    codes = F.array_compact(F.array(
        F.when(F.col("_worlds") != WORLDS, "wrong_world_count"), F.when(F.col("_few") < len(VIEWS), "missing_view"),
        F.when(F.col("_many") > len(VIEWS), "repeated_view"),
    ))
    return banks.select("bank", F.explode(codes).alias("rule"))


def _bit(world: Column) -> Column:
    """The bit of a world; an id outside the grid would fall on another world's bit and is an error."""
    known = F.when((world >= 0) & (world < WORLDS), world.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("world id outside the grid: "), world.cast("string"))).cast("int")
    )
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), known)


def world_masks(worlds: DataFrame) -> DataFrame:
    """Mask of the worlds that show each signature in each view of a bank."""
    return worlds.groupBy("bank", "view", "sig").agg(F.bit_or(_bit(F.col("world_id"))).alias("mask"))


def label_masks(worlds: DataFrame) -> DataFrame:
    """Mask of all worlds and of the supported worlds of each bank."""
    supported = F.when(F.col("label") == SUPPORTED, _bit(F.col("world_id"))).otherwise(F.lit(0).cast("bigint"))
    return worlds.groupBy("bank").agg(F.bit_or(_bit(F.col("world_id"))).alias("all_worlds"), F.bit_or(supported).alias("supported"))


def verdict_of(mask: Column, supported: Column) -> Column:
    """The single label left by a mask, or undecided; null when no world is left."""
    yes, no = mask.bitwiseAND(supported), mask.bitwiseAND(F.bitwise_not(supported))
    return F.when(mask == 0, None).when(no == 0, SUPPORTED).when(yes == 0, REFUTED).otherwise(UNDECIDED)


def compatible_worlds(history: DataFrame, worlds: DataFrame, keys: list[str]) -> DataFrame:
    """Per history (keys, bank, view, sig): how many worlds fit every observation and what they agree on.

    An observation that no world shows leaves no world.
    """
    seen = history.join(shuffled(world_masks(worlds)), ["bank", "view", "sig"], "left")
    left = seen.groupBy(*keys, "bank").agg(F.bit_and(F.coalesce("mask", F.lit(0).cast("bigint"))).alias("mask"))
    joined = left.join(shuffled(label_masks(worlds)), "bank")
    verdict = verdict_of(F.col("mask"), F.col("supported"))
    return joined.select(
        *keys, "bank", "mask", F.bit_count("mask").alias("worlds"), verdict.alias("verdict"),
        F.coalesce(verdict != UNDECIDED, F.lit(False)).alias("identified"),
    )


def world_views(worlds: DataFrame) -> DataFrame:
    """Per actual world: the mask left by each single view, by view name, its signatures (``_sigs``), and the bank's label masks."""
    bit = _bit(F.col("world_id"))
    supported = F.when(F.col("label") == SUPPORTED, bit).otherwise(F.lit(0).cast("bigint"))
    bank, alike = W.partitionBy("bank"), W.partitionBy("bank", "view", "sig")
    # A bank's rows meet in one task, so masks are windows over its few rows and nothing is joined.
    rows = spread(worlds.select("bank", "world_id", "label", "target", "view", "sig").distinct(), "bank").select(
        "*", F.bit_or(bit).over(bank).alias("all_worlds"), F.bit_or(supported).over(bank).alias("supported"), F.bit_or(bit).over(alike).alias("mask")
    ).filter("bank IS NOT NULL AND view IS NOT NULL AND sig IS NOT NULL")
    columns = [F.max(F.when(F.col("view") == v, F.col("mask"))).alias(v) for v in VIEWS]
    shown = [c for v in VIEWS for c in (F.lit(v), F.max(F.when(F.col("view") == v, F.col("sig"))))]
    columns.append(F.create_map(*shown).alias("_sigs"))
    columns += [F.max(c).alias(c) for c in ("all_worlds", "supported")]
    return rows.groupBy("bank", "world_id", "label", "target").agg(*columns)


def _view_bits(views: Column) -> Column:
    """One bit per request view in an array of views."""
    bits = F.lit(0)
    for i, view in enumerate(REQUEST_VIEWS):
        bits = bits + F.when(F.array_contains(views, view), 1 << i).otherwise(0)
    return bits


def min_requests(views: DataFrame, available: Column | None = None, initial: Column | None = None) -> DataFrame:
    """Smallest number of extra views after which one label is left, per actual world; null when none suffices.

    ``views`` is the output of ``world_views``, perhaps with columns for ``available`` (array of request views that exist) and
    ``initial`` (array of the views a case starts with, which cost no request). A choice of views is a number of five bits.
    """
    views = views.withColumn("_have", F.lit(31) if available is None else _view_bits(available))
    views = views.withColumn("_free", F.lit(0) if initial is None else _view_bits(initial))
    start = F.col(INITIAL_VIEWS[0]).bitwiseAND(F.col(INITIAL_VIEWS[1]))
    for i, view in enumerate(REQUEST_VIEWS):
        start = start.bitwiseAND(F.when(F.col("_free").bitwiseAND(F.lit(1 << i)) != 0, F.col(view)).otherwise(F.lit(-1).cast("long")))
    views, sizes = views.withColumn("_start", start), []
    for choice in range(1 << len(REQUEST_VIEWS)):
        mask = F.col("_start")
        for i, view in enumerate(REQUEST_VIEWS):
            mask = mask.bitwiseAND(F.col(view)) if choice >> i & 1 else mask
        extra = F.lit(choice).bitwiseAND(F.bitwise_not("_free"))
        ready = (extra.bitwiseAND(F.bitwise_not("_have")) == 0) & (verdict_of(mask, F.col("supported")) != UNDECIDED)
        sizes.append(F.when(ready, F.bit_count(extra)))
    return views.withColumn("min_requests", F.least(*sizes)).drop("_have", "_free", "_start")


def certify_bank(worlds: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """Rules that a bank breaks: worlds or views missing or repeated, leaks in metadata or views, states seen in the wrong
    place, and requests that decide too early or too late. A bank without any row here needs two requests for every world.

    ``wide`` is the output of ``world_views`` where a caller has it already."""
    def broken(grouped: DataFrame, rule: str) -> DataFrame:
        return grouped.select("bank", F.lit(rule).alias("rule")).distinct()

    def varies(c: str) -> Column:
        return F.min(c) != F.max(c)

    order, states = F.floor(F.col("world_id") / 8), F.col("world_id") % 8
    meta = worlds.groupBy("bank", "view").agg(varies("meta").alias("bad")).filter("bad")
    still = worlds.filter(F.col("view").isin(*INITIAL_VIEWS, "original")).groupBy("bank", "view").agg(varies("sig").alias("bad")).filter("bad")
    front = worlds.filter("view = 'front_survey'").groupBy("bank", order.alias("order")).agg(varies("sig").alias("bad"), F.min("sig").alias("sig"))
    mixed = front.groupBy("bank").agg(F.bool_or("bad").alias("bad"), F.count_distinct("sig").alias("n")).filter(F.col("bad") | (F.col("n") != len(ORDERS)))
    slot = F.array_position(F.array(*[F.lit(v) for v in REAR_VIEWS]), F.col("view")) - 1
    bit = states.bitwiseAND(_pick([1, 2, 4], slot)) > 0
    rear = worlds.filter(F.col("view").isin(*REAR_VIEWS)).groupBy("bank", "view", bit.alias("state")).agg(varies("sig").alias("bad"), F.min("sig").alias("sig"))
    sided = rear.groupBy("bank", "view").agg(F.bool_or("bad").alias("bad"), varies("sig").alias("differs")).filter(F.col("bad") | ~F.col("differs"))

    wide = world_views(worlds) if wide is None else wide
    initial = F.col("reference").bitwiseAND(F.col("initial"))
    def decided(mask: Column) -> Column:
        return F.coalesce(verdict_of(mask, F.col("supported")) != UNDECIDED, F.lit(True))
    single = F.lit(False)
    for v in REQUEST_VIEWS:
        single = single | decided(initial.bitwiseAND(F.col(v)))
    after_front = initial.bitwiseAND(F.col("front_survey"))
    useful = F.array_compact(F.array(*[F.when(decided(after_front.bitwiseAND(F.col(v))), v) for v in REQUEST_VIEWS]))
    tests = wide.select("bank", decided(initial).alias("early"), single.alias("single"), (useful != F.array("target")).alias("useless"))
    summary = tests.groupBy("bank").agg(*[F.bool_or(c).alias(c) for c in ("early", "single", "useless")])
    rules = {"early": "initial_identifies", "single": "single_request_identifies", "useless": "second_view_is_not_target"}
    flags = F.array_compact(F.array(*[F.when(F.col(c), name) for c, name in rules.items()]))
    out = summary.select("bank", F.explode(flags).alias("rule"))
    for grouped, rule in ((meta, "metadata_leak"), (still, "static_view_varies"), (mixed, "front_view_leak"), (sided, "rear_view_leak")):
        out = out.unionByName(broken(grouped, rule))
    return out.unionByName(grid_problems(worlds))


def fixed_view_rate(worlds: DataFrame) -> DataFrame:
    """Share of worlds identified by each fixed pair of request views, and the best pair, per bank."""
    initial = F.col("reference").bitwiseAND(F.col("initial"))
    pairs = F.array(*[
        F.struct(F.lit(f"{a}+{b}").alias("pair"), (verdict_of(initial.bitwiseAND(F.col(a)).bitwiseAND(F.col(b)), F.col("supported")) != UNDECIDED).alias("hit"))
        for a, b in combinations(REQUEST_VIEWS, 2)
    ])
    rates = world_views(worlds).select("bank", F.explode(pairs).alias("p")).groupBy("bank", F.col("p.pair").alias("pair")).agg(
        F.avg(F.when(F.col("p.hit"), 1.0).otherwise(0.0)).alias("rate")
    )
    return rates.withColumn("is_best", F.col("rate") == F.max("rate").over(W.partitionBy("bank")))


def paired_world_cases(banks: DataFrame, bank: str, seed: int) -> DataFrame:
    """One positive and one negative member per bank: the pair of slots cycles, orientation alternates, states are hashed."""
    indexed = ordered_index(banks.select(F.col(bank).alias("bank")), [], ["bank"], "_n").withColumn("_i", F.col("_n") - 1)
    digest = stable_hash(F.col("bank"), str(seed))
    pairs = list(combinations(range(3), 2))
    chosen = (F.col("_i") % 3).cast("int")
    rows = indexed.withColumn("_d", digest).withColumn("_left", _pick([p[0] for p in pairs], chosen)).withColumn("_right", _pick([p[1] for p in pairs], chosen))
    turn = F.col("_i") % 2

    def state(slot: int) -> Column:
        free = digest_int(F.col("_d"), 1 + slot, 1) % 2
        return F.when(F.col("_left") == slot, turn).when(F.col("_right") == slot, 1 - turn).otherwise(free)

    states = state(0) + 2 * state(1) + 4 * state(2)
    members = rows.withColumn("states", states.cast("int")).withColumn("member", F.explode(F.array(F.lit(0), F.lit(1))))
    position = F.when(F.col("member") == 0, F.col("_left")).otherwise(F.col("_right"))
    orders = [[i for i, s in enumerate(TARGET_SLOTS) if s == slot] for slot in range(3)]
    which = (digest_int(F.col("_d"), 10, 8) + F.col("member")) % 2
    order = F.when(which == 0, _pick([o[0] for o in orders], position)).otherwise(_pick([o[1] for o in orders], position))
    hit = F.col("states").bitwiseAND(_pick([1, 2, 4], position)) > 0
    return members.select(
        "bank", "member", (order * 8 + F.col("states")).cast("int").alias("world_id"), F.when(hit, SUPPORTED).otherwise(REFUTED).alias("label"),
        _pick(list(REAR_VIEWS), position).alias("target"),
    )


# ---------------------------------------------------------------- request schedules

REQUEST = "struct<object:string,time:string,view:string>"


def request_product(views: Column) -> Column:
    """All requests a case offers, by object, time and view."""
    options = F.col("request_options")
    return F.flatten(F.flatten(F.transform(F.array_distinct(options["objects"]), lambda o: F.transform(
        F.array_distinct(options["times"]),
        lambda t: F.transform(F.array_distinct(views), lambda v: F.struct(o.alias("object"), t.alias("time"), v.alias("view"))),
    ))))


def guided_calls(targets: Column, budget: Column, price: int, max_turns: int) -> Column:
    """The shortest public requests that release some target image set, empty where none can be reached or one is held.

    A request releases its smallest image not yet shown, so a set fixes how often each request is needed, and the requests of
    a set are made in the order in which the case offers them. Of equally short ways the one that is first in that order wins,
    which is the way a breadth-first search over released sets finds. Row columns: evidence, initial, request_options.
    """
    def ways(bound: Column) -> Column:
        product, released = bound["product"], bound["fresh"]

        def nth(e: Column) -> Column:
            return F.array_position(product, F.struct(e["object"].alias("object"), e["time"].alias("time"), e["view"].alias("view"))).cast("int")

        # Places in the product are looked up once per image, not for every pair of images.
        numbered = F.transform(released, lambda e: F.struct(e["id"].alias("id"), nth(e).alias("nth")))
        placed = let(numbered, lambda rows: F.transform(rows, lambda e: F.struct(
            e["id"].alias("id"), e["nth"].alias("nth"), F.size(F.filter(rows, lambda o: (o["nth"] == e["nth"]) & (o["id"] <= e["id"]))).alias("place")
        )))

        def way(images: Column, rows: Column) -> Column:
            needed = F.array_except(images, F.col("initial"))
            hits = F.filter(rows, lambda r: among(r["id"], needed))
            calls = F.flatten(F.transform(F.array_sort(F.array_distinct(F.transform(hits, lambda r: r["nth"]))), lambda n: F.array_repeat(
                n, F.array_max(F.transform(F.filter(hits, lambda r: r["nth"] == n), lambda r: r["place"]))
            )))
            return F.when(F.size(hits) == F.size(needed), F.struct(F.size(calls).alias("size"), calls.alias("calls")))

        return let(placed, lambda rows: F.transform(
            F.coalesce(
                F.array_min(F.filter(F.transform(F.filter(targets, lambda t: F.size(t) > 0), lambda t: way(t, rows)), lambda w: w["size"] <= depth))["calls"],
                F.array().cast("array<int>"),
            ), lambda n: F.get(product, n - 1),
        ))

    depth = F.least(F.floor(budget / price), F.lit(max_turns - 1)).cast("int")
    options = F.col("request_options")
    fresh = F.filter(
        "evidence",
        lambda e: e["available"] & e["id"].isNotNull() & ~among(e["id"], F.col("initial")) & among(e["object"], options["objects"])
        & among(e["time"], options["times"]) & among(e["view"], options["views"]),
    )
    return let(F.struct(request_product(options["views"]).alias("product"), fresh.alias("fresh")), ways)


def request_schedule(
    cases: DataFrame, policy: str, seed: int, keys: list[str], targets: Column | None = None, budget: int = 0, price: int = 1, max_turns: int = 1
) -> DataFrame:
    """Planned requests in order. ``cases`` has request_options, evidence, initial and case_id.

    fixed_order is the product of objects, times and views; fixed_original asks for originals only; random_order sorts
    the product by a hash that all variants of a family share; restore_preview asks for the original of every shown
    image whose display is smaller than its source, or for its camera's view where originals are not offered;
    annotation_guided is privileged: it knows the image sets that decide the case (``targets``) and takes ``guided_calls``.
    """
    options = F.col("request_options")
    views = options["views"] if policy != "fixed_original" else F.filter(options["views"], lambda v: v == "original")
    product = request_product(views)
    if policy in ("fixed_order", "fixed_original"):
        calls = product
    elif policy == "random_order":
        def key(c: Column) -> Column:
            return F.sha2(F.concat_ws("|", F.lit(str(seed)), strip_variant(F.col("case_id")), c["object"], c["time"], c["view"]), 256)
        calls = F.transform(F.array_sort(F.transform(product, lambda c: F.struct(key(c).alias("h"), c.alias("c")))), lambda s: s["c"])
    elif policy == "restore_preview":
        def reduced(e: Column) -> Column:
            box = e["source_bbox"]
            return F.array_contains("initial", e["id"]) & (e["display_size"][0] * e["display_size"][1] < (box[2] - box[0]) * (box[3] - box[1]))
        def asked(e: Column) -> Column:
            view = F.when(F.array_contains(options["views"], "original"), "original").otherwise(e["camera_view"])
            return F.struct(e["object"].alias("object"), e["time"].alias("time"), view.alias("view"))
        wanted = F.transform(F.filter("evidence", reduced), asked)
        public = F.filter(wanted, lambda c: F.array_contains(options["objects"], c["object"]) & F.array_contains(options["times"], c["time"]) & F.array_contains(options["views"], c["view"]))
        calls = F.array_distinct(public)
    elif policy == "annotation_guided":
        calls = guided_calls(targets, F.lit(budget), price, max_turns)
    else:
        raise ValueError(f"unknown policy {policy}")
    return cases.select(*keys, F.posexplode(calls).alias("ordinal", "c")).select(*keys, "ordinal", "c.*")


def cheapest_set(targets: Column) -> Column:
    """Struct(requests, images) of the cheapest way to hold some target image set, null where no set can be held.

    A query names object, time and view, and each request of it releases its smallest image not yet shown. To hold an
    image, a query is needed as often as the image's place among its unreleased matches; a set costs the largest such
    place per query. No search over released sets is needed. Row columns: evidence, initial, request_options.
    """
    def query_of(e: Column) -> Column:
        return F.concat_ws("|", e["object"], e["time"], e["view"])

    options = F.col("request_options")
    fresh = F.filter(
        "evidence",
        lambda e: e["available"] & e["id"].isNotNull() & ~among(e["id"], F.col("initial")) & among(e["object"], options["objects"])
        & among(e["time"], options["times"]) & among(e["view"], options["views"]),
    )
    # Images are sought and their queries named once, not for every pair of images.
    named = F.transform(fresh, lambda e: F.struct(e["id"].alias("id"), query_of(e).alias("q")))
    placed = let(named, lambda rows: F.transform(rows, lambda e: F.struct(
        e["id"].alias("id"), e["q"].alias("q"), F.size(F.filter(rows, lambda o: (o["q"] == e["q"]) & (o["id"] <= e["id"]))).alias("place")
    )))

    def plan(rows: Column) -> Column:
        def cost(images: Column) -> Column:
            needed = F.array_except(images, F.col("initial"))
            hits = F.filter(rows, lambda r: among(r["id"], needed))
            queries = F.array_distinct(F.transform(hits, lambda r: r["q"]))
            per_query = F.transform(queries, lambda q: F.array_max(F.transform(F.filter(hits, lambda r: r["q"] == q), lambda r: r["place"])))
            total = F.aggregate(per_query, F.lit(0), lambda a, v: a + v)
            return F.when(F.size(hits) == F.size(needed), F.struct(total.alias("requests"), F.array_sort(images).alias("images")))
        usable = F.filter(targets, lambda t: F.size(t) > 0)
        return F.array_min(F.array_compact(F.transform(usable, cost)))

    return let(placed, plan)


def within_budget(best: Column, budget: Column, price: int, max_turns: int) -> Column:
    """Struct(reachable, requests, images) of a cheapest set under a budget."""
    depth = F.least(F.floor(budget / price), F.lit(max_turns - 1)).cast("int")
    within = F.coalesce(best["requests"] <= depth, F.lit(False))
    return F.struct(within.alias("reachable"), F.when(within, best["requests"]).alias("requests"), F.when(within, best["images"]).alias("images"))


def shortest_requests(targets: Column, budget: Column, price: int, max_turns: int) -> Column:
    """Struct(reachable, requests, images) of the cheapest way to hold some target image set."""
    return let(cheapest_set(targets), lambda best: within_budget(best, budget, price, max_turns))


def schedule_audit(cases: DataFrame, targets: Column, budgets: list[int], by: list[str], price: int, max_turns: int) -> DataFrame:
    """Per budget: cases whose annotated image set is reachable, and the requests that takes."""
    # A case's cheapest set is the same under every budget, so it is worked out once.
    def plans(best: Column) -> Column:
        return F.array(*[F.struct(F.lit(b).alias("budget"), within_budget(best, F.lit(b), price, max_turns).alias("plan")) for b in budgets])
    rows = cases.select(*by, F.explode(let(cheapest_set(targets), plans)).alias("p"))
    return rows.groupBy(*by, F.col("p.budget").alias("budget")).agg(
        F.count("*").alias("cases"), F.count_if("p.plan.reachable").alias("reachable"), F.sum("p.plan.requests").alias("requests"), F.max("p.plan.requests").alias("most_requests")
    )


def schedules_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per case: whether two policies issue the same calls in the same order."""
    def calls(df: DataFrame, name: str) -> DataFrame:
        # A schedule has at most one row per public option, so a case's list is small by construction.
        listed = F.array_sort(F.collect_list(F.struct("ordinal", "object", "time", "view")))
        return df.groupBy(*keys).agg(listed.alias(name))
    joined = calls(a, "_a").join(calls(b, "_b"), keys, "full_outer")
    return joined.select(*keys, F.col("_a").eqNullSafe(F.col("_b")).alias("equal_calls"))


# ---------------------------------------------------------------- scoring

# Share of the diagnostic region that citations must cover.
COVERAGE = {"defect": 0.5, "panel": 0.9}


def score_search(episodes: DataFrame, worlds: DataFrame, keys: list[str]) -> DataFrame:
    """Full scoring of search episodes; a failed audit keeps the row with every score false.

    ``episodes`` has the keys, bank, world_id, ``cap`` (requests allowed), ``available_views`` (array of request views that
    exist for the case, null for all), observed (array of view and sig), verdict (null without a finish), citations_valid,
    links_complete, coverage (share of the diagnostic region) and localized. Optional are ``initial_views`` (views that the case starts
    with, null for the usual ones; they cost no request and must all be observed) and, inside an observation, ``metadata`` with
    ``metadata_sha256`` (checked), and ``derived`` with ``image_id`` (a derived view shows no new one; the image it comes from must be among the others).
    """
    wide = materialize(world_views(worlds), "world-views")
    broken = certify_bank(worlds, wide).select("bank").distinct().withColumn("_broken", F.lit(True))
    every, usual = F.array(*[F.lit(v) for v in REQUEST_VIEWS]), F.array(*[F.lit(v) for v in INITIAL_VIEWS])
    started = F.coalesce("initial_views", usual) if "initial_views" in episodes.columns else usual
    asked = episodes.withColumn("_available", F.array_sort(F.coalesce("available_views", every))).withColumn("_initial", F.array_sort(started))
    # Cases of one world with the same views available and seen at the start share their facts.
    kind = ["bank", "world_id", "_available", "_initial"]
    kinds = asked.select(*kind).distinct()
    facts = min_requests(kinds.join(shuffled(wide), ["bank", "world_id"]), F.col("_available"), F.col("_initial")).join(shuffled(broken), "bank", "left")
    joined = asked.join(shuffled(facts), kind, "left")
    fields = episodes.schema["observed"].dataType.elementType.names
    shown, sound, rooted = F.col("observed"), F.lit(True), F.lit(True)
    if "metadata_sha256" in fields:
        sound = F.forall("observed", lambda o: F.coalesce(F.sha2(o["metadata"], 256) == o["metadata_sha256"], F.lit(False)))
    if "derived" in fields:
        shown = F.filter("observed", lambda o: ~F.coalesce(o["derived"], F.lit(False)))
        derived = F.filter("observed", lambda o: F.coalesce(o["derived"], F.lit(False)))
        rooted = F.size(F.array_except(F.transform(derived, lambda o: o["image_id"]), F.transform(shown, lambda o: o["image_id"]))) == 0
    joined = joined.withColumn("_shown", shown).withColumn("_views", F.array_distinct(F.transform("_shown", lambda o: o["view"])))
    views = F.col("_views")
    acquired = F.array_except(views, "_initial")
    initial_seen = F.size(F.array_except("_initial", views)) == 0
    extra = F.array_except("_initial", usual)
    initial_valid = (F.size(F.array_except(usual, "_initial")) == 0) & (F.size(F.array_except(extra, "_available")) == 0)
    true_sigs = F.forall("_shown", lambda o: F.coalesce(F.try_element_at("_sigs", o["view"]) == o["sig"], F.lit(False)))
    # What is observed is what the actual world shows, so its own masks say which worlds are left.
    left = F.col("all_worlds")
    for v in VIEWS:
        left = left.bitwiseAND(F.when(F.array_contains(views, v), F.coalesce(F.col(v), F.lit(0).cast("long"))).otherwise(F.lit(-1).cast("long")))
    cap = F.col("cap")
    error = (
        F.when(F.col("label").isNull(), "unknown_world").when(F.col("_broken"), "bank_not_certified").when(~initial_valid, "invalid_initial")
        .when(~sound, "metadata_checksum").when(~true_sigs, "observation_mismatch")
        .when(F.size(F.array_except(acquired, "_available")) > 0, "unavailable_observation")
        .when(~initial_seen, "initial_missing").when(~rooted, "derived_without_parent").when(F.size(acquired) > cap, "too_many_requests")
    )
    base = joined.withColumn("_left", left).withColumn("_acquired", F.size(acquired)).withColumn("audit_error", error)
    base = base.withColumn("_ok", F.col("audit_error").isNull()).withColumn("_current", verdict_of(F.col("_left"), F.col("supported")))
    base = base.withColumn("_expected", F.when(F.coalesce(F.col("min_requests") <= cap, F.lit(False)), F.col("label")).otherwise(UNDECIDED))
    ok, verdict = F.col("_ok"), F.col("verdict")
    finished = ok & verdict.isNotNull()
    cited = finished & F.col("citations_valid")
    enough = ok & (F.col("_current") != UNDECIDED)
    target = cited & (verdict == F.col("_expected"))
    definite = verdict != UNDECIDED
    limit = F.when(F.col("label") == SUPPORTED, COVERAGE["defect"]).otherwise(COVERAGE["panel"])
    chain = target & F.when(definite, enough & F.col("links_complete") & (F.col("coverage") >= limit)).otherwise(True)
    strict = chain & (F.col("localized") | ~definite)
    flags = {
        "schema_valid_finish": finished, "source_label_correct": cited & (verdict == F.col("label")), "episode_target_correct": target,
        "decision_matches_current_evidence": cited & (verdict == F.col("_current")), "evidence_found": enough, "chain_grounded_correct": chain,
        "localized_grounded_correct": strict, "unlocalized_definite": chain & definite & ~strict,
        "unsupported_decision": finished & definite & ~F.coalesce(chain, F.lit(False)),
    }
    return base.select(
        *keys, "audit_error", F.when(ok, F.bit_count("_left")).alias("compatible_worlds"), F.when(ok, F.col("_acquired").cast("bigint")).alias("acquired"),
        *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()],
    )
