"""Trace analytics over messages in long form ``(episode, pos, role, name, call_id, image, status)``.

An episode may be arbitrarily long, so nothing here gathers one: first occurrences are minima joined back, orders are
distributed ranks, and ordered replays compose finite-state steps.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.actions import action_price
from ..functions.hashing import row_digest
from ..functions.text import strict_json
from ..schemas import PART
from ..session import materialize
from ..skew import composed_log, let, multiset_digest, ordered_index, replay_states, running_total


def explode_messages(traces: DataFrame, keys: list[str], messages: str = "messages") -> DataFrame:
    """One row per message with its position."""
    return traces.select(*keys, F.posexplode(messages).alias("pos", "message"))


def content_parts(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per content part of a message whose content is plain text or a JSON array of parts.

    Text that is no JSON array of objects is one text part.
    """
    parsed = strict_json(F.col(content))
    is_list = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY<OBJECT"), F.lit(False))
    plain = F.array(F.struct(
        F.lit("text").alias("type"), F.col(content).alias("text"), F.lit(None).cast("string").alias("image_ref")
    ))
    parts = F.when(is_list, F.from_json(content, f"array<{PART}>")).otherwise(plain)
    return df.select(*keys, F.posexplode(parts).alias("part", "p")).select(*keys, "part", "p.*")


def call_responses(messages: DataFrame) -> DataFrame:
    """Tool responses with the call they answer: the last definition of their call id before them in the episode.

    A response without such a call keeps nulls. Id, name and arguments (JSON text) of a call are in its own row; the status
    of a response is read from its JSON text.
    """
    calls = F.when(F.col("role") == "assistant", F.struct("pos", "name", "arguments"))
    before = W.partitionBy("episode", "call_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    known = messages.filter("role IN ('assistant', 'tool') AND call_id IS NOT NULL")
    answered = known.withColumn("_call", F.last(calls, ignorenulls=True).over(before))
    # Responses without an id answer nothing and need no window.
    alone = messages.filter("role = 'tool' AND call_id IS NULL").withColumn("_call", F.lit(None).cast(answered.schema["_call"].dataType))
    return answered.filter("role = 'tool'").unionByName(alone).select(
        "episode", "pos", "call_id", "name", json_field("text", "$.status").alias("status"), "image",
        F.col("_call.pos").alias("call_pos"), F.col("_call.name").alias("call_name"), F.col("_call.arguments").alias("call_arguments"),
    )


def json_field(text: str, path: str) -> Column:
    """A field of a JSON object in a text column; null for other texts."""
    return F.try_variant_get(strict_json(F.col(text)), path, "string")


def answered_requests(messages: DataFrame, action: str) -> DataFrame:
    """Responses to one action, by the call they answer or by their own name."""
    return call_responses(messages).filter((F.col("call_name") == action) | (F.col("name") == action))


def image_novelty(parts: DataFrame, fingerprint: str = "image") -> DataFrame:
    """Per message that shows images: how many, how many never shown in an earlier message, and whether none is new."""
    shown = parts.filter(F.col(fingerprint).isNotNull()).select("episode", "pos", fingerprint).distinct()
    first = parts.filter(F.col(fingerprint).isNotNull()).groupBy("episode", fingerprint).agg(F.min("pos").alias("_first"))
    return (
        shown.join(first, ["episode", fingerprint]).groupBy("episode", "pos")
        .agg(F.count("*").alias("returned"), F.count_if(F.col("pos") == F.col("_first")).alias("novel"))
        .withColumn("repeated_only", F.col("novel") == 0)
    )


def request_records(messages: DataFrame, action: str = "request_photo") -> DataFrame:
    """Per response to a photo request: status, view asked for (``query.view`` of the call's arguments), images returned and new."""
    requests = answered_requests(messages, action)
    novelty = image_novelty(messages)
    joined = requests.join(novelty, ["episode", "pos"], "left")
    return joined.select(
        "episode", "pos", "status", json_field("call_arguments", "$.query.view").alias("view"),
        F.coalesce("returned", F.lit(0)).alias("returned"), F.coalesce("novel", F.lit(0)).alias("novel"),
        F.coalesce("repeated_only", F.lit(False)).alias("repeated_only"),
    )


def action_sequence(messages: DataFrame) -> DataFrame:
    """Ordinal of each action of an episode, with the running episode's finish flag."""
    calls = messages.filter("role = 'assistant' AND name IS NOT NULL").select("episode", "pos", "name")
    return ordered_index(calls, ["episode"], ["pos"], "ordinal").select(
        "episode", "ordinal", "name", (F.col("name") == "finish").alias("is_finish")
    )


def tool_errors(messages: DataFrame, text: str = "text") -> DataFrame:
    """Counts per episode and error code found in JSON lines of tool responses, plus format corrections."""
    lines = (
        messages.filter("role = 'tool'").select("episode", F.explode(F.split(text, "\n")).alias("line"))
        .select("episode", F.try_variant_get(strict_json(F.col("line")), "$.error", "string").alias("code"))
        .filter("code IS NOT NULL")
    )
    corrections = messages.filter((F.col("role") == "user") & F.col(text).startswith("Invalid tool format.")).select(
        "episode", F.lit("format_correction").alias("code")
    )
    return lines.unionByName(corrections).groupBy("episode", "code").agg(F.count("*").alias("n"))


def initial_prompt(messages: DataFrame, keys: list[str], pos: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Digest and length of the messages before the first assistant message; the whole trace when it has none."""
    first = messages.filter(F.col(role) == "assistant").groupBy(*keys).agg(F.min(pos).alias("_first"))
    prefix = messages.join(first, keys, "left").filter(F.col("_first").isNull() | (F.col(pos) < F.col("_first")))
    digest = row_digest(F.col(pos), F.col(role), F.col(text))
    return multiset_digest(prefix.withColumn("_row", digest), keys, F.col("_row"), "prompt_digest")


def prefix_parity(prompts: DataFrame, pair: str, side: str) -> DataFrame:
    """Pairs whose two sides do not share the same initial prompt, and pairs with a missing side."""
    counted = prompts.groupBy(pair).agg(
        F.count("*").alias("sides"), F.min("prompt_digest").alias("low"), F.max("prompt_digest").alias("high")
    )
    reason = F.when(F.col("sides") != 2, "missing_side").when(F.col("low") != F.col("high"), "different_prompt")
    return counted.select(pair, reason.alias("reason")).filter("reason IS NOT NULL")


def first_success_prefix(messages: DataFrame) -> DataFrame:
    """Messages up to the first request that was provided and showed a new image."""
    wins = request_records(messages).filter("status = 'provided' AND novel > 0")
    stop = wins.groupBy("episode").agg(F.min("pos").alias("stop"))
    return messages.join(stop, "episode").filter("pos <= stop")


def public_state(log: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Last value per key; combines before its shuffle."""
    return log.groupBy(*keys).agg(F.max_by(value, order).alias("value"), F.max(order).alias("at"))


def replay_actions(
    actions: DataFrame, budget: int, episode: str = "episode", order: str = "pos", name: str = "name", costs: Mapping[str, int] | None = None,
    barred: str | None = None,
) -> DataFrame:
    """Ordered replay of priced actions under a budget; one row per action with its outcome.

    An action that costs more than what is left is rejected and not charged; everything after a finish is rejected. ``barred``
    names a boolean column of actions that fail for a reason of their own (``unreleased_image``), which are not charged either.
    """
    finished = budget + 1
    price = action_price(F.col(name), costs)
    failing = F.col(barred) if barred else F.lit(False)
    states = F.sequence(F.lit(0), F.lit(finished))

    def after(s: Column) -> Column:
        paid = F.when((s <= budget) & (price <= s), s - price)
        return F.when((s == finished) | failing, s).when(F.col(name) == "finish", finished).otherwise(F.coalesce(paid, s)).cast("int")

    rows = replay_states(actions, [episode], [order], F.transform(states, after), budget + 2, budget)
    open_ = F.col("state_before") <= budget
    affordable = F.coalesce(price, F.lit(finished)) <= F.col("state_before")
    outcome = (
        F.when(~open_, "episode_finished").when((F.col(name) == "finish") & ~failing, "finished")
        .when(price.isNull(), "unknown_action").when(~affordable, "insufficient_budget").when(failing, "unreleased_image").otherwise("accepted")
    )
    return rows.withColumn("price", price).withColumn("outcome", outcome)


def replay_releases(
    actions: DataFrame, evidence: DataFrame, budget: int, episode: str = "episode", order: str = "pos", name: str = "name",
    key: str = "view", image: str = "image", costs: Mapping[str, int] | None = None, short: int = 512,
) -> DataFrame:
    """``replay_actions`` with the set of released images: ``given`` and ``is_new`` for accepted requests, ``n_released`` (images out
    after the action), and outcome ``unreleased_image`` for an action on an image that was not out yet.

    ``actions`` have ``key`` (what a request asks for) and ``image`` (what another action or a finish looks at; null: nothing);
    ``evidence`` has ``episode``, ``key``, ``image``, ``available`` and ``released``. A request is given the smallest available image
    of its key that is not out, else the smallest one, else nothing; it is charged all the same.

    Episodes of at most ``short`` actions and images are folded action by action, one array each, in one pass over all of them.
    In longer ones budget and releases depend on each other, and each alone composes: steps of the budget in a tree of segments,
    the n-th accepted request of a key with the n-th unreleased image. They are replayed in turn until no action changes. A round
    settles all actions before the first wrong one, so the end is what a replay one by one gives, and no episode of any length
    is ever in one task.
    """
    rules = (budget, episode, order, name, key, image, costs)
    # As a struct, an episode without an id is joined like any other.
    whole = F.struct(F.col(episode).alias("episode")).alias("_whole")
    large = [t.groupBy(whole).agg(F.count("*").alias("_n")).where(F.col("_n") > short).select("_whole") for t in (actions, evidence)]
    large = materialize(large[0].unionByName(large[1]).distinct(), "large")
    if large.isEmpty():
        return _folded_releases(actions, evidence, *rules)

    def part(df: DataFrame, how: str) -> DataFrame:
        return df.select("*", whole).join(large, "_whole", how).select(*df.columns)

    folded = _folded_releases(part(actions, "left_anti"), part(evidence, "left_anti"), *rules)
    return folded.unionByName(_composed_releases(part(actions, "left_semi"), part(evidence, "left_semi"), *rules))


def _folded_releases(
    actions: DataFrame, evidence: DataFrame, budget: int, episode: str, order: str, name: str, key: str, image: str, costs: Mapping[str, int] | None,
) -> DataFrame:
    """``replay_releases`` of episodes that each fit an array."""
    asks = F.coalesce(F.col(name) == "request_photo", F.lit(False))
    item = F.struct(
        F.col(order).alias("_at"), F.col(key).alias("key"), F.col(image).alias("image"), asks.alias("asks"),
        F.coalesce(F.col(name) == "finish", F.lit(False)).alias("ends"), action_price(F.col(name), costs).alias("price"), F.struct(*actions.columns).alias("row"),
    )
    # Rows of an episode have different places, so no later field decides their order.
    own = actions.select(episode, item.alias("_item")).groupBy(episode).agg(F.collect_list("_item").alias("_items"))
    own = own.withColumn("_items", F.array_sort("_items", lambda a, b: F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).otherwise(0)))
    offer = F.struct(F.col(key).alias("key"), F.col(image).alias("id"))
    stock = evidence.groupBy(episode).agg(
        F.array_sort(F.collect_list(F.when(F.col("available") & ~F.col("released"), offer))).alias("_fresh"),
        F.array_sort(F.collect_set(F.when(F.col("available"), offer))).alias("_usable"), F.collect_set(F.when(F.col("released"), F.col(image))).alias("_start"),
    )
    joined = own.join(stock, episode, "left")
    joined = joined.withColumns({c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in ("_fresh", "_usable", "_start")})
    ids, keys = joined.schema["_start"].dataType.elementType, actions.schema[key].dataType
    empty = F.struct(
        F.lit(budget).alias("state"), F.array().cast(f"array<{ids.simpleString()}>").alias("out"), F.array().cast(f"array<{keys.simpleString()}>").alias("asked"),
        F.array().cast(f"array<struct<state_before:int,state_after:int,outcome:string,given:{ids.simpleString()},is_new:boolean,n_released:bigint>>").alias("log"),
    )

    def matching(offers: str, wanted: Column) -> Column:
        return F.filter(offers, lambda o: o["key"] == wanted)

    def step(acc: Column, item: Column) -> Column:
        held = F.coalesce(F.array_contains("_start", item["image"]) | F.array_contains(acc["out"], item["image"]), F.lit(False))
        failing = item["image"].isNotNull() & ~item["asks"] & ~held
        outcome = (
            F.when(acc["state"] > budget, "episode_finished").when(item["ends"] & ~failing, "finished").when(item["price"].isNull(), "unknown_action")
            .when(item["price"] > acc["state"], "insufficient_budget").when(failing, "unreleased_image").otherwise("accepted")
        )

        def taken(outcome: Column) -> Column:
            gives = item["asks"] & (outcome == "accepted")
            turn = F.size(F.filter(acc["asked"], lambda k: k == item["key"]))
            fresh = F.when(gives, F.get(matching("_fresh", item["key"]), turn)["id"])
            after = F.when(outcome == "finished", budget + 1).when(outcome == "accepted", acc["state"] - item["price"]).otherwise(acc["state"]).cast("int")
            return let(F.struct(after.alias("after"), gives.alias("gives"), fresh.alias("fresh")), lambda t: moved(outcome, t))

        def moved(outcome: Column, t: Column) -> Column:
            new = t["fresh"].isNotNull()
            out = F.when(new, F.array_append(acc["out"], t["fresh"])).otherwise(acc["out"])
            given = F.when(t["gives"], F.coalesce(t["fresh"], F.get(matching("_usable", item["key"]), F.lit(0))["id"]))
            line = F.struct(
                acc["state"].alias("state_before"), t["after"].alias("state_after"), outcome.alias("outcome"), given.alias("given"), new.alias("is_new"),
                (F.size("_start") + F.size(acc["out"]) + new.cast("int")).cast("bigint").alias("n_released"),
            )
            return F.struct(
                t["after"].alias("state"), out.alias("out"), F.when(t["gives"], F.array_append(acc["asked"], item["key"])).otherwise(acc["asked"]).alias("asked"),
                F.array_append(acc["log"], line).alias("log"),
            )

        return let(outcome, taken)

    log = F.aggregate("_items", empty, step, lambda acc: acc["log"])
    rows = joined.select(F.explode(F.arrays_zip(F.col("_items").alias("item"), log.alias("said"))).alias("z"))
    return rows.select("z.item.row.*", "z.said.state_before", "z.said.state_after", "z.item.price", "z.said.outcome", "z.said.given", "z.said.is_new", "z.said.n_released")


def _composed_releases(
    actions: DataFrame, evidence: DataFrame, budget: int, episode: str, order: str, name: str, key: str, image: str, costs: Mapping[str, int] | None,
) -> DataFrame:
    """``replay_releases`` of episodes of any length."""
    first = evidence.where("released").select(episode, image).distinct().withColumn("_out", F.lit(True))
    known = evidence.where("available OR released").select(episode, image).distinct().withColumn("_known", F.lit(True))
    asks = (F.col(name) == "request_photo").alias("_asks")
    rows = actions.select(*actions.columns, asks).join(first, [episode, image], "left").join(known, [episode, image], "left")
    looks = F.col(image).isNotNull() & ~F.coalesce("_asks", F.lit(False)) & F.col("_out").isNull()
    rows = rows.select(*actions.columns, looks.alias("_looks"), (looks & F.col("_known").isNull()).alias("_barred"))
    rows = materialize(rows, "actions")
    stock = evidence.select(episode, key, F.col(image).alias("id"), "available", "released")
    while True:
        replayed = materialize(replay_actions(rows, budget, episode, order, name, costs, "_barred"), "replayed")
        taken = replayed.where((F.col("outcome") == "accepted") & (F.col(name) == "request_photo")).select(episode, key, F.col(order).alias("pos"))
        given = materialize(resolve_requests(taken, stock, [episode, key]).select(episode, F.col("pos").alias(order), "given", "is_new"), "given")
        out = given.where("is_new").select(episode, F.col("given").alias(image), F.col(order).alias("_since"))
        again = replayed.drop("state_before", "state_after", "price", "outcome").join(out, [episode, image], "left")
        barred = F.col("_looks") & ~F.coalesce(F.col("_since") < F.col(order), F.lit(False))
        again = materialize(again.withColumn("_was", F.col("_barred")).withColumn("_barred", barred).drop("_since"), "again")
        if again.where("_was <> _barred").isEmpty():
            break
        rows = again.drop("_was")
    told = replayed.join(given, [episode, order], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    counted = running_total(told.withColumn("_one", F.col("is_new").cast("long")), [episode], [order], "_one", "n_released", "_all")
    start = first.groupBy(episode).agg(F.count("*").alias("_first"))
    counted = counted.join(start, episode, "left").withColumn("n_released", F.col("n_released") + F.coalesce("_first", F.lit(0)))
    return counted.select(*actions.columns, "state_before", "state_after", "price", "outcome", "given", "is_new", "n_released")


def released_before(replayed: DataFrame, evidence: DataFrame, episode: str = "episode", order: str = "pos", image: str = "image") -> DataFrame:
    """The image ids that are out before each action of ``replay_releases``, as rows ``(episode, order, image, since)``: ``since`` is null for
    images that are out from the start. Order them by ``since`` and ``image`` for the released list."""
    start = evidence.where("released").select(episode, F.col(image), F.lit(None).cast(replayed.schema[order].dataType).alias("since")).distinct()
    new = replayed.where("is_new").select(episode, F.col("given").alias(image), F.col(order).alias("since"))
    out = start.unionByName(new)
    return replayed.select(episode, order).join(out, episode).where(F.col("since").isNull() | (F.col("since") < F.col(order)))


def replay_summary(replayed: DataFrame, budget: int, episode: str = "episode", name: str = "name") -> DataFrame:
    """Counters of a replay: calls, requests, costs, rejections and what is left."""
    ok = F.col("outcome") == "accepted"
    request = F.col(name) == "request_photo"
    spent = F.coalesce(F.sum(F.when(ok, F.col("price"))), F.lit(0))
    return replayed.groupBy(episode).agg(
        F.count_if(ok).alias("calls"), F.count_if(ok & request).alias("requests"),
        F.coalesce(F.sum(F.when(ok & request, F.col("price"))), F.lit(0)).cast("long").alias("request_cost"),
        F.coalesce(F.sum(F.when(ok & ~request, F.col("price"))), F.lit(0)).cast("long").alias("tool_cost"),
        F.count_if(F.col("outcome").isin("insufficient_budget", "episode_finished", "unknown_action")).alias("rejected"),
        (F.lit(budget) - spent).cast("long").alias("remaining"),
        F.max(F.col("outcome") == "finished").alias("finished"),
    )


def resolve_requests(requests: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The evidence each request is given: the smallest matching id not yet released, else the smallest matching id.

    A query names object, time and view in full, so the candidates of different queries are disjoint and the n-th
    request of one query gets the n-th unreleased candidate; no sequential state is needed.
    ``evidence`` has ``keys``, ``id``, ``available`` and ``released``; ``requests`` has ``keys`` and ``pos``.
    """
    usable = evidence.filter("available")
    fresh = ordered_index(usable.filter("NOT released").select(*keys, "id"), keys, ["id"], "turn")
    smallest = usable.groupBy(*keys).agg(F.min("id").alias("smallest"))
    asked = ordered_index(requests, keys, ["pos"], "turn")
    found = asked.join(fresh, [*keys, "turn"], "left").join(smallest, keys, "left")
    given = F.coalesce("id", "smallest")
    return found.select(
        *keys, "pos", given.alias("given"), F.col("id").isNotNull().alias("is_new"),
        F.when(given.isNull(), "unable_to_provide").otherwise("provided").alias("status"),
    )


# Range of the display scale.
SCALE_LOW, SCALE_HIGH = 0.25, 4.0


def replay_sessions(events: DataFrame, keys: list[str], order: str = "pos", kind: str = "kind", factor: str = "factor") -> DataFrame:
    """Final display scale of every source of a session, with counts of acts and presentation-only events.

    ``kind`` is zoom (presentation only: the scale is multiplied by ``factor`` and kept in its range), show (an inspect or
    crop that resets the scale to 1) or anything else.
    """
    zoom, show = F.col(kind) == "zoom", F.col(kind) == "show"
    # x -> min(high, max(low, by * x)): such steps compose to one of their kind, and a reset is the step by zero onto 1.
    step = F.struct(
        F.when(show, 0.0).when(zoom, F.col(factor).cast("double")).otherwise(1.0).alias("by"),
        F.when(show, 1.0).otherwise(SCALE_LOW).alias("low"), F.when(show, 1.0).otherwise(SCALE_HIGH).alias("high"),
    )

    def after(first: Column, second: Column) -> Column:
        def bounded(x: Column) -> Column:
            return F.least(second["high"], F.greatest(second["low"], second["by"] * x))
        return F.struct((first["by"] * second["by"]).alias("by"), bounded(first["low"]).alias("low"), bounded(first["high"]).alias("high"))

    start = F.struct(F.lit(1.0).alias("by"), F.lit(SCALE_LOW).alias("low"), F.lit(SCALE_HIGH).alias("high"))
    scales = composed_log(events.withColumn("_step", step), keys, [order], "_step", start, after)
    counts = events.groupBy(F.struct(*keys).alias("_keys")).agg(
        F.count_if(~F.coalesce(zoom, F.lit(False))).alias("turns"), F.count_if(zoom).alias("presentation_events"),
        F.count_if(F.col(kind) == "request").alias("requests"),
    )
    final = F.least(F.col("_step.high"), F.greatest(F.col("_step.low"), F.col("_step.by")))
    return counts.join(scales, "_keys").select("_keys.*", final.alias("display_scale"), "turns", "presentation_events", "requests")


def visible_images(events: DataFrame, keys: list[str], image: str, rank: Column, order: str) -> DataFrame:
    """Images in display order: by class of release, then first occurrence, each once."""
    first = (
        events.filter(F.col(image).isNotNull()).groupBy(*keys, image)
        .agg(F.min(F.struct(rank.alias("_class"), F.col(order).alias("_pos"))).alias("_f"))
        .select(*keys, image, "_f.*")
    )
    return ordered_index(first, keys, ["_class", "_pos", image], "ordinal").select(*keys, image, "ordinal")


def finite(value: Column) -> Column:
    """Not negative, and neither NaN nor infinite: in comparisons NaN counts as larger than any number."""
    return (value >= 0) & (value < float("inf"))


def generation_usage(generation: Column, wall: Column, stored: Column, strict: bool = False) -> Column:
    """Usage struct of one episode's generation array.

    Halted calls ran no generation and count as rejected. A missing, negative or non-finite measure, a halted call with output
    tokens, or a wall time that differs from the stored one is a problem, never a silent zero; ``strict`` raises it.
    """
    made = F.filter(generation, lambda g: g["halt"].isNull())
    halted = F.filter(generation, lambda g: g["halt"].isNotNull())

    def bad(g: Column) -> Column:
        sound = (g["input_tokens"] >= 0) & (g["output_tokens"] >= 0) & finite(g["latency_s"])
        return ~F.coalesce(sound, F.lit(False))

    def total(field: str, kind: str) -> Column:
        return F.aggregate(F.transform(made, lambda g: g[field]), F.lit(0).cast(kind), lambda a, v: a + v)

    problem = (
        F.when(F.exists(halted, lambda g: g["output_tokens"].isNotNull()), "halted_call_with_tokens")
        .when(F.exists(made, bad), "invalid_measure")
        .when(~F.coalesce(finite(wall) & (F.abs(wall - stored) <= 1e-6), F.lit(False)), "latency_mismatch")
    )
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(problem).cast("string"))
    return F.struct(
        total("input_tokens", "bigint").alias("input_tokens"), total("output_tokens", "bigint").alias("output_tokens"),
        total("latency_s", "double").alias("model_s"), F.size(made).alias("model_calls"),
        F.size(halted).alias("rejected_calls"), problem.alias("problem"),
    )


def api_usage(traces: DataFrame, pilot: DataFrame, keys: list[str]) -> DataFrame:
    """Token and time sums per episode of an API run; a replayed generation takes its original time from the pilot.

    ``traces`` has ``keys`` and ``generation``; ``pilot`` has ``keys``, ``call`` and ``original_s``.
    """
    calls = traces.select(*keys, F.posexplode("generation").alias("call", "g")).select(*keys, "call", "g.*")
    timed = calls.join(pilot, [*keys, "call"], "left").withColumn("_s", F.coalesce("original_s", "latency_s"))
    return timed.groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("reasoning_tokens").alias("reasoning_tokens"), F.sum("_s").alias("model_s"),
        F.count_if(F.col("original_s").isNotNull()).alias("replayed_calls"), F.count("*").alias("model_calls"),
    )


# What a stored reference to a content-addressed image looks like.
IMAGE_REF_PATTERN = r'"image_ref"\s*:\s*"([^"]*)"'
CONTENT_ADDRESSED = r"^blobs/[0-9a-f]{64}\.png$"


def image_refs(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """Distinct image references at any depth of a JSON document, and whether each is content-addressed."""
    refs = F.array_distinct(F.regexp_extract_all(F.col(document), F.lit(IMAGE_REF_PATTERN), 1))
    return df.select(*keys, F.explode(refs).alias("image_ref")).withColumn(
        "content_addressed", F.col("image_ref").rlike(CONTENT_ADDRESSED)
    )


def trace_excerpt(messages: DataFrame) -> DataFrame:
    """Calls of each episode with the outcome of the last response to them, without pixels.

    The responses to a call are those up to the next use of its id.
    """
    answers = call_responses(messages).filter("call_pos IS NOT NULL").groupBy("episode", "call_id", F.col("call_pos").alias("pos")).agg(
        F.max_by("status", "pos").alias("status"), F.count("*").alias("responses")
    )
    calls = messages.filter("role = 'assistant'").select("episode", "pos", "call_id", "name")
    return calls.join(answers, ["episode", "call_id", "pos"], "left").select(
        "episode", "pos", "name", "status", F.coalesce("responses", F.lit(0)).alias("responses")
    )


def request_events(messages: DataFrame, action: str = "request_photo") -> DataFrame:
    """Status and returned image of each answered request."""
    return answered_requests(messages, action).select("episode", "pos", "status", F.col("image").alias("returned"))


def episode_rows(records: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Flat result rows: verdict against the case label, usage sums, peak memory and whether the target arrived."""
    usage = generation_usage(F.col("generation"), F.col("wall_latency_s"), F.col("wall_latency_s"))
    peak = F.array_max(F.transform("generation", lambda g: g["memory_mb"]))
    joined = records.join(cases, key, "left")
    return joined.select(
        *[c for c in records.columns if c not in ("generation", "released")],
        *[c for c in cases.columns if c not in (key, "target")],
        F.col("verdict").eqNullSafe(F.col("source_label")).alias("source_label_match"),
        usage["input_tokens"].alias("input_tokens"), usage["output_tokens"].alias("output_tokens"),
        usage["model_calls"].alias("model_calls"), peak.alias("peak_memory_mb"),
        F.array_contains("released", F.col("target")).alias("received_target"),
    )


def branch_audit(branches: DataFrame, origin: str = "origin") -> DataFrame:
    """Releases caused by the first action and by a whole branch, and whether the world stayed the same per origin."""
    worlds = branches.groupBy(origin).agg(F.min("fingerprint").alias("_low"), F.max("fingerprint").alias("_high"))
    return branches.join(worlds, origin).withColumn(
        "first_action_releases", F.array_except("released_first", "released_base")
    ).withColumn("branch_releases", F.array_except("released_all", "released_base")).withColumn(
        "world_unchanged", F.col("_low") == F.col("_high")
    ).drop("_low", "_high")
