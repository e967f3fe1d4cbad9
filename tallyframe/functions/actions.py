"""Tool actions: argument rules, prices and rewards."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..skew import let
from .text import strict_json

# Price of each action in budget units.
ACTION_COSTS = {
    "inspect": 1, "crop": 1, "zoom": 1, "ocr": 2, "compare": 2, "request_photo": 3, "assess_quality": 1,
    "read_metadata": 1, "ground_text_to_image": 3, "ground_image_to_image": 3, "ground_image_to_text": 2,
}
# Arguments of each action; a leading "?" marks an optional one.
ACTION_ARGUMENTS = {
    "inspect": ["image_id:text"],
    "crop": ["image_id:text", "bbox:box"],
    "zoom": ["image_id:text", "factor:zoom"],
    "ocr": ["image_id:text"],
    "compare": ["image_ids:pair"],
    "request_photo": ["query:query"],
    "finish": ["verdict:verdict", "citations:citations", "?links:links"],
    "assess_quality": ["image_id:text"],
    "read_metadata": ["image_id:text"],
    "ground_text_to_image": ["image_id:text", "text:phrase"],
    "ground_image_to_image": ["query_image_id:text", "target_image_id:text", "?top_k:top"],
    "ground_image_to_text": ["image_id:text", "candidates:phrases"],
}


# Shapes of a citation and a link as variant schemas, and the relations.
CITATION_SHAPE = "OBJECT<bbox: ARRAY<BIGINT>, image_id: STRING, time: STRING>"
LINK_SHAPE = f"OBJECT<left: {CITATION_SHAPE}, relation: STRING, right: {CITATION_SHAPE}>"
RELATION_NAMES = ("same_object", "different_object", "earlier_than", "same_time")


def _cited(value: Column, path: str) -> Column:
    box = F.try_variant_get(value, f"{path}.bbox", "array<bigint>")
    names = [F.length(F.try_variant_get(value, f"{path}.{k}", "string")) > 0 for k in ("image_id", "time")]
    return (F.size(box) == 4) & names[0] & names[1]


def _citation_ok(value: Column) -> Column:
    return F.coalesce((F.schema_of_variant(value) == CITATION_SHAPE) & _cited(value, "$"), F.lit(False))


def _link_ok(value: Column) -> Column:
    relation = F.try_variant_get(value, "$.relation", "string").isin(*RELATION_NAMES)
    shaped = F.schema_of_variant(value) == LINK_SHAPE
    return F.coalesce(shaped & relation & _cited(value, "$.left") & _cited(value, "$.right"), F.lit(False))


def _kind_ok(kind: str, value: Column) -> Column:
    """Rule of one argument kind over its variant value."""
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    schema = F.schema_of_variant(value)
    texts = F.try_variant_get(value, "$", "array<string>")
    is_text = schema == "STRING"
    is_number = schema.rlike("^(BIGINT|DOUBLE|DECIMAL)")
    all_texts = schema.isin("ARRAY<STRING>")
    if kind == "text":
        return is_text & (F.length(text) > 0)
    if kind == "phrase":
        return is_text & F.length(text).between(1, 500)
    if kind == "verdict":
        return is_text & text.isin("Supported", "Refuted", "Need more evidence")
    if kind == "zoom":
        return is_number & number.between(0.125, 4.0)
    if kind == "top":
        return schema.startswith("BIGINT") & number.between(1, 5)
    if kind in ("citations", "links"):
        items = F.try_variant_get(value, "$", "array<variant>")
        return schema.startswith("ARRAY") & F.forall(items, _citation_ok if kind == "citations" else _link_ok)
    if kind == "pair":
        return all_texts & (F.size(texts) == 2) & (F.size(F.array_distinct(texts)) == 2)
    if kind == "phrases":
        return all_texts & F.size(texts).between(1, 32) & F.forall(texts, lambda t: F.length(t).between(1, 500))
    if kind == "box":
        return (schema == "ARRAY<BIGINT>") & (F.size(F.try_variant_get(value, "$", "array<bigint>")) == 4)
    if kind == "query":
        fields = [F.try_variant_get(value, f"$.{k}", "string") for k in ("object", "time", "view")]
        filled = (F.length(fields[0]) > 0) & (F.length(fields[1]) > 0) & (F.length(fields[2]) > 0)
        return (schema == "OBJECT<object: STRING, time: STRING, view: STRING>") & filled
    raise ValueError(kind)


def action_errors(name: Column, arguments: Column) -> Column:
    """Sorted error codes of a call: unknown action, missing, unknown or invalid arguments.

    ``arguments`` is JSON text. The rule table is a constant, so the check is one projection without any join.
    """
    none = F.array().cast("array<string>")

    def check(call: Column) -> Column:
        checks = None
        for action, rules in ACTION_ARGUMENTS.items():
            found = _argument_errors(rules, call["parsed"], call["keys"])
            checks = F.when(call["name"] == action, found) if checks is None else checks.when(call["name"] == action, found)
        known = checks.otherwise(F.array(F.lit("unknown_action")))
        return F.when(call["parsed"].isNull(), F.array(F.lit("not_json"))).otherwise(known)

    keys = F.coalesce(F.json_object_keys(arguments), none)
    return let(F.struct(name.alias("name"), strict_json(arguments).alias("parsed"), keys.alias("keys")), check)


def _accepts(kind: str, value: Column) -> Column:
    return F.coalesce(_kind_ok(kind, value), F.lit(False))


def _argument_errors(rules: list[str], parsed: Column, keys: Column) -> Column:
    codes, known = [], []
    for rule in rules:
        field, kind = rule.lstrip("?").split(":")
        known.append(field)
        present = F.array_contains(keys, field)
        if not rule.startswith("?"):
            codes.append(F.when(~present, F.lit(f"missing:{field}")))
        valid = let(F.try_variant_get(parsed, f"$.{field}", "variant"), partial(_accepts, kind))
        codes.append(F.when(present & ~valid, F.lit(f"invalid:{field}")))
    extra = F.transform(F.array_except(keys, F.array(*[F.lit(k) for k in known])), lambda k: F.concat(F.lit("unknown:"), k))
    return F.array_sort(F.concat(F.array_compact(F.array(*codes)), extra))


def action_price(name: Column, costs: Mapping[str, int] | None = None) -> Column:
    """Budget price of an action; finishing is free, an unknown action has no price. ``costs`` replaces prices of single actions."""
    prices = ACTION_COSTS | dict(costs or {})
    if unknown := set(prices) - set(ACTION_COSTS):
        raise ValueError(f"no such action: {sorted(unknown)}")
    if any(cost < 0 for cost in prices.values()):
        raise ValueError("prices must not be negative")
    price = F.when(name == "finish", 0)
    for action, cost in prices.items():
        price = price.when(name == action, cost)
    return price


def microdollars(usd: Column) -> Column:
    """Ceiling in integer micro-dollars; an error for negative or non-finite amounts."""
    sound = (usd >= 0) & ~F.isnan(usd.cast("double")) & (usd.cast("double") < float("inf"))
    amount = F.ceil(usd * 1_000_000).cast("long")
    return F.when(sound, amount).when(usd.isNotNull(), F.raise_error(F.lit("amounts must be finite and non-negative")).cast("long"))


def call_charge(input_tokens: Column, output_tokens: Column, rate_in: float, rate_out: float) -> Column:
    """Price in USD of one call at rates per million tokens, as an exact decimal."""
    rates = [F.lit(str(r)).cast("decimal(12,4)") for r in (rate_in, rate_out)]
    tokens = [t.cast("decimal(18,0)") for t in (input_tokens, output_tokens)]
    return ((tokens[0] * rates[0] + tokens[1] * rates[1]) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(28,10)")


def trajectory_reward(correct: Column, tool_cost: Column, request_cost: Column, errors: Column) -> Column:
    """One for a grounded correct end, minus one otherwise, less small costs."""
    return F.when(correct, 1.0).otherwise(-1.0) - 0.01 * tool_cost - 0.02 * request_cost - 0.02 * errors
