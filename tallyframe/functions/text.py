"""Reading verdicts, tool calls and paths out of model text; nothing is repaired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..skew import let

# The accepted answer and call patterns.
VERDICT_PATTERN = r"^\s*(?:VERDICT:\s*)?(Supported|Refuted|Need more evidence)\s*[.!]?\s*$"
CALL_PATTERN = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
FUNCTION_PATTERN = r"(?s)^<function=([A-Za-z_][A-Za-z0-9_]*)>\s*(.*?)\s*</function>$"
PARAMETER_PATTERN = r"(?s)<parameter=([A-Za-z_][A-Za-z0-9_]*)>(.*?)</parameter>"
VARIANT_SUFFIX = r"(-(Sufficient|Obtainable|Missing|Unavailable))+$"


def strict_json(text: Column) -> Column:
    """Variant of a text that is exactly one JSON value; null otherwise.

    Spark's parser stops after the first value; inside brackets anything that follows breaks the document or adds a
    second item.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return let(items, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def parse_verdict(text: Column) -> Column:
    """The single explicit answer of a text; null for anything else."""
    return F.nullif(F.regexp_extract(text, VERDICT_PATTERN, 1), F.lit(""))


def parse_tool_call(text: Column, allow_bare: bool = False, allow_unclosed: bool = False) -> Column:
    """Struct(name, arguments JSON) of exactly one call block with a name and object arguments; else null.

    Two transports may be allowed on top: a bare JSON object that is the whole text, and an opening tag without its
    closing one. Delimiters are transport; the JSON itself must be complete.
    """
    blocks = F.regexp_extract_all(text, F.lit(CALL_PATTERN), 1)
    if allow_unclosed:
        open_only = text.startswith("<tool_call>") & ~text.contains("</tool_call>")
        blocks = F.when(open_only, F.array(F.substring(text, F.lit(len("<tool_call>") + 1), F.length(text)))).otherwise(blocks)
    if allow_bare:
        bare = F.btrim(text, F.lit(" \t\r\n"))
        blocks = F.when(bare.startswith("{"), F.array(bare)).otherwise(blocks)

    def read(found: Column) -> Column:
        body = F.get(found, F.lit(0))
        parsed = strict_json(body)
        keys = F.array_sort(F.json_object_keys(body))
        sound = (
            (F.size(found) == 1) & parsed.isNotNull() & (keys == F.array(F.lit("arguments"), F.lit("name")))
            & F.schema_of_variant(F.variant_get(parsed, "$.name", "variant")).eqNullSafe("STRING")
            & F.schema_of_variant(F.variant_get(parsed, "$.arguments", "variant")).startswith("OBJECT")
        )
        call = F.struct(
            F.try_variant_get(parsed, "$.name", "string").alias("name"), F.get_json_object(body, "$.arguments").alias("arguments")
        )
        return F.when(F.coalesce(sound, F.lit(False)), call)

    return let(blocks, read)


def parse_xml_call(text: Column, known: dict[str, dict[str, str]]) -> Column:
    """Struct(name, arguments JSON, content) of exactly one XML call; ``known`` has the type of each parameter by function.

    String parameters stay text; any other type must be valid JSON and keeps it. ``content`` is the text around the call.
    Null for repeated parameters, stray content and unknown names.
    """
    blank = F.lit(" \t\r\n")

    kinds = F.create_map(*[F.lit(x) for f, own in known.items() for p, kind in own.items() for x in (f"{f} {p}", kind)])

    # A JSON string literal is what to_json writes behind the name of a one-field object.
    def literal(p: Column) -> Column:
        quoted = F.to_json(F.struct(p["v"].alias("s")))
        return F.when(p["kind"] == "string", F.substring(quoted, F.lit(6), F.length(quoted) - 6)).otherwise(p["v"])

    # Each part of the call is cut out once, and only of a call that is sound so far.
    def read(found: Column) -> Column:
        body = F.get(found, F.lit(0))
        parts = F.struct(F.regexp_extract(body, FUNCTION_PATTERN, 1).alias("name"), F.regexp_extract(body, FUNCTION_PATTERN, 2).alias("inner"))
        return F.when(F.size(found) == 1, let(parts, named))

    def named(call: Column) -> Column:
        stray = F.btrim(F.regexp_replace(call["inner"], PARAMETER_PATTERN, ""), blank)
        keys = F.regexp_extract_all(call["inner"], F.lit(PARAMETER_PATTERN), 1)
        return F.when(call["name"].isin(*known) & (stray == ""), let(keys, lambda found: keyed(call, found)))

    def keyed(call: Column, keys: Column) -> Column:
        values = F.regexp_extract_all(call["inner"], F.lit(PARAMETER_PATTERN), 2)
        pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(
            p["k"].alias("k"), F.btrim(p["v"], blank).alias("v"), F.try_element_at(kinds, F.concat_ws(" ", call["name"], p["k"])).alias("kind")
        ))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), let(pairs, lambda found: typed(call, found)))

    def typed(call: Column, pairs: Column) -> Column:
        sound = F.forall(pairs, lambda p: p["kind"].isNotNull() & ((p["kind"] == "string") | strict_json(p["v"]).isNotNull()))
        fields = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["k"], F.lit('": '), literal(p))), ", ")
        around = F.btrim(F.regexp_replace(text, CALL_PATTERN, ""), blank)
        out = F.struct(call["name"].alias("name"), F.concat(F.lit("{"), fields, F.lit("}")).alias("arguments"), around.alias("content"))
        return F.when(sound, out)

    return let(F.regexp_extract_all(text, F.lit(CALL_PATTERN), 1), read)


def strip_variant(case_id: Column) -> Column:
    """Case id without its variant suffix, so that all variants of a family share one schedule."""
    return F.regexp_replace(case_id, VARIANT_SUFFIX, "")


def path_errors(path: Column) -> Column:
    """Codes of what makes a stored path not portable."""
    rules = [
        (path == "", "empty"),
        (path.startswith("/"), "absolute"),
        (path.rlike(r"^[A-Za-z]:"), "drive"),
        (path.rlike(r"(^|/)\.\.(/|$)"), "parent"),
        (path.contains("\\"), "backslash"),
        (path.rlike(r"//|(^|/)\.(/|$)|.+/$"), "not_normalized"),
    ]
    return F.array_compact(F.array(*[F.when(bad, code) for bad, code in rules]))
