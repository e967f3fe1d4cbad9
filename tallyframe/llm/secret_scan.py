"""Secret scan with multipart credential linking, in Spark SQL expressions alone.

Secrets with a telling form are reported wherever they stand. A weak candidate, such as a user name, a host or a value
behind a vague name, is reported only if a complementary part stands close by: an interval join within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize
from .keys import document_key


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def named_value(names: list[str], value: str) -> str:
    return f"({'|'.join(names)})" + r"""["']?\x20*[:=]\x20*["']?""" + f"({value})"


# Kind, role, pattern, group whose length counts, least length. Fixed values of the base kinds: the first three rows.
# Runs of one class of characters have their least length in the pattern: a shorter run holds no match that starts later,
# so that this drops the same matches as a test afterwards would, without listing them.
ASSIGN = named_value([*map(either_case, ["password", "passwd", "secret", "token"]), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"], "[A-Za-z0-9+/_.=-]+")
KINDS = [
    ("assign", "secret", ASSIGN, 2, 6),
    ("access", "identifier", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "secret", "[0-9a-f]{24,}", 0, 24),
    ("identifier", "identifier", named_value([*map(either_case, ["username", "user", "login", "account"]), "[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]"], "[A-Za-z0-9+/_.@-]+"), 2, 3),
    ("endpoint", "endpoint", "https?://[A-Za-z0-9.-]+", 0, 10),
    ("weak_secret", "secret", named_value([*map(either_case, ["pwd", "pass", "credential"]), "[Kk][Ee][Yy]"], "[A-Za-z0-9+/_.=-]+"), 2, 4),
]
BASE_KINDS = 3
# Code points between the starts of parts of one credential.
SCOPE = 256


def part_rows(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """All matches as ``key``, ``kind`` (place in ``KINDS``), ``start``, ``end`` (code points, end exclusive)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(document_key(id_col, text).alias("key"), whole.alias("text"))
    hits = rows.select("key", "text", *[F.regexp_extract_all("text", F.lit(k[2]), F.lit(0)).alias(f"hits{i}") for i, k in enumerate(KINDS)])
    found = [
        F.when(F.size(f"hits{i}") > 0, F.struct(F.lit(i).alias("kind"), F.arrays_zip(F.split("text", k[2], -1).alias("gap"), F.col(f"hits{i}").alias("hit")).alias("parts")))
        for i, k in enumerate(KINDS)
    ]
    listed = hits.select("key", F.explode(F.array_compact(F.array(*found))).alias("found"))
    listed = listed.select("key", "found.kind", F.posexplode("found.parts").alias("turn", "part"))
    # A match starts behind all gaps and matches before it and its own gap.
    passed = F.sum(F.length("part.gap") + F.coalesce(F.length("part.hit"), F.lit(0))).over(W.partitionBy("key", "kind").orderBy("turn"))
    listed = listed.withColumn("end", passed).where("part.hit IS NOT NULL")
    fits = F.lit(False)
    for i, (_, _, pattern, group, least) in enumerate(KINDS):
        value = F.regexp_extract("part.hit", pattern, group) if group else F.col("part.hit")
        fits = F.when(F.col("kind") == i, F.length(value) >= least).otherwise(fits)
    return listed.where(fits).select("key", "kind", (F.col("end") - F.length("part.hit")).alias("start"), "end").distinct()


def role(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k[1]) for k in KINDS]), kind + 1)


def near(rows: DataFrame) -> DataFrame:
    """Rows once for each scope that their neighbours can start in."""
    scope = F.floor(F.col("start") / SCOPE)
    return rows.withColumn("scope", F.explode(F.array(scope - 1, scope, scope + 1)))


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Spans of every whole text: ``id_col``, ``spans`` (array of ``start``, ``kind``, ``name``, ``end``, by start, then kind).

    Kinds below ``BASE_KINDS`` are always reported. A weak secret is reported if an identifier or an endpoint starts within
    ``SCOPE`` code points of it in the same document and no base span overlaps it; an identifier or an endpoint if a
    secret of any strength does. Matches of one kind are leftmost and do not overlap.

    One row per input row; rows that repeat id and text are one document with one result. Null, empty and clean texts have
    an empty array. Other columns are ignored; an empty table gives an empty result.
    """
    # Three inputs follow from the matches; written once, the texts are scanned once.
    parts = materialize(part_rows(docs, text, id_col), "parts")
    base, weak = parts.where(F.col("kind") < BASE_KINDS), parts.where(F.col("kind") >= BASE_KINDS)
    others = parts.select("key", F.floor(F.col("start") / SCOPE).alias("scope"), F.col("kind").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    complement = (role(F.col("kind")) == "secret") != (role(F.col("k")) == "secret")
    within = F.abs(F.col("s") - F.col("start")) <= SCOPE
    same = ["key", "scope"]
    candidates = near(weak).alias("w")
    on = [F.col(f"w.{c}") == F.col(f"o.{c}") for c in same]
    linked = candidates.join(others.alias("o"), [*on, complement, within], "left_semi").select("key", "kind", "start", "end").distinct()
    # A value behind a vague name that a base span covers already is no further finding.
    over = others.where(F.col("k") < BASE_KINDS).alias("o")
    overlap = (F.col("kind") == len(KINDS) - 1) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e"))
    linked = linked.alias("w").join(over, [F.col("w.key") == F.col("o.key"), overlap], "left_anti")
    names = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    spans = base.unionByName(linked).withColumn("name", names).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "name", "end"))).alias("spans"))
    rows = docs.select(F.col(id_col), document_key(id_col, text).alias("key"))
    return rows.join(spans, "key", "left").select(id_col, F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
