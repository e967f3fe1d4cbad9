"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns share the nodes of these turns, so that each shared turn is written once. The nodes
of a tree stand depth first; a node has the position of its first token as if its conversation stood alone, and the
intervals of the tree's sequence that its tokens may attend to besides their own predecessors: its ancestors. The loss mask
is a span of each node, in characters of its formatted text and in its tokens: the text of an assistant's turn, nothing else.
Head, text and tail of a turn are encoded on their own, so no token crosses an edge of the mask.

Template: a turn is ``<s>[INST] role``, a line feed, the text and `` [/INST]</s>``. In roles and texts a backslash goes
before every ``\\``, ``<`` and ``[``, and a line feed in a role becomes ``\\n``, so that no text can contain a control string.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize
from .tokens import kept_encoder

OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>"
LEARNED = "assistant"
# Texts taken from Arrow at a time.
TEXTS = 100


def escaped(text: Column) -> Column:
    for mark in ("\\", "<", "["):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``: each backslash goes and what follows it stays."""
    return F.regexp_replace(text, r"\\([\\<\[])", "$1")


def formatted(role: Column, text: Column) -> Column:
    named = F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(OPEN), named, F.lit("\n"), escaped(text), F.lit(CLOSE))


def parsed(turn: Column) -> Column:
    """``struct<role, text>`` of a formatted turn."""
    inner = F.substring(turn, F.lit(len(OPEN) + 1), F.length(turn) - len(OPEN) - len(CLOSE))
    # A line feed inside a role is written as \n, which no escape of \\, < or [ produces at an even place.
    role = F.substring_index(inner, "\n", 1)
    body = F.substring(inner, F.length(role) + 2, F.length(inner))
    # Possessive runs: the matcher goes through a role of any length in a loop, without a call per character.
    lines = F.regexp_replace(role, r"\G((?:[^\\]++|\\[\\<\[])*+)\\n", "$1\n")
    return F.struct(unescaped(lines).alias("role"), unescaped(body).alias("text"))


def turn_rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns in order with the identity of the path that ends in them: ``conv``, ``depth``, ``path``, ``role``, ``text``."""
    rows = conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("depth", F.row_number().over(order))
    # The turns up to a depth, each with its place: their exclusive or names the path, and a window keeps it without holding the path.
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    marks = [F.expr("bit_xor(mark1)").over(upto).alias("a"), F.expr("bit_xor(mark2)").over(upto).alias("b")]
    rows = rows.withColumn("mark1", F.xxhash64("depth", "role", "text")).withColumn("mark2", F.xxhash64(F.lit(5), "role", "depth", "text"))
    return rows.withColumn("path", F.struct("depth", *marks)).drop("mark1", "mark2", "turn")


# Characters handed to the tokenizer at once. What it returns takes about a hundred bytes a character.
CALL = 1 << 17
# Between two letters around a space, tokenizers of this kind always cut; ``ChatEncoder`` makes sure of it.
SEAM = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


class ChatEncoder:
    """Token ids of texts, in calls of bounded size; control strings inside texts are plain text."""

    def __init__(self, path: str):
        # One task has one core: the tokenizer's own threads would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.seams = self._call(["ab cd"])[0].tolist() == [*self._call(["ab"])[0].tolist(), *self._call([" cd"])[0].tolist()]
        self.heads: dict[str, np.ndarray] = {}

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> Iterator[str]:
        at = 0
        while self.seams and len(text) - at > CALL and (seam := SEAM.search(text, at + CALL // 2)):
            yield text[at : seam.start()]
            at = seam.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        rows, parts, size = [], [], 0
        for row, text in enumerate(texts):
            for part in self._cut(text):
                if parts and size + len(part) > CALL:
                    for r, ids in zip(rows, self._call(parts)):
                        found[r].append(ids)
                    rows, parts, size = [], [], 0
                rows.append(row)
                parts.append(part)
                size += len(part)
        for r, ids in zip(rows, self._call(parts)):
            found[r].append(ids)
        return [np.concatenate(x) if len(x) > 1 else x[0] for x in found]

    def head(self, text: str) -> np.ndarray:
        """Heads are few as a rule; those of short roles are remembered, a thousand at most."""
        if text in self.heads:
            return self.heads[text]
        ids = self.encode([text])[0]
        if len(text) < 100 and len(self.heads) < 1000:
            self.heads[text] = ids
        return ids


def token_ids(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``ids``, the token ids of each node's ``formatted`` text, and ``masked``, the tokens of the learned text in them.

    The tokenizer is loaded once per worker process.
    """

    @F.arrow_udf("struct<ids: array<int>, low: bigint, high: bigint>")
    def encode(formatted: pa.Array, inner: pa.Array, high: pa.Array) -> pa.Array:
        known = kept_encoder(tokenizer, ChatEncoder)
        tail, out, low, end = known.head(CLOSE), [], [], []
        begin, finish = inner.to_pylist(), high.to_pylist()
        for at in range(0, len(formatted), TEXTS):
            texts = formatted.slice(at, TEXTS).to_pylist()
            spans = list(zip(begin[at : at + TEXTS], finish[at : at + TEXTS]))
            for text, (first, last), body in zip(texts, spans, known.encode([t[i:j] for t, (i, j) in zip(texts, spans)])):
                head = known.head(text[:first])
                out.append(np.concatenate([head, body, tail]))
                low.append(len(head))
                end.append(len(head) + len(body))
        return pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.int32())), pa.array(low, pa.int64()), pa.array(end, pa.int64())], ["ids", "low", "high"])

    nodes = nodes.withColumn("_found", encode("formatted", "span.low", "span.high"))
    masked = F.when(F.col("learned").isNotNull(), F.struct("_found.low", "_found.high"))
    return nodes.select(*nodes.columns, "_found.ids", masked.alias("masked")).drop("span")


def format_conversations(
    conversations: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The nodes of the prefix forest, and the node of each turn of each conversation.

    Nodes: ``tree`` (path of the root), ``path``, ``depth``, ``formatted``, ``ids``, ``start`` and ``size`` (tokens, in the
    depth-first sequence of the tree), ``position`` (of the first token in its conversation), ``ancestors`` (array of
    ``low``, ``high``, end exclusive), and the loss mask: ``learned`` (characters of ``formatted``) and ``masked`` (places in
    ``ids``), both ``low``, ``high``, end exclusive, null for other roles than the assistant's. Turns: ``conv``, ``depth``, ``path``.

    Turns are ordered by ``turn``, ties by role and text; rows repeated whole are turns of their own; null roles and texts
    count as empty; rows with a null conversation id form one conversation. Other columns are ignored; an empty table gives
    empty results. One conversation's path, 24 bytes a turn, has to fit a row; trees and shared turns may be of any size.
    """
    turns = materialize(turn_rows(conversations, conv_id, turn, role, text), "turns")
    texts = turns.groupBy("path").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    low = F.length(formatted(F.col("role"), F.lit(""))) - len(CLOSE)
    span = F.struct(low.cast("long").alias("low"), (low + F.length(escaped(F.col("text")))).cast("long").alias("high"))
    texts = texts.withColumn("span", span).withColumn("learned", F.when(F.col("role") == LEARNED, F.col("span")))
    texts = texts.select("path", formatted(F.col("role"), F.col("text")).alias("formatted"), "span", "learned")
    texts = materialize(token_ids(texts, tokenizer).withColumn("size", F.size("ids").cast("long")), "node-texts")

    # Conversations in the order of their paths are the leaves from left to right; a node belongs to its first one.
    leaves = turns.groupBy("conv").agg(F.array_sort(F.collect_list("path")).alias("route"))
    leaves = leaves.select(F.struct("conv").alias("key"), F.get("route", F.lit(0)).alias("tree"), "route")
    leaves = leaves.repartitionByRange("tree", "route", "key").sortWithinPartitions("tree", "route", "key")
    leaves = materialize(leaves.withColumn("leaf", F.monotonically_increasing_id()).select("key", "tree", "leaf"), "leaves")
    placed = turns.select(F.struct("conv").alias("key"), "depth", "path").join(leaves, "key")
    owners = placed.groupBy("path").agg(F.min("leaf").alias("owner"))
    sized = materialize(placed.join(owners, "path").join(texts.select("path", "size"), "path"), "placed")

    # Where the own nodes of each leaf begin: sums over runs of leaves of one tree in one partition, then inside them.
    own = sized.where("owner = leaf").groupBy("tree", "leaf").agg(F.sum("size").alias("own"), F.min("depth").alias("from"))
    own = own.withColumn("run", F.shiftright("leaf", 33))
    runs = own.groupBy("tree", "run").agg(F.sum("own").alias("total"))
    runs = runs.withColumn("ahead", F.coalesce(F.sum("total").over(W.partitionBy("tree").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("own").over(W.partitionBy("tree", "run").orderBy("leaf").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begin = own.join(runs, ["tree", "run"]).select("tree", F.col("leaf").alias("owner"), (F.col("ahead") + inside).alias("begin"), "from")

    # Along each conversation: tokens before a node, and before it among the nodes of the same owner.
    before = W.partitionBy("key").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    among = W.partitionBy("key", "owner").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    spots = sized.withColumn("position", F.coalesce(F.sum("size").over(before), F.lit(0)))
    spots = spots.withColumn("inside", F.coalesce(F.sum("size").over(among), F.lit(0)))
    spots = materialize(spots.join(begin, ["tree", "owner"]).withColumn("start", F.col("begin") + F.col("inside")), "spots")
    runs_of = spots.groupBy("key", "leaf", "owner").agg(F.min("depth").alias("depth"), F.struct(F.min("start").alias("low"), F.max(F.col("start") + F.col("size")).alias("high")).alias("span"))
    above = runs_of.where("owner <> leaf").groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "span"))), lambda s: s["span"]).alias("above"))
    nodes = spots.where("owner = leaf").join(above, "leaf", "left").join(texts.drop("size"), "path")
    first = F.col("start") - F.col("inside")
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    mine = F.when(F.col("inside") > 0, F.array(F.struct(first.alias("low"), F.col("start").alias("high")))).otherwise(none)
    nodes = nodes.select(
        "tree", "path", "depth", "formatted", "ids", "start", "size", "position", F.concat(F.coalesce("above", none), mine).alias("ancestors"),
        "learned", "masked",
    )
    return nodes, turns.select("conv", "depth", "path")


def read_back(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations from the formatted nodes: ``conv`` and ``turns`` (``role``, ``text``, ``formatted`` and ``loss``, the text under
    the loss mask, unescaped, in order)."""
    under = unescaped(F.substring("formatted", F.col("learned.low").cast("int") + 1, (F.col("learned.high") - F.col("learned.low")).cast("int")))
    read = nodes.select("path", "formatted", parsed(F.col("formatted")).alias("said"), F.coalesce(under, F.lit("")).alias("loss"))
    said = F.struct("depth", "said.role", "said.text", "formatted", "loss")
    return turns.join(read, "path").groupBy("conv").agg(F.array_sort(F.collect_list(said)).alias("turns"))
