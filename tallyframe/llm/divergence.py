"""Which sources of a language differ from one another, and by which terms.

Texts are cut into terms where they lie, and a block's equal terms are counted there. From then on only 64-bit digests of
terms are shuffled. The text of a term is written once per block; the smallest and the largest text behind a digest show
whether it stands for several terms, and such digests are split by the terms themselves. Texts are joined back for the
reported terms alone.

A term is a longest run of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that occur in
at least ``least`` of its documents (V of them). A group (language, source) or a language gives a kept term of which it has
``count`` the share p = 1 + floor(10^9 (count + 1) / (N + V)), N its occurrences of kept terms. The divergence of p from
q is floor((p - q)^2 / q). All arithmetic is exact.

Sums over all kept terms are built from what two sources have in common: a term that neither has counts alike for both, so
one product per pair stands for all of them; terms that one has are counted per number of occurrences; only terms that both
have are met one by one. Null texts, languages and sources are ''. Rows that repeat an id are documents of their own. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import materialize
from .blocks import mix, powers, row_blocks, text_bytes
from .keys import lookup

LEAST = 3
SHOWN = 200
UNIT = 1_000_000_000
BLOCK = 4 << 20
# Rows of blocks that are merged before they leave a task.
MERGED = 3 << 18
BASE = 0x9E6C63D0876A9A47  # odd, so that it has an inverse modulo 2**64
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_TERM = np.zeros(256, bool)
IN_TERM[ord("a") : ord("z") + 1] = IN_TERM[ord("A") : ord("Z") + 1] = IN_TERM[128:] = True


def terms_of(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a block of texts, one after another, and the number of terms of each text."""
    inside = IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    terms = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])])
    return terms, np.diff(np.searchsorted(begin, starts))


def counted(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted non-negative numbers, and how often each occurs."""
    begin = np.flatnonzero(np.diff(ranked, prepend=-1))
    return ranked[begin], np.diff(np.append(begin, len(ranked)))


def block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of texts, language, source and term: occurrences ``n`` and documents ``docs``."""
    for batch in batches:
        data, starts = text_bytes(batch.column("text"))
        langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
        lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
        for row, stop in row_blocks(starts, BLOCK):
            low, high = int(starts[row]), int(starts[stop])
            terms, counts = terms_of(data[low:high], starts[row : stop + 1] - low)
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            term, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(row, stop), counts)
            # Sorting plain numbers is several times as fast as sorting their places.
            size = len(coded.dictionary)
            pairs, n = counted(np.sort(doc * size + term))
            doc, term = pairs // size, pairs % size
            key = (lang[doc] * len(sources.dictionary) + source[doc]) * size + term
            order = np.argsort(key)
            begin = np.flatnonzero(np.diff(key[order], prepend=-1))
            at = order[begin]
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(lang[doc[at]])), sources.dictionary.take(pa.array(source[doc[at]])), coded.dictionary.take(pa.array(term[at])),
                pa.array(np.add.reduceat(n[order], begin), pa.int64()), pa.array(np.diff(np.append(begin, len(order))), pa.int64()),
            ], ["lang", "source", "term", "n", "docs"])


def merged_counts(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0

    def merged() -> pa.Table:
        table = pa.Table.from_batches(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return table.select(["lang", "source", "term", "n_sum", "docs_sum"]).combine_chunks()

    for block in blocks:
        held.append(block)
        size += block.num_rows
        if size >= MERGED:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


def term_hashes(terms: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of an array without nulls."""
    data, starts = text_bytes(terms)
    low, high = int(starts[0]), int(starts[-1])
    starts = starts - low
    total = np.zeros(high - low + 1, np.uint64)
    np.cumsum(BYTE_CODES[data[low:high]] * powers(BASE, high - low), out=total[1:])
    down = powers(pow(BASE, -1, 1 << 64), high - low + 1)
    return mix((total[starts[1:]] - total[starts[:-1]]) * down[starts[:-1]])


def term_counter(digest: Callable[[np.ndarray], np.ndarray], every_term: bool):
    """Function over Arrow batches of texts: counts per language, source and ``digest``, with the term's text on its first row of
    each block, or on all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in merged_counts(block_counts(batches)):
            columns = [c.chunk(0) for c in table.columns]
            coded = columns[2].dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            digests = digest(term_hashes(coded.dictionary)).view(np.int64)[codes]
            first = np.zeros(len(codes), bool)
            first[np.unique(codes, return_index=True)[1]] = True
            shown = columns[2].cast(pa.string())
            if not every_term:
                shown = pc.if_else(pa.array(first), shown, pa.scalar(None, pa.string()))
            rows = [columns[0].cast(pa.string()), columns[1].cast(pa.string()), pa.array(digests), shown, columns[3], columns[4]]
            yield from pa.Table.from_arrays(rows, ["lang", "source", "digest", "term", "n", "docs"]).to_batches(max_chunksize=100_000)

    return count


COUNTED = "lang string, source string, digest long, term string, n long, docs long"


def share(count: str | Column, size: str) -> Column:
    """1 + floor(10^9 (count + 1) / size), exact."""
    count = F.col(count) if isinstance(count, str) else count
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", scaled, F.col(size).cast("decimal(20,0)")) + 1


def gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def counted_terms(named: DataFrame, digest: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Counts per language, source and term, and the text of each term. A term is ``digest`` and ``twin``, which is '' unless
    the digest stands for several terms: then it is the term itself."""
    blocks = materialize(named.mapInArrow(term_counter(digest, False), COUNTED), "terms")
    texts = blocks.where("term IS NOT NULL").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    texts = materialize(texts, "texts")
    torn = materialize(texts.where("low <> high").select("digest"), "torn")
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    counts = blocks.groupBy("lang", "source", "digest").agg(*sums).withColumn("twin", F.lit(""))
    texts = texts.select("digest", F.lit("").alias("twin"), F.col("low").alias("term"))
    if (n_torn := torn.count()):
        again = materialize(lookup(named.mapInArrow(term_counter(digest, True), COUNTED), torn, n_torn, "digest", "left_semi"), "apart")
        apart = again.groupBy("lang", "source", "digest", F.col("term").alias("twin")).agg(*sums)
        counts = lookup(counts, torn, n_torn, "digest", "left_anti").select("lang", "source", "digest", "twin", "n", "docs").unionByName(apart)
        texts = lookup(texts, torn, n_torn, "digest", "left_anti").unionByName(again.select("digest", F.col("term").alias("twin"), "term").distinct())
    return materialize(counts, "counts"), texts


def audit_sources(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, shown: int = SHOWN,
    digest: Callable[[np.ndarray], np.ndarray] = lambda hashes: hashes,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``. Part ``pair``: the group's divergence from each other source of
    its language, over all kept terms. Part ``term``: the ``shown`` kept terms that the group has more often than its
    language, by divergence."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    counts, texts = counted_terms(named, digest)
    term = ["digest", "twin"]
    kept = counts.groupBy("lang", *term).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    cells = materialize(counts.drop("docs").join(kept, ["lang", *term]), "cells")
    langs = materialize(kept, "kept").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    none = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("v", none).alias("v"), (F.coalesce("total", none) + F.coalesce("v", none)).alias("size"), (F.coalesce("lang_total", none) + F.coalesce("v", none)).alias("lang_size"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, share(none, "size"))), "groups")
    n_groups = groups.count()
    cells = lookup(cells, groups, n_groups, ["lang", "source"]).withColumn("p", share("n", "size"))
    return ranked_pairs(cells, groups, term).unionByName(ranked_terms(cells, texts, term, shown))


def ranked_terms(cells: DataFrame, texts: DataFrame, term: list[str], shown: int) -> DataFrame:
    more = cells.withColumn("q", share("lang_n", "lang_size")).where("p > q").select("lang", "source", *term, gap("p", "q").alias("value"))
    group = W.partitionBy("lang", "source")
    # Ties need the texts to be put in order: all terms that tie with the last rank get theirs.
    near = more.withColumn("rank", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("rank") <= shown).drop("rank")
    named = near.join(texts, term).withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "term")))
    return named.where(F.col("rank") <= shown).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def ranked_pairs(cells: DataFrame, groups: DataFrame, term: list[str]) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    plain = groups.join(other, "lang").where(apart).select("lang", "source", "item", F.coalesce(F.col("v") * gap("p0", "q0"), F.lit(0).cast("long")).alias("value"))
    # Number of terms per count of occurrences: what a term adds where the other source lacks it depends on nothing else.
    sizes = cells.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("terms"))
    met = sizes.join(other, "lang").where(apart)
    own = met.select("lang", "source", "item", (F.col("terms") * (gap("p", "q0") - gap("p0", "q0"))).alias("value"))
    theirs = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * (gap("q0", "p") - gap("q0", "p0"))).alias("value"))
    left = cells.select("lang", *term, "source", "p", "p0")
    right = cells.select("lang", *term, F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = left.join(right, ["lang", *term]).where(apart)
    shared = gap("p", "q") - gap("p", "q0") - gap("p0", "q") + gap("p0", "q0")
    both = both.groupBy("lang", "source", "item").agg(F.sum(shared).alias("value"))
    summed = plain.unionByName(own).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
