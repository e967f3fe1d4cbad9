"""Compression of vectors to codes of small codebooks, by a walk over the trie of their distinct parts.

A component x becomes the integer floor(256 x), a vector is cut into equal consecutive parts, and every part position has a
codebook. Distinct parts with their numbers of rows are laid out in lexicographic order, so that the walk over them is a
depth-first traversal of their trie: the distances of a prefix to all entries are summed up once and shared by all parts
below it; a leaf takes the nearest entry and adds its weighted components to that entry's sums. Only these sums, a few numbers
per codebook entry and task, are ever shuffled in a round. Vectors are coded where they lie, by the same walk over the parts of
a batch, so no vector is moved and no group of equal vectors meets in one task.

Vectors that are null, empty, hold null or non-finite components, or differ in length from the first kept one, or whose
length is no multiple of the number of parts, take no part. Integers are held within ±2^24, where all sums are exact; vectors
that repeat an id are rows of their own, ordered by their integers; null ids come last. With fewer vectors than entries the
codebooks have one entry per vector. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .keys import join_groups

SCALE, BOUND = 256, 1 << 24
# Parts whose distances to all entries are held at a time.
SLICE = 8192


class Walk:
    """Depth-first walk over parts that come in lexicographic order, slice by slice.

    ``sums[i]`` holds the distances of the current path's first i + 1 components to all entries. Within a slice the new
    nodes of each level are computed together from the sums of their parents; a prefix that goes on from the slice before is
    not computed again. Parts in another order get the same result and share less.
    """

    def __init__(self, book: np.ndarray):
        self.book, self.last = book, None
        self.sums = [np.zeros((1, len(book)), np.int64) for _ in range(book.shape[1])]

    def step(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (the lower index on ties) and squared distance of each part."""
        before = np.vstack([parts[:1] if self.last is None else self.last, parts[:-1]])
        shared = np.logical_and.accumulate(parts == before, axis=1)
        if self.last is None:
            shared[0] = False
        above, parent = np.zeros((1, len(self.book)), np.int64), np.zeros(len(parts), np.int64)
        for level in range(parts.shape[1]):
            new = ~shared[:, level]
            at = np.flatnonzero(new)
            gap = parts[at, level][:, None] - self.book[:, level]
            above = np.vstack([self.sums[level], above[parent[at]] + gap * gap])
            parent = np.cumsum(new)
            self.sums[level] = above[-1:]
        self.last = parts[-1:]
        nearest = above.argmin(axis=1)
        return nearest[parent], above[np.arange(len(above)), nearest][parent]


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distances of parts in any order, over the trie of the distinct ones."""
    order = np.lexsort(parts.T[::-1])
    ranked, walk = parts[order], Walk(book)
    codes, gaps = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for low in range(0, len(parts), SLICE):
        chunk = slice(low, low + SLICE)
        codes[order[chunk]], gaps[order[chunk]] = walk.step(ranked[chunk])
    return codes, gaps


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """``id``, ``label``, ``ints`` of all vectors that take part, and their length (0 if none does)."""
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & (F.size(vec_col) % parts == 0) & sound)

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int")

    rows = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vec_col, whole).alias("ints"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints").select(F.size("ints")).first()
    length = first[0] if first else 0
    return rows.where(F.size("ints") == length), length


def distinct_parts(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """``place``, ``part``, ``n``: each distinct part of each position with its number of rows, in lexicographic order per file."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("ints", p * width + 1, width))
    counted = vectors.select(F.posexplode(cut).alias("place", "part")).groupBy("place", "part").agg(F.count("*").alias("n"))
    return materialize(counted.repartitionByRange("place", "part").sortWithinPartitions("place", "part"), "parts")


def entry_sums(books: np.ndarray):
    """Function over Arrow batches of distinct parts: per codebook entry the number of rows (item ``width``) and the sums of their
    components (items below), as rows ``slot``, ``total``."""
    places, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((places, entries, width + 1), np.int64)
        walks = [Walk(book) for book in books]
        for batch in batches:
            place = batch.column("place").to_numpy(zero_copy_only=False)
            rows, n = matrix(batch.column("part"), width), batch.column("n").to_numpy(zero_copy_only=False)
            for p in np.unique(place):
                own = place == p
                weights, mine = n[own], rows[own]
                for low in range(0, len(mine), SLICE):
                    part, weight = mine[low : low + SLICE], weights[low : low + SLICE]
                    codes, _ = walks[p].step(part)
                    np.add.at(totals[p], codes, np.column_stack([part, np.ones(len(part), np.int64)]) * weight[:, None])
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals.ravel()[used], pa.int64())], ["slot", "total"])

    return sums


def fit_codebooks(vectors: DataFrame, length: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks of all positions: ``entries`` first vectors, then ``rounds`` rounds over all distinct parts. Bounded by
    ``entries`` x ``length`` numbers, whatever the number of vectors."""
    width = length // parts
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    books = np.array([row.ints for row in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    table = distinct_parts(vectors, parts, width)
    for _ in range(rounds):
        found = table.mapInArrow(entry_sums(books), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
        totals = np.zeros((parts, len(first), width + 1), np.int64)
        for row in found:
            totals.flat[row.slot] = row.total
        used = totals[:, :, width] > 0
        books[used] = totals[used][:, :width] // totals[used][:, width:]
    return books


def coder(books: np.ndarray):
    """Function over Arrow batches of vectors: ``code`` and ``error`` next to ``id`` and ``label``."""
    places, _, width = books.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("ints"), places * width)
            codes, error = np.zeros((len(rows), places), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(places):
                codes[:, p], gaps = nearest_entries(rows[:, p * width : (p + 1) * width], books[p])
                error += gaps
            digits = codes.tobytes().hex()
            text = [digits[i : i + 2 * places] for i in range(0, len(digits), 2 * places)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return code


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place in the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2,
) -> DataFrame:
    """Per kept vector: id, label (both under their names), ``code`` (two hex digits per part), ``error`` (squared distance to
    its code), ``label_error`` (summed over the rows of its label, nulls together) and ``codebooks_sha256``."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kinds = dict(rows.dtypes)
    vectors, length = integer_vectors(rows, id_col, vec_col, label_col, parts)
    if not length:
        none = F.lit(None).cast("long")
        return vectors.where("false").select(F.col("id").alias(id_col), F.col("label").alias(label_col), F.lit("").alias("code"), none.alias("error"), none.alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = fit_codebooks(vectors, length, parts, entries, rounds)
    schema = f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"
    coded = materialize(vectors.mapInArrow(coder(books), schema), "codes").withColumn("key", F.struct("label"))
    labels = materialize(coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("size")), "labels")
    total = coded.count()
    out = join_groups(coded.withColumn("spot", F.monotonically_increasing_id()), labels, "key", F.col("spot"), total)
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
