"""Near-duplicate documents by HyperMinHash.

The shingles of a text are dealt to 128 registers by the first bits of their hash; each register keeps the smallest
remainder as a 16-bit number, its leading zeros and ten bits after the first one. Bands of neighbouring registers are
compared as they are. Documents that share a band are estimated on all registers, corrected for chance collisions, and
what passes is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graphs import connected_components
from ..session import materialize
from .blocks import mix
from .keys import lookup
from .tokens import forget_encoders
from .words import shingle_sets

REGISTERS = 128
MANTISSA = 10
# The bands and size classes are proven from this similarity on.
LEAST_PERCENT = 80
# Links of sets with fewer shingles are found for certain.
SMALL = 64
PREFIX = 0x3C6EF372FE94F82B
BLOCK = 128


def least_estimate(percent: int) -> float:
    """Estimates below this are dropped: eight deviations of the estimate at a similarity of ``percent``, 0.60 for 85 and 0.52 for 80."""
    share = percent / 100
    return share - 8 * (share * (1 - share) / REGISTERS) ** 0.5


def registers(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``[text, register]`` of sorted distinct hashes; 0 where no shingle fell."""
    out = np.zeros((len(sizes), REGISTERS), np.uint16)
    if not len(sets):
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bucket = (sets >> np.uint64(57)).astype(np.int64)
    spot = owner * REGISTERS + bucket
    # Hashes are sorted, so the first of each register is its smallest.
    first = np.concatenate([[True], spot[1:] != spot[:-1]])
    rest = (sets[first] << np.uint64(7)) | np.uint64(1)
    high = np.floor(np.log2(rest.astype(np.float64))).astype(np.int64).clip(0, 63)
    zeros = (63 - high).astype(np.uint64)
    mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    out.ravel()[spot[first]] = ((zeros.clip(0, 62) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16) + np.uint16(1)
    return out


def band_keys(marks: np.ndarray, sets: np.ndarray, sizes: np.ndarray, percent: int) -> list[np.ndarray]:
    """Band keys of each text.

    From 64 shingles on there are 32 bands of 4 registers. At a similarity of 0.85 a band agrees with probability 0.52, and
    none of 32 agrees with 6e-11; at 0.80 these are 0.41 and 5e-8. Smaller sets have fewer, wider bands of two to four
    shingles each, and a set near the next size class is put into both. An empty band has no key. A set with fewer than 64
    shingles, or one that may link with such a set, has a band in common with each set it links with if more of its bands
    hold shingles than shingles can differ. Where they do not, it also gets prefix keys, its smallest hashes, one more than
    can be missing from the other set: of two linked sets without a common band both have them, and they share one.
    """
    packed = np.ascontiguousarray(marks).view(np.uint64)
    found: dict[int, np.ndarray] = {}
    for bands in (2, 4, 8, 16, 32):
        group = packed.reshape(len(marks), bands, 32 // bands)
        key = np.full(group.shape[:2], bands, np.uint64) * np.uint64(64) + np.arange(bands, dtype=np.uint64)
        for k in range(group.shape[2]):
            key = mix(key ^ group[:, :, k])
        found[bands] = np.where(group.any(axis=2), key, np.uint64(0))
    out = []
    begin = 0
    for row, size in enumerate(sizes.tolist()):
        low, high = (next((b for top, b in ((8, 2), (16, 4), (32, 8), (64, 16)) if n < top), 32) for n in (size, size * 100 / percent))
        classes = [found[b][row][found[b][row] != 0] for b in ((low,) if low == high else (low, high))]
        differing = size * (100 - percent) // percent
        if size * percent < SMALL * 100 and min(len(c) for c in classes) <= differing:
            prefix = size - -(-size * percent // 100) + 1
            classes.append(mix(sets[begin : begin + min(prefix, size)] ^ np.uint64(PREFIX)))
        out.append(np.concatenate(classes).view(np.int64))
        begin += size
    return out


def signatures(docs: DataFrame, text: str, id_col: str, percent: int) -> DataFrame:
    """Per row: ``id``, ``n`` shingles, set digest ``d1``, ``d2``, ``marks`` (registers) and ``keys`` (bands)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for row, stop, sets, sizes in shingle_sets(batch.column(1)):
                marks = registers(sets, sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.concatenate([[0], np.cumsum(mix(sets ^ np.uint64(salt)))]).astype(np.uint64) for salt in (0x5851F42D, 0x14057B7E)]
                d1, d2 = ((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)
                keys = band_keys(marks, sets, sizes, percent)
                flat = pa.array(marks.view(np.uint8).reshape(-1), pa.uint8()).buffers()[1]
                spots = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * 2 * REGISTERS).buffers()[1]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)), pa.array(np.concatenate(keys) if keys else [], pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.array(sizes), pa.array(d1), pa.array(d2), pa.Array.from_buffers(pa.binary(), len(sizes), [None, spots, flat]), lists],
                    ["id", "n", "d1", "d2", "marks", "keys"],
                )

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(sign, f"id {kind}, n long, d1 long, d2 long, marks binary, keys array<long>")


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Jaccard similarity from registers (last axis), less the registers expected to agree by chance.

    Two registers of different sets agree by chance with a probability of about 0.34 divided by the number of mantissas,
    less where the sets differ in size or leave registers empty. Each differing shingle spoils one register at most: where one
    set is small and no more registers differ than linked sets may differ in shingles, the result is ``least_estimate`` at least.
    """
    either = (left != 0) | (right != 0)
    total = either.sum(-1)
    agree = ((left == right) & either).sum(-1)
    a, b = n_left / REGISTERS, n_right / REGISTERS
    chance = 2 * 0.169919 / (1 << MANTISSA) * 4 * a * b / (a + b) ** 2 * (1 - np.exp(-a)) * (1 - np.exp(-b))
    by_chance = chance * REGISTERS
    out = np.clip((agree - by_chance) / np.maximum(total - by_chance, 1e-9), 0, 1)
    near = (np.minimum(n_left, n_right) < SMALL) & ((total - agree) * (100 + percent) <= (n_left + n_right) * (100 - percent))
    return np.where(near, np.maximum(out, least_estimate(percent)), out)


def mark_matrix(marks) -> np.ndarray:
    return np.frombuffer(b"".join(marks), np.uint16).reshape(-1, REGISTERS)


def estimated(percent: int) -> Callable:
    @F.arrow_udf(T.DoubleType())
    def compare(left: pa.Array, right: pa.Array, n_left: pa.Array, n_right: pa.Array) -> pa.Array:
        sizes = [np.asarray(n.to_numpy(zero_copy_only=False), np.float64) for n in (n_left, n_right)]
        return pa.array(estimate(mark_matrix(left.to_pylist()), mark_matrix(right.to_pylist()), *sizes, percent))

    return compare


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def shingle_table(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """``id``, ``shingles``: the distinct shingle hashes of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, sets, sizes in shingle_sets(batch.column(1)):
                spots = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(spots, pa.array(sets.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), lists], ["id", "shingles"])

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(collect, f"id {kind}, shingles array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, text: str, id_col: str, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough; sets are built anew for the texts in question alone."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "wanted")
    few = lookup(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), wanted, wanted.count(), "_id", "left_semi")
    sets = materialize(shingle_table(few, "_text", "_id").dropDuplicates(["id"]), "sets")
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"id": "a", "shingles": "left"}), "a")
    both = both.join(sets.withColumnsRenamed({"id": "b", "shingles": "right"}), "b")
    shared = F.size(F.array_intersect("left", "right"))
    return both.withColumn("_shared", shared).where(
        100 * F.col("_shared") >= percent * (F.size("left") + F.size("right") - F.col("_shared"))
    ).select("a", "b")


def paired_blocks(members: DataFrame, key: str, size: str) -> DataFrame:
    """Members of each group dealt to blocks of about 128, and a unit of work per pair of blocks: ``key``, ``low``, ``high``.

    A unit holds two blocks at most, so that no task holds a group, however large.
    """
    rows = members.withColumn("_blocks", F.ceil(F.col(size) / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), "_blocks").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")}).drop("_blocks", "_other")
    return rows.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def whole_units(batches, key: str):
    """Frames of whole units with the bounds of each unit, from batches that may cut through units."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        spots = rest[[key, "low", "high"]].to_numpy()
        cut = np.flatnonzero((spots[1:] != spots[:-1]).any(axis=1)) + 1
        if len(cut):
            yield rest.iloc[: cut[-1]], np.concatenate([[0], cut])
            rest = rest.iloc[cut[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        spots = rest[[key, "low", "high"]].to_numpy()
        yield rest, np.concatenate([[0], np.flatnonzero((spots[1:] != spots[:-1]).any(axis=1)) + 1, [len(rest)]])


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """Pairs that suffice to join what all pairs join."""
    parent: dict = {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for x, y in set(zip(a.tolist(), b.tolist())):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((max(x, y), min(x, y)))
    return out


def close_roots(frame: pd.DataFrame, bounds: np.ndarray, percent: int) -> list[tuple]:
    """Pairs of components with members that share a unit and pass the estimate, as a forest per unit."""
    marks, n = mark_matrix(frame["marks"]), frame["n"].to_numpy(np.float64)
    root, block = frame["root"].to_numpy(), frame["block"].to_numpy()
    inside = (frame["low"] == frame["high"]).to_numpy()
    sizes, out = np.diff(bounds), []

    def passing(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        able = (root[i] != root[j]) & (inside[i] | (block[i] != block[j]))
        able &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
        i, j = i[able], j[able]
        parts = [(i[at : at + 50_000], j[at : at + 50_000]) for at in range(0, len(i), 50_000)]
        near = [estimate(marks[p], marks[q], n[p], n[q], percent) for p, q in parts]
        good = np.concatenate(near) >= least_estimate(percent) if near else np.zeros(0, bool)
        return root[i[good]], root[j[good]]

    for size in range(2, 9):
        starts, (i, j) = bounds[:-1][sizes == size], np.triu_indices(size, 1)
        for at in range(0, len(starts), 5000):
            some = starts[at : at + 5000, None]
            out += forest(*passing((some + i).ravel(), (some + j).ravel()))
    for low, high in zip(bounds[:-1][sizes > 8].tolist(), bounds[1:][sizes > 8].tolist()):
        i, j = np.triu_indices(high - low, 1)
        out += forest(*passing(low + i, low + j))
    return out


def linked_roots(frame: pd.DataFrame, bounds: np.ndarray, percent: int) -> list[tuple]:
    """Pairs of components that a link joins, by the exact intersections of all pairs of a unit, as a forest per unit."""
    out = []
    ids, n = frame["root"].to_numpy(), frame["n"].to_numpy(np.float64)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        root, size = ids[low:high], n[low:high]
        if high - low < 2 or (root == root[0]).all():
            continue
        own = frame["shingles"].iloc[low:high].tolist()
        owner = np.repeat(np.arange(high - low), [len(s) for s in own])
        _, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((high - low, high - low), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            part = slice(*np.searchsorted(column, [at, at + 4096]))
            held = np.zeros((high - low, 4096), np.float32)
            held[owner[part], column[part] - at] = 1
            both += held @ held.T
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        i, j = np.nonzero(np.triu(linked & (root[:, None] != root[None, :]), 1))
        out += forest(root[i], root[j])
    return out


def scan_units(rows: DataFrame, key: str, compare, percent: int, kind: str) -> DataFrame:
    def scan(batches):
        for frame, bounds in whole_units(batches, key):
            yield pd.DataFrame(compare(frame, bounds, percent), columns=["a", "b"])

    return rows.mapInPandas(scan, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = 85) -> DataFrame:
    """Near-duplicate class of every row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if ``100 * |A ∩ B| >= percent * |A ∪ B|`` for their shingle sets. ``component_id`` is the
    smallest id that links lead to, and ``kept`` marks its row. Null, empty and blank texts have no shingles and link with
    nothing, nor does a row with a null id (its component is null and it is kept). Rows that share an id are one node; each
    of them gets its own row. Other columns are ignored; an empty table gives an empty result. ``percent`` may not be
    below 80, for which the bands are made.

    Equal sets are one node from the start. In each band, members are first compared with the smallest one. Where a band
    then still joins several components, all its members are estimated against each other, and components that come near
    each other form a cluster, in which every pair is settled by exact intersections.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the bands find similarities of {LEAST_PERCENT} percent and more")
    signed = materialize(signatures(docs, text, id_col, percent), "signatures")
    able = signed.where("n > 0 AND id IS NOT NULL")
    classes = materialize(able.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "classes")
    nodes = able.join(classes, ["d1", "d2", "n"]).where("id = rep").dropDuplicates(["id"]).select("id", "n", "marks", "keys")
    nodes = materialize(nodes, "nodes")
    bands = nodes.select("id", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = materialize(bands.join(materialize(shared, "bands"), "key"), "members")
    facts = nodes.select("id", "n", "marks")

    def named(side: str) -> DataFrame:
        return facts.withColumnsRenamed({"id": side, "n": f"n_{side}", "marks": f"marks_{side}"})

    stars = members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    stars = stars.join(named("a"), "a").join(named("b"), "b").where(similar_sizes(F.col("n_a"), F.col("n_b"), percent))
    stars = stars.withColumn("estimate", estimated(percent)("marks_a", "marks_b", "n_a", "n_b")).where(F.col("estimate") >= least_estimate(percent))
    best = materialize(stars.groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b")), "stars")
    linked = materialize(confirmed(best, docs, text, id_col, percent), "links")
    roots = connected_components(linked)

    placed = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    torn = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = placed.join(materialize(torn, "torn"), "key").join(facts, "id").select("key", "id", "root", "n", "marks", "size")
    kind = docs.schema[id_col].dataType.simpleString()
    close = scan_units(paired_blocks(rest, "key", "size"), "key", close_roots, percent, kind)
    clusters = connected_components(close).withColumnsRenamed({"root": "cluster", "node": "root"})
    # Components whose members come near each other: all members of such a cluster are compared, each pair once.
    inside = nodes.select("id", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    inside = materialize(inside.join(clusters, "root"), "clusters")
    inside = inside.join(inside.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")
    few = lookup(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), inside.select(F.col("id").alias("_id")), inside.count(), "_id", "left_semi")
    sets = shingle_table(few, "_text", "_id").dropDuplicates(["id"])
    units = paired_blocks(inside.join(sets, "id"), "cluster", "size")
    more = materialize(scan_units(units, "cluster", linked_roots, percent, kind), "more-links")
    roots = connected_components(linked.union(more))

    nodes_of = signed.select("id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    out = nodes_of.join(roots.withColumnsRenamed({"node": "rep"}), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
