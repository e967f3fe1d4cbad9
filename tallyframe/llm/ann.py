"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations (iterative quantization on a bounded sample). A code is cut into
substrings, and each substring is an index of its own. Two codes within Hamming distance r agree in some substring up to
r / substrings, so that probing every substring up to that distance retrieves each code within r; what is retrieved is
ranked by the distance of the original vectors. The index is dealt to shards of bounded size, and every query visits every shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import share

BITS = 128
SUBSTRINGS = 16
SHARD = 8192
QUERIES = 256
# Number of ones of each byte, and the bytes within each distance of each byte.
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
DISTANCE = ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass
class BinaryCodes:
    """Mean, rotations (``[dimension, bits]``) and the Hamming radius that held the wanted share of true neighbours."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """``[vector, substring]`` bytes."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def learn_codes(sample: np.ndarray, k: int = 10, share: float = 0.975, rounds: int = 30, probes: int = 200) -> BinaryCodes:
    """Rotations that bring the sample close to the corners of a cube, and the radius by its own neighbours.

    Neighbours in a sample lie farther apart than in the whole table, so the radius errs on the large side.
    """
    mean = sample.mean(0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:BITS]
    turns, have, seed = [], 0, 0
    while have < BITS:
        flat = centred @ axes.T
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(axes), len(axes))))[0]
        for _ in range(rounds):
            corners = np.where(flat @ turn > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(corners.T @ flat)
            turn = (u @ v).T
        turns.append(axes.T @ turn)
        have += len(axes)
        seed += 1
    codes = BinaryCodes(mean, np.hstack(turns)[:, :BITS], BITS)
    if len(sample) > k + 1:
        bytes_ = codes.encode(sample)
        found = []
        for at in range(0, len(sample), max(1, len(sample) // probes)):
            far = np.sqrt(((sample - sample[at]) ** 2).sum(1))
            far[at] = np.inf
            nearest = np.argpartition(far, k)[:k]
            found.append(ONES[bytes_[nearest] ^ bytes_[at]].sum(1))
        codes.radius = int(np.quantile(np.concatenate(found), share))
    return codes


class Shard:
    """One index per substring: the shard's rows in the order of the substring's byte."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(SUBSTRINGS)]
        self.start = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the radius, by probing every substring up to its share of it."""
        reach = radius // SUBSTRINGS
        if reach >= 8:
            hit = np.arange(len(self.codes))
        else:
            seen = np.zeros(len(self.codes), bool)
            for j in range(SUBSTRINGS):
                order, start = self.order[j], self.start[j]
                for byte in np.flatnonzero(DISTANCE[code[j]] <= reach).tolist():
                    if start[byte] < start[byte + 1]:
                        seen[order[start[byte] : start[byte + 1]]] = True
            hit = np.flatnonzero(seen)
        return hit[ONES[self.codes[hit] ^ code].sum(1, dtype=np.int64) <= radius]


def usable(vector: Column) -> Column:
    """Neither null nor zero, no null and no non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", id_col: str = "vec_id", sample_rows: int = 4096,
) -> DataFrame:
    """The ``k`` nearest rows found for each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean distance).

    A query never finds rows with its own id; ties go to the smaller id; a query with fewer candidates gets all of them.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Vectors are compared
    with vectors of their own length. Repeated rows count once. Other columns are ignored; empty tables give an empty result.

    Of equal vectors only the ``k + 1`` with the smallest ids can be among the nearest, so no more of them are indexed.
    The codes are learned on about ``sample_rows`` vectors per length; every row is indexed.
    """
    def cleaned(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return own.where(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("size", F.size("v"))

    base = cleaned(rows).distinct()
    asked = cleaned(queries).distinct()
    base = base.withColumn("_turn", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).where(F.col("_turn") <= k + 1).drop("_turn")
    sizes = {r["size"]: r["n"] for r in base.groupBy("size").agg(F.count("*").alias("n")).collect()}
    asked_sizes = {r["size"]: r["n"] for r in asked.groupBy("size").agg(F.count("*").alias("n")).collect()}
    kind = rows.schema[id_col].dataType.simpleString()
    found = rows.sparkSession.createDataFrame([], f"query_id {kind}, vec_id {kind}, score double")
    for size, count in sizes.items():
        if size in asked_sizes:
            found = found.union(shard_search(base.where(F.col("size") == size), asked.where(F.col("size") == size), count, asked_sizes[size], k, kind, sample_rows))
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def shard_search(base: DataFrame, asked: DataFrame, count: int, questions: int, k: int, kind: str, sample_rows: int) -> DataFrame:
    space = 1 << 30
    drawn = base.where(F.pmod(F.xxhash64("id"), F.lit(space)) < min(space, space * sample_rows // count + 1)).select("id", "v").collect()
    drawn.sort(key=lambda r: str(r["id"]))
    sample = np.array([r["v"] for r in drawn] or [base.select("v").first()["v"]])
    shared = share(base.sparkSession, learn_codes(sample, k))
    shards, groups = -(-count // SHARD), -(-questions // QUERIES)
    left = base.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = asked.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("part"))

    def search(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(ask):
            codes = shared()
            x, q = np.stack(own["v"].to_numpy()), np.stack(ask["v"].to_numpy())
            ids = own["id"].to_numpy()
            shard, asked_codes = Shard(codes.encode(x)), codes.encode(q)
            for at, query in enumerate(ask["id"].tolist()):
                radius = codes.radius
                while True:
                    hit = shard.within(asked_codes[at], radius)
                    hit = hit[ids[hit] != query]
                    if len(hit) >= k or radius >= BITS:
                        break
                    radius += SUBSTRINGS
                far = np.sqrt(((x[hit] - q[at]) ** 2).sum(1))
                table = pd.DataFrame({"query_id": query, "vec_id": ids[hit], "score": far})
                out.append(table.sort_values(["score", "vec_id"]).drop_duplicates("vec_id").head(k))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["shard", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, f"query_id {kind}, vec_id {kind}, score double")
