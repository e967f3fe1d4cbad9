"""Quality classifier: a generalized additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature at a time, leaves one lookup table per feature and one per chosen pair of
features. A score is the sum of the table entries of a text's bins.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import powers, row_blocks, text_bytes
from .keys import lookup
from .shared import share
from .words import BASE, BLOCK, word_hashes

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "marks", "beyond_ascii", "lines", "symbol_endings",
    "repeated_next", "distinct_words", "top_word", "long_words",
]
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(ord("A"), ord("Z") + 1)]] = 1
CLASS[[*range(ord("0"), ord("9") + 1)]] = 2
CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 3
CLASS[[ord(c) for c in ".,"]] = 4
CLASS[0x80:] = 5
CLASS[ord("\n")] = 6


def features(texts: pa.Array) -> np.ndarray:
    """``[text, feature]``; zeros for null and empty texts."""
    data, starts = text_bytes(texts)
    out = np.zeros((len(starts) - 1, len(FEATURES)))
    size, tables = 0, None
    for row, stop in row_blocks(starts, BLOCK):
        low, high = int(starts[row]), int(starts[stop])
        if high - low > size or tables is None:
            size = max(BLOCK, high - low)
            tables = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
        out[row:stop] = block_features(data[low:high], starts[row : stop + 1] - low, tables)
    return out


def block_features(data: np.ndarray, bounds: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    texts = len(bounds) - 1
    length = np.diff(bounds).astype(np.float64)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    kinds = CLASS[data]
    share = [np.bincount(owner, kinds == k, texts) / np.maximum(length, 1) for k in range(7)]
    words, counts = word_hashes(data, bounds, tables)
    ends = np.cumsum(counts)
    n = np.maximum(counts, 1).astype(np.float64)
    mine = np.repeat(np.arange(texts), counts)
    again = np.zeros(texts)
    if len(words) > 1:
        again = np.bincount(mine[1:], (words[1:] == words[:-1]) & (mine[1:] == mine[:-1]), texts)
    distinct, top = np.zeros(texts), np.zeros(texts)
    for at, (end, count) in enumerate(zip(ends.tolist(), counts.tolist())):
        if count:
            own = np.sort(words[end - count : end])
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[at], top[at] = len(edge) - 1, np.diff(edge).max()
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    last = np.zeros(len(data), bool)
    if len(data):
        last = ~space
        last[:-1] &= space[1:] | (owner[1:] != owner[:-1])
    odd_end = np.bincount(owner, last & (kinds == 3), texts)
    inner = np.bincount(owner, ~space, texts)
    spaces = np.flatnonzero(last)
    run = np.diff(np.concatenate([[-1], spaces]))
    long_words = np.bincount(owner[spaces], run > 15, texts) if len(spaces) else np.zeros(texts)
    return np.column_stack([
        np.log1p(length), np.log1p(counts), inner / n, share[1], share[2], share[3], share[4], share[5], share[6] * length / n, odd_end / n,
        again / n, distinct / n, top / n, long_words / n,
    ])


@dataclass
class QualityModel:
    """Bin edges of each feature, one table per feature, and ``(feature, feature, table)`` per pair."""

    edges: list[np.ndarray]
    base: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.single):
            total += table[b[:, i]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton step per bin of a tree with few leaves over ordered bins."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, spot = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
                gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
                better = gain(gl, hl) + gain(gs - gl, hs - hl) - gain(gs, hs)
                at = int(np.argmax(better))
                if better[at] > best:
                    best, spot = better[at], lo + at + 1
        if spot is None:
            break
        cuts = sorted([*cuts, spot])
    step = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        step[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return step


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and Newton step of the best tree with one cut on each of two features."""
    parts = []
    for x in (g, h):
        c = x.cumsum(0).cumsum(1)
        a, row, column = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        parts.append((a, row - a, column - a, c[-1, -1] - row - column + a))
    total = sum(gain(x, y) for x, y in zip(*parts)) - gain(g.sum(), h.sum())
    if not total.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    step = np.zeros_like(g)
    for at, spot in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[spot] = parts[0][at][i, j] / (parts[1][at][i, j] + 1.0)
    return float(total[i, j]), step


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 6, rate: float = 0.15) -> QualityModel:
    """Cyclic boosting: features in turn, then the pairs whose quadrants explain most of what is left."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
    positive = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = QualityModel(edges, float(np.log(positive / (1 - positive))), [np.zeros(len(e) + 1) for e in edges], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, table in enumerate(model.single):
            g, h = slopes()
            step = rate * shallow_tree(np.bincount(b[:, i], g, len(table)), np.bincount(b[:, i], h, len(table)))
            table += step
            total += step[b[:, i]]

    def square(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(model.single[i]), len(model.single[j])
        return np.bincount(b[:, i] * shape[1] + b[:, j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -quadrants(square(*p, g), square(*p, h))[0])
    model.pairs = [(i, j, np.zeros((len(model.single[i]), len(model.single[j])))) for i, j in ranked[:pairs]]
    for _ in range(rounds // 2):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * quadrants(square(i, j, g), square(i, j, h))[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", label_id: str = "doc_id", sample_rows: int = 20_000,
) -> QualityModel:
    """Fit on about ``sample_rows`` labelled documents at most, drawn by a hash of the id; only their features reach the driver.

    Rows with a null label or id teach nothing; a null text counts as empty. Without labels, or with one label alone, the
    score is the share of label 1 (0.5 without any).
    """
    rows = labels.select(F.col(label_id).alias("_id"), F.col(label).cast("double").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").distinct()
    space = 1 << 30
    size = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("_id"), F.lit(space)) < min(space, space * sample_rows // max(size, 1)))
    marked = lookup(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), drawn, min(size, 2 * sample_rows), "_id")

    @F.arrow_udf("array<double>")
    def measured(values: pa.Array) -> pa.Array:
        return pa.array(list(features(values)), pa.list_(pa.float64()))

    found = marked.select("_y", measured("_text").alias("x")).collect()
    found.sort(key=lambda r: (r["_y"], r["x"]))
    x = np.array([r["x"] for r in found], np.float64).reshape(-1, len(FEATURES))
    return fit_tables(x, np.array([r["_y"] for r in found], np.float64))


def quality_column(df: DataFrame, text: Column, model: QualityModel) -> Column:
    shared = share(df.sparkSession, model)

    @F.arrow_udf("double")
    def scored(values: pa.Array) -> pa.Array:
        return pa.array(shared().score(features(values)))

    return scored(text)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Quality of every whole text: ``id_col``, ``score`` in 0 to 1.

    One row per input row, repeated rows included; null and empty texts have a score as well; other columns are ignored.
    """
    return docs.select(F.col(id_col), quality_column(docs, F.col(text), model).alias("score"))
