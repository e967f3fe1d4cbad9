"""Language identification by cross-parsing against suffix automata of labelled text.

Per language, the suffix automaton of a bounded sample recognizes every substring of that sample. A text is cut greedily
into the longest phrases that occur in the sample; the language that needs the fewest phrases, weighted by the logarithm
of its sample's length, wins. The automata are dense tables, so a step of all blocks of a batch and all languages is one gather.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import share
from .tokens import forget_encoders

UNDETERMINED = "und"
GAP = 0  # code of everything between two runs of letters
OTHER = 1  # code of a letter that no sample has
LETTERS = 254
LANE = 2048  # letters parsed together; phrases end at a lane's end
BATCH_LETTERS = 1 << 20
ROWS = 200


@dataclass
class LanguageModel:
    """Dense automata of all languages; ``step[root[l] + state * width + code]`` is the next state, or its complement after a phrase."""

    languages: list[str]
    codes: np.ndarray
    width: int
    step: np.ndarray
    base: np.ndarray
    weight: np.ndarray


def letter_codes(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, runs of other characters as one gap, and the bounds of each text."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in lowered), np.int64, len(lowered))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = codes[points]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != GAP) | (out[:-1] != GAP)
    inner = bounds[:-1][lengths > 0]
    keep[inner] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[bounds]


def suffix_automaton(codes: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the minimal automaton of all substrings: ``[state, code]``, -1 where there is none."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes.tolist():
        current = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and code not in moves[state]:
            moves[state][code] = current
            state = link[state]
        if state >= 0:
            target = moves[state][code]
            if length[target] == length[state] + 1:
                link[current] = target
            else:
                twin = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state >= 0 and moves[state].get(code) == target:
                    moves[state][code] = twin
                    state = link[state]
                link[target] = link[current] = twin
        last = current
    table = np.full((len(moves), width), -1, np.int32)
    for state, out in enumerate(moves):
        for code, target in out.items():
            table[state, code] = target
    return table


def fit_language_model(
    labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_chars: int = 16_384,
    total_chars: int = 1 << 20, text_chars: int = 2048,
) -> LanguageModel:
    """Fit on at most ``sample_chars`` characters per language and ``total_chars`` over all languages.

    Rows with null text or language teach nothing. The sample follows a hash of id and text, so null or repeated ids are drawn
    like others; of one text at most ``text_chars`` characters enter it, so that it draws on many texts, and equal ones enter
    once. The model's size, and what is gathered for it, is bounded by these numbers and the number of languages alone.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    space = 1 << 30
    spot = F.pmod(F.xxhash64("key", "text"), F.lit(space))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("spot", spot)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("spot").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros(0x110000, np.uint8), 2, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    chars = max(64, min(sample_chars, total_chars // len(sizes)))
    wanted = 4 * -(-chars // 1024)
    limit = F.element_at(
        F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(space, space * wanted // max(n, 1) + 1))]), F.col("lang")
    )
    drawn = rows.where(F.col("spot") < limit).select("lang", "spot", F.substring("text", 1, text_chars).alias("text")).dropDuplicates(["lang", "text"])
    first = F.row_number().over(W.partitionBy("lang").orderBy("spot", "text"))
    drawn = drawn.withColumn("turn", first).where(F.col("turn") <= 4 * wanted).drop("turn").collect()
    drawn.sort(key=lambda r: (r["lang"], r["spot"], r["text"]))
    samples: dict[str, str] = {}
    for row in drawn:
        have = samples.get(row["lang"], "")
        if len(have) < chars:
            samples[row["lang"]] = (have + "\n" + row["text"].lower())[:chars]
    languages = sorted(samples)
    seen = Counter(c for s in samples.values() for c in s if c.isalpha())
    # A code fits a byte; letters beyond the most frequent ones share OTHER, which no phrase contains.
    letters = sorted(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])
    codes = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            codes[point] = OTHER
    for at, letter in enumerate(letters):
        codes[ord(letter)] = at + 2
    width = len(letters) + 2
    tables, base, weight, offset = [], [], [], 0
    for name in languages:
        sample, _ = letter_codes([samples[name]], codes)
        table = suffix_automaton(sample, width)
        restart = np.maximum(table[0], 0)
        base.append(offset)
        # States are stored as table offsets, so that a step is one addition and one gather.
        moved = np.where(table >= 0, table * width, ~(restart * width)[None, :]).astype(np.int32)
        tables.append(moved.ravel())
        offset += moved.size
        weight.append(math.log2(max(2, len(sample))))
    return LanguageModel(languages, codes, width, np.concatenate(tables), np.array(base, np.int64), np.array(weight))


def phrase_counts(codes: np.ndarray, bounds: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Phrases of each text under each language: ``[language, text]``."""
    texts, languages = len(bounds) - 1, len(model.languages)
    lanes = -(-np.diff(bounds) // LANE)
    owner = np.repeat(np.arange(texts), lanes)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = bounds[:-1][owner] + inside * LANE
    size = np.minimum(bounds[1:][owner] - begin, LANE)
    order = np.argsort(-size, kind="stable")
    owner, begin, size = owner[order], begin[order], size[order]
    counts = np.ones((languages, len(owner)), np.int64)
    state = np.zeros((languages, len(owner)), np.int64)
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    base = model.base[:, None]
    for step, live in enumerate(active.tolist()):
        code = codes[begin[:live] + step]
        moved = model.step[base + state[:, :live] + code]
        broke = moved < 0
        counts[:, :live] += broke
        state[:, :live] = np.where(broke, ~moved, moved)
    out = np.zeros((languages, texts), np.int64)
    for row in range(languages):
        out[row] = np.bincount(owner, counts[row], texts).astype(np.int64)
    return out


def predict(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, scores
    codes, bounds = letter_codes(texts, model.codes)
    total = np.concatenate([[0], np.cumsum(codes != GAP)])
    letters = total[bounds[1:]] - total[bounds[:-1]]
    rates = phrase_counts(codes, bounds, model) * model.weight[:, None]
    best = np.argmin(rates, axis=0)
    first = rates[best, np.arange(len(texts))]
    if len(model.languages) > 1:
        second = np.partition(rates, 1, axis=0)[1]
    else:
        second = np.full(len(texts), np.inf)
    for row in np.flatnonzero(letters > 0).tolist():
        names[row] = model.languages[best[row]]
        scores[row] = 1.0 if math.isinf(second[row]) else second[row] / (first[row] + second[row])
    return names, scores


def language_column(df: DataFrame, text: Column, model: LanguageModel) -> Column:
    """Column ``struct<lang_pred string, score double>`` of a text column."""
    shared = share(df.sparkSession, model)

    @F.arrow_udf("lang_pred string, score double")
    def identify(values: pa.Array) -> pa.Array:
        forget_encoders()
        names, scores, batch = [], [], []
        for at in range(0, len(values), ROWS):
            batch += values.slice(at, ROWS).to_pylist()
            letters = sum(len(t or "") for t in batch)
            if letters >= BATCH_LETTERS or at + ROWS >= len(values):
                some, marks = predict(batch, shared())
                names += some
                scores += marks.tolist()
                batch = []
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return identify(text)


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Predicted language of every whole text: ``id_col``, ``lang_pred``, ``score``.

    One row per input row, repeated rows included; other columns are ignored. A null text, an empty one and one without
    a letter get ``und`` and 0. ``score`` is the runner-up's share of the phrases, 0.5 for a tie (the smaller name wins)
    and 1 with a single learned language. Without any learned language all rows get ``und``.
    """
    found = docs.select(F.col(id_col), F.col(text).alias("_text"))
    found = found.withColumn("_found", language_column(docs, F.col("_text"), model))
    return found.select(id_col, "_found.lang_pred", "_found.score")
