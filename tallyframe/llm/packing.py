"""Best-fit packing of token sequences by bin completion with branch and bound.

Pieces of equal length are interchangeable, so the search of ``bin_completion`` works on the number of pieces of each length, at
most one count per possible length however many documents there are. It leaves patterns of lengths with the number of
sequences that follow each; pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..skew import ordered_index
from .bin_completion import pack
from .tokens import encoder

CAPACITY = 4096
TEXTS = 256


def token_pieces(
    docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False,
) -> DataFrame:
    """Token ids of each text and ``end_id``, cut into pieces of at most ``capacity``: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and perhaps ``ids``."""
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    last = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for r, data in enumerate(known.encode([t or "" for t in part.column(1).to_pylist()])):
                    data += last
                    for number, begin in enumerate(range(0, len(data), 4 * capacity)):
                        some = data[begin : begin + 4 * capacity]
                        row.append(r)
                        piece.append(number)
                        start.append(begin // 4)
                        length.append(len(some) // 4)
                        crc.append(zlib.crc32(some))
                        if with_ids:
                            ids.append(np.frombuffer(some, "<u4").astype(np.int32))
                columns = [
                    part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(cut, schema)


def bin_patterns(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = 300_000) -> list[tuple[int, list[int]]]:
    """``(times, lengths of one bin)`` for all pieces counted in ``histogram``; ``steps`` bounds the search for fewer bins than best
    fit needs."""
    return [(times, [n for n, copies in pattern for _ in range(copies)]) for times, pattern in pack(histogram, capacity, steps)]


def slot_table(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Ranks of each length that a pattern takes, sorted by length and first rank; ranks count from 0."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for n, k in sorted(Counter(lengths).items(), reverse=True):
            rows.append((n, taken[n], times, sequence, offset))
            taken[n] += k * times
            offset += k * n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), table.T))


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; the driver gets one count per length, at most ``capacity`` of them."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slot_table(bin_patterns(histogram, capacity))
    high = np.int64(1 << 44)

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (length, rank))
        at = np.searchsorted(slots["length"] * high + slots["rank"], n * high + r - 1, side="right") - 1
        inside = r - 1 - slots["rank"][at]
        number, copy = inside // slots["times"][at], inside % slots["times"][at]
        return pa.StructArray.from_arrays([pa.array(slots["sequence"][at] + copy), pa.array(slots["offset"][at] + number * n)], ["sequence_id", "offset"])

    ranked = ordered_index(pieces, ["length"], ["doc_id", "piece"], "_rank").withColumn("_place", place("length", "_rank"))
    return ranked.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the search finds: never more than best fit does.

    Returns one row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, with
    ``with_ids`` also ``ids``. Only documents longer than a sequence are cut. A null text counts as empty and has the end
    token alone; null ids, equal ids and repeated rows are packed row by row. Other columns are ignored; an empty table
    gives an empty result.
    """
    pieces = materialize(token_pieces(docs, tokenizer, text, id_col, capacity, end_id, with_ids), "pieces")
    return place_pieces(pieces, capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed ``with_ids``: ``sequence_id``, ``ids``, ``doc_ids``, ``offsets``. A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
