"""Removal of every repeated 100-byte substring by bucket-pointer refinement.

Suffixes start in buckets of 32 bytes and are refined by the bucket identifiers of later offsets: two buckets of 32 bytes
name one of 64, two of those one of 100, and the first and the last window of an anchor name all bytes between. Buckets are
named by 64-bit fingerprints, which need no global numbering, and only the suffixes at content-chosen anchors are moved
between tasks: equal windows have equal anchors at equal offsets, so nothing is missed. Buckets with one suffix leave at
once. What one bucket still holds together is settled by the earliest suffix; a bucket whose suffixes differ somewhere in
their windows is refined once more, window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .anchors import WINDOW, anchors, gram_buckets, segments, window_buckets

KEY = ["known", "id", "hash"]
# Distinct contexts of one bucket that one unit of work compares.
UNIT = 4096
# A run of neighbouring windows as one number: first start * SPAN + (last start - first start).
SPAN = 128


def keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Documents with the three columns of their key: a null id is a flag, so that ids keep their type everywhere."""
    whole, own = F.coalesce(F.col(text), F.lit("")), F.col(id_col)
    filled = F.coalesce(own, F.lit(0).cast(docs.schema[id_col].dataType))
    return docs.select(own.isNotNull().alias("known"), filled.alias("id"), F.xxhash64(whole).alias("hash"), whole.alias("text"), own.alias("own"))


def anchor_rows(rows: DataFrame, payload: bool) -> DataFrame:
    """``gram`` of every anchor; with ``payload`` also ``cover``, the document's key and ``span``."""
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bounds, row, shift in segments(batch.column(3)):
                found = anchors(data, bounds, row, shift)
                if found is None:
                    continue
                columns = [pa.array(found.gram.view(np.int64))]
                if payload:
                    at = pa.array(found.row)
                    span = found.first * SPAN + (found.last - found.first)
                    columns += [pa.array(found.cover.view(np.int64)), *(batch.column(i).take(at) for i in range(3)), pa.array(span)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "cover", *KEY, "span"][: len(columns)])

    return rows.select(*KEY, "text").mapInArrow(find, "gram long" + (f", cover long, known boolean, id {kind}, hash long, span long" if payload else ""))


def contexts(listed: DataFrame) -> DataFrame:
    """The bytes that the windows of each listed anchor cover."""
    kind = listed.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(3), batch.column(4)
            row, values, counts = [], [], []
            for at, (text, items) in enumerate(zip(texts, lists)):
                data = text.as_buffer().to_pybytes()
                for item in items.as_py():
                    first, wide = divmod(item["span"], SPAN)
                    row.append(at)
                    values.append((item["gram"], item["members"], first, data[first : first + wide + WINDOW]))
            gram, members, first, context = zip(*values) if values else ((), (), (), ())
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram, pa.int64()), pa.array(members, pa.int64()), *(batch.column(i).take(at) for i in range(3)),
                    pa.array(first, pa.int64()), pa.array(context, pa.binary()),
                ],
                ["gram", "members", *KEY, "first", "context"],
            )

    return listed.select(*KEY, "text", "items").mapInArrow(cut, f"gram long, members long, known boolean, id {kind}, hash long, first long, context binary")


def settled(rows: DataFrame) -> DataFrame:
    """Windows of differing contexts compared inside their bucket.

    Rows ``window`` null: windows (key and ``span``) that start earlier elsewhere. Other rows: the earliest
    occurrence of a window in a slice of a bucket with more than ``UNIT`` contexts, to be compared across its slices.
    """
    kind = rows.schema["id"].dataType.simpleString()
    slices = F.ceil(F.col("members") / UNIT)
    units = rows.withColumn("slice", F.pmod(F.xxhash64(*KEY, "first"), slices)).repartition("gram", "slice").sortWithinPartitions("gram", "slice")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        """All rows of some whole units at once; a window belongs to one bucket, so units cannot mix."""
        part = part.sort_values([*KEY, "first"], kind="stable").reset_index(drop=True)
        sizes = part["context"].str.len().to_numpy(np.int64)
        data = np.frombuffer(b"".join(part["context"]), np.uint8)
        starts = np.cumsum(sizes) - sizes
        windows = sizes - WINDOW + 1
        owner = np.repeat(np.arange(len(part)), windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        bucket = np.concatenate([
            window_buckets(gram_buckets(data[lo:hi]))[(starts[a:b, None] - lo + np.arange(WINDOW))[np.arange(WINDOW) < windows[a:b, None]]]
            for a, b, lo, hi in pieces(starts, sizes)
        ])
        # Rows are in document order, so the first row of a window is its earliest occurrence here.
        _, first = np.unique(bucket, return_index=True)
        earliest = np.zeros(len(bucket), bool)
        earliest[first] = True
        begin = part["first"].to_numpy(np.int64)[owner] + offset
        late = ~earliest
        run = np.flatnonzero(late & ~np.concatenate([[False], late[:-1] & (owner[1:] == owner[:-1])]))
        stop = np.flatnonzero(late & ~np.concatenate([late[1:] & (owner[1:] == owner[:-1]), [False]]))
        gone = part.loc[owner[run], KEY].assign(window=pd.array([None] * len(run), "Int64"), span=begin[run] * SPAN + begin[stop] - begin[run])
        many = np.flatnonzero(earliest & (part["members"].to_numpy() > UNIT)[owner])
        open_ = part.loc[owner[many], KEY].assign(window=pd.array(bucket[many].view(np.int64), "Int64"), span=begin[many] * SPAN)
        return pd.concat([gone, open_], ignore_index=True)[[*KEY, "window", "span"]]

    def scan(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rest) < 2000:
                continue
            change = (rest["gram"].to_numpy()[1:] != rest["gram"].to_numpy()[:-1]) | (rest["slice"].to_numpy()[1:] != rest["slice"].to_numpy()[:-1])
            cut = np.flatnonzero(change)
            if len(cut):
                yield compare(rest.iloc[: cut[-1] + 1])
                rest = rest.iloc[cut[-1] + 1 :]
        if rest is not None and len(rest):
            yield compare(rest)

    return units.mapInPandas(scan, f"known boolean, id {kind}, hash long, window long, span long")


def pieces(starts: np.ndarray, sizes: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int, int, int]]:
    """Runs of contexts with about ``limit`` bytes together: first, last + 1, and their byte bounds."""
    row = 0
    while row < len(starts):
        stop = max(row + 1, int(np.searchsorted(starts, starts[row] + limit)))
        yield row, stop, int(starts[row]), int(starts[stop - 1] + sizes[stop - 1])
        row = stop


def covered_windows(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All windows that also start earlier, as runs: the document's key and ``span``."""
    rows = keyed(docs, text, id_col)
    # Counts combine before their shuffle, however often one bucket occurs.
    repeated = materialize(anchor_rows(rows, False).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "buckets")
    held = materialize(anchor_rows(rows, True).join(repeated.hint("shuffle_hash"), "gram"), "suffixes")
    place = F.struct(*KEY, "span")
    covers = materialize(held.groupBy("gram", "cover").agg(F.min(place).alias("first")), "covers")
    later = held.join(covers, ["gram", "cover"]).where(F.col("first") < place).select(*KEY, "span")
    # A bucket with one cover is settled; in the others windows are compared one by one, once per distinct cover.
    mixed = covers.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
    asked = covers.join(mixed, "gram").select("gram", "members", "first.*")
    asked = asked.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "members", "span")).alias("items"))
    found = materialize(settled(contexts(rows.join(asked, KEY))), "windows")
    done = found.where("window IS NULL").select(*KEY, "span")
    first = found.where("window IS NOT NULL").groupBy("window").agg(F.min(place).alias("first"))
    across = found.where("window IS NOT NULL").join(first, "window").where(F.col("first") < place).select(*KEY, "span")
    return later.union(done).union(across)


def dedup_substrings(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Texts without repeated substrings: ``id_col``, ``kept`` (the bytes left), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A text is its UTF-8 bytes. Every byte goes that lies in a 100-byte string which also starts earlier: in a document with
    a smaller id (a null id first; equal ids in the order of a text hash), or further up in the same one; overlaps count.
    Strings are judged on the input, and matches never cross documents. ``n_spans`` counts maximal removed runs.

    One row per input row; rows that repeat id and text are one document with one result. A null or empty text has no
    bytes; one shorter than 100 bytes keeps all. Other columns are ignored; an empty table gives an empty result.
    """
    rows = keyed(docs, text, id_col)
    spans = covered_windows(docs, text, id_col).groupBy(*KEY).agg(F.collect_list("span").alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, runs = [], [], []
            for value, spans in zip(batch.column(1), batch.column(2)):
                data = value.as_buffer().to_pybytes()
                marks = np.zeros(len(data) + 1, np.int64)
                if spans.is_valid:
                    packed = np.asarray(spans.values)
                    first, wide = packed // SPAN, packed % SPAN
                    np.add.at(marks, first, 1)
                    np.add.at(marks, first + wide + WINDOW, -1)
                gone = np.cumsum(marks)[:-1] > 0
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if spans.is_valid else data)
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(kept, pa.binary()), pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                [id_col, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = rows.join(spans, KEY, "left").select("own", "text", "spans")
    return joined.mapInArrow(strip, f"`{id_col}` {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
