"""Texts of an Arrow batch as one byte buffer, cut into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each text in them; a null text is empty."""
    texts = pa.array([], pa.large_string()) if len(texts) == 0 else texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64) if offsets is not None else np.zeros(1, np.int64)
    starts = starts[texts.offset : texts.offset + len(texts) + 1]
    if len(starts) == 0:
        starts = np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), starts


def row_blocks(starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes together; a longer text is a run of its own."""
    row, rows = 0, len(starts) - 1
    while row < rows:
        stop = int(np.searchsorted(starts, starts[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, count: int) -> np.ndarray:
    """1, base, base², … modulo 2⁶⁴."""
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)
