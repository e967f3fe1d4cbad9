"""Content-chosen anchors of byte texts and bucket identifiers of their substrings.

Every window of ``WINDOW`` bytes has an anchor: the leftmost of its ``GRAM``-byte substrings with the smallest hash. The
choice depends on the window's bytes alone, so equal windows anywhere have equal anchors at equal offsets, and neighbouring
windows mostly share theirs: about one position in 35 is an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .blocks import mix, powers, row_blocks, text_bytes

WINDOW = 100
GRAM = 32
BLOCK = 1 << 19
BASE = 0x2545F4914F6CDD1D
CODES = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
SPOT = np.uint64((1 << 20) - 1)
UP, DOWN = powers(BASE, BLOCK + 2 * WINDOW), powers(pow(BASE, -1, 1 << 64), BLOCK + 2 * WINDOW)


@dataclass
class Anchors:
    """Parallel arrays: text (row of the batch), first and last window start in it, the anchor's bucket, the bucket of all bytes the windows cover."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    cover: np.ndarray


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket identifier of the ``GRAM`` bytes from each position on."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * UP[: len(data)], out=total[1:])
    return mix((total[GRAM:] - total[:-GRAM]) * DOWN[: len(data) - GRAM + 1])


def refined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bucket of a position from its own bucket and the bucket at a later offset."""
    return mix(left + mix(right ^ np.uint64(0x8EBC6AF09C88C6E3)))


def window_buckets(grams: np.ndarray) -> np.ndarray:
    """Bucket of the ``WINDOW`` bytes from each position on: 32 bytes are refined to 64, and those to 100."""
    double = refined(grams[:-GRAM], grams[GRAM:])
    rest = WINDOW - 2 * GRAM
    return refined(double[:-rest], double[rest:])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def segments(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Segments of a batch: bytes, text bounds in them, the batch row of the first text, and where in that text the segment begins.

    A text longer than a block is cut into segments that overlap by one byte less than a window.
    """
    data, starts = text_bytes(texts)
    for row, stop in row_blocks(starts, BLOCK):
        low, high = int(starts[row]), int(starts[stop])
        if high - low <= BLOCK:
            yield data[low:high], starts[row : stop + 1] - low, row, 0
        else:
            for begin in range(0, max(1, high - low - WINDOW + 1), BLOCK):
                part = data[low + begin : min(high, low + begin + BLOCK + WINDOW - 1)]
                yield part, np.array([0, len(part)]), row, begin


def anchors(data: np.ndarray, bounds: np.ndarray, row: int, shift: int) -> Anchors | None:
    if len(data) < WINDOW:
        return None
    grams = gram_buckets(data)
    low = smallest((grams & ~SPOT) | np.arange(len(grams), dtype=np.uint64), WINDOW - GRAM + 1) & SPOT
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(text[: len(low)] == text[WINDOW - 1 :])
    if not len(whole):
        return None
    chosen = low[whole].astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    first, last = whole[cut], whole[np.concatenate([cut[1:] - 1, [len(whole) - 1]])]
    anchor = chosen[cut]
    # First and last window overlap, so their buckets and their distance fix all bytes between.
    windows = window_buckets(grams)
    cover = refined(windows[first], windows[last]) ^ mix((last - first + 1).astype(np.uint64))
    owner = text[first]
    return Anchors(row + owner, first - bounds[owner] + shift, last - bounds[owner] + shift, grams[anchor], cover)

