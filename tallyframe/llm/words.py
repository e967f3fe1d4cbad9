"""Word shingles of texts as 64-bit hashes, for whole Arrow batches at a time.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, after
lower-casing A-Z. A shingle is five consecutive words; a text of one to four words has one shingle, the whole sequence;
a null text or one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .blocks import mix, powers, row_blocks, text_bytes

WIDTH = 5
BLOCK = 1 << 20
BASE = 0x2545F4914F6CDD1D  # odd, so that it has an inverse modulo 2**64
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
BYTE_CODES[ord("A") : ord("Z") + 1] = BYTE_CODES[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PLACE_CODES = mix(np.arange(101, 101 + 2 * WIDTH, dtype=np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a block and the number of words of each text; ``starts`` counts from the block's first byte."""
    up, down = tables
    count = len(data)
    if not count:
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    space = SPACE[data]
    edge = np.zeros(count + 1, bool)
    edge[starts] = True
    first = ~space
    first[1:] &= space[:-1] | edge[1:-1]
    last = ~space
    last[:-1] &= space[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(count + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:count], out=total[1:])
    hashes = mix((total[end] - total[begin]) * down[begin])
    bounds = np.searchsorted(begin, starts)
    return hashes, np.diff(bounds)


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of a block, text by text, and their number per text (repeats included)."""
    per_text = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    which = np.repeat(np.arange(len(counts)), per_text)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = begin[which] + inside
    size = np.minimum(counts, WIDTH)[which]
    padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
    out = PLACE_CODES[WIDTH + size - 1].copy() if len(which) else np.zeros(0, np.uint64)
    for k in range(WIDTH):
        out += np.where(size > k, padded[at + k] * PLACE_CODES[k], np.uint64(0))
    return mix(out), per_text


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of rows: first row, last row + 1, sorted distinct hashes of each text one after another, their number per text."""
    data, starts = text_bytes(texts)
    size = 0
    tables = None
    for row, stop in row_blocks(starts, BLOCK):
        low, high = int(starts[row]), int(starts[stop])
        if high - low > size or tables is None:
            size = max(BLOCK, high - low)
            tables = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
        words, counts = word_hashes(data[low:high], starts[row : stop + 1] - low, tables)
        hashes, per_text = shingle_hashes(words, counts)
        ends = np.cumsum(per_text)
        sets = [np.unique(hashes[e - n : e]) for e, n in zip(ends.tolist(), per_text.tolist())]
        yield row, stop, (np.concatenate(sets) if sets else hashes), np.array([len(s) for s in sets], np.int64)
