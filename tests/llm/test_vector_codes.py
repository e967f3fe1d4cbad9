"""Vector codes against plain loops."""

import hashlib
import math
import random

import numpy as np

from tallyframe.llm.vector_codes import SLICE, Walk, compress_vectors, nearest_entries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, size long"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == width * parts]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else entry for e, entry in enumerate(books[p])]
    coded = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    sums = {}
    for _, label, _, error in coded:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, code, error, sums[label], digest) for i, label, code, error in coded), key=repr)


def check(spark, rows, **options):
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    got = compress_vectors(table, **options).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=repr) == brute(rows, **options)


def vectors(n, length, seed, steps=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, length)) / 4
    x = np.round(x * steps) / steps if steps else x
    return [(int(i), [float(c) for c in np.float32(v)], int(rng.integers(5))) for i, v in enumerate(x)]


def test_codes_with_awkward_rows(spark):
    rows = vectors(400, 64, 1)
    rows += [(1000 + i, rows[3][1], None) for i in range(150)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [float("nan")] * 64, 1), (2003, [None] * 64, 1), (2004, [float("inf")] + [0.0] * 63, 1), (2005, [0.0] * 64, None)]
    rows += [(3000, [0.5] * 32, 1), (3001, [0.5] * 33, 1), (None, [0.25] * 64, 2), (7, rows[9][1], 3), (7, rows[7][1], 1)]
    check(spark, rows)


def test_ties_shared_prefixes_and_few_vectors(spark):
    check(spark, vectors(300, 32, 2, steps=4))
    check(spark, vectors(200, 8, 3, steps=2), parts=2, entries=5, rounds=3)
    check(spark, vectors(9, 16, 4))


def test_no_vector(spark):
    table = spark.createDataFrame([(1, None, 1, "c", 1)], SCHEMA)
    out = compress_vectors(table)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert out.count() == 0 and compress_vectors(table.limit(0)).count() == 0


def test_walk_shares_prefixes_over_slices():
    rng = random.Random(5)
    parts = np.array(sorted([rng.randrange(-3, 4) for _ in range(4)] for _ in range(SLICE + 500)), np.int64)
    book = np.array([[rng.randrange(-3, 4) for _ in range(4)] for _ in range(20)], np.int64)
    want = ((parts[:, None] - book) ** 2).sum(2)
    codes, gaps = nearest_entries(parts[::-1], book)
    assert (codes[::-1] == want.argmin(1)).all() and (gaps[::-1] == want.min(1)).all()

    walk = Walk(book)
    for low in range(0, len(parts), 777):
        walk.step(parts[low : low + 777])
    assert (walk.sums[-1] == want[-1]).all()
