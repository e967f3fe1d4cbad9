"""Bin completion against exact optima of small cases and against best fit on large ones."""

import random
from collections import Counter

from tallyframe.llm.bin_completion import best_fit, lower_bound, pack
from tallyframe.llm.packing import bin_patterns


def optimum(items, capacity):
    """Fewest bins and the least fill of the last one, over all subsets."""
    best = [(99, 0)] * (1 << len(items))
    best[0] = (0, capacity)
    for mask in range(len(best)):
        bins, fill = best[mask]
        for i, n in enumerate(items):
            if not mask >> i & 1:
                step = (bins, fill + n) if fill + n <= capacity else (bins + 1, n)
                best[mask | 1 << i] = min(best[mask | 1 << i], step)
    return best[-1][0]


def bins_of(patterns):
    return sum(times for times, _ in patterns)


def check(items, capacity, patterns):
    assert all(sum(n * k for n, k in pattern) <= capacity for _, pattern in patterns)
    assert sorted(n for times, pattern in patterns for n, k in pattern for _ in range(times * k)) == sorted(items)


def test_small_cases_are_optimal():
    rng = random.Random(1)
    for _ in range(10_000):
        capacity = rng.choice([20, 30, 50, 100])
        items = [rng.randrange(1, capacity + 1) if rng.random() < 0.3 else rng.randrange(capacity // 6 + 1, capacity * 2 // 3) for _ in range(rng.randrange(0, 8))]
        patterns = pack(Counter(items), capacity)
        check(items, capacity, patterns)
        assert bins_of(patterns) == (optimum(items, capacity) if items else 0)
    assert bins_of(bin_patterns({6: 1, 9: 2, 10: 1, 12: 1, 13: 1, 14: 1, 15: 1}, 30)) == 3


def test_best_fit_in_groups_is_best_fit_piece_by_piece():
    rng = random.Random(2)
    for _ in range(300):
        items = [rng.randrange(1, 61) for _ in range(rng.randrange(80))]
        spaces = []
        for n in sorted(items, reverse=True):
            fitting = [s for s in spaces if s >= n]
            space = min(fitting) if fitting else 60
            if fitting:
                spaces.remove(space)
            spaces.append(space - n)
        patterns = best_fit(Counter(items), 60)
        check(items, 60, patterns)
        assert bins_of(patterns) == len(spaces)
        assert lower_bound(Counter(items), 60) <= len(spaces)


def test_large_cases_never_need_more_bins_than_best_fit():
    rng = random.Random(3)
    draws = [lambda: rng.randrange(1, 4097), lambda: min(4096, int(rng.lognormvariate(6, 1.2)) + 1), lambda: rng.choice([1, 1, 2, 4096, rng.randrange(1100, 1500)])]
    for draw in draws:
        items = [draw() for _ in range(5000)]
        patterns = pack(Counter(items), 4096)
        check(items, 4096, patterns)
        assert lower_bound(Counter(items), 4096) <= bins_of(patterns) <= bins_of(best_fit(Counter(items), 4096))
    millions = {n: 1_000_000 + n for n in (1, 5, 700, 1300, 1366, 2049, 4096)}
    patterns = pack(millions, 4096)
    assert {n: sum(t * dict(p).get(n, 0) for t, p in patterns) for n in millions} == millions
    assert bins_of(patterns) <= bins_of(best_fit(millions, 4096))
