"""Bin packing by completion with branch and bound, over the number of pieces of each length.

Pieces of equal length are interchangeable, so a state is one count per length, at most as many as the capacity. A branch takes
the largest piece left, completes its bin by a filling that no other one dominates, and uses this pattern as often as the
stock allows, or once. Best-fit packing of the same counts is the incumbent; a branch ends where the waste of its bins
rules out a packing with fewer bins, and the search where the lower bound is met.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate
from operator import mul

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # (length, copies) of one bin


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing: each piece goes to the fullest bin that takes it. Bins that are filled alike are one group, so the work
    depends on the number of lengths, not of pieces."""
    open_: dict[int, list[tuple[int, Pattern]]] = {}
    spaces: list[int] = []

    def put(space: int, times: int, pattern: Pattern) -> None:
        if space not in open_:
            insort(spaces, space)
        open_.setdefault(space, []).append((times, pattern))

    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left > 0:
            at = bisect_left(spaces, n)
            if at == len(spaces):
                space, times, pattern = capacity, -(-left // (capacity // n)), ()
            else:
                space = spaces[at]
                times, pattern = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            each = space // n
            full = min(times, left // each)
            if full:
                put(space - each * n, full, (*pattern, (n, each)))
            times, left = times - full, left - full * each
            if times and left:
                put(space - left * n, 1, (*pattern, (n, left)))
                times, left = times - 1, 0
            if times and pattern:
                put(space, times, pattern)
    return [group for groups in open_.values() for group in groups]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: what is larger than half a bin has one of its own, and these bins have so much room for the rest."""
    counts = np.zeros(capacity + 2, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    sizes = counts * np.arange(capacity + 2)
    pieces, tokens = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(sizes))  # below each length
    half = capacity // 2 + 1
    least = np.append(0, np.flatnonzero(counts[:half]))
    # Pieces of ``least`` tokens and more: those that leave no room for one of them, those that do, and those up to half a bin.
    whole = pieces[-1] - pieces[half]
    room = capacity * (pieces[capacity - least + 1] - pieces[half]) - (tokens[capacity - least + 1] - tokens[half])
    small = tokens[half] - tokens[least]
    bounds = whole + np.maximum(0, -((room - small) // capacity))
    return int(max(-(-int(sizes.sum()) // capacity), bounds.max()))


class Completion:
    """The search itself. ``steps`` bounds all fillings looked at, ``width`` those of one bin."""

    def __init__(self, histogram: dict[int, int], capacity: int, steps: int, width: int):
        self.capacity, self.left, self.width = capacity, steps, width
        self.lengths = sorted(n for n, c in histogram.items() if c > 0)
        self.counts = [histogram[n] for n in self.lengths]
        self.total = sum(n * c for n, c in zip(self.lengths, self.counts))
        self.allowed = 0  # waste that a packing with fewer bins than the incumbent may have, less that of the bins so far

    def fillings(self, gap: int, free: list[int]) -> Iterator[tuple[int, Pattern]]:
        """Waste and content of undominated fillings of ``gap``: those without waste as they are found, then the others by waste."""
        lengths, kept, chosen, budget = self.lengths, [], [], self.width
        stock = [0, *accumulate(map(mul, lengths, free))]
        marks = np.zeros(self.capacity + 1, np.uint8)
        marks[lengths] = np.array(free) > 0
        have = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
        # Setting a bin up costs about as much as looking at so many fillings.
        self.left -= len(lengths) // 8

        def descend(top: int, space: int) -> Iterator[tuple[int, Pattern]]:
            nonlocal budget
            at = min(bisect_right(lengths, space) - 1, top)
            while at >= 0 and budget > 0 and self.left > 0:
                # The stock at or below this length bounds what the branch can fill.
                if space - stock[at + 1] > self.allowed:
                    break
                if free[at]:
                    n = lengths[at]
                    for copies in range(min(free[at], space // n), 0, -1):
                        budget, self.left = budget - 1, self.left - 1
                        free[at] -= copies
                        chosen.append((n, copies))
                        yield from descend(at - 1, space - n * copies)
                        chosen.pop()
                        free[at] += copies
                        if budget <= 0 or self.left <= 0:
                            return
                at -= 1
            if space <= self.allowed and maximal(space) and not dominated(space):
                yield space, tuple(chosen)

        def maximal(space: int) -> bool:
            return not any(free[i] for i in range(bisect_right(lengths, space) - 1, -1, -1))

        def dominated(waste: int) -> bool:
            """A piece in stock could take the place of several of these, or of a smaller one: they would fit elsewhere in its stead."""
            if sum(k for _, k in chosen) > 12:
                return False
            stocked = have
            for n, _ in chosen:
                if not free[bisect_left(lengths, n)]:
                    stocked &= ~(1 << n)
            one = many = 0
            for n, copies in chosen:
                for _ in range(copies):
                    many |= (one | many) << n
                    one |= 1 << n
            return any(stocked & ((many << d) | (one << d if d else 0)) for d in range(waste + 1))

        for waste, filling in descend(len(lengths) - 1, gap):
            if waste:
                kept.append((waste, filling))
            else:
                yield 0, filling
        yield from sorted(kept, key=lambda w: (w[0], sum(k for _, k in w[1])))

    def branches(self) -> Iterator[tuple[int, int, Pattern]]:
        """``times``, ``waste`` and pattern of the bins of the largest piece left: as often as possible first, then once."""
        top = next(i for i in range(len(self.counts) - 1, -1, -1) if self.counts[i])
        largest = self.lengths[top]
        self.counts[top] -= 1
        again = []
        fillings = self.fillings(self.capacity - largest, self.counts.copy())
        self.counts[top] += 1
        for waste, filling in fillings:
            need = dict(filling)
            need[largest] = need.get(largest, 0) + 1
            times = min(self.counts[bisect_left(self.lengths, n)] // k for n, k in need.items())
            if waste:
                times = min(times, self.allowed // waste)
            if times < 1:
                continue
            pattern = tuple(sorted(need.items(), reverse=True))
            if times > 1:
                again.append((1, waste, pattern))
            yield times, waste, pattern
        yield from again

    def take(self, times: int, waste: int, pattern: Pattern) -> None:
        for n, k in pattern:
            self.counts[bisect_left(self.lengths, n)] -= times * k
        self.allowed -= times * waste

    def greedy(self) -> list[tuple[int, Pattern]]:
        """The first branch everywhere, whatever it wastes: one way down, of at most as many bins as there are lengths."""
        before, left, width = self.counts.copy(), self.left, self.width
        self.left = self.allowed = 1 << 60
        self.width, patterns = min(width, 300), []
        while any(self.counts):
            branch = next(self.branches())
            self.take(*branch)
            patterns.append((branch[0], branch[2]))
        self.counts, self.left, self.width = before, left, width
        return patterns

    def improve(self, best: list[tuple[int, Pattern]], bound: int) -> list[tuple[int, Pattern]]:
        bins = sum(t for t, _ in best)
        self.allowed = (bins - 1) * self.capacity - self.total
        path: list[tuple[int, int, Pattern]] = []
        stack = [self.branches()] if bins > bound else []
        while stack and bins > bound and self.left > 0:
            branch = next(stack[-1], None)
            if branch is None:
                stack.pop()
                if path:
                    times, waste, pattern = path.pop()
                    self.take(-times, waste, pattern)
                continue
            times, waste, pattern = branch
            if times * waste > self.allowed:
                continue
            self.take(*branch)
            path.append(branch)
            if any(self.counts):
                stack.append(self.branches())
                continue
            found = sum(t for t, _, _ in path)
            if found < bins:
                self.allowed -= (bins - found) * self.capacity
                bins, best = found, [(t, p) for t, _, p in path]
            path.pop()
            self.take(-times, waste, pattern)
        return best


def pack(histogram: dict[int, int], capacity: int, steps: int = 300_000, width: int = 3000) -> list[tuple[int, Pattern]]:
    """``(times, pattern)`` of a packing: never more bins than best fit, and the fewest possible unless ``steps`` run out."""
    histogram = {n: c for n, c in histogram.items() if c > 0}
    if not histogram:
        return []
    best, bound = best_fit(histogram, capacity), lower_bound(histogram, capacity)
    if sum(t for t, _ in best) > bound:
        search = Completion(histogram, capacity, steps, width)
        other = search.greedy()
        if sum(t for t, _ in other) < sum(t for t, _ in best):
            best = other
        best = search.improve(best, bound)
    return best
