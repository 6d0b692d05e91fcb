"""Cutting stock by column generation: patterns of item lengths that fill bins of one size.

The problem has one row per length class, whatever the number of items, so it is solved on the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

MAX_ROUNDS = 20_000  # pivots after which the solution so far is taken; any basic solution is a valid one
GAP = 0.002  # stop within this share of the lower bound
EPS = 1e-9


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the multiset of items of most value within the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        fit = fits[room]
        if fit:
            gain = best[room - sizes[:fit]] + values[:fit]
            at = int(gain.argmax())
            if gain[at] > best[room - 1] + EPS:
                best[room], pick[room] = gain[at], at
                continue
        best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            pattern[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), pattern


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per column) and how often each is used, fractions included, by the revised simplex method."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    used = inverse @ demand
    for _ in range(MAX_ROUNDS):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(prices, 0), sizes, capacity)
        # A pattern's worth bounds the optimum from below by total / worth.
        if value <= 1 + EPS or 1 - 1 / value <= GAP:
            break
        change = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > EPS, used / change, np.inf)
        row = int(ratio.argmin())
        step = ratio[row]
        used -= step * change
        used[row] = step
        pivot = inverse[row] / change[row]
        inverse -= np.outer(change, pivot)
        inverse[row] = pivot
        columns[:, row] = pattern
    return columns.astype(np.int64), np.maximum(used, 0)


def fill_patterns(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit, largest first, of the few items that rounding leaves over."""
    free: list[tuple[int, int]] = []
    bins: list[np.ndarray] = []
    for kind in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[kind])):
            at = bisect_left(free, (int(sizes[kind]), -1))
            if at < len(free):
                room, number = free.pop(at)
            else:
                room, number = capacity, len(bins)
                bins.append(np.zeros(len(sizes), np.int64))
            bins[number][kind] += 1
            insort(free, (room - int(sizes[kind]), number))
    return [(b, 1) for b in bins]


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(items per size, times used) that hold exactly ``demand`` items of each of the ascending ``sizes``."""
    if not len(sizes):
        return []
    columns, used = relaxed(sizes, demand.astype(float), capacity)
    times = np.floor(used + 1e-6).astype(np.int64)
    while (over := columns @ times - demand).max() > 0:  # an inexact solution, rounded up by its tolerance
        at = int(np.flatnonzero((columns[int(over.argmax())] > 0) & (times > 0))[0])
        times[at] -= 1
    whole = [(columns[:, i], int(times[i])) for i in np.flatnonzero(times)]
    return whole + fill_patterns(sizes, demand - columns @ times, capacity)
