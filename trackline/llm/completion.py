"""Bin completion: branch and bound over whole bins, for one block of item lengths.

The largest item left opens a bin; the search branches on the undominated ways to fill the rest of it. Best fit of the
items in falling order gives the first solution, and a branch is left as soon as the room it has wasted, and must
still waste, rules out one bin less than the best solution so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

Bins = list[list[int]]
EFFORT = 150_000  # units of search per block: sizes tried and sizes summed for bounds
WAYS = 6  # fillings of one bin that the search branches on
TRIES = 200  # sizes tried for the fillings of one bin
CHECKED = 6  # most items of a filling whose subsets are looked at for dominance


def best_fit(items: list[int], capacity: int) -> Bins:
    """The items, in falling order, each in the bin it fits best."""
    bins: Bins = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has room r
    for item in items:
        fits = rooms >> item
        if fits:
            room = item + (fits & -fits).bit_length() - 1
            held = by_room[room]
            at = held.pop()
            if not held:
                rooms ^= 1 << room
        else:
            at, room = len(bins), capacity
            bins.append([])
        bins[at].append(item)
        room -= item
        if room:
            by_room.setdefault(room, []).append(at)
            rooms |= 1 << room
    return bins


def least_waste(counts: dict[int, int], capacity: int) -> int:
    """Room that any packing of the items wastes beside items of over half a bin, each of which has a bin of its own.

    From the largest on, all items that fit beside it, and that larger ones did not need, fill what it leaves as if
    they were liquid.
    """
    sizes = sorted(s for s, n in counts.items() if n)
    waste = liquid = at = 0
    for size in reversed(sizes):
        if 2 * size <= capacity:
            break
        room = capacity - size
        while at < len(sizes) and sizes[at] <= room:
            liquid += sizes[at] * counts[sizes[at]]
            at += 1
        needed = room * counts[size]
        waste += max(0, needed - liquid)
        liquid = max(0, liquid - needed)
    return waste


def undominated(filling: list[int], room: int, available: int) -> bool:
    """Whether no available size could replace some of the filling's items, or join them, and leave less room.

    ``available`` has a bit per size that is left beside the filling, ``room`` is what the filling leaves.
    """
    window = (1 << (room + 1)) - 1
    if available & window & ~1:
        return False  # an item fits on top
    if len(filling) <= CHECKED:
        for n in range(1, len(filling) + 1):
            for some in combinations(filling, n):
                found = available >> sum(some) & window
                # A single item is only replaced by a larger one, several also by one as large as all of them.
                if found & ~1 if n == 1 else found:
                    return False
    return True


def fillings(counts: dict[int, int], available: int, room: int, waste: int) -> tuple[list[tuple[int, list[int]]], int]:
    """Undominated fillings (room left, items) of ``room`` that leave at most ``waste``, the fullest first; sizes tried.

    One item that fits exactly dominates all other fillings. Larger items are tried first, as small ones fit anywhere.
    """
    if available >> room & 1 and room:
        return [(0, [room])], 1
    found: list[tuple[int, list[int]]] = []
    tried = 0
    chosen: list[int] = []

    def extend(left: int, most: int) -> None:
        nonlocal available, tried
        if len(found) >= WAYS or tried >= TRIES:
            return
        below = available & ((1 << (min(left, most) + 1)) - 1) & ~1
        if not below:
            if left <= waste and undominated(chosen, left, available):
                found.append((left, list(chosen)))
            return
        while below and len(found) < WAYS and tried < TRIES:
            size = below.bit_length() - 1
            below ^= 1 << size
            tried += 1
            chosen.append(size)
            counts[size] -= 1
            if not counts[size]:
                available ^= 1 << size
            extend(left - size, size)
            if not counts[size]:
                available |= 1 << size
            counts[size] += 1
            chosen.pop()

    extend(room, room)
    if not found:
        # Too many small items for a whole filling within the tries: the largest that fits, again and again.
        left, taken, beside = room, [], dict(counts)
        while below := available & ((1 << (left + 1)) - 1) & ~1:
            size = below.bit_length() - 1
            n = min(beside[size], left // size)
            taken += [size] * n
            left -= n * size
            beside[size] -= n
            if not beside[size]:
                available ^= 1 << size
        if left <= waste:
            found.append((left, taken))
    found.sort(key=lambda f: (f[0], len(f[1])))
    return found, tried


def pack_block(items: list[int], capacity: int, effort: int = EFFORT) -> Bins:
    """Bins of the items, as few as the search finds; every item is at most ``capacity`` long."""
    items = sorted(items, reverse=True)
    best = best_fit(items, capacity)
    counts: dict[int, int] = {}
    for item in items:
        counts[item] = counts.get(item, 0) + 1
    total = sum(items)
    least = -(-(total + least_waste(counts, capacity)) // capacity)
    if len(best) <= least:
        return best
    available = 0
    for size in counts:
        available |= 1 << size
    bins: Bins = []
    spent = 0

    def branches(wasted: int) -> Iterator[tuple[int, list[int]]]:
        """The ways to fill the next bin that can still save a bin."""
        nonlocal spent
        allowed = (len(best) - 1) * capacity - total - wasted
        left = {s: n for s, n in counts.items() if n}
        if allowed < 0 or (backtracked and least_waste(left, capacity) > allowed):
            return
        if backtracked:
            spent += len(left)
        largest = available.bit_length() - 1
        take(largest)
        found, tried = fillings(counts, available, capacity - largest, allowed)
        give(largest)
        spent += tried
        for waste, filling in found:
            yield waste, [largest, *filling]

    def take(size: int) -> None:
        nonlocal available
        counts[size] -= 1
        if not counts[size]:
            available ^= 1 << size

    def give(size: int) -> None:
        nonlocal available
        if not counts[size]:
            available |= 1 << size
        counts[size] += 1

    backtracked = False
    stack: list[tuple[Iterator[tuple[int, list[int]]], int]] = [(branches(0), 0)]
    while stack and spent < effort and len(best) > least:
        ways, wasted = stack[-1]
        way = next(ways, None)
        if way is None:
            stack.pop()
            backtracked = True
            if bins and stack:
                for size in bins.pop():
                    give(size)
            continue
        waste, filling = way
        if wasted + waste > (len(best) - 1) * capacity - total:
            continue
        for size in filling:
            take(size)
        bins.append(filling)
        if available:
            stack.append((branches(wasted + waste), wasted + waste))
        else:
            if len(bins) < len(best):
                best = [list(b) for b in bins]
            for size in bins.pop():
                give(size)
    return best

