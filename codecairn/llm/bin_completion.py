"""Bin completion over a length histogram.

The input is at most ``capacity`` lengths with counts, however many documents
there are; bins are found as patterns with multiplicities, so the search runs on
a table of bounded size.  Each step takes the largest remaining length,
enumerates undominated fillings of the rest of its bin, least waste first, and
uses the chosen filling as often as the counts allow.  A best-fit solution is
the incumbent; a branch is cut when its waste exceeds what a better solution may
have.  ``NODE_LIMIT`` bounds the effort of the search, never the result: every
item is packed by the best solution found.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np

#: A filling: ((length, copies), ...), longest first.
Pattern = tuple[tuple[int, int], ...]

NODE_LIMIT = 2_500
#: Fillings kept for one branch.
WIDTH = 6
#: Documents added to the largest one when fillings are enumerated; the last takes several copies if it can.
DEPTH = 4


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any solution needs: volume, and long items that cannot share a bin."""
    items = sorted((n, c) for n, c in counts.items() if c)
    if not items:
        return 0
    n, c = (np.array(x, dtype=np.int64) for x in zip(*items))
    number, volume = (np.concatenate([[0], np.cumsum(x)]) for x in (c, n * c))
    half = np.searchsorted(n, capacity // 2, "right")  # items up to here are at most half a bin
    # alpha: items of more than capacity - alpha share a bin with nothing of alpha or more
    alpha = np.concatenate([[0], n[:half]])
    huge_at = np.searchsorted(n, capacity - alpha, "right")
    huge, wide = number[-1] - number[huge_at], number[huge_at] - number[half]
    free = wide * capacity - (volume[huge_at] - volume[half])
    small = volume[half] - volume[np.searchsorted(n, alpha, "left")]
    return int(max(-(-volume[-1] // capacity), np.max(huge + wide + np.maximum(0, -((free - small) // capacity)))))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, on groups of equal bins."""
    groups: dict[int, dict[Pattern, int]] = defaultdict(lambda: defaultdict(int))  # free room -> pattern -> bins
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        for room in sorted(r for r in groups if r >= length):
            copies = room // length
            for pattern, bins in list(groups[room].items()):
                if not left:
                    break
                full = min(bins, left // copies)
                for used, times in ((copies, full), (left - full * copies, int(full < bins and left > full * copies))):
                    if used > 0 and times:
                        used = min(used, copies)
                        groups[room][pattern] -= times
                        groups[room - used * length][(*pattern, (length, used))] += times
                        left -= used * times
                if not groups[room][pattern]:
                    del groups[room][pattern]
        copies = capacity // length
        for used, times in ((copies, left // copies), (left % copies, 1)):
            if used and times:
                groups[capacity - used * length][((length, used),)] += times
    return [(p, n) for by in groups.values() for p, n in by.items() if n]


def _reachable(lengths: list[int], counts: dict[int, int], room: int) -> int:
    """Bit s is set if some of the items sum to s, at most ``room``."""
    sums, keep = 1, (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        copies, step = min(counts[n], room // n), 1
        while copies > 0:  # binary splitting of the copies
            take = min(step, copies)
            sums |= (sums << (take * n)) & keep
            copies -= take
            step *= 2
    return sums


def _fits_into(parts: tuple[int, ...], holders: tuple[int, ...]) -> bool:
    """Whether the parts can be put into the holders, each holder being one item."""
    if not parts:
        return True
    first, rest = parts[0], parts[1:]
    for k, room in enumerate(holders):
        if room >= first and _fits_into(rest, tuple(sorted((*holders[:k], room - first, *holders[k + 1 :]), reverse=True))):
            return True
    return False


def _flat(filling: Pattern) -> tuple[int, ...]:
    return tuple(n for n, c in filling for _ in range(c))


def fillings(counts: dict[int, int], room: int, most_waste: int) -> list[tuple[int, Pattern]]:
    """Undominated fillings of ``room`` as ``(waste, filling)``, least waste first.

    A filling that could be put inside another one's items is dominated.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    if not lengths:
        return [(room, ())]
    index = {n: k for k, n in enumerate(lengths)}
    sums = _reachable(lengths, counts, room)
    found: list[tuple[int, Pattern]] = []
    budget = [2500]  # nodes of one enumeration
    for total in range(room, max(0, room - most_waste) - 1, -1):
        if not sums >> total & 1:
            continue
        if budget[0] <= 0 and found:
            break

        def build(target: int, at: int, depth: int, chosen: Pattern):
            if target == 0:
                yield chosen
                return
            if depth == DEPTH or budget[0] <= 0:
                return
            if depth == DEPTH - 1:
                if target in index and index[target] >= at:
                    yield (*chosen, (target, 1))
                return
            for k in range(max(at, bisect_left(lengths, -target, key=lambda n: -n)), len(lengths)):
                n = lengths[k]
                if n * (DEPTH - depth) < target and n * counts[n] < target:
                    return  # what follows is shorter still
                budget[0] -= 1
                most = min(counts[n], target // n)
                for copies in ({most, 1} if most > 1 else {1}):
                    yield from build(target - copies * n, k + 1, depth + 1, (*chosen, (n, copies)))

        for filling in build(total, 0, 0, ()):
            flat = _flat(filling)
            if len(flat) <= 6 and any(len(o) <= 4 and _fits_into(flat, o) for o in (_flat(f) for _, f in found)):
                continue
            found.append((room - total, filling))
            if len(found) >= WIDTH or len(flat) == 1:  # one document as long as all that may follow dominates it
                return found
        if total == 0:
            break
    if not found:  # deeper fillings than DEPTH: longest first, whatever still fits
        filling, left = [], room
        for n in lengths:
            if copies := min(counts[n], left // n):
                filling.append((n, copies))
                left -= copies * n
        found.append((left, tuple(filling)))
    return found


def _pack(pattern: Pattern, counts: dict[int, int]) -> int:
    return min(counts[n] // c for n, c in pattern)


def bin_completion(counts: dict[int, int], capacity: int, node_limit: int = NODE_LIMIT) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they hold every item once."""
    counts = {n: c for n, c in counts.items() if c}
    if any(n > capacity or n < 1 for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    if not counts:
        return []
    total = sum(n * c for n, c in counts.items())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_bins = sum(t for _, t in best)
    if best_bins == least:
        return best

    # Depth first: a frame is [fillings still to try, pattern in use, times, waste before].
    left = dict(counts)
    waste, bins, nodes = 0, 0, 0
    frames: list[list] = []

    def branch() -> list[Pattern]:
        longest = max(left)
        left[longest] -= 1
        room_left = capacity - longest
        most = (best_bins - 1) * capacity - total - waste
        options = fillings({n: c for n, c in left.items() if c}, room_left, min(room_left, max(most, 0)))
        left[longest] += 1
        patterns = []
        for lost, filling in options:
            if lost > most:
                continue
            merged = defaultdict(int)
            merged[longest] += 1
            for n, c in filling:
                merged[n] += c
            patterns.append(tuple(sorted(merged.items(), reverse=True)))
        return patterns[::-1]

    frames.append([branch(), None, 0])
    while frames and nodes < node_limit and best_bins > least:
        options, pattern, times = frames[-1]
        if pattern is not None:  # undo
            for n, c in pattern:
                left[n] = left.get(n, 0) + c * times
            lost = capacity - sum(n * c for n, c in pattern)
            waste, bins = waste - lost * times, bins - times
            frames[-1][1] = None
        if not options:
            frames.pop()
            continue
        nodes += 1
        pattern = options.pop()
        times = _pack(pattern, left)
        lost = capacity - sum(n * c for n, c in pattern)
        allowed = (best_bins - 1) * capacity - total - waste
        if lost and lost * times > allowed:
            times = allowed // lost
        if times < 1:
            continue
        for n, c in pattern:
            left[n] -= c * times
            if not left[n]:
                del left[n]
        waste, bins = waste + lost * times, bins + times
        frames[-1][1:] = [pattern, times]
        if not left:
            if bins < best_bins:
                best_bins = bins
                best = [(f[1], f[2]) for f in frames]
            continue
        if bins + lower_bound(left, capacity) >= best_bins:
            continue
        frames.append([branch(), None, 0])
    return best
