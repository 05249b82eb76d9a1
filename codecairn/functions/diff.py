"""The shortest edit script between two lists of lines, in linear space.

Divide and conquer on the middle of an optimal path, found by greedy searches
from both ends.  What both lists begin and end with is set aside first, and so
are lines that only one of them has: these are in no common subsequence, so the
script stays shortest while unlike texts cost little.
"""

from __future__ import annotations


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A run (x0, y0) to (x1, y1) of equal lines, maybe empty, on a shortest path of two edits or more."""
    n, m = len(a), len(b)
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            x0, y0 = x, x - k
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and abs(delta - k) < d and x + back[delta - k] >= n:
                return x0, y0, x, x - k
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            x0, y0 = x, x - k
            while x < n and x - k < m and a[n - 1 - x] == b[m - 1 - x + k]:
                x += 1
            back[k] = x
            if delta % 2 == 0 and abs(delta - k) <= d and x + ahead[delta - k] >= n:
                return n - x, m - x + k, n - x0, m - y0
    raise AssertionError("the searches meet")


def line_changes(old: list[str], new: list[str]) -> tuple[list[int], list[int]]:
    """Places of the lines that go from ``old`` and come in ``new``, as few as can be."""
    both = set(old) & set(new)
    number: dict[str, int] = {}
    a = [(number.setdefault(x, len(number)), i) for i, x in enumerate(old) if x in both]
    b = [(number.setdefault(x, len(number)), i) for i, x in enumerate(new) if x in both]
    gone = [i for i, x in enumerate(old) if x not in both]
    come = [i for i, x in enumerate(new) if x not in both]
    left, right = [x for x, _ in a], [x for x, _ in b]
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and left[a0] == right[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and left[a1 - 1] == right[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            gone += [a[i][1] for i in range(a0, a1)]
            come += [b[i][1] for i in range(b0, b1)]
            continue
        x0, y0, x1, y1 = _middle(left[a0:a1], right[b0:b1])
        open_ += [(a0, a0 + x0, b0, b0 + y0), (a0 + x1, a1, b0 + y1, b1)]
    return sorted(gone), sorted(come)


def hunks(old: list[str], new: list[str], gone: list[int], come: list[int]) -> str:
    """The changes as text: where, the lines that go, the lines that come."""
    out, i, j, g, c = [], 0, 0, 0, 0
    while g < len(gone) or c < len(come):
        # lines in common up to the next change
        step = min(gone[g] - i if g < len(gone) else len(old), come[c] - j if c < len(come) else len(new))
        i, j = i + step, j + step
        g0, c0 = g, c
        while g < len(gone) and gone[g] == i:
            g, i = g + 1, i + 1
        while c < len(come) and come[c] == j:
            c, j = c + 1, j + 1
        out.append(f"@@ -{i - (g - g0) + 1},{g - g0} +{j - (c - c0) + 1},{c - c0} @@")
        out += ["-" + old[x] for x in gone[g0:g]] + ["+" + new[x] for x in come[c0:c]]
    return "\n".join(out)
