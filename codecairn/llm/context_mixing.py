"""Bit predictors over hashed contexts, their mixing and its refinement, in numpy.

A text is read as bytes, A-Z lower-cased, with ``END`` after the last one.  It is
cut into units, a word with the blank behind it, and every byte is coded by the
binary decisions of a Huffman code, one for each byte that may stand before it.  Each decision is predicted in several
contexts of the same unit: the last byte, the last two, the last four, and all
bytes of the unit so far.  A predictor is the counts of zeros and ones that the
corpus had in that context, kept as one state byte.
"""

from __future__ import annotations

import heapq
import re
from itertools import accumulate

import numpy as np
import pandas as pd
import zstandard

END = 255
#: Bytes of the unit that each context sees; None: all so far.
ORDERS = (2, 4, None)
#: Inputs of the mixer: one per context and the decision's own frequency.
INPUTS = len(ORDERS) + 1
#: Weight sets: what is known of the two longest contexts, times the depth of the decision.
GATES = 18
#: Counts that a state tells apart (a count is taken down to the next of them).
LEVELS = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512, 4096, 65536])
#: Added to both counts of a predictor.
PRIOR = 0.4
#: Units before a document's weights are refined first; each time twice as many, up to the last.
BLOCK, LAST_BLOCK = 64, 512
#: Cells of the refinement map over the mixed prediction, and the weight of its start.
CELLS, CELL_PRIOR = 33, 40.0
#: Step of the weights towards their local optimum, what damps it at the start, and
#: what a decision's variance counts for.
RATE, DAMPING, CURVE = 1.0, 100.0, 16.0
#: Start of the mixer's weights, in every gate of every text.
FIRST = np.array([0.15, 0.35, 0.7, 0.3], np.float32)

_UNIT = re.compile(rb"[^\x20\x09-\x0D]*+[\x20\x09-\x0D]")


def units_of(segment: bytes, last: bool) -> list[bytes]:
    """Words with the blank behind them, and lone blanks; the last one carries the end."""
    units = _UNIT.findall(segment)
    if last:
        units.append(segment[sum(map(len, units)) :] + bytes([END]))
    return units


def segments_of(text: bytes, size: int) -> list[bytes]:
    """A text in parts of about ``size`` bytes, cut behind blanks only."""
    out, at = [], 0
    while len(text) - at > size:
        cut = re.compile(rb"[\x20\x09-\x0D]").search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.end()])
        at = cut.end()
    return [*out, text[at:]]


def pack(values: np.ndarray) -> bytes:
    """An array of integers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


class Code:
    """A Huffman code for each byte seen before: the decisions (node, bit) of every pair.

    ``counts``: occurrences of (byte before, byte) in order of the pair's number
    ``256 * before + byte``; the byte before the first of a unit is ``END``.
    """

    def __init__(self, counts: np.ndarray):
        length, nodes, bits, own = [], [], [], np.zeros((256, 256), np.float32)
        plain = None
        for before, row in enumerate(counts.reshape(256, 256)):
            if plain is not None and not row.any():  # never seen: one code for all of these
                paths, odds = plain
            else:
                paths, odds = _huffman(row)
                if not row.any():
                    plain = paths, odds
            own[before, :255] = odds
            for path in paths:
                length.append(len(path))
                nodes += [node for node, _ in path]
                bits += [bit for _, bit in path]
        self.length = np.array(length, np.int32)
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length
        self.node, self.bit = np.array(nodes, np.uint8), np.array(bits, np.uint8)
        pair = np.repeat(np.arange(65536), self.length)
        odds = own[pair >> 8, self.node]
        self.own = np.clip(np.round(odds * 8) + 128, 0, 255).astype(np.uint8)  # place in OWN

    def decisions(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per decision of the pairs: which pair, its depth, its place in the code."""
        n = self.length[pairs]
        which = np.repeat(np.arange(len(pairs), dtype=np.int32), n)
        depth = np.arange(len(which), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int32) - n, n)
        return which, depth, self.start[pairs][which] + depth


def _huffman(counts: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[float]]:
    """Paths of all bytes from the root, and the log odds of a one at every node."""
    heap = [(int(c) + 1, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    odds = []
    for node in range(255):
        (zero, a), (one, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a], above[b] = (node, 0), (node, 1)
        odds.append(float(np.log(one / zero)))
        heapq.heappush(heap, (zero + one, 256 + node))
    paths = []
    for s in range(256):
        path, at = [], s
        while at in above:
            path.append(above[at])
            at = 256 + above[at][0]
        paths.append(path[::-1])
    return paths, odds


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(64 - bits)


class Units:
    """Distinct units, byte by byte, and their hashed contexts."""

    def __init__(self, whole: bytes, sizes: np.ndarray):
        self.size = sizes.astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.symbol = np.frombuffer(whole, np.uint8)
        self.unit = np.repeat(np.arange(len(sizes), dtype=np.int32), self.size)
        self.ends = self.symbol[self.first + self.size - 1] == END if len(sizes) else np.zeros(0, bool)
        self.inside = np.arange(len(self.symbol)) - np.repeat(self.first, self.size)
        before = np.concatenate([[END], self.symbol[:-1]]).astype(np.int32)
        before[self.first] = END
        self.pair = before * 256 + self.symbol

    def keys(self, bits: int):
        """Per context: (hash of the context, byte before, byte) of every byte, as one integer.

        A context that reaches the start of the unit is that of all bytes so far.
        """
        inside = self.inside
        byte, pair = self.symbol.astype(np.uint64), self.pair.astype(np.uint64)
        # a polynomial hash of all bytes before, from running sums
        power = np.cumprod(np.full(int(inside.max(initial=0)) + 1, 0xD1B54A32D192ED03, np.uint64))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((byte + np.uint64(1)) * power[inside])])
        whole = (_mixed(running[:-1] - np.repeat(running[self.first], self.size), bits) << np.uint64(16)) | pair
        for order in ORDERS:
            if order is None:
                yield whole
                continue
            inner = np.flatnonzero(inside > order)
            seen = np.full(len(inner), order << 50, np.uint64)
            for back in range(1, order + 1):
                seen |= (byte[inner - back] + np.uint64(1)) << np.uint64(9 * (back - 1))
            keys = whole.copy()
            keys[inner] = (_mixed(seen, bits) << np.uint64(16)) | pair[inner]
            yield keys


def distinct_keys(units: Units, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys of a batch in ascending order, and per context the place of each byte's key."""
    code, keys = pd.factorize(np.concatenate(list(units.keys(bits))))
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return keys[order], np.split(place[code], len(ORDERS))


def key_counts(units: Units, places: list[np.ndarray], counts: np.ndarray, n_keys: int) -> np.ndarray:
    """Occurrences of the keys, given those of the units; a key counts once for each byte."""
    out, each = np.zeros(n_keys), counts[units.unit]
    for order, place in zip(ORDERS, places):
        rows = slice(None) if order is None else units.inside > order
        out += np.bincount(place[rows], each[rows], n_keys)
    return out


def level(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(LEVELS, counts, side="right") - 1).astype(np.uint8)


def states(keys: np.ndarray, counts: np.ndarray, code: Code) -> np.ndarray:
    """State bytes along the code of every (context, pair), keys ascending and distinct."""
    which, _, at = code.decisions((keys & np.uint64(65535)).astype(np.int64))
    context = np.cumsum(np.diff(keys >> np.uint64(8), prepend=keys[:1] >> np.uint64(8)) != 0)
    node, _ = pd.factorize(context[which] * 256 + code.node[at])
    ones = code.bit[at].astype(bool)
    n = counts[which].astype(np.float64)
    n1 = np.bincount(node, np.where(ones, n, 0))
    n0 = np.bincount(node, np.where(ones, 0, n))
    return (level(n0) * 16 + level(n1))[node]


#: Log odds of a one for every state, and the occurrences that it stands for.
_ZEROS, _ONES = np.repeat(LEVELS, 16), np.tile(LEVELS, 16)
FULL = np.log((_ONES + PRIOR) / (_ZEROS + PRIOR)).astype(np.float32)
SEEN = _ZEROS + _ONES
#: Log odds of a decision's own frequency, in steps.
OWN = ((np.arange(256) - 128) / 8).astype(np.float32)


def gates(state: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Weight sets of decisions, by their states and their depth in the code."""
    word, tail = SEEN[state[:, -1]], SEEN[state[:, -2]]
    known = np.where(word > 0, 2 + (word > 3) + (word > 31) + (word > 500), tail > 0)
    return (known * 3 + np.minimum((depth + 1) // 2, 2)).astype(np.uint8)


#: Decisions worked on at once, for the sake of memory and caches.
CHUNK = 150_000


class Decisions:
    """Every decision of a batch's distinct units, as eight bytes each.

    The states, then the gate and the bit, then the decision's own odds.
    """

    def __init__(self, units: Units, places: list[np.ndarray], keys: np.ndarray, answers: np.ndarray, code: Code):
        length = code.length[(keys & np.uint64(65535)).astype(np.int64)]
        offset = np.cumsum(length, dtype=np.int32) - length
        each = code.length[units.pair]
        self.packed = np.empty((int(each.sum()), 8), np.uint8)
        at = 0
        for a in range(0, len(units.pair), CHUNK // 3):
            part = slice(a, a + CHUNK // 3)
            which, depth, where = code.decisions(units.pair[part])
            rows = self.packed[at : at + len(which)]
            for k, place in enumerate(places):
                rows[:, k] = answers[offset[place[part]][which] + depth]
            rows[:, len(ORDERS)] = gates(rows[:, : len(ORDERS)], depth) * 2 + code.bit[where]
            rows[:, len(ORDERS) + 1] = code.own[where]
            at += len(which)
        self.packed = self.packed.view(np.uint64).ravel()
        self.count = np.bincount(units.unit, each, len(units.size)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count


def log2_likelihood(decisions: Decisions, sequence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log2 probability of each text: mixed predictions, refined while it is read.

    ``sequence``: units of all texts, ``sizes``: how many each has, one at least.
    Texts of like length move on side by side, a block of units at a time.
    """
    order = np.argsort(-sizes, kind="stable")
    first, out = np.cumsum(sizes) - sizes, np.empty(len(sizes))
    width = max(1, CHUNK // (BLOCK * 20))
    for a in range(0, len(order), width):
        side = order[a : a + width]
        out[side] = _side_by_side(decisions, sequence, first[side], sizes[side])
    return out


def _side_by_side(d: Decisions, sequence: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts by falling length.  A block is predicted with what the text before it
    has taught; then the text's weights take a damped step to their local optimum
    and its map of mixed predictions is updated."""
    total = np.zeros(len(sizes))
    slots = len(sizes) * GATES
    mix = np.repeat(FIRST[:, None], slots, axis=1)
    curve = np.full(slots, DAMPING)
    centre = 1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))
    cells = np.tile((centre * CELL_PRIOR).astype(np.float32), slots)
    seen = np.full(len(cells), CELL_PRIOR, np.float32)
    at, block = 0, BLOCK
    while True:
        active = int(np.searchsorted(-sizes, -at))  # texts with more than ``at`` units
        n = np.minimum(sizes[:active] - at, block)
        starts = np.cumsum(n) - n
        unit = sequence[np.arange(int(n.sum())) + np.repeat(first[:active] + at - starts, n)]
        m = d.count[unit]
        row = np.arange(int(m.sum()), dtype=np.int32) + np.repeat((d.first[unit] - (np.cumsum(m) - m)).astype(np.int32), m)
        lane = np.repeat(np.arange(active, dtype=np.int32), np.add.reduceat(m, starts))
        packed = d.packed[row].view(np.uint8).reshape(-1, 8)
        x = np.empty((INPUTS, len(row)), np.float32)
        for k in range(len(ORDERS)):
            FULL.take(packed[:, k], out=x[k])
        OWN.take(packed[:, INPUTS], out=x[-1])
        bit = (packed[:, INPUTS - 1] & 1).astype(np.float32)
        slot = lane * GATES + (packed[:, INPUTS - 1] >> 1)
        z = np.einsum("kn,kn->n", x, mix[:, slot])
        p = 1 / (1 + np.exp(-z))
        cell = slot * CELLS + (np.clip(z, -8, 8) * np.float32((CELLS - 1) / 16) + np.float32(CELLS / 2)).astype(np.int32)
        final = np.clip((p + cells[cell] / seen[cell]) * np.float32(0.5), np.float32(1e-6), np.float32(1 - 1e-6))
        total[:active] += np.bincount(lane, np.log2(np.abs(1 - bit - final)), active)
        at, block = at + block, min(2 * block, LAST_BLOCK)
        if sizes[0] <= at:
            return total
        size = active * GATES
        error = bit - p
        curve[:size] += np.bincount(slot, p * (1 - p), size) * CURVE
        for k in range(INPUTS):
            mix[k, :size] += (RATE * np.bincount(slot, error * x[k], size) / curve[:size]).astype(np.float32)
        cells[: size * CELLS] += np.bincount(cell, bit, size * CELLS)
        seen[: size * CELLS] += np.bincount(cell, minlength=size * CELLS)
