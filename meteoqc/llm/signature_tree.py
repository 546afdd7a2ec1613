"""Signature trees: which sets of two bounded blocks are similar enough, by dual traversal.

Leaves hold a few sets each, in order of size; every node holds the OR of its sets' token bitmaps,
the range of their sizes, and the most tokens that one of its sets has beyond its bits. Two nodes
are only opened if their bitmaps and sizes leave room for the overlap that a link needs. Pairs of
sets that are already connected are not compared, so a block of copies of each other takes about as
many comparisons as it has members.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS, LEAF, FAN, CHUNK = 1024, 8, 8, 1 << 15
#: a link: PERCENT of the union, at least, is in the intersection
PERCENT = 80


@dataclass
class Level:
    """Nodes of one level: bitmaps, smallest and largest set, most tokens beyond the bits of a set."""

    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    beyond: np.ndarray


class Tree:
    """``order`` lists the sets as the leaves hold them; ``levels[0]`` are the sets, the last level is one node."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        first = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((first, sizes))
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, at in enumerate(self.order):
            b = sets[at] & np.uint64(BITS - 1)
            np.bitwise_or.at(bits[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        held = np.array([len(s) for s in sets])[self.order]
        n = sizes[self.order]
        self.levels = [Level(bits, n, n, held - np.bitwise_count(bits).sum(1))]
        for fan in self._fans(len(sets)):
            low = self.levels[-1]
            at = np.arange(0, len(low.low), fan)
            self.levels.append(Level(np.bitwise_or.reduceat(low.bits, at), np.minimum.reduceat(low.low, at), np.maximum.reduceat(low.high, at),
                                     np.maximum.reduceat(low.beyond, at)))

    @staticmethod
    def _fans(n: int) -> list[int]:
        out = []
        while n > 1:
            out.append(FAN if out else LEAF)
            n = -(-n // out[-1])
        return out


def room(a: Level, b: Level, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets below nodes ``i`` and ``j`` may be linked."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), CHUNK):
        p, q = i[at:at + CHUNK], j[at:at + CHUNK]
        common = np.bitwise_count(a.bits[p] & b.bits[q]).sum(1).astype(np.int64) + np.minimum(a.beyond[p], b.beyond[q])
        common = np.minimum(common, np.minimum(a.high[p], b.high[q]))
        low, high = np.maximum(a.low[p], b.low[q]), np.minimum(a.high[p], b.high[q])
        out[at:at + CHUNK] = ((100 + PERCENT) * common >= PERCENT * (a.low[p] + b.low[q])) & (100 * high >= PERCENT * low)
    return out


def candidate_pairs(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``order``) of the sets that dual traversal cannot rule out; within one tree each pair once."""
    same = a is b
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = room(a.levels[la], b.levels[lb], i, j)
        i, j = i[keep], j[keep]
        if la == lb == 0 or not len(i):
            return (i, j) if not same else (i[i < j], j[i < j])
        if la and (same or la >= lb):
            i, j = _children(i, j, len(a.levels[la - 1].low), FAN if la > 1 else LEAF)
            la -= 1
        if lb and (same or lb > la):
            j, i = _children(j, i, len(b.levels[lb - 1].low), FAN if lb > 1 else LEAF)
            lb -= 1
        if same:
            i, j = i[i <= j], j[i <= j]


def _children(open_: np.ndarray, other: np.ndarray, n: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    down = (open_[:, None] * fan + np.arange(fan)).ravel()
    kept = down < n
    return down[kept], np.repeat(other, fan)[kept]


def linked(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> bool:
    """The exact test; ``a`` and ``b`` are sorted tokens, of which those outside may be any that no other set holds."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return 100 * common >= PERCENT * (na + nb - common)


class Groups:
    """Union-find whose labels are the smallest member."""

    def __init__(self, labels: np.ndarray):
        self.labels = labels

    def join(self, x: int, y: int) -> None:
        low, high = sorted((self.labels[x], self.labels[y]))
        self.labels[self.labels == high] = low


def links(a: Tree, b: Tree, label_a: np.ndarray, label_b: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of different labels, enough to connect all that are connected; labels start apart or known."""
    i, j = candidate_pairs(a, b)
    i, j = a.order[i], b.order[j]
    if a is b:
        groups, x, y = Groups(label_a.copy()), i, j
    else:
        groups, x, y = Groups(np.concatenate([label_a, label_b])), i, j + len(a.sets)
    out = []
    while len(x):
        apart = groups.labels[x] != groups.labels[y]
        x, y = x[apart], y[apart]
        for p, q in zip(x[:256].tolist(), y[:256].tolist()):
            if groups.labels[p] != groups.labels[q]:
                s, t = p, q if a is b else q - len(a.sets)
                if linked(a.sets[s], a.sizes[s], b.sets[t], b.sizes[t]):
                    groups.join(p, q)
                    out.append((s, t))
        x, y = x[256:], y[256:]
    return out
