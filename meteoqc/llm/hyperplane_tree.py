"""Multiway hyperplane trees over vectors, searched by score windows.

A node has up to ``BRANCH`` split points; every row belongs to the child of its nearest split point.
For each split point and each child the node stores the range of distances to all rows below that
child. A query with an annulus (rows between two distances) drops a child as soon as the range of
one split point cannot meet it.

Scores are inner products of integer vectors. Rows are lifted onto a sphere of radius ``reach`` by
one more component, queries get zero there. Then the distance of a row falls as its score rises,
``distance^2 = query^2 + reach^2 - 2 score``, so a window of scores is an annulus. Distances only
prune (with a slack far above their rounding); scores are exact.
"""

from __future__ import annotations

import numpy as np

BRANCH, LEAF = 12, 64
LOWEST = np.iinfo(np.int64).min // 4


def lifted(x: np.ndarray, reach2: float) -> np.ndarray:
    """Rows with the component that brings all of them to the same norm."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, reach2 - (x * x).sum(1)))])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] - 2 * x @ points.T + (points * points).sum(1)[None]
    return np.sqrt(np.maximum(squares, 0.0))


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, by floating point where that holds them all."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Node:
    """Split points, children (a node, or ``-1 - leaf``), and distance ranges by split point and child."""

    def __init__(self, points: np.ndarray):
        m = len(points)
        self.points, self.children = points, [0] * m
        self.low, self.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)

    def widen(self, d: np.ndarray, child: np.ndarray) -> None:
        for j in np.unique(child):
            rows = d[child == j]
            self.low[:, j] = np.minimum(self.low[:, j], rows.min(0))
            self.high[:, j] = np.maximum(self.high[:, j], rows.max(0))

    def open_children(self, d: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which children each query must visit: every split point's range meets the query's annulus."""
        up, down = d + far[:, None], d - far[:, None]
        ball = (down[:, :, None] <= self.high[None]) & (up[:, :, None] >= self.low[None])
        beyond = d[:, :, None] + self.high[None] >= near[:, None, None]
        return (ball & beyond).all(1)


class Tree:
    """Grown on ``x`` (lifted rows) until ``leaf`` rows are left; ``members`` are the rows of each leaf."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.nodes: list[Node] = []
        self.members: list[np.ndarray] = []
        self.root = self._grow(x, np.arange(len(x)), leaf)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        points = spread(x[rows]) if len(rows) > leaf else None
        if points is None:
            self.members.append(rows)
            return -len(self.members)
        at = len(self.nodes)
        node = Node(points)
        self.nodes.append(node)
        d = distances(x[rows], points)
        child = d.argmin(1)
        node.widen(d, child)
        for j in range(len(points)):
            node.children[j] = self._grow(x, rows[child == j], leaf)
        return at

    def forget_ranges(self) -> None:
        for node in self.nodes:
            node.low[:], node.high[:] = np.inf, -np.inf

    def place(self, x: np.ndarray, widen: bool = False) -> np.ndarray:
        """The leaf of every row; ``widen`` lets the ranges follow."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                leaf[rows] = -1 - at
            elif len(rows):
                node = self.nodes[at]
                d = distances(x[rows], node.points)
                child = d.argmin(1)
                if widen:
                    node.widen(d, child)
                todo += [(node.children[j], rows[child == j]) for j in np.unique(child)]
        return leaf

    def reached(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Queries by leaves: where an annulus may have rows."""
        out = np.zeros((len(q), len(self.members)), bool)
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            at, who = todo.pop()
            if at < 0:
                out[who, -1 - at] = True
            elif len(who):
                node = self.nodes[at]
                go = node.open_children(distances(q[who], node.points), near[who], far[who])
                todo += [(node.children[j], who[go[:, j]]) for j in range(go.shape[1])]
        return out


def spread(x: np.ndarray) -> np.ndarray | None:
    """Up to ``BRANCH`` rows far from each other, out of three times as many evenly taken; None if all are equal."""
    some = x[np.linspace(0, len(x) - 1, min(len(x), 3 * BRANCH)).astype(int)]
    if (x == x[0]).all():
        return None
    if (some == some[0]).all():
        some = np.vstack([some[:1], x[(x != x[0]).any(1)][:1]])
    taken, gap = [0], distances(some, some[:1])[:, 0]
    gap[0] = -1.0
    while len(taken) < BRANCH and gap.max() > 0:
        k = int(gap.argmax())
        taken.append(k)
        gap = np.minimum(gap, distances(some, some[k:k + 1])[:, 0])
        gap[taken] = -1.0
    return some[taken] if len(taken) > 1 else None


class Search:
    """The best ``k`` rows in each score window of each query.

    ``low`` and ``high`` are windows (queries by windows, both ends belong to them); a window with
    ``low > high`` is empty. ``same`` asks for rows of the query's label, else for those of others.
    ``low`` rises as rows are found, and the annulus shrinks with it.
    """

    def __init__(self, x: np.ndarray, labels: np.ndarray, reach2: float, leaf: int = LEAF):
        self.x, self.labels, self.reach2 = x, labels, reach2
        self.slack = 1e-6 * (1.0 + np.sqrt(reach2))
        self.tree = Tree(lifted(x, reach2), leaf)

    def best(self, q: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Arrays: query, window, row, score. Rows as good as the ``k``-th are all there."""
        self.q, self.label, self.same, self.low, self.high, self.k = q, label, same, low.copy(), high, k
        self.top = np.full((*low.shape, k), LOWEST)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.lifted = np.column_stack([q, np.zeros(len(q))])
        self.near, _ = annulus(q, self.low, high, self.reach2, self.slack)
        self._visit(self.tree.root, np.flatnonzero((low <= high).any(1)))
        who, window, row, score = (np.concatenate(c) for c in zip(*self.found)) if self.found else [np.zeros(0, np.int64)] * 4
        good = score >= self.low[who, window]
        return who[good], window[good], row[good], score[good]

    def _visit(self, at: int, who: np.ndarray) -> None:
        if not len(who):
            return
        if at < 0:
            return self._score(self.tree.members[-1 - at], who)
        node = self.tree.nodes[at]
        d = distances(self.lifted[who], node.points)
        for j in np.argsort(d.mean(0), kind="stable"):
            _, far = annulus(self.q[who], self.low[who], self.high[who], self.reach2, self.slack)
            self._visit(node.children[j], who[node.open_children(d, self.near[who], far)[:, j]])

    def _score(self, rows: np.ndarray, who: np.ndarray) -> None:
        scores = inner_products(self.q[who], self.x[rows])
        fits = (self.labels[rows][None] == self.label[who][:, None]) == self.same
        for w in range(self.low.shape[1]):
            good = fits & (scores >= self.low[who, w][:, None]) & (scores <= self.high[who, w][:, None])
            i, j = np.nonzero(good)
            if len(i):
                self.found.append((who[i], np.full(len(i), w), rows[j], scores[i, j]))
                both = np.concatenate([self.top[who, w], np.where(good, scores, LOWEST)], axis=1)
                best = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:]
                self.top[who, w] = best
                self.low[who, w] = np.maximum(self.low[who, w], best.min(1))


def annulus(q: np.ndarray, low: np.ndarray, high: np.ndarray, reach2: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest distance of rows in any window of each query; nothing is within reach if all are empty."""
    some = low <= high
    least = np.where(some, low, np.iinfo(np.int64).max).min(1).astype(float)
    most = np.where(some, high, np.iinfo(np.int64).min).max(1).astype(float)
    base = (q * q).sum(1) + reach2
    near = np.sqrt(np.maximum(0.0, base - 2 * most)) - slack
    far = np.where(some.any(1) & (base - 2 * least >= -slack * slack), np.sqrt(np.maximum(0.0, base - 2 * least)) + slack, -np.inf)
    return near, far
