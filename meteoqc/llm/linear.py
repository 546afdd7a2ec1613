"""Logistic regression on sparse rows, for models that are fitted on a bounded sample of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: row ``i`` holds ``values[j]`` in columns ``columns[j]`` for ``edges[i] <= j < edges[i + 1]``."""

    edges: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: list[dict[int, float]]) -> Rows:
        n = np.array([len(r) for r in rows], np.int64)
        return cls(np.concatenate([[0], np.cumsum(n)]), np.array([c for r in rows for c in r], np.int64),
                   np.array([v for r in rows for v in r.values()], np.float64))

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        """All rows of ``parts``, one after the other."""
        base = np.concatenate([[0], np.cumsum([len(p.columns) for p in parts])])
        edges = [p.edges[1:] + b for p, b in zip(parts, base)]
        return cls(np.concatenate([[0], *edges]).astype(np.int64), np.concatenate([p.columns for p in parts]), np.concatenate([p.values for p in parts]))

    def __len__(self) -> int:
        return len(self.edges) - 1

    def take(self, at: np.ndarray) -> Rows:
        n = self.edges[at + 1] - self.edges[at]
        ends = np.cumsum(n)
        inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.edges[at], n)
        return Rows(np.concatenate([[0], ends]).astype(np.int64), self.columns[inner], self.values[inner])

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.edges))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row_numbers(), self.values * weights[self.columns], minlength=len(self))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: Rows, target: np.ndarray, width: int, decay: float = 1e-4, rounds: int = 30, batch: int = 256, rate: float = 0.3) -> np.ndarray:
    """Weights of ``width`` columns and, last, the intercept; ``target`` may be probabilities. Fixed order, so repeatable."""
    w, g2 = np.zeros(width + 1), np.full(width + 1, 1e-6)
    order = np.random.default_rng(7)
    if not len(rows):
        return w
    for _ in range(rounds):
        for at in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            part = rows.take(at)
            gap = sigmoid(part.times(w) + w[-1]) - target[at]
            step = np.zeros(width + 1)
            np.add.at(step, part.columns, part.values * gap[part.row_numbers()])
            step[-1] = gap.sum()
            step = step / len(at) + decay * np.append(w[:-1], 0)
            g2 += step * step
            w -= rate * step / np.sqrt(g2)
    return w


def calibrated(score: np.ndarray, target: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(slope, intercept) that turn scores into calibrated log odds: halved Newton steps with a little shrinkage."""
    if not len(score):
        return 1.0, 0.0
    scale = float(np.std(score)) or 1.0
    x = np.column_stack([score / scale, np.ones(len(score))])
    theta = np.zeros(2)

    def loss(t):
        z = x @ t
        return np.logaddexp(0, z).sum() - target @ z + 0.05 * t @ t

    for _ in range(rounds):
        p = sigmoid(x @ theta)
        grad = x.T @ (p - target) + 0.1 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9 or size <= 1e-6:
            break
    return float(theta[0] / scale), float(theta[1])
