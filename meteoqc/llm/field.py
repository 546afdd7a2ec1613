"""A linear-chain conditional random field over word shapes: training, and Viterbi in numpy batches.

A word's shape is a number packed from small counts and classes of its characters (``ASPECTS``).
Scores of a state are sums of weights of the aspects, and of some pairs of them, of the word itself
and of its two neighbours; states follow each other with transition weights.

Where the background state beats all others by more than any transitions could win back, the best
path must pass through it. Such words cut a text into short stretches, exactly; only those go
through Viterbi, many at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: aspects of a word: name, number of values
ASPECTS = [("digits", 11), ("letters", 3), ("dots", 5), ("at", 3), ("dashes", 4), ("capitals", 3), ("others", 3),
           ("first", 6), ("last", 4), ("trailing", 2), ("check", 3), ("place", 3)]
SIZES = [n for _, n in ASPECTS]
SPACE = int(np.prod(SIZES))
#: pairs of aspects that count together
TOGETHER = [(0, 1), (0, 2), (0, 4), (3, 2), (7, 8), (0, 7), (0, 6)]
#: shapes besides those of words: nothing (before the first and after the last word)
NOTHING = int(np.ravel_multi_index([0] * 11 + [2], SIZES))
LONGEST_WORD = 511

_DIGITS = np.minimum(np.searchsorted([1, 2, 3, 4, 5, 7, 10, 13, 16, 20], np.arange(512), side="right"), 10)
_LETTERS = np.searchsorted([1, 3], np.arange(512), side="right")
_UPTO = {n: np.minimum(np.arange(512), n) for n in (2, 3, 4)}
_FIELDS = ("digits", "letters", "capitals", "dots", "at", "dashes", "others")
_KIND = np.full(256, 6, np.uint8)
_KIND[48:58], _KIND[97:123], _KIND[128:], _KIND[65:91] = 0, 1, 1, 2
_KIND[46], _KIND[64], _KIND[45] = 3, 4, 5
_WEIGHT = np.uint64(1) << (np.uint64(9) * _KIND.astype(np.uint64))
_FIRST = np.full(256, 5, np.uint8)
_FIRST[97:123], _FIRST[128:], _FIRST[65:91], _FIRST[48:58], _FIRST[43], _FIRST[40] = 0, 0, 1, 2, 3, 4
_LAST = np.full(256, 3, np.uint8)
_LAST[97:123], _LAST[128:], _LAST[65:91], _LAST[48:58], _LAST[41] = 0, 0, 0, 1, 2
_TRAIL = np.zeros(256, bool)
_TRAIL[[ord(c) for c in ".,;:!?\"'>]}"]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[ord(c) for c in "\"'<[{"]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cores(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without quotes before them and up to three marks behind them; a byte is always left."""
    low, high = start.copy(), end.copy()
    for _ in range(3):
        high -= (high - low > 1) & _TRAIL[raw[high - 1]]
    low += (high - low > 1) & _LEAD[raw[low]]
    return low, high


def shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shape of every word ``start:end`` of ``raw``, and the bounds of its core."""
    if not len(start):
        return start, start, end
    low, high = cores(raw, start, end)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_WEIGHT[raw], out=sums[1:])
    packed = sums[high] - sums[low]
    count = {f: ((packed >> np.uint64(9 * k)) & np.uint64(511)).astype(np.int64) for k, f in enumerate(_FIELDS)}
    check = np.zeros(len(start), np.int64)
    for k in np.flatnonzero((count["digits"] >= 16) & (count["digits"] <= 19) & (high - low == count["digits"])).tolist():
        check[k] = 1 if luhn(raw[low[k]:high[k]].tobytes().decode()) else 2
    parts = (_DIGITS[count["digits"]], _LETTERS[count["letters"] + count["capitals"]], _UPTO[4][count["dots"]], _UPTO[2][count["at"]],
             _UPTO[3][count["dashes"]], _UPTO[2][count["capitals"]], _UPTO[2][count["others"]], _FIRST[raw[low]].astype(np.int64),
             _LAST[raw[high - 1]].astype(np.int64), (high < end).astype(np.int64), check, np.zeros(len(start), np.int64))
    shape = np.ravel_multi_index(parts, SIZES)
    shape[high - low > LONGEST_WORD] = LONG
    return shape, low, high


LONG = int(np.ravel_multi_index([0] * 11 + [1], SIZES))


def indicators(shape: np.ndarray) -> np.ndarray:
    """Shapes by features, zeros and ones."""
    value = np.unravel_index(shape, SIZES)
    blocks = [(value[k], n) for k, n in enumerate(SIZES)]
    blocks += [(value[a] * SIZES[b] + value[b], SIZES[a] * SIZES[b]) for a, b in TOGETHER]
    out = np.zeros((len(shape), sum(n for _, n in blocks)))
    at = 0
    for v, n in blocks:
        out[np.arange(len(shape)), at + v] = 1.0
        at += n
    return out


FEATURES = sum(SIZES) + sum(SIZES[a] * SIZES[b] for a, b in TOGETHER)


class Field:
    """Weights of a field; state 0 is the background."""

    def __init__(self, states: int):
        self.states = states
        self.own, self.before, self.after = (np.zeros((FEATURES, states)) for _ in range(3))
        self.step, self.start, self.stop = np.zeros((states, states)), np.zeros(states), np.zeros(states)

    def parameters(self) -> list[np.ndarray]:
        return [self.own, self.before, self.after, self.step, self.start, self.stop]

    def tables(self, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = indicators(shape)
        return x @ self.own, x @ self.before, x @ self.after

    def swing(self) -> float:
        """The most that transitions can gain by leaving the background at one word."""
        into = np.vstack([self.step, self.start])
        out = np.column_stack([self.step, self.stop])
        gain = into[:, 1:, None] + out[None, 1:, :] - into[:, :1, None] - out[0][None, None, :]
        return float(gain.max())

    def decode(self, shape: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The best state of every word; text ``i`` covers ``borders[i]:borders[i + 1]``."""
        n = len(shape)
        states = np.zeros(n, np.uint8)
        if not n:
            return states
        seen = np.zeros(SPACE, bool)
        seen[shape] = seen[NOTHING] = True
        kinds = np.flatnonzero(seen)
        number = np.zeros(SPACE, np.int32)
        number[kinds] = np.arange(len(kinds))
        own, before, after = self.tables(kinds)
        lead = [t[:, 0] - t[:, 1:].max(1) for t in (own, before, after)]
        k, nothing = number[shape], number[NOTHING]
        filled = np.flatnonzero(np.diff(borders))
        first, last = borders[filled], borders[filled + 1] - 1
        previous, following = np.concatenate([[nothing], k[:-1]]), np.concatenate([k[1:], [nothing]])
        previous[first], following[last] = nothing, nothing
        at = np.flatnonzero(lead[0][k] + lead[1][previous] + lead[2][following] <= self.swing() + 1e-9)
        if not len(at):
            return states
        opening, closing = np.zeros(n, bool), np.zeros(n, bool)
        opening[first], closing[last] = True, True
        new = np.concatenate([[True], (np.diff(at) > 1) | opening[at[1:]]])
        begin = np.flatnonzero(new)
        length = np.diff(np.concatenate([begin, [len(at)]]))
        scores = own[k[at]] + before[previous[at]] + after[following[at]]
        enter = np.where(opening[at[begin]][:, None], self.start[None], self.step[0][None])
        leave = np.where(closing[at[begin + length - 1]][:, None], self.stop[None], self.step[:, 0][None])
        states[at] = viterbi(scores, begin, length, enter, leave, self.step)
        return states


def viterbi(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, enter: np.ndarray, leave: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best states of all stretches ``begin:begin + length`` of ``scores`` at once, longest first."""
    order = np.argsort(-length, kind="stable")
    begin, length, enter, leave = begin[order], length[order], enter[order], leave[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # stretches longer than t
    best = enter + scores[begin]
    final = best.copy()
    back = []
    for t in range(1, int(length[0])):
        n = active[t]
        ways = best[:n, :, None] + step[None]
        came = ways.argmax(1)
        best = np.take_along_axis(ways, came[:, None, :], 1)[:, 0] + scores[begin[:n] + t]
        back.append(came.astype(np.uint8))
        final[:n] = best
    out = np.zeros(len(scores), np.uint8)
    state = (final + leave).argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = active[t]
        out[begin[:n] + t] = state[:n]
        if t:
            state[:n] = back[t - 1][np.arange(n), state[:n]]
    return out


def train(texts: Sequence[np.ndarray], tags: Sequence[np.ndarray], states: int, rounds: int = 100, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam steps on all texts at once (``decay`` pulls weights to zero)."""
    field = Field(states)
    kinds, flat = np.unique(np.concatenate([[NOTHING], *texts]), return_inverse=True)
    length = np.array([len(t) for t in texts])
    width = int(length.max())
    shape = np.zeros((len(texts), width + 2), np.int64)  # padded by nothing on both sides
    shape[:] = flat[0]
    gold = np.zeros((len(texts), width), np.int64)
    at = 1
    for i, (t, g) in enumerate(zip(texts, tags)):
        shape[i, 1:len(t) + 1], gold[i, :len(t)] = flat[at:at + len(t)], g
        at += len(t)
    inside = np.arange(width)[None] < length[:, None]
    x, everyone = indicators(kinds), np.arange(len(texts))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in field.parameters()]
    for r in range(1, rounds + 1):
        own, before, after = x @ field.own, x @ field.before, x @ field.after
        scores = own[shape[:, 1:-1]] + before[shape[:, :-2]] + after[shape[:, 2:]]
        share, pairs = marginals(field, scores, length)
        error = -share * inside[:, :, None]
        rows, cols = np.nonzero(inside)
        error[rows, cols, gold[rows, cols]] += 1.0
        turn = -pairs
        later = inside[:, 1:]
        rows, cols = np.nonzero(later)
        np.add.at(turn, (gold[rows, cols], gold[rows, cols + 1]), 1.0)
        steps = []
        for near in (shape[:, 1:-1], shape[:, :-2], shape[:, 2:]):
            total = np.zeros((len(kinds), states))
            np.add.at(total, near[inside], error[inside])
            steps.append(x.T @ total)
        steps += [turn, error[everyone, 0].sum(0), error[everyone, length - 1].sum(0)]
        for p, g, (m, v) in zip(field.parameters(), steps, moments):
            g = g / len(texts) - decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return field


def marginals(field: Field, scores: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of states at every word, and expected numbers of transitions."""
    n, width, states = scores.shape
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = field.start + scores[:, 0]
    for t in range(1, width):
        forward[:, t] = log_sum(forward[:, t - 1, :, None] + field.step[None], 1) + scores[:, t]
    ends = length - 1
    for t in range(width - 1, -1, -1):
        going = np.zeros((n, states)) if t == width - 1 else log_sum(field.step[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where((ends == t)[:, None], field.stop[None], going)
    total = log_sum(forward[np.arange(n), ends] + field.stop, 1)
    share = np.exp(np.minimum(0.0, forward + backward - total[:, None, None]))
    pairs = np.zeros((states, states))
    for t in range(width - 1):
        use = ends > t
        ways = forward[use, t, :, None] + field.step[None] + (scores[use, t + 1] + backward[use, t + 1])[:, None, :] - total[use, None, None]
        pairs += np.exp(ways).sum(0)
    return share, pairs


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))
