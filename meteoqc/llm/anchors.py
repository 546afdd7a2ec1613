"""Anchors: positions chosen by content so that every window of a text holds one.

The anchor of a window is the start of its smallest gram (by a hash; leftmost of equals). It is a
function of the window's content, so two equal windows have their anchors at the same place in the
window. Windows with the same anchor follow each other; such a run of windows is one *span*. About
two of ``window - gram`` positions are anchors, and instead of every window only spans have to be
compared: windows can only be equal where the grams at their anchors are.

Symbols are 64-bit numbers (of bytes or of words). Several documents are handled as one array;
spans never reach across their borders.
"""

from __future__ import annotations

import numpy as np

PLACE_BITS = 24
#: grams that are searched at a time, so that places fit their bits (a power of two)
LONGEST = 1 << PLACE_BITS
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for i, b in enumerate((BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` neighbouring symbols."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(symbols))
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:len(symbols)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[:n])


def part_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each part ``start:end``, its length included."""
    up, down = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:len(symbols)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima within blocks of that width."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors_of(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost of equals) of every ``width`` neighbouring grams.

    Grams are searched in parts of at most ``LONGEST``, or twice ``width`` if that is more; parts
    overlap by ``width - 1`` grams, so every window lies in one of them as a whole.
    """
    part = max(LONGEST, 1 << (2 * width - 1).bit_length())
    low = np.uint64(part - 1)
    n = len(grams) - width + 1
    anchor = np.zeros(n, np.int64)
    for at in range(0, n, part - width + 1):
        own = grams[at:at + part]
        packed = (own & ~low) | np.arange(len(own), dtype=np.uint64)
        anchor[at:at + len(own) - width + 1] = at + (sliding_minimum(packed, width) & low).astype(np.int64)
    return anchor


def spans(symbols: np.ndarray, borders: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Spans of all documents in ``symbols``; document ``i`` covers ``borders[i]:borders[i + 1]``.

    Returns arrays: document, first window start, last window start, anchor, hash of the anchor's gram.
    """
    grams = gram_hashes(symbols, k)
    width = window - k + 1
    none = np.zeros(0, np.int64)
    if len(grams) < width:
        return none, none, none, none, np.zeros(0, np.uint64)
    anchor = anchors_of(grams, width)
    doc = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    inside = doc[:len(anchor)] == doc[window - 1:window - 1 + len(anchor)]
    start = np.flatnonzero(inside)
    if not len(start):
        return none, none, none, none, np.zeros(0, np.uint64)
    a, d = anchor[start], doc[start]
    new = np.flatnonzero((np.diff(a) != 0) | (np.diff(d) != 0)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new - 1, [len(start) - 1]])
    return d[first], start[first], start[last], a[first], grams[a[first]]
