"""Statistics over time windows that end at each row, at a cost that does not grow with the rows a window holds.

Spark evaluates a frame with a moving lower end anew for every row, so a day of a station that
reports every few seconds costs thousands of steps per reading and statistic. Here the rows of one
(station, chunk) are merged into pieces of 1, 2, 4, ... neighbours, and every window is put
together from at most one piece of each size. Count, mean and squared deviations are merged by
their exact update rule, so no large sums are subtracted from each other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NO_TIME = -(2**62)  # rows without a time see each other only
BATCH_ROWS = 20_000
Parts = tuple[np.ndarray, ...]  # count, mean, squared deviations, min, max


def _merged(a: Parts, b: Parts) -> Parts:
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros(len(n)), where=n > 0)
    off = b[1] - a[1]
    return n, a[1] + off * share, a[2] + b[2] + off * off * a[0] * share, np.fmin(a[3], b[3]), np.maximum(a[4], b[4])


def _single(x: np.ndarray, valid: np.ndarray) -> Parts:
    return valid.astype(float), np.where(valid, x, 0.0), np.zeros(len(x)), np.where(valid, x, np.nan), np.where(valid, x, -np.inf)


def _with_infinite(mean: np.ndarray, x: np.ndarray, valid: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Means of windows that hold infinite values: their sign, or not a number where both signs meet."""
    def held(mark):
        total = np.concatenate([[0], np.cumsum(mark & valid)])
        return total[end] > total[first]

    up, down, nan = held(np.isposinf(x)), held(np.isneginf(x)), held(np.isnan(x))
    mean = np.where(up, np.inf, np.where(down, -np.inf, mean))
    return np.where(nan | (up & down), np.nan, mean)


def statistics(us: np.ndarray, x: np.ndarray, valid: np.ndarray, at: np.ndarray, spans: Sequence[int]) -> list[Parts]:
    """Per span count, mean, std, min and max over ``(us - span, us]`` at the rows ``at``; ``us`` ascends."""
    end = np.searchsorted(us, us[at], side="right")
    first = [np.searchsorted(us, us[at] - (span - 1), side="left") for span in spans]
    taken = [f.copy() for f in first]
    found = [_single(np.zeros(len(at)), np.zeros(len(at), bool)) for _ in spans]
    piece = _single(x, valid)
    longest = max((int((end - f).max(initial=0)) for f in first), default=0)
    with np.errstate(invalid="ignore", over="ignore"):
        for k in range(longest.bit_length()):
            for s, f in enumerate(first):
                rows = np.flatnonzero((end - f) >> k & 1)
                new = _merged(tuple(p[rows] for p in found[s]), tuple(p[taken[s][rows]] for p in piece))
                for have, values in zip(found[s], new):
                    have[rows] = values
                taken[s][rows] += 1 << k
            if longest >> k + 1:
                piece = _merged(tuple(p[: -(1 << k)] for p in piece), tuple(p[1 << k:] for p in piece))
        out = []
        odd = not np.isfinite(x[valid]).all()
        for f, (n, mean, squares, low, high) in zip(first, found):
            std = np.where(n > 1, np.sqrt(squares / np.maximum(n - 1, 1)), 0.0)
            out.append((n, _with_infinite(mean, x, valid, f, end) if odd else mean, std, low, high))
    return out


def with_statistics(table: pa.Table, ts: str, cols: Sequence[str], spans: Sequence[int], schema: pa.Schema, own: str | None) -> pa.Table:
    """The rows marked ``own`` (all, if None) and per span and column mean, std, min, max and count in that order."""
    when = pc.fill_null(table[ts].combine_chunks(), NO_TIME).to_numpy(zero_copy_only=False)
    order = np.argsort(when, kind="stable")
    mine = np.ones(len(when), bool) if own is None else table[own].to_numpy()
    at = np.flatnonzero(mine[order])
    back = np.argsort(order[at], kind="stable")  # results in the order the rows came in
    columns = {}
    for c in cols:
        col = table[c].combine_chunks()
        x = pc.fill_null(col.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)[order]
        valid = col.is_valid().to_numpy(zero_copy_only=False)[order]
        columns[c] = statistics(when[order], x, valid, at, spans)
    kept = table.filter(pa.array(mine))
    arrays = list(kept.columns)
    for s in range(len(spans)):
        for c in cols:
            n, mean, std, low, high = (v[back] for v in columns[c][s])
            for v, empty in ((mean, n == 0), (std, None), (low, n == 0), (high, n == 0), (n, None)):
                arrays.append(pa.array(v, mask=empty, from_pandas=False).cast(schema.field(len(arrays)).type))
    out = pa.Table.from_arrays(arrays, names=schema.names)
    if out.num_rows <= BATCH_ROWS:
        return out
    return pa.concat_tables(pa.Table.from_batches([b], out.schema) for b in out.combine_chunks().to_batches(max_chunksize=BATCH_ROWS))
