"""Merged partition sketches: which of very many keys may occur twice or more.

Every task sends the cells its keys touched; cells of all tasks are added up, counters stop at two.
What remains is one bit for each cell, and it never says "once" of a key that occurs twice. A sketch
that is too small for its keys says "twice" of more and more keys; that costs work later, never a
result. ``sized`` makes one whose cells follow the number of keys; what is too large to be held is
read part by part. ``tallies`` keeps counts up to 255 instead of bits; they are never too low.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meteoqc.llm.anchors import MIX, mixed
from meteoqc.llm.common import file_system, new_folder

SENT = "part int, n int, cells binary, twice binary"
#: bytes of a merged sketch that a worker holds; a larger one is read anew, part by part, for each lookup
HELD = 64 << 20
PART_CELLS = 1 << 22

#: merged sketches that a worker has read, the last two
_READ: dict[str, list[bytes]] = {}


@dataclass(frozen=True)
class Merged:
    """A merged sketch in the shared folder; tasks read it there, nothing of it passes the driver."""

    path: str
    parts: int
    size: int = 0

    @property
    def large(self) -> bool:
        return self.size > HELD

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        """(part, bits or counts) of the parts in which a key fell; one file at a time where all are too large to be held."""
        if not self.large:
            yield from enumerate(self.value)
            return
        import pyarrow.dataset as ds

        system, path = file_system(self.path)
        for file in ds.dataset(path, format="parquet", filesystem=system).get_fragments():
            got = file.to_table()
            yield from zip(got["part"].to_pylist(), got["bits"].to_pylist())

    @property
    def value(self) -> list[bytes]:
        """Bits by part, empty where no key fell."""
        if self.path not in _READ:
            import pyarrow.parquet as pq

            while len(_READ) > 1:
                _READ.pop(next(iter(_READ)))
            system, path = file_system(self.path)
            got = pq.read_table(path, filesystem=system)
            held = dict(zip(got["part"].to_pylist(), got["bits"].to_pylist()))
            _READ[self.path] = [held.get(i, b"") for i in range(self.parts)]
        return _READ[self.path]


@dataclass(frozen=True)
class Sketch:
    """``rows`` counters for a key, ``cells`` (a power of two) in each, handled in ``parts`` of equal size."""

    rows: int
    cells: int
    parts: int

    @property
    def part_cells(self) -> int:
        return self.cells // self.parts

    def cell(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (mixed(keys + np.uint64((row + 1) * int(MIX) % (1 << 64))) & np.uint64(self.cells - 1)).astype(np.int64)

    def touched(self, keys: np.ndarray, tally: bool = False) -> Iterator[pa.RecordBatch]:
        """Cells of ``keys`` by part: differences of sorted cells, byte by byte so that they compress; with whether each was met twice, or how often."""
        for row in range(self.rows):
            cell, n = np.unique(self.cell(keys, row), return_counts=True)
            often = np.minimum(n, 255).astype(np.uint8) if tally else n > 1
            edge = np.searchsorted(cell, np.arange(self.parts + 1) * self.part_cells)
            found = [(row * self.parts + i, b - a, planes(np.diff(cell[a:b], prepend=i * self.part_cells)), (often[a:b] if tally else np.packbits(often[a:b])).tobytes())
                     for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
            if found:
                part, size, cells, twice = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array(cells, pa.binary()), pa.array(twice, pa.binary())],
                                                 names=["part", "n", "cells", "twice"])

    def merge(self, batches: Iterator[pa.RecordBatch], tally: bool = False) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                cell = np.cumsum(from_planes(r["cells"], r["n"]))
                sent = np.frombuffer(r["twice"], np.uint8)
                more = sent.astype(np.uint16) if tally else 1 + np.unpackbits(sent, count=r["n"])
                count = counts.setdefault(r["part"], np.zeros(self.part_cells, np.uint8))
                count[cell] = np.minimum(count[cell] + more, 255 if tally else 2)
        for part, count in counts.items():
            kept = count if tally else np.packbits(count > 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kept.tobytes()], pa.binary())], names=["part", "bits"])

    def bits(self, sent: DataFrame, tally: bool = False) -> Merged:
        """The merged sketch, from a table of ``SENT`` rows; ``rows * cells`` bits (or bytes, of a tally) are written."""
        path = new_folder(sent.sparkSession, "sketch")
        sent.repartition(self.rows * self.parts, "part").mapInArrow(lambda batches: self.merge(batches, tally), "part int, bits binary").write.parquet(path)
        return Merged(path, self.rows * self.parts, self.rows * self.cells // (1 if tally else 8))

    def _found(self, merged: Merged | list[bytes], keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
        """(places in ``keys``, their cells within the part, the part) for each part that holds some of them."""
        held = {}
        for row in range(self.rows):
            cell = self.cell(keys, row)
            order = np.argsort(cell, kind="stable")
            edge = np.searchsorted(cell[order], np.arange(self.parts + 1) * self.part_cells)
            for i in np.flatnonzero(np.diff(edge)):
                at = order[edge[i]:edge[i + 1]]
                held[row * self.parts + int(i)] = at, cell[at] - int(i) * self.part_cells
        for part, blob in merged.blobs() if isinstance(merged, Merged) else enumerate(merged):
            if blob and part in held:
                yield *held[part], blob

    def repeated(self, bits: Merged | list[bytes], keys: np.ndarray) -> np.ndarray:
        """Whether each key is estimated to occur twice or more."""
        rows = np.zeros(len(keys), np.uint8)
        for at, c, blob in self._found(bits, keys):
            rows[at] += np.frombuffer(blob, np.uint8)[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1
        return rows == self.rows

    def counts(self, tallies: Merged | list[bytes], keys: np.ndarray) -> np.ndarray:
        """How often each key occurs, at most 255; never too low."""
        out = np.full(len(keys), 255, np.uint8)
        for at, c, blob in self._found(tallies, keys):
            out[at] = np.minimum(out[at], np.frombuffer(blob, np.uint8)[c])
        return out


def sized(keys: int) -> Sketch:
    """A sketch of at least as many cells as there are keys."""
    cells = 1 << max(16, (max(1, keys) - 1).bit_length())
    return Sketch(rows=1, cells=cells, parts=max(16, cells // PART_CELLS))


def planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)
