"""Periodic runs of words, found by uniting suffix classes in descending order of common prefixes.

A run is a stretch of words with smallest period ``q`` that is at least twice as long, and that no
neighbouring word extends. Runs are found inside each document, so documents are never shuffled:

1. Suffixes can only belong to a run where their first ``gram`` words (half the shortest run) occur
   again in the document. One count of hashed grams picks them (and the ``gram`` suffixes behind each,
   with which prefix doubling compares).
2. Prefix doubling sorts the picked suffixes; the ranks of each round are kept, and the longest
   common prefix (LCP) of neighbours in the order follows from them by halving.
3. Kruskal: neighbours are united from the largest LCP down. Every class holds its positions in
   order, the smaller set goes into the larger one. Positions ``i < j`` that become adjacent at LCP
   ``L`` with ``j - i <= L`` repeat with period ``j - i`` as far as ``j + L``; that is a run if the
   word before does not continue it. Each run has exactly one such pair, its first two periods:
   a position between them in the same class would give a smaller period.

Documents are worked on in slices of about 1 MB of text, a longer text by itself; one text needs some
200 bytes of memory for each word that repeats. Words are compared by 64-bit hashes.

Null and empty text has no words and no runs. Rows that share a ``doc_id``, or have none, are
documents of their own. Other columns are not read. An empty table gives no rows. Equal lengths are
ranked by start, then by period.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.llm import anchors
from meteoqc.llm.common import slices, table
from meteoqc.llm.window_dedup import Words

LEAST = 12
RUNS = "doc_id long, start long, length long, period long"
RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


class Found(NamedTuple):
    """Runs of all documents of a batch, by document, start and period; ``start`` counts from the document's first word."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def repeated_positions(symbols: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Positions, in order, whose next ``gram`` symbols occur again in their document, and the ``gram`` positions after each."""
    n = len(symbols) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = np.flatnonzero(doc[:n] == doc[gram - 1:])
    key = anchors.mixed(anchors.gram_hashes(symbols, gram)[inside] + anchors.mixed(doc[inside].astype(np.uint64) + np.uint64(1)))
    bucket = (key >> np.uint64(64 - 20)).astype(np.int64)
    often = np.flatnonzero(np.bincount(bucket, minlength=1 << 20)[bucket] > 1)  # spares most of the sort
    key, inside = key[often], inside[often]
    order = np.argsort(key, kind="stable")
    key = key[order]
    equal = key[1:] == key[:-1]
    edge = np.zeros(len(symbols) + gram + 1, np.int32)
    again = np.unique(inside[order][np.concatenate([equal, [False]]) | np.concatenate([[False], equal])] if len(key) else inside)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + gram + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:len(symbols)]))
    first = np.maximum.accumulate(np.where(np.isin(at, again, assume_unique=True), at, -1))
    return at[doc[first] == doc[at]]


def starts_of(new: np.ndarray) -> np.ndarray:
    """For every place the last place at or before it that starts a group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class Suffixes:
    """Sorted suffixes at the positions ``at``, in an order that keeps equal beginnings of any length together.

    Where the first ``gram`` symbols (times a power of two) of two suffixes at ``at`` are equal, the
    suffixes behind those symbols must be at ``at`` as well.
    """

    def __init__(self, symbols: np.ndarray, doc: np.ndarray, at: np.ndarray, gram: int):
        self.symbols, self.doc, self.at, self.gram = symbols, doc, at, gram
        self.place = np.full(len(symbols), -1, np.int32)
        self.place[at] = np.arange(len(at), dtype=np.int32)
        self.ranks = [self._first_ranks()]
        step = gram
        while True:
            rank = self.ranks[-1]
            many = np.flatnonzero(np.bincount(rank, minlength=len(at))[rank] > 1)
            if not len(many):
                break
            ahead = self._rank(rank, at[many], np.full(len(many), step))
            order = np.lexsort((ahead, rank[many]))
            own, ahead, many = rank[many][order], ahead[order], many[order]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            outer = starts_of(new)
            inner = starts_of(new | np.concatenate([[True], ahead[1:] != ahead[:-1]]))
            rank = rank.copy()
            rank[many] = own + (inner - outer)
            self.ranks.append(rank)
            step *= 2
        self.order = np.argsort(self.ranks[-1], kind="stable")

    def _first_ranks(self) -> np.ndarray:
        """Ranks by document and the next ``gram`` symbols; a document's end comes before all symbols."""
        last = len(self.symbols) - 1
        own = self.doc[self.at]
        keys = []
        for k in range(self.gram):
            to = np.minimum(self.at + k, last)
            keys.append(np.where((self.at + k <= last) & (self.doc[to] == own), self.symbols[to], np.uint64(0)))
        order = np.lexsort((*reversed(keys), own))
        new = np.zeros(len(order), bool)
        new[0] = True
        for key in (own, *keys):
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(order), np.int32)
        rank[order] = starts_of(new)
        return rank

    def _rank(self, rank: np.ndarray, start: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Ranks ``offset`` symbols after ``start``; whatever ends or occurs once is different from all else."""
        to = np.minimum(start + offset, len(self.symbols) - 1)
        inside = (start + offset < len(self.symbols)) & (self.doc[to] == self.doc[start])
        place = np.where(inside, self.place[to], -1)
        return np.where(place >= 0, rank[place], -1 - np.where(inside, to, start))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours in the order that share a gram: places (numbers into ``at``) and LCP."""
        a, b = self.order[:-1], self.order[1:]
        same = self.ranks[0][a] == self.ranks[0][b]
        a, b = a[same], b[same]
        lcp = np.zeros(len(a), np.int64)
        i, j = self.at[a], self.at[b]
        for r in range(len(self.ranks) - 1, -1, -1):
            equal = self._rank(self.ranks[r], i, lcp) == self._rank(self.ranks[r], j, lcp)
            lcp += np.where(equal, self.gram << r, 0)
        going, last = np.ones(len(a), bool), len(self.symbols) - 1
        for _ in range(self.gram - 1):
            p, q = np.minimum(i + lcp, last), np.minimum(j + lcp, last)
            going &= (i + lcp <= last) & (j + lcp <= last) & (self.doc[p] == self.doc[i]) & (self.doc[q] == self.doc[j])
            going &= self.symbols[p] == self.symbols[q]
            lcp += going
        return a, b, lcp


def unite(at: np.ndarray, a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Seeds (i, j, LCP): positions that become adjacent, at a distance within their LCP, as classes unite."""
    order = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    sets: dict[int, list[int]] = {}
    seeds: list[tuple[int, int, int]] = []
    where = at.tolist()
    for x, y, height in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist()):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        while (up := parent.get(y, y)) != y:
            parent[y] = y = parent.get(up, up)
        large, small = sets.get(x) or [where[x]], sets.pop(y, None) or [where[y]]
        if len(large) < len(small):
            large, small = small, large
        cuts = [bisect_left(large, p) for p in small]
        end = len(small) - 1
        for k, (p, cut) in enumerate(zip(small, cuts)):
            if cut and (k == 0 or cuts[k - 1] != cut) and p - large[cut - 1] <= height:
                seeds.append((large[cut - 1], p, height))
            if cut < len(large) and (k == end or cuts[k + 1] != cut) and large[cut] - p <= height:
                seeds.append((p, large[cut], height))
        if len(small) < 32:
            for p, cut in zip(reversed(small), reversed(cuts)):
                large.insert(cut, p)
        else:
            large = sorted(large + small)  # two ordered stretches: a merge
        parent[y] = x
        sets[x] = large
    return np.array(seeds, np.int64).reshape(-1, 3)


def find_runs(symbols: np.ndarray, borders: np.ndarray, least: int = LEAST) -> Found:
    """Runs of ``least`` symbols and more in every document; document ``i`` covers ``borders[i]:borders[i + 1]``."""
    gram = max(1, -(-least // 2))
    doc = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    at = repeated_positions(symbols, doc, gram)
    none = np.zeros(0, np.int64)
    if not len(at):
        return Found(none, none, none, none)
    suffixes = Suffixes(symbols, doc, at, gram)
    a, b, lcp = suffixes.neighbours()
    # a class whose closest members lie further apart than its longest prefix holds no run
    number = suffixes.ranks[0]
    top, near = np.zeros(len(at), np.int64), np.full(len(at), len(symbols) + 1)
    np.maximum.at(top, number[a], lcp)
    order = np.argsort(number, kind="stable")
    same = number[order][1:] == number[order][:-1]
    np.minimum.at(near, number[order][1:][same], np.diff(at[order])[same])
    keep = near[number[a]] <= top[number[a]]
    i, j, height = unite(at, a[keep], b[keep], lcp[keep]).T
    first = borders[doc[i]]
    long = (height + j - i >= least) & ((i == first) | (symbols[i - 1] != symbols[j - 1]))
    i, j, height = i[long], j[long], height[long]
    order = np.lexsort((j - i, i))
    i, j, height = i[order], j[order], height[order]
    return Found(doc[i], i - borders[doc[i]], height + j - i, j - i)


def hidden_repeats(doc_ids: list[int | None], borders: np.ndarray) -> np.ndarray:
    """For every word the word that stands there, with repeats planted in a tenth of the documents.

    With h = crc32(decimal id), every document with h % 10 = 0 repeats itself from word a = g % n on
    with period 1 + (n - a) // (3 + g % 8), where g = h // 10. Documents without an id stay as they are.
    """
    index = np.arange(borders[-1])
    for k, doc_id in enumerate(doc_ids):
        n = int(borders[k + 1] - borders[k])
        if doc_id is None or not n:
            continue
        g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
        if rest == 0:
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            index[borders[k] + a:borders[k + 1]] = borders[k] + a + np.arange(n - a) % period
    return index


def collapsed_mask(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: all but those of a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) == 0


class Batch:
    """Documents of a batch with their words and runs."""

    def __init__(self, batch: pa.RecordBatch, least: int, planted: bool):
        column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        self.ids = column("doc_id")
        self.docs = [(t or "").encode() for t in column("text")]
        words = Words(self.docs)
        symbols = words.symbols()
        self.borders = words.borders
        self.index = hidden_repeats(self.ids, self.borders) if planted else None
        self.runs = find_runs(symbols if self.index is None else symbols[self.index], self.borders, least)
        self.bounds = np.searchsorted(self.runs.doc, np.arange(len(self.docs) + 1))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = slice(self.bounds[k], self.bounds[k + 1])
        return self.runs.start[part], self.runs.length[part], self.runs.period[part]

    def collapsed(self, k: int) -> bytes:
        words = self.docs[k].split()
        if self.index is not None:
            words = [words[i] for i in (self.index[self.borders[k]:self.borders[k + 1]] - self.borders[k]).tolist()]
        start, length, period = self.of(k)
        if len(start):
            words = [w for w, stays in zip(words, collapsed_mask(len(words), start, length, period).tolist()) if stays]
        return b" ".join(words)


def _listing(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def runs(batches):
        for b in slices(batches, "text"):
            own = Batch(b, least, False)
            ids = pa.array([own.ids[k] for k in own.runs.doc.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype("<i8")) for x in own.runs[1:])], names=["doc_id", "start", "length", "period"])

    return runs


def _collapsing(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def collapse(batches):
        for b in slices(batches, "text"):
            own, texts = Batch(b, least, False), b.column(1).to_pylist()
            kept = [t if own.bounds[k] == own.bounds[k + 1] else own.collapsed(k).decode() for k, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return collapse


def _digesting(least: int, planted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def digest(batches):
        for b in slices(batches, "text"):
            own, out = Batch(b, least, planted), []
            for k, doc_id in enumerate(own.ids):
                start, length, period = own.of(k)
                best = (None, None, None, None)
                if len(start):
                    top = np.lexsort((period, start, -length))[0]
                    best = (int(start[top]), int(length[top]), int(period[top]), int(1000 * length[top] // period[top]))
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
                out.append((doc_id, len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(own.collapsed(k)).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return digest


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Every run of ``least`` words and more: doc_id, first word, number of words, period."""
    return _own(docs).mapInArrow(_listing(least), RUNS)


def without_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text): documents with runs keep the first period of each, words joined by one space; others stay as they are."""
    return _own(docs).mapInArrow(_collapsing(least), "doc_id long, text string")


def run_digests(docs: DataFrame, least: int = LEAST, planted: bool = False) -> DataFrame:
    """One row per document: number of runs, the longest one, hashes of all runs and of the collapsed text."""
    return _own(docs).mapInArrow(_digesting(least, planted), RESULT)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"), planted=True)
