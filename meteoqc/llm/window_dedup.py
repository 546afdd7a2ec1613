"""Removal of words covered by a window that also starts earlier; a count-min sketch goes first.

A window is ``window`` consecutive words of one document. Windows are counted at their anchors
(see ``anchors``): equal windows have equal grams at their anchors, so a window whose anchor gram
occurs once in the corpus cannot be repeated.

1. Every task counts its anchor grams in a count-min sketch and sends the cells it touched. Sketches
   are merged cell by cell; counters stop at two, since only "twice or more" matters. The merged
   sketch has a fixed size, whatever the corpus.
2. A second pass keeps the spans whose gram the sketch estimates as repeated. A sketch never
   estimates too low, so no repeated window is lost; a full sketch only lets more spans through.
3. Exact grouping: spans with equal windows throughout are grouped first; all but the earliest are
   covered whole. Only where different spans share a gram are single windows of the earliest ones
   grouped, and all but the earliest of each group are covered. Spans carry one hash each; windows
   are hashed from the text again, in those few documents that hold such spans.

Words are runs of bytes other than space and 09-0D. Null text has no words and keeps none. Documents
count in ``doc_id`` order; rows that share a ``doc_id`` (or have none, which come first) count as
documents of their own, in a fixed order. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.llm import anchors
from meteoqc.llm.common import keyed, slices, staged, table
from meteoqc.llm.sketch import SENT, Sketch

WINDOW, GRAM = 20, 8
SKETCH = Sketch(rows=2, cells=1 << 26, parts=32)
#: anchors that a task holds before it sends their cells
FLUSH = 2_000_000
#: opened spans that may be broadcast (up to about 170 MB; more of them are joined by a shuffle)
BROADCAST_ROWS = 1_000_000
SPANS = "row long, first int, n int, seed long, whole long"
WINDOWS = "seed long, hash long, row long, a int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = anchors.mixed(np.arange(1, 257, dtype=np.uint64) * anchors.BASE)


class Words:
    """Words of several documents in one buffer, each followed by one byte of white space."""

    def __init__(self, documents: list[bytes]):
        raw = np.frombuffer(b"\n".join([*documents, b""]), np.uint8)
        blank = _SPACE[raw]
        start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        self.raw, self.start, self.end = raw, start, end
        ends = np.cumsum([len(d) + 1 for d in documents]) if documents else np.zeros(0, np.int64)
        self.borders = np.concatenate([[0], np.searchsorted(start, ends)])

    def symbols(self) -> np.ndarray:
        """A 64-bit number for each word, from running sums over its bytes."""
        n = len(self.raw)
        up, down = anchors.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[self.raw] * up[:n], out=sums[1:])
        return anchors.mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def _documents(batch: pa.RecordBatch) -> list[bytes]:
    return [(x or "").encode() for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _spans(batch: pa.RecordBatch, window: int, gram: int):
    words = Words(_documents(batch))
    symbols = words.symbols()
    return (words, symbols, *anchors.spans(symbols, words.borders, window, gram))


def _sketching(sketch: Sketch, window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches):
        held, n = [], 0
        for b in slices(batches, "text"):
            held.append(_spans(b, window, gram)[-1])
            n += len(held[-1])
            if n > FLUSH:
                yield from sketch.touched(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from sketch.touched(np.concatenate(held))

    return send


def _keeping(sketch: Sketch, bits, window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches):
        for b in slices(batches, "text"):
            words, symbols, doc, first, last, _, seed = _spans(b, window, gram)
            at = np.flatnonzero(sketch.repeated(bits.value, seed))
            if not len(at):
                continue
            doc, first, last, seed = doc[at], first[at], last[at], seed[at]
            whole = anchors.part_hashes(symbols, first, last + window)
            rows = b.column(b.schema.get_field_index("row")).to_numpy(zero_copy_only=False)[doc]
            yield pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()), pa.array((first - words.borders[doc]).astype("<i4")), pa.array((last - first + 1).astype("<i4")),
                pa.array(seed.view(np.int64)), pa.array(whole.view(np.int64))], names=["row", "first", "n", "seed", "whole"])

    return keep


def candidate_spans(own: DataFrame, window: int = WINDOW, gram: int = GRAM, sketch: Sketch = SKETCH) -> DataFrame:
    """Spans of ``own`` (row, text) that may be repeated: row, first window, windows, gram, hash of all their words."""
    held = sketch.bits(own.select("text").mapInArrow(_sketching(sketch, window, gram), SENT))
    return own.select("row", "text").mapInArrow(_keeping(sketch, held, window, gram), SPANS)


def _opening(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A hash for every window of the opened spans of a document."""
    def open_(batches):
        for b in slices(batches, "text"):
            words = Words(_documents(b))
            hashes = anchors.gram_hashes(words.symbols(), window).view(np.int64)
            out = [(s["seed"], hashes[start + k], row, k) for row, start, spans in
                   zip(b.column(b.schema.get_field_index("row")).to_pylist(), words.borders.tolist(), b.column(b.schema.get_field_index("open")).to_pylist())
                   for s in spans for k in range(s["first"], s["first"] + s["n"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                                             names=["seed", "hash", "row", "a"])

    return open_


def covered_windows(own: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, a, b): windows ``a`` to ``b`` that also start earlier. ``spans`` is read several times."""
    classes = staged(spans.groupBy("seed", "whole").agg(F.min(F.struct("row", "first", "n")).alias("earliest"), F.count("*").alias("times")))
    later = spans.join(classes.where("times > 1").select("seed", "whole", "earliest.row", "earliest.first").toDF("seed", "whole", "row0", "first0"), ["seed", "whole"])
    later = later.where("row != row0 OR first != first0").select("row", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1).alias("b"))
    shared = classes.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").select("seed")
    opened = staged(classes.join(shared, "seed").select("earliest.*", "seed").groupBy("row").agg(F.collect_list(F.struct("first", "n", "seed")).alias("open")))
    few = opened.agg(F.sum(F.size("open"))).first()[0] or 0
    single = staged(own.select("row", "text").join(F.broadcast(opened) if few <= BROADCAST_ROWS else opened, "row").mapInArrow(_opening(window), WINDOWS))
    groups = single.groupBy("seed", "hash").agg(F.min(F.struct("row", "a")).alias("earliest"), F.count("*").alias("times")).where("times > 1")
    again = single.join(groups, ["seed", "hash"]).where(F.struct("row", "a") != F.col("earliest")).select("row", "a", F.col("a").alias("b"))
    return later.unionByName(again)


def _removing(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def remove(batches):
        for b in slices(batches, "text"):
            out = []
            found = b.column(b.schema.get_field_index("found")).to_pylist()
            for doc, ranges in zip(_documents(b), found):
                words = doc.split()
                kept = words
                if ranges:
                    edge = np.zeros(len(words) + window + 1, np.int32)
                    np.add.at(edge, [r["a"] for r in ranges], 1)
                    np.add.at(edge, [r["b"] + window for r in ranges], -1)
                    gone = np.cumsum(edge)[:len(words)] > 0
                    kept = [w for w, g in zip(words, gone) if not g]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, r, sha = zip(*out)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(r, pa.int64()),
                                              pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return remove


def dedup_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, sketch: Sketch = SKETCH) -> DataFrame:
    """What is left of every document of ``docs`` (doc_id, text) without its repeated windows."""
    own = keyed(docs)
    spans = staged(candidate_spans(own, window, gram, sketch))
    found = covered_windows(own, spans, window).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    return own.join(found, "row", "left").select("doc_id", "text", "found").mapInArrow(_removing(window), RESULT)


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(table(spark, sf_dir, "documents"))
