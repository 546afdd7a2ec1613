"""Repeated byte strings by prefix doubling over anchored suffixes.

A suffix array of the corpus would rank every byte position; ranking all of them at every doubling
moves the corpus many times over. Here the ranked positions are anchors (see ``anchors``): a string
of ``LENGTH`` bytes that occurs twice has its anchor at the same offset in both places, so only
suffixes around equal anchors need ranks.

* Ranks start with the gram at the anchor (``GRAM`` bytes). Positions with a rank of their own drop out.
* A span holds the windows with one anchor. Spans with equal windows throughout are past the
  threshold: all of their windows are repeated, and one of them stays to stand for the rest.
* The others are split into blocks of windows. In each round the string that all windows of a block
  share reaches further (``LENGTH - block + 1`` bytes, the block an eighth of the last), and Spark
  groups (rank, hash of the longer string) pairs into new ranks. Blocks with a rank of their own
  drop out; blocks whose whole reach is found twice are past the threshold; the rest are split until
  a block is one window and the string is ``LENGTH`` bytes long.

The result is what a full suffix array gives: every byte covered by a ``LENGTH``-byte string that
also starts anywhere else, overlaps included. Strings are compared by two 64-bit hashes.

Null text is empty; texts shorter than ``LENGTH`` keep everything; strings never cross documents;
rows that share a ``doc_id`` (or have none) are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.llm import anchors
from meteoqc.llm.common import fresh, keyed, slices, staged, table

LENGTH, GRAM = 400, 128
BLOCKS = (64, 8, 1)
LETTERS = anchors.mixed(np.arange(1, 257, dtype=np.uint64) * anchors.MIX)
SPANS = "row long, first int, n int, off int, seed long, whole long"
SLICES = "row long, first int, n int, off int, seed long, bytes binary"
RANKED = "id long, block int, rank long, whole long, row long, a int, b int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Bytes:
    """Running sums over a buffer, from which any part of it is hashed."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        up, self.down = anchors.powers(n + 1)
        self.symbols = LETTERS[buffer]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.symbols * up[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return anchors.mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _documents(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    docs = [(x or "").encode() for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
    return docs, np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)


def _spanning(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def span(batches):
        for b in slices(batches, "text"):
            docs, borders = _documents(b)
            text = Bytes(np.frombuffer(b"".join(docs), np.uint8))
            doc, first, last, anchor, seed = anchors.spans(text.symbols, borders, length, gram)
            if len(doc):
                rows = b.column(b.schema.get_field_index("row")).to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows, pa.int64()), pa.array((first - borders[doc]).astype("<i4")), pa.array((last - first + 1).astype("<i4")),
                    pa.array((anchor - first).astype("<i4")), pa.array(seed.view(np.int64)),
                    pa.array((text.hashes(first, last + length) ^ anchors.mixed((anchor - first).astype(np.uint64))).view(np.int64))],
                    names=["row", "first", "n", "off", "seed", "whole"])

    return span


def _slicing(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches):
        for b in slices(batches, "text"):
            docs, _ = _documents(b)
            rows = b.column(b.schema.get_field_index("row")).to_pylist()
            out = [(r, s["first"], s["n"], s["off"], s["seed"], d[s["first"]:s["first"] + s["n"] - 1 + length])
                   for r, d, found in zip(rows, docs, b.column(b.schema.get_field_index("open")).to_pylist()) for s in found]
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                                             names=["row", "first", "n", "off", "seed", "bytes"])

    return cut


def _ranking(length: int, size: int, parent: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of blocks of ``size`` windows: what they share, with the anchor's gram, and their whole reach.

    A window is named by its distance ``d`` to the anchor, a block by ``d // size``.
    """
    def rank(batches):
        for b in slices(batches, "bytes"):
            col = {c: b.column(b.schema.get_field_index(c)) for c in ("id", "row", "first", "n", "off", "seed", "bytes")}
            raw = col["bytes"].to_pylist()
            base = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
            text = Bytes(np.frombuffer(b"".join(raw), np.uint8))
            first, n, off = (col[c].to_numpy().astype(np.int64) for c in ("first", "n", "off"))
            low, high = off - n + 1, off
            if parent is None:
                which = np.repeat(np.arange(len(raw)), high // size - low // size + 1)
                ends = np.cumsum(high // size - low // size + 1)
                block = np.arange(len(which)) - np.repeat(ends - (high // size - low // size + 1), high // size - low // size + 1) + (low // size)[which]
            else:
                lists = b.column(b.schema.get_field_index("blocks")).to_pylist()
                step = parent // size
                which = np.repeat(np.arange(len(raw)), [len(x) * step for x in lists])
                block = np.array([p * step + k for x in lists for p in x for k in range(step)], np.int64)
                fits = (block * size <= high[which]) & (block * size + size - 1 >= low[which])
                which, block = which[fits], block[fits]
            if not len(which):
                continue
            d0, d1 = block * size, block * size + size - 1
            at = base[which] + off[which]
            core = text.hashes(at - d0, at - d1 + length)
            c0, c1 = np.maximum(d0, low[which]), np.minimum(d1, high[which])
            whole = text.hashes(at - c1, at - c0 + length) ^ anchors.mixed((c0 * 65537 + c1).astype(np.uint64))
            seed = col["seed"].to_numpy().view(np.uint64)[which]
            key = anchors.mixed(core ^ anchors.mixed(seed + block.astype(np.uint64) * anchors.BASE))
            place = first[which] + off[which]
            yield pa.RecordBatch.from_arrays([
                pa.array(col["id"].to_numpy()[which]), pa.array(block.astype("<i4")), pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)),
                pa.array(col["row"].to_numpy()[which]), pa.array((place - c1).astype("<i4")), pa.array((place - c0).astype("<i4"))],
                names=["id", "block", "rank", "whole", "row", "a", "b"])

    return rank


def repeated_windows(own: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, a, b): windows of ``own`` (row, text) starting at bytes ``a`` to ``b`` that also start elsewhere."""
    spans = staged(own.select("row", "text").mapInArrow(_spanning(length, gram), SPANS))
    # counted and written apart, so that the joins below read nothing but their two sides and hot keys can be split
    seeds = staged(spans.groupBy("seed").agg(F.count("*").alias("n_seed"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n_seed > 1"))
    spans = staged(spans.join(seeds.select("seed"), "seed", "left_semi"))
    classes = staged(spans.groupBy("seed", "whole").agg(F.count("*").alias("times"), F.min(F.struct("row", "first", "n", "off")).alias("one")))
    again = classes.where("times > 1").select("seed", "whole")
    found = spans.join(again, ["seed", "whole"], "left_semi").select("row", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1).alias("b"))
    several = seeds.where("low != high").select("seed")
    opened = classes.join(several, "seed", "left_semi").select("one.*", "seed").groupBy("row").agg(F.collect_list(F.struct("first", "n", "off", "seed")).alias("open"))
    cut = own.select("row", "text").join(opened, "row").mapInArrow(_slicing(length), SLICES)
    parts = staged(cut.select(F.monotonically_increasing_id().alias("id"), "*"))
    source, last = parts, None
    for size in (s for s in BLOCKS if s == 1 or 4 * s <= length):
        ranked = staged(source.mapInArrow(_ranking(length, size, last), RANKED))
        groups = staged(ranked.groupBy("rank", "whole").agg(F.count("*").alias("times"), F.min(F.struct("id", "block")).alias("one")))
        found = found.unionByName(ranked.join(groups.where("times > 1").select("rank", "whole"), ["rank", "whole"], "left_semi").select("row", "a", "b"))
        if size > 1:
            split = staged(groups.groupBy("rank").agg(F.count("*").alias("k")).where("k > 1").select("rank"))
            left = groups.join(split, "rank", "left_semi").select("one.*").groupBy("id").agg(F.collect_list("block").alias("blocks"))
            source, last = parts.join(left, "id"), size
    return found


def _removing(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def remove(batches):
        for b in slices(batches, "text"):
            docs, _ = _documents(b)
            out = []
            for d, found in zip(docs, b.column(b.schema.get_field_index("found")).to_pylist()):
                kept, runs = cut_out(d, found, length)
                out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            n, r, s, sha = zip(*out)
            yield pa.RecordBatch.from_arrays([
                b.column(b.schema.get_field_index("doc_id")), *(pa.array(x, pa.int64()) for x in (n, r, s)), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove


def cut_out(text: bytes, found: list[dict] | None, length: int) -> tuple[bytes, int]:
    """What is left without the found windows, and the number of maximal removed runs."""
    if not found:
        return text, 0
    ranges = sorted((f["a"], f["b"] + length) for f in found)
    kept, at, runs = [], 0, 0
    end = -1
    for a, b in ranges:
        if a > end:
            kept.append(text[at:a])
            runs += 1
        end = at = max(end, b)
    kept.append(text[at:])
    return b"".join(kept), runs


def with_found(own: DataFrame, length: int = LENGTH, gram: int = GRAM, name: str = "found") -> DataFrame:
    """``own`` with the repeated windows of every row, null where there are none."""
    found = repeated_windows(own, length, gram).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias(name))
    return own.join(found, "row", "left")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What is left of every document of ``docs`` (doc_id, text) without its repeated strings."""
    return with_found(keyed(docs), length, gram).select("doc_id", "text", "found").mapInArrow(_removing(length), RESULT)


def _cutting(length: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches):
        for b in slices(batches, "text"):
            docs, _ = _documents(b)
            at, found = b.schema.get_field_index("text"), b.column(b.schema.get_field_index(name)).to_pylist()
            text = b.column(at).to_pylist()
            kept = [t if not f else cut_out(d, f, length)[0].decode("utf-8", "ignore") for t, d, f in zip(text, docs, found)]
            columns = {c: b.column(i) for i, c in enumerate(b.schema.names) if c != name} | {"text": pa.array(kept, b.schema.field(at).type)}
            if "n_chars" in columns:
                count = [n if not f else len(k) for n, k, f in zip(columns["n_chars"].to_pylist(), kept, found)]
                columns["n_chars"] = pa.array(count, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return cut


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with all columns; repeated strings are cut from ``text``, and ``n_chars`` follows.

    A character of which a cut leaves only some bytes goes as well.
    """
    name = fresh("found", docs.columns)
    return with_found(keyed(docs, whole=True), length, gram, name).select("doc.*", name).mapInArrow(_cutting(length, name), docs.schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
