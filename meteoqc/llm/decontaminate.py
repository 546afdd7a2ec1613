"""Benchmark passages in training text: n-gram seeds, then Smith-Waterman alignment.

1. Seeds are the word ``GRAM``-grams of the benchmark items (lower case, without marks). All of them
   start alignments, however many documents hold them: an edited passage that leaked into many
   documents may have no other grams left.
2. One pass joins the documents' n-grams to the seeds. Where enough seeds of one item fall within a
   stretch of the item's length, that stretch and its surroundings are aligned with the item, word by
   word (match 2, mismatch -1, gap -1). The score is the alignment's share of a perfect one; copies
   that are paraphrased or edited lose a part of it. At ``THRESHOLD`` a document counts as
   contaminated. Stretches that have too few words of the item to reach the threshold in any order
   (stock phrases, mostly) are not aligned, which loses nothing.

Seeds and item texts are broadcast in blocks of at most ``BLOCK_GRAMS`` n-grams; a larger benchmark
takes one pass for each block. Documents are only ever seen in their own task, so a passage that a
third of them share is no hot key.

Null or empty texts match nothing. Items of fewer than ``SHORTEST`` words are too short to be
evidence and match nothing. Repeated items are reported each, repeated documents as well.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.llm.common import slices, table

GRAM, SHORTEST, THRESHOLD = 3, 6, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_GRAMS = 1_000_000
WORD = re.compile(r"\w+")
HITS = "doc_id long, item_id long, score double, matched int, first_word int, last_word int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Block:
    """Items with their words as numbers, and the places of every seed."""

    items: list[tuple[int, np.ndarray]] = field(default_factory=list)
    number: dict[str, int] = field(default_factory=dict)
    seeds: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    def add(self, item_id: int, words: list[str]) -> None:
        numbers = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
        for at, key in enumerate(grams(numbers).tolist()):
            self.seeds[key].append((len(self.items), at))
        self.items.append((item_id, numbers))


def grams(numbers: np.ndarray) -> np.ndarray:
    """A key for every ``GRAM`` neighbouring word numbers; exact below 2^21 words, and -1 where a word is unknown (0)."""
    if len(numbers) < GRAM:
        return np.zeros(0, np.int64)
    key, known = np.zeros(len(numbers) - GRAM + 1, np.int64), np.ones(len(numbers) - GRAM + 1, bool)
    for i in range(GRAM):
        part = numbers[i:len(numbers) - GRAM + 1 + i]
        key, known = key * (1 << 21) + part, known & (part > 0)
    return np.where(known, key, -1)


def blocks_of(items: DataFrame) -> list[Block]:
    """The benchmark in blocks of bounded size, read item by item."""
    out, held = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        words = words_of(r["text"])
        if len(words) < SHORTEST:
            continue
        if not out or held + len(words) > BLOCK_GRAMS:
            out.append(Block())
            held = 0
        out[-1].add(r["item_id"], words)
        held += len(words)
    return out


def _numbers(text: str | None, number: dict[str, int]) -> np.ndarray:
    words = words_of(text)
    return np.fromiter((number.get(w, 0) for w in words), np.int64, len(words))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: (score, matched words, first and last word in ``text``)."""
    places = np.arange(len(text) + 1)
    rows = [np.zeros(len(text) + 1, np.int64)]
    for word in item:
        up = rows[-1]
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = np.maximum(0, np.maximum(up[:-1] + np.where(text == word, MATCH, MISMATCH), up[1:] + GAP))
        rows.append(np.maximum.accumulate(row - GAP * places) + GAP * places)  # gaps within the row
    grid = np.array(rows)
    i, j = np.unravel_index(grid.argmax(), grid.shape)
    best, last, matched = int(grid[i, j]), int(j) - 1, 0
    while i and j and grid[i, j]:
        same = item[i - 1] == text[j - 1]
        if grid[i, j] == grid[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif grid[i, j] == grid[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, matched, int(j), last


def most_matched(item: np.ndarray, text: np.ndarray) -> int:
    """Words that the two have in common, in any order: no alignment matches more."""
    words, times = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    return int(np.minimum(np.bincount(at[words[at] == text], minlength=len(words)), times).sum())


def stretches(found: list[tuple[int, int]], size: int, least: int) -> list[tuple[int, int]]:
    """Stretches of text, ``size`` words and some more, that hold ``least`` seeds of an item; overlapping ones joined."""
    places = sorted({p for p, _ in found})
    out: list[list[int]] = []
    for i in range(len(places) - least + 1):
        a, b = places[i], places[i + least - 1]
        if b - a <= size:
            low, high = max(0, b - size - size // 2), a + size + size // 2 + GRAM
            if out and low <= out[-1][1]:
                out[-1][1] = high
            else:
                out.append([low, high])
    return [(a, b) for a, b in out]


def hits(text: str | None, block: Block, threshold: float) -> list[tuple]:
    """(item_id, score, matched, first word, last word) of every item that the text holds."""
    numbers = _numbers(text, block.number)
    found = defaultdict(list)
    for at, key in enumerate(grams(numbers).tolist()):
        if key >= 0 and key in block.seeds:
            for item, place in block.seeds[key]:
                found[item].append((at, place))
    out = []
    for item, places in found.items():
        item_id, words = block.items[item]
        best = None
        for a, b in stretches(places, len(words), 2 if len(words) >= 2 * SHORTEST else 1):
            for low in range(a, b, 8 * len(words)):  # a long run of copies is aligned piece by piece
                part = numbers[low:min(b, low + 10 * len(words))]
                if most_matched(words, part) < threshold * len(words):
                    continue
                score, matched, first, last = align(words, part)
                if best is None or score > best[0]:
                    best = (score, matched, low + first, low + last)
        if best and best[0] >= threshold * MATCH * len(words):
            out.append((item_id, best[0] / (MATCH * len(words)), *best[1:]))
    return out


def _aligning(held, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches):
        block = held.value
        for b in slices(batches, "text"):
            rows = [(d, *h) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in hits(t, block, threshold)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in HITS.split(", ")])

    return find


def _clean(held, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches):
        block = held.value
        for b in slices(batches, "text"):
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([not hits(t, block, threshold) for t in text], pa.bool_()))

    return keep


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that it holds; other documents have none."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], HITS)
    for block in blocks_of(items):
        held = docs.sparkSession.sparkContext.broadcast(block)
        found = found.unionByName(own.mapInArrow(_aligning(held, threshold), HITS))
    return found


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    out = docs
    for block in blocks_of(items):
        held = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_clean(held, threshold), docs.schema)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
