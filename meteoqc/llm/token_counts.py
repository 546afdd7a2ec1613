"""Token counts by byte-pair merging with a heap over a linked list of symbols; no ids are formed.

Symbols start as characters. Neighbours whose joined string is in the vocabulary wait in a heap by
rank, then by place; the best pair is merged, its neighbours' new pairs are pushed, stale entries
are skipped. The count of a text is its initial symbols minus its merges; a character that the
vocabulary lacks counts as its UTF-8 bytes.

Where no vocabulary entry holds a word mark behind another character, no merge crosses the start of
a run of marks, so the count of a text is the sum over its runs. Counts of short runs are kept in a
bounded memo.

Null text counts as empty (0 tokens); repeated rows are each counted; an empty table gives none.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.llm.common import slices, table, texts

MARK = "▁"
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CROSSING = re.compile(f"[^{MARK}]{MARK}")
MEMO_RUNS, MEMO_PARTS, MEMO_CHARS = 700_000, 500_000, 48
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merges(word: str, ranks: dict[str, float]) -> int:
    """How many merges the heap makes in ``word``."""
    n = len(word)
    if n < 2:
        return 0
    end = list(range(1, n + 1))       # symbol at i covers word[i:end[i]]; 0 once it is merged away
    left = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid == n or end[mid] != stop:
            continue                  # one of the two has changed since
        end[i], end[mid] = stop, 0
        done += 1
        if stop < n:
            left[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := left[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return done


class PieceCounter:
    """Counts of whole texts under one model; runs are cut where no vocabulary entry reaches across."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.single = frozenset(p for p in pieces if len(p) == 1)
        self.ranks = {p: r for p, r in pieces.items() if len(p) > 1}
        self.joined = frozenset(p[i:i + 2] for p in self.ranks for i in range(len(p) - 1))
        self.by_word = not any(map(CROSSING.search, pieces))
        self.lines_apart = not any("\n" in p for p in pieces)
        self.memo: dict[str, int] = {}      # a word's count with a mark in front
        self.parts: dict[str, int] = {}     # counts of strings that merges cannot leave

    def _part(self, part: str) -> int:
        if (n := self.parts.get(part)) is None:
            n = sum(1 if c in self.single else len(c.encode()) for c in part) - merges(part, self.ranks)
            if len(part) <= MEMO_CHARS:
                if len(self.parts) > MEMO_PARTS:
                    self.parts.clear()
                self.parts[part] = n
        return n

    def run(self, run: str) -> int:
        """Count of any marked string, cut between neighbours that no vocabulary entry holds together."""
        total, start, joined = 0, 0, self.joined
        for i in range(1, len(run)):
            if run[i - 1:i + 1] not in joined:
                total += self._part(run[start:i])
                start = i
        return total + self._part(run[start:])

    def _word(self, word: str) -> int:
        n = self.run(word if word[:1] == "\n" else MARK + word)
        if len(word) <= MEMO_CHARS:
            if len(self.memo) > MEMO_RUNS:
                self.memo.clear()
            self.memo[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or not self.lines_apart or MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            marked = MARK + text.replace(" ", MARK)
            return sum(map(self.run, RUNS.findall(marked))) if self.by_word else self.run(marked)
        words = text.replace("\n", " \n").split(" ")  # a line end stands in front of its word
        get, lead = self.memo.get, 0
        if "\n" in text and "" in words:                # a mark of its own in front of a line end
            lead = words.count("") * self.run(MARK)
            words = [w for w in words if w]
        got = list(map(get, words))
        if None in got:
            got = [self._word(w) if n is None else n for w, n in zip(words, got)]
        return sum(got) + lead


_COUNTERS: dict[str, PieceCounter] = {}


def _counting(path: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches):
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, PieceCounter(path))
        for part in slices(batches, "text"):
            own = texts(part)
            n = np.array([counter.count(t) for t in own], "<i8")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t.encode()) for t in own], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Tokens of every text in ``docs`` (doc_id, text) under a byte-pair model; no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counting(model, limit), SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))
