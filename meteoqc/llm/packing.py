"""Mixture-controlled packing: deficit round-robin over source queues into full sequences.

Every source is a queue of its documents' tokens. Windows of a few sequences are filled one after
the other; in each, the queues are served in turn. A queue's share of a window is its target
proportion of the window; what whole tokens cannot express is its deficit, which it carries into
the next window. After ``j`` windows a queue has been served ``take * j // windows`` tokens, so the
deficit of any window follows from the window's number alone and every task can place its
documents without seeing the others: it needs the queue totals (one number for each source, broadcast)
and the tokens of its queue in earlier tasks (prefix sums over one row for each task and queue).
Every source has a queue of its own, whatever their number, and is named in the result.

Without targets the proportions are those of the corpus, so all queues run dry together. With
targets, a queue that runs dry starts a new phase in which the others share its part; queues
without a target are served last. Nothing is dropped. Sequences are cut from the windows in order,
so only the last one of all is padded.

Null text is empty and gives its end id alone; a null source is a queue of its own; repeated rows
are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meteoqc.llm.common import slices, staged, table, texts
from meteoqc.llm.pieces import encoder

SEQUENCE = 2048
WINDOW_SEQUENCES = 16
#: queue starts that a task keeps, of the windows it met last
MEMO = 1 << 22
#: rows of the prefix sums that may be broadcast (about 40 bytes each)
BROADCAST_ROWS = 1_000_000
CODED = "doc_id long, queue string, part int, before long, n long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "window long, queue string")


def _coding(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches):
        enc = encoder(tokenizer, spaced=False)
        end = np.array([end_id], enc.dtype).tobytes()
        part, served = TaskContext.get().partitionId(), {}
        for b in slices(batches, "text"):
            coded = [x + end for x in enc.encode(texts(b))]
            queues = b.column(b.schema.get_field_index("queue")).to_pylist()
            n = [len(x) // enc.dtype.itemsize for x in coded]
            before = []
            for q, k in zip(queues, n):
                before.append(served.get(q, 0))
                served[q] = before[-1] + k
            yield pa.RecordBatch.from_arrays([
                b.column(b.schema.get_field_index("doc_id")), pa.array(queues, pa.string()), pa.array([part] * len(n), pa.int32()),
                pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(coded, pa.binary())],
                names=["doc_id", "queue", "part", "before", "n", "ids"])

    return code


def with_queues(docs: DataFrame) -> DataFrame:
    """(doc_id, text, queue); every source is a queue."""
    name = F.concat(F.lit("source "), F.col("source").cast("string"))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(name, F.lit("none")).alias("queue"))


def phases(totals: dict[str, int], targets: dict[str, float] | None, window: int) -> list[dict]:
    """Spans in which the proportions stay: windows, first window, first position, queue starts and takes."""
    queues = sorted(totals)
    left, out = [totals[q] for q in queues], []
    weight = [round(1e6 * (targets or {}).get(q, 0)) for q in queues]
    aimed = [i for i, w in enumerate(weight) if w]
    first = base = 0
    while any(left):
        live = [i for i in aimed if left[i]]
        if targets is None or not live:
            take = list(left)
        else:
            dry = min(live, key=lambda i: left[i] / weight[i])
            take = [0] * len(queues)
            for i in live:
                take[i] = min(left[i], left[dry] * weight[i] // weight[dry])
        n = sum(take)
        out.append({
            "windows": max(1, n // window), "first": first, "base": base,
            "start": np.array([totals[q] - k for q, k in zip(queues, left)], "<i8"), "take": np.array(take, "<i8")})
        first, base = first + out[-1]["windows"], base + n
        left = [k - t for k, t in zip(left, take)]
    return out


def served(take: np.ndarray | int, windows: int, j: int) -> np.ndarray | int:
    """Tokens of each queue in the first ``j`` windows; quotient and rest apart, so 64 bits suffice."""
    return take // windows * j + take % windows * j // windows


class Starts:
    """First positions of the queues in a window of a phase, for the windows met last."""

    def __init__(self, plan: list[dict], queues: int):
        self.plan, self.kept, self.most = plan, OrderedDict(), max(4, MEMO // max(1, queues))

    def of(self, phase: int, j: int) -> np.ndarray:
        """``start[q]``: where token 0 of queue ``q`` would lie, if it went on without a gap."""
        if (found := self.kept.get((phase, j))) is None:
            p = self.plan[phase]
            low, high = served(p["take"], p["windows"], j), served(p["take"], p["windows"], j + 1)
            found = p["base"] + int(low.sum()) + np.cumsum(high - low) - high
            self.kept[phase, j] = found
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return found


def _placing(held, sequence: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches):
        plan, queues = held.value
        at, starts = {q: i for i, q in enumerate(queues)}, Starts(plan, len(queues))
        for b in batches:
            rows = []
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{width}").astype("<u4")
                q, a = at[r["queue"]], r["base"] + r["before"]
                for k, p in enumerate(plan):
                    start, take = int(p["start"][q]), int(p["take"][q])
                    t, stop = max(0, a - start), min(take, a + r["n"] - start)
                    while t < stop:
                        j = -(-p["windows"] * (t + 1) // take) - 1
                        end = min(stop, served(take, p["windows"], j + 1))
                        pos = int(starts.of(k, j)[q]) + t
                        first = t + start - a
                        while t < end:
                            n = min(end - t, sequence - pos % sequence)
                            rows.append((r["doc_id"], first, n, zlib.crc32(ids[first:first + n].tobytes()), r["n"], pos // sequence,
                                         pos % sequence, p["first"] + j, queues[q]))
                            t, pos, first = t + n, pos + n, first + n
            if rows:
                kinds = [pa.int64()] * 8 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return place


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES,
         targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text, source) in sequences of ``sequence`` tokens.

    ``targets``: wanted proportion of each source in every window.
    """
    coded = staged(with_queues(docs).mapInArrow(_coding(tokenizer, end_id), CODED))
    parts = staged(coded.groupBy("queue", "part").agg(F.sum("n").alias("tokens")))
    totals = {r["queue"]: r["tokens"] for r in parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    if parts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    named = {("none" if s is None else f"source {s}"): w for s, w in targets.items()} if targets else None
    plan = phases(totals, named, sequence * window_sequences)
    width = encoder(tokenizer, spaced=False).dtype.itemsize
    queues = sorted(totals)
    held = docs.sparkSession.sparkContext.broadcast((plan, queues))
    return coded.join(bases, ["queue", "part"]).mapInArrow(_placing(held, sequence, width), PIECES)


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id=1)
