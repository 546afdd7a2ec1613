"""Quality by co-training: a text view and a metadata view teach each other, then both are combined.

* Text view: shapes of words (letter case, digits and marks, runs shortened; a long word counts by its
  pieces of ``PIECE`` characters), shares of characters, repeated words and lines. Metadata view:
  language, source, length, and their combinations.
* Both are linear and fitted on at most ``LABELLED`` labelled documents (those with the smallest
  hashes of ``doc_id``). In every round both score all unlabelled documents; of each class the
  ``TAUGHT`` documents that a view is surest of (and at least ``SURE``) join the other view's rows.
* One labelled row in five is kept out of training; on these rows each view's log odds are
  calibrated and a last linear model weighs the two.

Every document is scored, whatever its length; it is kept if its score is 0.5 or more. The features
of all documents are written once and read by every round; only those of chosen documents come to
the driver.

Null text counts as empty; null metadata is a value of its own; a document labelled more than once
takes its highest label; labels that are null are no labels. With no labels of both classes
everything scores 1 and is kept. Rows with equal ``doc_id`` are scored each; for training one of them
stands for all. Equal odds are ranked by ``doc_id``. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.llm.common import slices, staged, table
from meteoqc.llm.linear import Rows, calibrated, fit, sigmoid

LABELLED, TAUGHT, ROUNDS, SURE = 12_000, 360, 3, 0.9
WIDTH, PIECE = 1 << 12, 64
METADATA = ("lang", "source", "n_chars")
VIEWS = "doc_id long, tc array<short>, tv array<float>, mc array<short>, mv array<float>"
SCORES = "doc_id long, text_score double, metadata_score double, score double, keep boolean"
_CLASSES = (("A", re.compile(r"[A-ZÀ-ÖØ-Þ]+")), ("a", re.compile(r"[^\W\d_A]+")), ("0", re.compile(r"\d+")))
_SHAPES: dict[str, int] = {}


def _column(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


def _shape(word: str) -> int:
    """Column of a word's shape: runs of one kind of character shortened to one letter."""
    if (got := _SHAPES.get(word)) is None:
        shape = word
        for letter, pattern in _CLASSES:
            shape = pattern.sub(letter, shape)
        shape = re.sub(r"(\W)\1+", r"\1\1", shape)
        if len(_SHAPES) > 60_000:
            _SHAPES.clear()
        got = _SHAPES[word] = _column("shape " + shape)
    return got


def pieces(words: list[str]) -> Iterator[str]:
    """Words, and those longer than ``PIECE`` characters in pieces."""
    for w in words:
        if len(w) <= PIECE:
            yield w
        else:
            yield from (w[k:k + PIECE] for k in range(0, len(w), PIECE))


def text_view(text: str) -> dict[int, float]:
    words = text.split()
    n, size = len(words), max(1, len(text))
    out = {c: min((k / n) ** 0.5, 3.0) for c, k in Counter(map(_shape, pieces(words))).items()}
    lines = text.split("\n")
    letters = sum(map(text.count, "eaintrosEAINTROS"))
    for name, value in (
        ("words", np.log1p(n) / 10), ("distinct", len(set(words)) / max(1, n)), ("lines", len(set(lines)) / len(lines)),
        ("letters", letters / size), ("blanks", n / size * 4), ("upper", sum(map(text.count, "EAINTROS")) / max(1, letters)),
        ("word length", size / max(1, n) / 20 if n else 0.0), ("empty", float(not n)),
    ):
        out[_column("stat " + name)] = min(float(value), 3.0)
    return out


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> dict[int, float]:
    size = "none" if n_chars is None else str(int(np.log2(max(1, n_chars)) * 2))
    return {_column(x): 1.0 for x in (f"lang {lang}", f"source {source}", f"size {size}", f"lang size {lang} {size}")}


@dataclass
class Model:
    """Weights and calibration of the two views and of their combination."""

    text: np.ndarray
    metadata: np.ndarray
    scales: tuple[tuple[float, float], tuple[float, float]]
    both: np.ndarray

    def scores(self, text: Rows, metadata: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = [a * (v.times(w) + w[-1]) + b for v, w, (a, b) in zip((text, metadata), (self.text, self.metadata), self.scales)]
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(odds[0] * self.both[0] + odds[1] * self.both[1] + self.both[2])


#: (weights of both views, ids each view has been taught) -> ids, both views' rows and labels of what each view is surest of
Pool = Callable[[list[np.ndarray], list[set[int]]], list[tuple[list[int], tuple[Rows, Rows], np.ndarray]]]


def co_train(views: tuple[Rows, Rows], label: np.ndarray, kept_out: np.ndarray, pool: Pool | None = None, rounds: int = ROUNDS) -> Model | None:
    """A model from labelled rows and whatever ``pool`` finds; ``kept_out`` marks rows for calibration."""
    known = np.flatnonzero(~kept_out)
    if len(set(label[known])) < 2:
        return None
    rows = [v.take(known) for v in views]
    target = [label[known].astype(float)] * 2
    weights = [fit(v, t, WIDTH) for v, t in zip(rows, target)]
    taught: list[set[int]] = [set(), set()]
    for _ in range(rounds if pool else 0):
        given = pool(weights, taught)
        for own, other in ((0, 1), (1, 0)):
            ids, found, labels = given[other]
            if ids:
                rows[own], target[own] = Rows.joined([rows[own], found[own]]), np.concatenate([target[own], labels])
                taught[own] |= set(ids)
        weights = [fit(v, t, WIDTH) for v, t in zip(rows, target)]
    check = np.flatnonzero(kept_out)
    if len(set(label[check])) < 2:
        check = known
    truth = label[check].astype(float)
    odds = [v.take(check).times(w) + w[-1] for v, w in zip(views, weights)]
    scales = tuple(calibrated(o, truth) for o in odds)
    table_ = [dict(enumerate((np.array([o * a + b for o, (a, b) in zip(pair, scales)]) / 10).tolist())) for pair in zip(*odds)]
    both = fit(Rows.of(table_), truth, 2, decay=1e-5, rounds=60)
    return Model(*weights, scales, np.array([both[0] / 10, both[1] / 10, both[2]]))


def view_rows(b: pa.RecordBatch) -> tuple[Rows, Rows]:
    """Both views of a batch of documents, in the precision they are written with."""
    cols = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", *METADATA)}
    views = Rows.of([text_view(t or "") for t in cols["text"]]), Rows.of([metadata_view(*m) for m in zip(*(cols[c] for c in METADATA))])
    return tuple(Rows(v.edges, v.columns, v.values.astype(np.float32).astype(np.float64)) for v in views)


def _viewing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        lists = [pa.ListArray.from_arrays(pa.array(v.edges, pa.int32()), x) for v in view_rows(b) for x in (pa.array(v.columns, pa.int16()), pa.array(v.values, pa.float32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "tc", "tv", "mc", "mv"])


def views_of(docs: DataFrame) -> DataFrame:
    """The features of every document, written once."""
    return staged(_own(docs).mapInArrow(_viewing, VIEWS))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def read_rows(b: pa.RecordBatch | pa.Table) -> tuple[Rows, Rows]:
    """Both views from their list columns."""
    out = []
    for c, v in (("tc", "tv"), ("mc", "mv")):
        columns, values = (b.column(b.schema.get_field_index(x)) for x in (c, v))
        if isinstance(columns, pa.ChunkedArray):
            columns, values = columns.combine_chunks(), values.combine_chunks()
        n = columns.value_lengths().to_numpy(zero_copy_only=False)
        out.append(Rows(np.concatenate([[0], np.cumsum(n)]).astype(np.int64), columns.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64)))
    return tuple(out)


def of_ids(views: DataFrame, ids: DataFrame) -> pa.Table:
    """Features of a bounded number of documents in order of their ids, one row for each id."""
    one = views.join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min(F.struct("tc", "tv", "mc", "mv")).alias("f"))
    return one.select(*ids.columns, "f.*").toArrow().sort_by("doc_id")


def whole_pool(views: DataFrame, marked: DataFrame, taught: int = TAUGHT, sure: float = SURE) -> Pool:
    """Scores all documents of ``views`` without a label in every round and finds the surest."""
    spark, least = views.sparkSession, float(np.log(sure / (1 - sure)))

    def choose(weights, had):
        held = spark.sparkContext.broadcast(weights)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                odds = [v.times(w) + w[-1] for v, w in zip(read_rows(b), held.value)]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, odds)], names=["doc_id", "odds0", "odds1"])

        odds = staged(views.mapInArrow(score, "doc_id long, odds0 double, odds1 double").where("doc_id IS NOT NULL").join(marked.select("doc_id"), "doc_id", "left_anti"))
        best = []
        for own in (0, 1):
            other = 1 - own
            free = odds.where(~F.col("doc_id").isin(list(had[other]))) if had[other] else odds
            for label, size in ((0, -F.col(f"odds{own}")), (1, F.col(f"odds{own}"))):
                best.append(free.where(size >= least).orderBy(size.desc(), "doc_id").limit(taught).select("doc_id", F.lit(own).alias("own"), F.lit(label).alias("label")))
        found = best[0].unionByName(best[1]).unionByName(best[2]).unionByName(best[3])
        # an id with rows of both classes teaches nothing
        found = found.groupBy("doc_id").agg(*[F.when(F.count_distinct(F.when(F.col("own") == k, F.col("label"))) == 1, F.max(F.when(F.col("own") == k, F.col("label")))).alias(f"label{k}") for k in (0, 1)])
        got = of_ids(views, found)
        held.unpersist()
        out = []
        for k in (0, 1):
            at = np.flatnonzero(got[f"label{k}"].is_valid().to_numpy(zero_copy_only=False))
            both = tuple(v.take(at) for v in read_rows(got))
            out.append((got["doc_id"].to_numpy()[at].tolist(), both, got[f"label{k}"].take(pa.array(at)).to_numpy().astype(float)))
        return out

    return choose


def train_on(views: DataFrame, labels: DataFrame) -> Model | None:
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    got = of_ids(views, marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))
    if not got.num_rows:
        return None
    held = np.array([zlib.crc32(b"calibrate %d" % i) % 5 == 0 for i in got["doc_id"].to_pylist()])
    return co_train(read_rows(got), got["label"].to_numpy(), held, whole_pool(views, marked))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from labelled documents and from what it is surest of among all others."""
    return train_on(views_of(docs), labels)


def _scoring(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches):
        model = held.value
        for b in batches:
            t, m, s = model.scores(*read_rows(b)) if model else (np.ones(b.num_rows),) * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t), pa.array(m), pa.array(s), pa.array(s >= 0.5)],
                                             names=["doc_id", "text_score", "metadata_score", "score", "keep"])

    return score


def _filtering(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches):
        model = held.value
        for b in slices(batches, "text"):
            yield b.filter(pa.array(model.scores(*view_rows(b))[2] >= 0.5)) if model else b

    return keep


def scores_of(views: DataFrame, model: Model | None) -> DataFrame:
    """Scores of all documents whose features are in ``views``."""
    return views.mapInArrow(_scoring(views.sparkSession.sparkContext.broadcast(model)), SCORES)


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    return scores_of(views_of(docs), model)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    return docs.mapInArrow(_filtering(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = views_of(table(spark, sf_dir, "documents"))
    return scores_of(views, train_on(views, table(spark, sf_dir, "labels")))
