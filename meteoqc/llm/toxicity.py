"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

* Voters are mined from labelled training documents: lexicon voters (a word, or words that begin
  alike) and pattern voters (shape of the text). A voter votes by being present.
* The label model takes votes as noisy witnesses of a hidden label. Expectation maximisation
  estimates each voter's rate under either label and the share of toxic documents; what pairs of
  voters have in common beyond the label (their conditional correlations) is estimated in every
  round and shares out the weight of voters that say the same.
* A sparse linear classifier is fitted to the posterior labels and scores every text, so documents
  without any voter are scored as well. Its log odds are calibrated on the training documents' labels.

Labels of documents with ``crc32(doc_id as text) % 5 = 0`` are held out: never read. Nothing but the
text enters a score. Fitted on at most ``LABELLED`` labelled documents (smallest hashes of
``doc_id``); at most ``VOTERS`` voters and ``FEATURES`` features.

Null text is empty and scored by the intercept. A null ``doc_id`` is not held out. A document
labelled more than once takes its highest label. Without training labels of both classes all scores
are 0. Rows with equal ``doc_id`` are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.llm.common import slices, table
from meteoqc.llm.linear import Rows, calibrated, fit, sigmoid

LABELLED, VOTERS, FEATURES, FOLDS = 12_000, 200, 8192, 5
BITS = 23
WORD = re.compile(r"\w+")
STEMS = (3, 4, 5, 6, 7)
#: a word or stem counts as a feature once it occurs, and as further ones at these numbers of times
TIMES = (2, 3, 5)
SCORES = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def word_features(word: str) -> list[int]:
    """The word itself and its beginnings."""
    return [_feature(f"word {word}")] + [_feature(f"stem {word[:n]}") for n in STEMS if len(word) > n]


def patterns(text: str) -> list[int]:
    """Features of the text's shape."""
    size = max(1, len(text))
    upper = sum(map(text.count, "EAINTROS")) / size
    out = [_feature("loud")] if upper > 0.2 else []
    bangs = text.count("!")
    out += [_feature("bangs")] if bangs * 100 > size else []
    out += [_feature("questions")] if text.count("?") * 200 > size else []
    out += [_feature("marks")] if sum(map(text.count, "#$%&*@")) * 50 > size else []
    out += [_feature(f"length {len(text).bit_length()}")]
    return out


def repeats(feature: int) -> list[int]:
    """The features that say how often another one occurs."""
    return [(feature * 31 + n * 7919) & ((1 << BITS) - 1) for n in TIMES]


def features(text: str) -> np.ndarray:
    counts: Counter[int] = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in word_features(word):
            counts[f] += n
    out = set(patterns(text)) | counts.keys()
    out |= {r for f, n in counts.items() if n > 1 for r, least in zip(repeats(f), TIMES) if n >= least}
    return np.array(sorted(out), np.int64)


@dataclass
class LabelModel:
    """Rates of each voter under label 0 and 1, its share of weight among correlated voters, and the scale of the sum."""

    rates: np.ndarray
    share: np.ndarray
    scale: tuple[float, float]

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """A voter that is absent abstains: most toxic texts hold few of the many lexicon words."""
        return votes @ (np.log(self.rates[1] / self.rates[0]) * self.share)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.odds(votes) + self.scale[1])


def fit_label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 8) -> LabelModel:
    """Expectation maximisation; the training labels start it and hold the posterior's scale in every round."""
    p = np.clip(label.astype(float), 0.02, 0.98)
    model = None
    for _ in range(rounds):
        weight = np.column_stack([1 - p, p])
        mass = weight.sum(0)
        rates = np.clip((weight.T @ votes + 0.5) / (mass[:, None] + 1.0), 1e-5, 1 - 1e-5)
        shared = np.zeros((votes.shape[1],) * 2)
        for side in (0, 1):  # what is common to voters once the label is known
            rest = (votes - rates[side]) * np.sqrt(weight[:, side])[:, None]
            cov = rest.T @ rest / max(mass[side], 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            shared += mass[side] / mass.sum() * np.abs(cov / np.outer(sd, sd))
        shared[np.abs(shared) < 0.2] = 0  # below that it is chance
        share = 1 / np.maximum(1.0, shared.sum(1))
        model = LabelModel(rates, share, (1.0, 0.0))
        model.scale = calibrated(model.odds(votes), label)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    return model


@dataclass
class Model:
    """Chosen features with their weights; the last weight is the intercept."""

    columns: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        used = np.flatnonzero(self.weights[:-1])
        self.weight_of = dict(zip(self.columns[used].tolist(), self.weights[:-1][used].tolist()))
        self.memo: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        got = tuple(f for f in word_features(word) if f in self.weight_of or any(r in self.weight_of for r in repeats(f)))
        if len(self.memo) > 400_000:
            self.memo.clear()
        self.memo[word] = got
        return got

    def score(self, text: str) -> float:
        counts: dict[int, int] = {}
        get = self.memo.get
        for word, n in Counter(WORD.findall(text.lower())).items():
            got = get(word)
            if got is None:
                got = self._word(word)
            for f in got:
                counts[f] = counts.get(f, 0) + n
        found = set(patterns(text)) | counts.keys()
        found |= {r for f, n in counts.items() if n > 1 for r, least in zip(repeats(f), TIMES) if n >= least}
        return float(sigmoid(np.float64(self.weights[-1] + sum(self.weight_of.get(f, 0.0) for f in sorted(found)))))


def _counts(sets: list[np.ndarray], weight: np.ndarray, width: int) -> np.ndarray:
    """Sum of the weights of the documents that hold each feature; no document holds one twice."""
    out = np.zeros(width)
    for s, w in zip(sets, weight):
        out[s] += w
    return out


def _best(worth: np.ndarray, occurring: np.ndarray) -> np.ndarray:
    """The ``FEATURES`` features of most worth, ascending; those of none follow by their number."""
    first = np.argsort(-worth, kind="stable")[:FEATURES]
    chosen = occurring[first[worth[first] > 0]]
    rest = np.setdiff1d(np.arange(min(2 * FEATURES, 1 << BITS)), chosen, assume_unique=True)
    return np.sort(np.concatenate([chosen, rest[: FEATURES - len(chosen)]]))


def train(sets: list[np.ndarray], label: np.ndarray) -> Model | None:
    """A model from training documents' features and labels (0 or 1)."""
    if len(set(label.tolist())) < 2:
        return None
    # the features that occur are far fewer than their numbers reach, and all arrays below are as long as they are many
    seen = np.zeros(1 << BITS, np.int32)
    for s in sets:
        seen[s] = 1
    occurring = np.flatnonzero(seen)
    seen[occurring] = np.arange(len(occurring))
    short = [seen[s] for s in sets]
    del seen
    ones, total = _counts(short, label.astype(float), len(occurring)), _counts(short, np.ones(len(sets)), len(occurring))
    base = label.mean()
    odds = np.log((ones + base) / (total - ones + 1 - base)) - np.log(base / (1 - base))
    strong = np.flatnonzero((ones >= min(5, max(2, label.sum() // 20))) & (odds > 1.5))
    strong = strong[np.argsort(-(odds[strong] * np.sqrt(ones[strong])), kind="stable")][:VOTERS * 3 // 4]
    calm = np.flatnonzero((total >= 20) & (odds < -0.7))
    calm = calm[np.argsort(odds[calm] * np.sqrt(total[calm]), kind="stable")][:VOTERS // 8]
    shape = np.unique(np.array([_feature(x) for x in ("loud", "bangs", "questions", "marks")]))
    voters = np.unique(np.concatenate([occurring[strong], occurring[calm], shape]))
    votes = np.array([np.isin(voters, s, assume_unique=True) for s in sets], float)
    soft = fit_label_model(votes, label.astype(float)).posterior(votes)
    soft = np.clip(np.where(np.isnan(soft), base, soft), 1e-6, 1 - 1e-6)  # without votes: the share of toxic documents
    toxic = _counts(short, soft, len(occurring))
    fine = total - toxic
    rate = np.log((toxic + soft.mean()) / (fine + 1 - soft.mean())) - np.log(soft.mean() / (1 - soft.mean()))
    worth = np.where(total >= 2, np.abs(rate) * np.sqrt(np.minimum(toxic, total)), 0)
    columns = _best(worth, occurring)
    place = np.full(len(occurring), -1, np.int32)
    known = np.isin(occurring, columns, assume_unique=True)
    place[known] = np.searchsorted(columns, occurring[known])
    held = [place[s] for s in short]
    held = [h[h >= 0] for h in held]
    edges = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
    rows = Rows(edges, np.concatenate(held).astype(np.int64), np.ones(edges[-1]))
    weights = fit(rows, soft, len(columns), decay=3e-4, rounds=25)
    slope, shift = calibrated(rows.times(weights) + weights[-1], label.astype(float))
    weights = weights * slope
    weights[-1] += shift
    weights[:-1][np.abs(weights[:-1]) < 1e-6] = 0
    return Model(columns, weights)


def _featuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        rows = b.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["label"] for r in rows], pa.int32()),
             pa.array([features(r["text"] or "").astype("<i4") for r in rows], pa.list_(pa.int32()))], names=["doc_id", "label", "f"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label): labelled documents that are not held out, a bounded number of them."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")


def model_for(docs: DataFrame, labels: DataFrame) -> Model | None:
    got = training_rows(docs, labels).mapInArrow(_featuring, "doc_id long, label int, f array<int>").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), range(got.num_rows)))
    if not rows:
        return None
    lists = got["f"].combine_chunks()
    flat, edge = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return train([flat[edge[i]:edge[i + 1]] for *_, i in rows], np.array([r[1] for r in rows]))


def _scoring(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches):
        model = held.value
        for b in slices(batches, "text"):
            text = b.column(b.schema.get_field_index("text")).to_pylist()
            s = np.array([model.score(t or "") for t in text]) if model else np.zeros(len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("<i4"))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return score


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every document with its score; the model is bounded by ``FEATURES``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return own.mapInArrow(_scoring(held), SCORES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, model_for(docs, table(spark, sf_dir, "labels")))
