"""Isolation forest: bounded hash samples per tree, vectorised scoring, exact tree attributions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meteoqc.functions.numeric import steady_round
from meteoqc.functions.physics import finite

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


@dataclass(frozen=True)
class ForestParams:
    """The usual defaults of the method."""

    trees: int = 100
    sample: int = 256
    contamination: float = 0.01
    seed: int = 42


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe))


def feature_array(features: Sequence[str]) -> Column:
    """Missing, NaN and infinite features count as 0."""
    return F.array(*[F.coalesce(finite(c), F.lit(0.0)) for c in features])


def tree_samples(df: DataFrame, features: Sequence[str], row_id: Sequence[str], p: ForestParams) -> DataFrame:
    """(tree, rank, x): about ``sample`` rows per tree, chosen by hash.

    Rows are filtered by hash before anything is shuffled, so the shuffle carries about
    ``trees * sample`` rows whatever the table size; small tables repeat rows over several trees.
    """
    n = df.count()
    want = p.trees * p.sample * 1.25
    copies = max(1, int(np.ceil(want / max(n, 1))))
    rows = df.select(F.struct(*row_id).alias("_id"), feature_array(features).alias("x"))
    if copies == 1:
        cut = int(want / n * (1 << 30))
        rows = rows.filter(F.pmod(F.xxhash64("_id", F.lit(p.seed)), F.lit(1 << 30)) < cut)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(min(copies, p.trees)))))
    # consecutive trees from a hashed start: a row never enters the same tree twice
    tree = ((F.pmod(F.xxhash64("_id", F.lit(p.seed + 1)), F.lit(p.trees)) + F.col("copy")) % p.trees).cast("int")
    w = Window.partitionBy("tree").orderBy(F.xxhash64("_id", F.lit(p.seed + 2), "tree"), "_id")
    return rows.withColumn("tree", tree).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= p.sample).select("tree", "rank", "x")


def grow(x: np.ndarray, rng: np.random.RandomState, max_depth: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, size, depth) of one tree; leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    links: dict[int, list[int]] = {}
    while todo:
        idx, depth, parent, is_right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            links[parent][int(is_right)] = me
        links[me] = [-1, -1]
        part = x[idx]
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(idx) > 1 else np.array([], dtype=int)
        if depth >= max_depth or len(spread) == 0:
            nodes.append((me, -1, 0.0, len(idx), depth))
            continue
        f = int(rng.choice(spread))
        t = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        nodes.append((me, f, t, len(idx), depth))
        below = part[:, f] <= t
        todo += [(idx[~below], depth + 1, me, True), (idx[below], depth + 1, me, False)]
    return [(n, f, t, links[n][0], links[n][1], s, d) for n, f, t, s, d in nodes]


class IsolationForest(Estimator):
    """Estimator over plain feature columns; ``row_id`` names columns that identify a row."""

    def __init__(self, features: Sequence[str], row_id: Sequence[str], params: ForestParams = ForestParams()):
        super().__init__()
        self.features, self.row_id, self.forest_params = list(features), list(row_id), params

    def _fit(self, df: DataFrame) -> ForestModel:
        p = self.forest_params
        depth = int(np.ceil(np.log2(max(p.sample, 2))))

        def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.vstack(pdf.sort_values("rank")["x"].to_numpy())
            rows = grow(x, np.random.RandomState(p.seed * 10_007 + int(key[0])), depth)
            return pd.DataFrame([(int(key[0]), *r) for r in rows], columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

        sample = tree_samples(df, self.features, self.row_id, p)
        # at most trees * (2 * sample) small rows: bounded by the parameters, not by the data
        nodes = sample.groupBy("tree").applyInPandas(one, NODE_SCHEMA).toPandas().sort_values(["tree", "node"])
        model = ForestModel(self.features, nodes.reset_index(drop=True), p)
        q = F.percentile_approx("raw", 1.0 - p.contamination, 10_000)
        span = model.with_raw(df).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), q.alias("offset")).first()
        return ForestModel(self.features, model.nodes, p, span["lo"], span["hi"], span["offset"])


@dataclass
class _Arrays:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    walk: _Walk
    leaves: tuple = field(default=())


@dataclass
class _Walk:
    """Nodes renumbered so that a right child follows its left sibling; a leaf is its own child and no value exceeds its threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    steps: np.ndarray  # per tree; its root has the tree's position as number


def _walk(feature, threshold, left, right, value, depth, roots) -> _Walk:
    inner = np.flatnonzero(feature >= 0)
    at = np.empty(len(feature), dtype=np.intp)
    at[roots] = np.arange(len(roots))
    at[left[inner]] = len(roots) + 2 * np.arange(len(inner))
    at[right[inner]] = at[left[inner]] + 1
    old = np.argsort(at)
    leaf = feature[old] < 0
    return _Walk(np.where(leaf, 0, feature[old]).astype(np.intp), np.where(leaf, np.inf, threshold[old]),
                 np.where(leaf, np.arange(len(old)), at[left[old]]), value[old], np.maximum.reduceat(depth, roots))


def to_arrays(nodes: pd.DataFrame) -> _Arrays:
    """Node table -> flat arrays with global node numbers."""
    start = nodes.reset_index().groupby("tree")["index"].min()
    base = nodes["tree"].map(start).to_numpy()
    leaf = nodes["feature"].to_numpy() < 0
    shift = lambda c: np.where(leaf, np.arange(len(nodes)), nodes[c].to_numpy() + base)
    f, t, left, right, size, depth = nodes["feature"].to_numpy(), nodes["threshold"].to_numpy(), shift("left"), shift("right"), nodes["size"].to_numpy(), nodes["depth"].to_numpy()
    roots = start.to_numpy()
    return _Arrays(f, t, left, right, size, depth, roots, _walk(f, t, left, right, depth + average_path(size), depth, roots))


def path_lengths(a: _Arrays, x: np.ndarray, slice_rows: int = 4096) -> np.ndarray:
    """Mean path length over the trees for each row of ``x`` (finite values, see ``feature_array``).

    Slices keep the rows at hand in the processor's cache while all trees are walked.
    """
    w, total = a.walk, np.zeros(len(x))
    for start in range(0, len(x), slice_rows):
        part = np.ascontiguousarray(x[start:start + slice_rows].T)
        n, values = part.shape[1], part.ravel()
        rows, column = np.arange(n), w.feature * n
        for tree, steps in enumerate(w.steps):
            at = np.full(n, tree, dtype=np.intp)
            for _ in range(steps):
                place = column.take(at)
                place += rows
                above = values.take(place) > w.threshold.take(at)
                at = w.child.take(at)
                at += above
            total[start:start + n] += w.value.take(at)
    return total / len(a.roots)


def leaf_table(a: _Arrays) -> tuple[np.ndarray, ...]:
    """Per leaf, padded to the same width: feature, lower and upper limit, share of rows, path length."""
    width = int(a.depth.max())
    feats, lows, highs, shares, values = [], [], [], [], []
    stack = [(int(r), {}) for r in a.roots]
    while stack:
        n, path = stack.pop()
        if a.feature[n] < 0:
            items = list(path.items()) + [(0, (-np.inf, np.inf, 1.0))] * (width - len(path))
            feats.append([k for k, _ in items])
            lows.append([v[0] for _, v in items])
            highs.append([v[1] for _, v in items])
            shares.append([v[2] for _, v in items])
            values.append(a.depth[n] + float(average_path(a.size[n])))
            continue
        f, t = int(a.feature[n]), float(a.threshold[n])
        lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
        for child, low, high in ((int(a.left[n]), lo, min(hi, t)), (int(a.right[n]), max(lo, t), hi)):
            stack.append((child, {**path, f: (low, high, z * a.size[child] / a.size[n])}))
    return tuple(np.array(v) for v in (feats, lows, highs, shares, values))


@dataclass
class LeafEffects:
    """What every leaf adds to each feature's attribution, for each pattern of the leaf's conditions.

    A leaf has at most one interval per feature, so a row meets one of ``2^k`` patterns of its ``k``
    conditions. ``effects`` holds a row of features for each of them, leaf after leaf from ``first``.
    ``groups`` are runs of leaves; for each feature a group has the limits of its leaves in order and
    a table of (stretch between limits, leaf) with the bits of the conditions that hold there.
    """

    groups: list[tuple[slice, list[tuple[int, np.ndarray, np.ndarray]]]]
    first: np.ndarray
    effects: np.ndarray


LEAVES = 256


def _condition_groups(feats: np.ndarray, lows: np.ndarray, highs: np.ndarray, bits: np.ndarray) -> list:
    kind = np.min_scalar_type((1 << feats.shape[1]) - 1)  # all bits of a pattern
    groups = []
    for start in range(0, len(feats), LEAVES):
        run, tables = slice(start, min(start + LEAVES, len(feats))), []
        for f in np.unique(feats[run][bits[run] > 0]):
            leaf, at = np.nonzero((feats[run] == f) & (bits[run] > 0))
            low, high, bit = (a[run][leaf, at] for a in (lows, highs, bits))
            limits = np.unique(np.concatenate([low[np.isfinite(low)], high[np.isfinite(high)]]))
            stretch = np.arange(len(limits) + 1)[:, None]  # as many limits lie below a value in it
            above = stretch > np.where(np.isfinite(low), np.searchsorted(limits, low), -1)
            below = stretch <= np.where(np.isfinite(high), np.searchsorted(limits, high), len(limits))
            table = np.zeros((len(limits) + 1, run.stop - run.start), kind)
            table[:, leaf] = (above & below) * bit
            tables.append((int(f), limits, table))
        groups.append((run, tables))
    return groups


def leaf_effects(leaves: tuple[np.ndarray, ...], width: int) -> LeafEffects:
    """Shapley values of the path length at each leaf, with branch shares as background.

    The sum over feature subsets is the integral over t of the product of (o*t + z*(1-t)); its degree
    is below the number of conditions, so a short Gauss-Legendre rule is exact.
    """
    feats, lows, highs, shares, values = leaves
    real = np.isfinite(lows) | np.isfinite(highs)  # conditions come first, padding has none
    k = real.sum(1)
    first = np.concatenate([[0], np.cumsum(1 << k)])
    effects = np.zeros((first[-1], width))
    for n in np.unique(k[k > 0]):
        at = np.flatnonzero(k == n)
        o = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(float)[None]
        z = shares[at, None, :n]
        nodes, weights = np.polynomial.legendre.leggauss(int(n) // 2 + 1)
        acc = np.zeros((len(at), 1 << n, n))
        for t, w in zip((nodes + 1) / 2, weights / 2):
            g = o * t + z * (1 - t)
            acc += w * g.prod(2, keepdims=True) / g
        phi = values[at, None, None] * (o - z) * acc
        rows = first[at][:, None, None] + np.arange(1 << n)[None, :, None]
        effects[rows, feats[at, None, :n]] = phi
    return LeafEffects(_condition_groups(feats, lows, highs, np.where(real, 1 << np.arange(feats.shape[1]), 0)), first[:-1], effects)


def attributions(leaves: LeafEffects, trees: int, x: np.ndarray, slice_rows: int = 64) -> np.ndarray:
    """Shapley values of the mean path length: each row's pattern at every leaf looks up that leaf's effects.

    The patterns of a group of leaves are sums of one table row for each feature. Slices of rows and
    groups of leaves are small enough for the effects at hand to stay in the processor's cache.
    """
    out = np.zeros((len(x), leaves.effects.shape[1]))
    for start in range(0, len(x), slice_rows):
        part = np.ascontiguousarray(x[start:start + slice_rows].T)
        for run, tables in leaves.groups:
            if not tables:  # no condition, no effect
                continue
            pattern = sum(table.take(np.searchsorted(limits, part[f]), axis=0) for f, limits, table in tables)
            place = np.ascontiguousarray(pattern.T) + leaves.first[run][:, None]
            out[start:start + slice_rows] += leaves.effects.take(place, axis=0).sum(0)
    return out / trees


class ForestModel(Model):
    def __init__(self, features, nodes: pd.DataFrame, params: ForestParams, low: float = 0.0, high: float = 1.0,
                 offset: float = 0.5, threshold: float = 0.5):
        super().__init__()
        self.features, self.nodes, self.forest_params = list(features), nodes, params
        self.low, self.high, self.offset, self.threshold = low, high, offset, threshold

    def with_raw(self, df: DataFrame) -> DataFrame:
        """Column ``raw``: 2^(-mean path / expected path), higher = easier to isolate."""
        arrays = df.sparkSession.sparkContext.broadcast(to_arrays(self.nodes))  # size set by the parameters
        norm = float(average_path(self.forest_params.sample))

        @F.pandas_udf("double")
        def raw(xs: pd.Series) -> pd.Series:
            if len(xs) == 0:
                return pd.Series([], dtype=float)
            return pd.Series(np.power(2.0, -path_lengths(arrays.value, np.vstack(xs.to_numpy())) / norm))

        return df.withColumn("raw", raw(feature_array(self.features)))

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds ``raw``, ``score`` in [0, 1] and ``pred``."""
        span = self.high - self.low if self.high > self.low else 1.0
        s = (F.col("raw") - self.low) / span
        out = self.with_raw(df).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
        return out.withColumn("pred", (F.col("score") >= self.threshold).cast("int"))

    def with_threshold(self, threshold: float) -> ForestModel:
        return ForestModel(self.features, self.nodes, self.forest_params, self.low, self.high, self.offset, threshold)

    def with_contributions(self, df: DataFrame, name: str = "contributions") -> DataFrame:
        """Array of (feature, value, contribution); positive = pushes towards anomaly."""
        arrays = to_arrays(self.nodes)
        leaves = df.sparkSession.sparkContext.broadcast(leaf_effects(leaf_table(arrays), len(self.features)))  # size set by the parameters
        trees, width = len(arrays.roots), len(self.features)

        @F.pandas_udf("array<double>")
        def phi(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in batches:
                x = np.vstack(xs.to_numpy()) if len(xs) else np.zeros((0, width))
                yield pd.Series(list(-attributions(leaves.value, trees, x)))

        x = feature_array(self.features)
        out = df.withColumns({"_x": x, "_phi": phi(x)})
        names = F.array(*[F.lit(f) for f in self.features])
        return out.withColumn(name, F.arrays_zip(names.alias("feature"), F.col("_x").alias("value"), F.col("_phi").alias("contribution"))).drop("_x", "_phi")

    def registry_row(self, spark: SparkSession, model_id: str, data: DataFrame, ts: str = "obs_ts") -> DataFrame:
        p = self.forest_params
        return data.agg(F.min(ts).alias("training_start"), F.max(ts).alias("training_end"), F.count(F.lit(1)).alias("training_rows")).select(
            F.lit(model_id).alias("model_id"), F.lit("IsolationForest").alias("algorithm"), "training_start", "training_end", "training_rows",
            F.lit(",".join(self.features)).alias("feature_list"), F.lit(p.trees).alias("trees"), F.lit(p.sample).alias("sample"),
            F.lit(p.contamination).alias("contamination"), F.lit(p.seed).alias("seed"), F.lit(float(self.low)).alias("score_low"),
            F.lit(float(self.high)).alias("score_high"), F.lit(float(self.offset)).alias("score_offset"), F.lit(float(self.threshold)).alias("threshold"))

    def save_to(self, spark: SparkSession, folder: str, model_id: str, data: DataFrame) -> None:
        """Node table and one registry row per model id."""
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{folder}/{model_id}/nodes")
        self.registry_row(spark, model_id, data).write.mode("overwrite").parquet(f"{folder}/{model_id}/registry")

    @staticmethod
    def load_from(spark: SparkSession, folder: str, model_id: str) -> ForestModel:
        r = spark.read.parquet(f"{folder}/{model_id}/registry").first()
        nodes = spark.read.parquet(f"{folder}/{model_id}/nodes").toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        p = ForestParams(r["trees"], r["sample"], r["contamination"], r["seed"])
        return ForestModel(r["feature_list"].split(","), nodes, p, r["score_low"], r["score_high"], r["score_offset"], r["threshold"])


class ColumnDetector(Model):
    """Detector whose score is a column expression; same contract as the forest model."""

    def __init__(self, score: Column, threshold: float = 0.5):
        super().__init__()
        self.score_column, self.threshold = score, threshold

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", self.score_column).withColumn("pred", (F.col("score") >= self.threshold).cast("int"))


def ranked(contributions: str = "contributions", k: int = 5) -> Column:
    """The ``k`` contributions largest in magnitude, with direction and rank."""
    rounded = F.transform(contributions, lambda c: F.struct(
        F.abs(c["contribution"]).alias("size"), c["feature"].alias("feature"), c["value"].alias("value"), steady_round(c["contribution"], 4).alias("contribution")))
    top = F.slice(F.reverse(F.array_sort(rounded)), 1, k)
    return F.transform(top, lambda c, i: F.struct(
        (i + 1).alias("rank"), c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("contribution"),
        F.when(c["size"] < 1e-4, "neutral").when(c["contribution"] > 0, "increases_anomaly").otherwise("decreases_anomaly").alias("direction")))


def value_contributions(features: Sequence[str]) -> Column:
    """Fallback without a tree model: the feature value itself."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(finite(f), F.lit(0.0)).alias("value"), F.coalesce(finite(f), F.lit(0.0)).alias("contribution")) for f in features])
