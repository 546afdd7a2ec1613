"""One experiment over several seeds and feature sets: split, perturb, fit, calibrate, evaluate.

Readings are split by time. The last two parts are perturbed once per seed; the first part and an
unchanged copy of the last one stay as measured. Every such copy is a *variant*, and the station
names of a variant carry its name, so that one pass of the feature operators serves all variants and
nothing is carried from one into another: a model sees the first part only, a threshold the second
only, metrics the third only.

Detectors follow the contract of ``pyspark.ml``: ``fit`` gives a model whose ``transform`` adds
scores in [0, 1]. ``ForestGrid`` grows the isolation forests of all feature sets and seeds in one
job, one group for each (set, seed, tree).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meteoqc.functions import scores as sco
from meteoqc.functions.numeric import steady_round
from meteoqc.operators import augment as au
from meteoqc.operators import evaluate as ev
from meteoqc.operators import features as ft
from meteoqc.operators import forest as fo
from meteoqc.operators.staging import staged
from meteoqc.schema import KEY, RH, SLP, TEMP, TS

MARK = "#"
#: fixed values: seeds of the stability comparison, distance between the seeds of the two perturbed parts
SEEDS = (42, 123, 2026)
TEST_OFFSET = 100


def variants(obs: DataFrame, seeds: Sequence[int] = SEEDS, every: int = 100, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(readings, labelled events) of all variants with ``part``, ``seed`` (null where unchanged) and ``site``.

    ``counted``: events with the number of readings they affect.
    """
    split = staged(ev.chronological_split(obs))

    def part(name: str) -> DataFrame:
        return split.filter(F.col("split") == name).drop("split")

    def tagged(df: DataFrame, name: str, seed: int | None) -> DataFrame:
        mark = F.lit(f"{MARK}{name}{seed or ''}")
        return df.withColumns({"part": F.lit(name), "seed": F.lit(seed).cast("long"), "site": F.col(KEY), KEY: F.concat(KEY, mark)})

    rows = tagged(part("train"), "train", None).unionByName(tagged(part("test"), "clean", None))
    labels = None
    for seed in seeds:
        for name, own in (("validation", seed), ("test", seed + TEST_OFFSET)):
            source = part(name)
            episodes = staged(au.choose_episodes(obs.sparkSession, source, every, own))
            events = au.labelled_events(episodes)
            found = tagged(au.with_affected(events, source) if counted else events, name, seed)
            labels = found if labels is None else labels.unionByName(found)
            rows = rows.unionByName(tagged(au.apply_episodes(source, episodes), name, seed))
    return staged(ft.first_per_key(rows)), staged(labels)


class ThresholdDetector(Estimator):
    """Fixed physical limits and rates; nothing is learned, and the threshold is not calibrated."""

    name, calibrates = "fixed_threshold", False

    def _fit(self, df: DataFrame) -> fo.ColumnDetector:
        return fo.ColumnDetector(sco.threshold_score(F.col(f"{TEMP}_rate_per_5min")), 0.5)


class ZScoreDetector(Estimator):
    """Largest departure from the mean of the window ``ref``, in standard deviations."""

    name, calibrates = "rolling_zscore", True

    def __init__(self, ref: str = "24h"):
        super().__init__()
        self.ref = ref

    def _fit(self, df: DataFrame) -> fo.ColumnDetector:
        return fo.ColumnDetector(sco.zscore_score(self.ref), float(np.tanh(1.0)))


class ForestGrid(Estimator):
    """Isolation forests of every feature set and seed; ``row_id`` names columns that identify a row."""

    def __init__(self, sets: Mapping[str, Sequence[str]], seeds: Sequence[int], row_id: Sequence[str], params: fo.ForestParams = fo.ForestParams()):
        super().__init__()
        self.sets, self.seeds, self.row_id, self.forest_params = dict(sets), list(seeds), list(row_id), params

    def _fit(self, df: DataFrame) -> ForestGridModel:
        p = self.forest_params
        features = sorted({f for own in self.sets.values() for f in own})
        specs = [(name, seed) for name in self.sets for seed in self.seeds]
        used = [[features.index(f) for f in self.sets[name]] for name, _ in specs]
        depth = int(np.ceil(np.log2(max(p.sample, 2))))

        def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
            spec, tree = int(key[0]), int(key[1])
            x = np.vstack(pdf.sort_values("rank")["x"].to_numpy())[:, used[spec]]
            rows = fo.grow(x, np.random.RandomState(specs[spec][1] * 10_007 + tree), depth)
            return pd.DataFrame([(spec, tree, n, used[spec][f] if f >= 0 else -1, t, *rest) for n, f, t, *rest in rows],
                                columns=["spec", "tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

        sample = self._samples(df, features, specs)
        # at most specs * trees * (2 * sample) small rows: bounded by the parameters, not by the data
        nodes = sample.groupBy("spec", "tree").applyInPandas(one, "spec int, " + fo.NODE_SCHEMA).toPandas().sort_values(["spec", "tree", "node"])
        model = ForestGridModel(features, specs, nodes.reset_index(drop=True), p, None)
        raw = model.with_raw(df)
        span = raw.agg(*[F.struct(F.min(F.get("raw", F.lit(k))), F.max(F.get("raw", F.lit(k)))).alias(str(k)) for k in range(len(specs))]).first()
        return ForestGridModel(features, specs, model.nodes, p, [tuple(s) for s in span])

    def _samples(self, df: DataFrame, features: Sequence[str], specs: Sequence[tuple[str, int]]) -> DataFrame:
        """(spec, tree, rank, x): about ``sample`` rows per tree of each spec, chosen by hash before anything is shuffled."""
        p, n = self.forest_params, df.count()
        want = p.trees * p.sample * 1.25
        copies = max(1, int(np.ceil(want / max(n, 1))))
        cut = int(want / max(n, 1) * (1 << 30)) if copies == 1 else 1 << 30
        rows = df.select(F.struct(*self.row_id).alias("_id"), fo.feature_array(features).alias("x"))
        every = F.array(*[F.struct(F.lit(k).alias("spec"), F.lit(seed).alias("seed")) for k, (_, seed) in enumerate(specs)])
        rows = rows.select("*", F.explode(F.filter(every, lambda s: F.pmod(F.xxhash64("_id", s["seed"], s["spec"]), F.lit(1 << 30)) < cut)).alias("s"))
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(min(copies, p.trees)))))
        # consecutive trees from a hashed start: a row never enters the same tree twice
        tree = ((F.pmod(F.xxhash64("_id", F.col("s.seed") + 1, "s.spec"), F.lit(p.trees)) + F.col("copy")) % p.trees).cast("int")
        w = Window.partitionBy("spec", "tree").orderBy(F.xxhash64("_id", "seed", "tree"), "_id")
        rows = rows.select("_id", "x", "s.spec", "s.seed", tree.alias("tree")).withColumn("rank", F.row_number().over(w))
        return rows.filter(F.col("rank") <= p.sample).select("spec", "tree", "rank", "x")


class ForestGridModel(Model):
    """``transform`` adds ``scores``: an array of (set, seed, score), one entry for each forest."""

    def __init__(self, features, specs, nodes: pd.DataFrame, params: fo.ForestParams, spans):
        super().__init__()
        self.features, self.specs, self.nodes, self.forest_params, self.spans = list(features), list(specs), nodes, params, spans

    def with_raw(self, df: DataFrame, seed: Column | None = None) -> DataFrame:
        """Column ``raw``, one entry for each forest; those of other seeds are null where ``seed`` is set."""
        forests = [fo.to_arrays(self.nodes[self.nodes["spec"] == k].reset_index(drop=True)) for k in range(len(self.specs))]
        held = df.sparkSession.sparkContext.broadcast(forests)  # size set by the parameters
        norm, seeds = float(fo.average_path(self.forest_params.sample)), [s for _, s in self.specs]

        @F.pandas_udf("array<double>")
        def raw(xs: pd.Series, own: pd.Series) -> pd.Series:
            if len(xs) == 0:
                return pd.Series([], dtype=object)
            x, own = np.vstack(xs.to_numpy()), own.to_numpy(dtype=float, na_value=np.nan)
            out = np.full((len(x), len(seeds)), np.nan)
            for k, a in enumerate(held.value):
                rows = np.flatnonzero(np.isnan(own) | (own == seeds[k]))
                out[rows, k] = np.power(2.0, -fo.path_lengths(a, x[rows]) / norm)
            return pd.Series(list(out))

        return df.withColumn("raw", raw(fo.feature_array(self.features), (F.lit(None) if seed is None else seed).cast("long")))

    def _scores(self, own: Column | None = None) -> Column:
        def entry(k: int) -> Column:
            (name, seed), (low, high) = self.specs[k], self.spans[k]
            score = (F.get("raw", F.lit(k)) - low) / (high - low if high > low else 1.0)
            out = F.struct(F.lit(name).alias("set"), F.lit(seed).cast("long").alias("seed"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))
            return out if own is None else F.when(own.isNull() | (own == seed), out)

        return F.array(*[entry(k) for k in range(len(self.specs))])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.with_raw(df).withColumn("scores", self._scores()).drop("raw")

    def transform_own(self, df: DataFrame, seed: str = "seed") -> DataFrame:
        """As ``transform``, but a row with a seed is walked by the forests of that seed alone; the entries of others are null."""
        own = F.col(seed)
        return self.with_raw(df, own).withColumn("scores", self._scores(own)).drop("raw")


TAGS = ["part", "seed", "detector", KEY, TS]


def with_truth(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``TAGS``, ``score`` (rounded, so that thresholds are stable) and ``y_true``."""
    return staged(ev.with_truth_of_events(rows.withColumn("score", steady_round(F.col("score"), ev.SCORE_DIGITS)), labels).select(*TAGS, "score", "y_true"))


def column_scores(rows: DataFrame, ref: str = "24h") -> tuple[DataFrame, list[str]]:
    """Scores of the two detectors without training in long form, and those to calibrate."""
    f = staged(ft.time_features(rows, windows=(ref,), cols=[TEMP, RH, SLP], lags=(), ref=ref, persistence=False))
    out = None
    detectors = [ThresholdDetector(), ZScoreDetector(ref)]
    for d in detectors:
        model = d.fit(f.filter(F.col("part") == "train"))
        own = model.transform(f).withColumn("detector", F.lit(d.name)).select(*TAGS, "score")
        out = own if out is None else out.unionByName(own)
    return out, [d.name for d in detectors if d.calibrates]


def evaluate(scored: DataFrame, labels: DataFrame, calibrated: Sequence[str] | None, target: str = "f1") -> DataFrame:
    """Per detector and seed: threshold from the validation part, metrics of the test part alone.

    ``calibrated`` names the detectors whose threshold is chosen (None: all); others keep 0.5.
    Unchanged readings of the test part give the false alarms in normal weather.
    """
    by = ["detector", "seed"]
    cuts = ev.calibrate_by(scored.filter(F.col("part") == "validation"), by, target)
    if calibrated is not None:
        keeps = F.col("detector").isin(list(calibrated))
        cuts = cuts.withColumns({"threshold": F.when(keeps, F.col("threshold")).otherwise(0.5), "metric": F.when(keeps, F.col("metric"))})
    cuts = staged(cuts)
    hit = (F.col("score") >= F.col("threshold")).cast("int")
    test = scored.filter(F.col("part") == "test").join(F.broadcast(cuts), by).withColumn("pred", hit)  # detectors times seeds rows
    # an untrained detector scores unchanged readings once for all seeds, a trained one once for each
    clean = scored.filter(F.col("part") == "clean").withColumnRenamed("seed", "own").join(F.broadcast(cuts), "detector").filter(
        F.col("own").isNull() | (F.col("own") == F.col("seed"))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("clean_observations"), F.sum(hit).alias("clean_alarms"))
    faults = labels.filter((F.col("part") == "test") & F.col("is_fault"))
    events = faults.groupBy("seed").agg(F.count_distinct("anomaly_id").alias("events"))
    asked = faults.drop("seed").join(F.broadcast(cuts.select("detector").distinct()), F.lit(True))  # a few detectors
    hits = ev.first_hits(test.filter(F.col("pred") == 1), asked, ["detector", KEY], ["seed"]).filter(F.col("hit").isNotNull())
    found = hits.groupBy("detector", F.col("hit.seed").alias("seed")).agg(F.count_distinct("anomaly_id").alias("detected"))
    out = ev.confusion(test, by).join(cuts, by).join(clean, by).join(events, "seed", "left").join(found, by, "left").fillna(0, ["events", "detected"])
    return out.withColumn("event_recall", steady_round(F.when(F.col("events") > 0, F.col("detected") / F.col("events")).otherwise(0.0), 4))


def stability(metrics: DataFrame, cols: Sequence[str] = ("precision", "recall", "f1", "fpr", "event_recall")) -> DataFrame:
    """Mean and population spread of each metric over the seeds of each detector."""
    long = metrics.select("detector", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["detector"], list(cols), "metric", "value")
    return long.groupBy("detector", "metric").agg(F.count("value").alias("seeds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
