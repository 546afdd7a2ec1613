"""Imputation in series, forest properties, exact attributions, calibration, causality."""

import random
from datetime import datetime, timedelta
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meteoqc.operators import evaluate as ev
from meteoqc.operators import forest as fo
from meteoqc.operators import repair as rp
from meteoqc.schema import KEY, TEMP, TS


def estimate_one(past, idw, steps, gap, rules):
    """(estimate, method) of one missing reading from its history and neighbour estimate."""
    if gap > rules.max_gap_minutes or steps > rules.max_steps:
        return None, "NO_ESTIMATE"
    if idw is not None and len(past) >= rules.min_history:
        return 0.6 * idw + 0.4 * float(np.median(past[-rules.history:])), "COMBINED_TEMPORAL_SPATIAL"
    if idw is not None:
        return idw, "SPATIAL_IDW_CONSENSUS"
    if len(past) >= rules.min_history:
        return past[-1] + max(-1.0, min(1.0, 0.5 * (past[-1] - past[-3]) / 2.0)) * steps, "CAUSAL_TEMPORAL_INTERPOLATION"
    return (float(np.mean(past)), "ROLLING_BASELINE") if past else (None, "NO_ESTIMATE")


def sequential(values, idw, rules, cadence):
    past, steps, out = [], 0, []
    for i, v in enumerate(values):
        if v is not None:
            past, steps = past + [v], 0
            continue
        steps += 1
        e, m = estimate_one(past, idw.get(i), steps, steps * cadence, rules)
        if e is not None:
            e = max(-50.0, min(60.0, round(e + 1e-9, 3)))
            past = past + [e]
        out.append((i, steps, e, m))
    return out


@pytest.mark.parametrize("share", [0.1, 0.5])
def test_series_imputation_equals_sequential(spark, share):
    rng, rules, t0 = random.Random(5), rp.RepairRules(), datetime(2024, 1, 1)
    rows, ctx, expected = [], [], {}
    for s in ("a", "b"):
        values = [None if rng.random() < (share if i % 60 > 20 else 0.0) else round(rng.uniform(10, 30), 2) for i in range(300)]
        values[100:118] = [None] * 18  # longer than the safety limit
        idw = {i: 21.5 for i, v in enumerate(values) if v is None and rng.random() < 0.4}
        rows += [(s, t0 + timedelta(minutes=5 * i), v) for i, v in enumerate(values)]
        ctx += [(s, t0 + timedelta(minutes=5 * i), v) for i, v in idw.items()]
        expected |= {(s, t0 + timedelta(minutes=5 * i)): (k, e, m) for i, k, e, m in sequential(values, idw, rules, 5.0)}
    obs = spark.createDataFrame(rows, f"{KEY} string, {TS} timestamp, {TEMP} double")
    c = spark.createDataFrame(ctx, f"{KEY} string, {TS} timestamp, temp_idw double")
    c = c.withColumns({f"{v}_{x}": F.lit(None).cast("double") for v in ("temp", "rh", "slp") for x in ("idw", "n", "std", "km") if f"{v}_{x}" != "temp_idw"})
    got = {(r.station_id, r.obs_ts): (r.missing_steps, r.estimate, r.method) for r in rp.impute_series(obs, c, ("temp",), rules=rules, seconds=3600, segment=16).collect()}
    assert got.keys() == expected.keys()
    for k, (steps, e, m) in expected.items():
        assert got[k][0] == steps and got[k][2] == m and (got[k][1] is None) == (e is None), k
        assert e is None or abs(got[k][1] - e) < 2e-3


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.RandomState(0)
    x = np.vstack([rng.normal(0, 1, (2000, 3)), rng.normal(9, 0.3, (12, 3))])
    df = pd.DataFrame(x, columns=["a", "b", "c"])
    df["id"], df["planted"] = range(len(df)), [0] * 2000 + [1] * 12
    df["obs_ts"] = datetime(2024, 1, 1)
    return spark.createDataFrame(df).cache()


@pytest.fixture(scope="module")
def model(cloud):
    return fo.IsolationForest(["a", "b", "c"], ["id"], fo.ForestParams(trees=40)).fit(cloud)


def test_forest_separates_and_repeats(cloud, model):
    s = model.transform(cloud).groupBy("planted").agg(F.min("score").alias("lo"), F.avg("score").alias("mean"), F.max("score").alias("hi")).collect()
    by = {r.planted: r for r in s}
    assert 0.0 <= min(r.lo for r in s) and max(r.hi for r in s) <= 1.0 and by[1].mean > by[0].mean + 0.4
    again = fo.IsolationForest(["a", "b", "c"], ["id"], fo.ForestParams(trees=40)).fit(cloud.repartition(13))
    pd.testing.assert_frame_equal(again.nodes, model.nodes)
    assert model.nodes.groupby("tree").size().count() == 40 and model.nodes[model.nodes.node == 0]["size"].max() <= 256


def test_forest_null_features_count_as_zero(spark, model):
    df = spark.createDataFrame([(None, float("nan"), float("inf")), (0.0, 0.0, 0.0)], "a double, b double, c double")
    assert len({r.raw for r in model.transform(df).collect()}) == 1


def test_save_and_load(spark, cloud, model, tmp_path):
    model.with_threshold(0.6).save_to(spark, str(tmp_path), "m1", cloud)
    back = fo.ForestModel.load_from(spark, str(tmp_path), "m1")
    a, b = (m.transform(cloud.limit(50)).select("id", F.round("score", 9).alias("s")) for m in (model, back))
    assert a.exceptAll(b).count() == 0 and back.threshold == 0.6


def test_attributions_are_shapley_values(model):
    arrays = fo.to_arrays(model.nodes)
    leaves = fo.leaf_effects(fo.leaf_table(arrays), 3)
    x = np.array([[9.0, 8.5, 9.2], [0.1, -0.2, 0.3], [0.0, 9.0, 0.0]])
    phi = fo.attributions(leaves, len(arrays.roots), x, slice_rows=2)

    def expectation(row, known):  # mean path length with only the known features fixed
        def walk(n):
            f = arrays.feature[n]
            if f < 0:
                return arrays.depth[n] + float(fo.average_path(arrays.size[n]))
            left, right = arrays.left[n], arrays.right[n]
            if f in known:
                return walk(left if row[f] <= arrays.threshold[n] else right)
            return (walk(left) * arrays.size[left] + walk(right) * arrays.size[right]) / arrays.size[n]
        return np.mean([walk(r) for r in arrays.roots])

    for row, p in zip(x, phi):
        for i in range(3):
            rest = [j for j in range(3) if j != i]
            exact = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (expectation(row, {*s, i}) - expectation(row, set(s)))
                        for k in range(3) for s in combinations(rest, k))
            assert abs(exact - p[i]) < 1e-9
        assert abs(p.sum() + expectation(row, set()) - fo.path_lengths(arrays, row[None])[0]) < 1e-9


def test_contributions_are_ranked(cloud, model):
    r = model.with_contributions(cloud.filter("planted = 1").limit(1)).select(fo.ranked("contributions", 2).alias("t")).first().t
    assert [c["rank"] for c in r] == [1, 2] and abs(r[0]["contribution"]) >= abs(r[1]["contribution"])
    assert {c["direction"] for c in r} <= {"increases_anomaly", "decreases_anomaly", "neutral"}


def test_curves_and_calibration(spark):
    rng = random.Random(3)
    data = [(round(min(1.0, max(0.0, rng.gauss(0.7 if y else 0.4, 0.2))), 2), y) for y in [1] * 60 + [0] * 240]
    df = spark.createDataFrame(data, "score double, y_true int")
    s, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    pos, neg = s[y == 1], s[y == 0]
    roc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = np.sum((s >= t) & (y == 1))
        ap += (tp / 60 - last) * tp / np.sum(s >= t)
        last = tp / 60
    r = ev.curve_areas(df).first()
    assert abs(r.roc_auc - roc) < 1e-4 and abs(r.pr_auc - ap) < 1e-4
    best, choice = -1.0, None
    for t in np.unique(np.percentile(s, np.linspace(1, 99, 99))):
        tp, fp = np.sum((s >= t) & (y == 1)), np.sum((s >= t) & (y == 0))
        f1 = 2 * tp / (2 * tp + fp + 60 - tp)
        if f1 > best + 1e-12:
            best, choice = f1, t
    c = ev.calibrate(df).first()
    assert abs(c.threshold - choice) < 1e-6 and abs(c.metric - best) < 1e-6
    one = ev.calibrate(df.withColumn("y_true", F.lit(0))).first()
    assert one.threshold == 0.5


def test_walk_in_slices_equals_one_row_at_a_time():
    """Trees of uneven depth, one of a single leaf, values on the thresholds."""
    rng = np.random.RandomState(5)
    x = np.round(rng.randn(300, 4), 1)
    grown = [fo.grow(x[rng.choice(len(x), n)], rng, d) for n, d in ((64, 6), (1, 6), (2, 6), (200, 3))]
    nodes = pd.DataFrame([(t, *n) for t, own in enumerate(grown) for n in own], columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    x[0] = nodes[nodes.feature >= 0].threshold.iloc[0]

    def length(row):
        total = 0.0
        for own in grown:
            at = own[0]
            while at[1] >= 0:
                at = own[at[3] if row[at[1]] <= at[2] else at[4]]
            total += at[6] + fo.average_path(at[5])
        return total / len(grown)

    arrays = fo.to_arrays(nodes)
    assert fo.path_lengths(arrays, x, slice_rows=7).tolist() == fo.path_lengths(arrays, x).tolist() == [length(r) for r in x]
    assert len(fo.path_lengths(arrays, x[:0])) == 0


def test_patterns_come_from_one_table_row_for_each_feature():
    rng = np.random.RandomState(5)
    rows = [(t, *r) for t in range(9) for r in fo.grow(np.round(rng.randn(256, 5), 1), np.random.RandomState(t), 8)]
    arrays = fo.to_arrays(pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]))
    table = fo.leaf_table(arrays)
    feats, lows, highs = table[:3]
    leaves = fo.leaf_effects(table, 5)
    x = np.concatenate([np.round(rng.randn(70, 5), 1), np.tile(arrays.threshold[arrays.feature >= 0][:70, None], (1, 5))])
    want = np.zeros((len(x), 5))
    for i, row in enumerate(x):
        met = (row[feats] > lows) & (row[feats] <= highs) & (np.isfinite(lows) | np.isfinite(highs))
        want[i] = leaves.effects[leaves.first + (met << np.arange(feats.shape[1])).sum(1)].sum(0) / 9
    assert len(feats) > fo.LEAVES and len(leaves.groups) == -(-len(feats) // fo.LEAVES)
    assert np.allclose(fo.attributions(leaves, 9, x), want, rtol=0, atol=1e-9)
