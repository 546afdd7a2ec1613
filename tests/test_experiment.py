"""Splits and experiments: exact borders, nothing learned from the test part."""

import contextlib
import io
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meteoqc.operators import evaluate as ev
from meteoqc.operators import experiment as ex
from meteoqc.operators import feature_sets as fs
from meteoqc.operators import forest as fo
from meteoqc.operators import spatial as sp
from meteoqc.plans import experiment_plans as ep
from meteoqc.schema import KEY, TEMP, TS

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 500])
def test_split_is_by_position(spark, n):
    """Many readings share their time; the third by id decides."""
    rnd = random.Random(n)
    rows = [(i, T0 + timedelta(seconds=rnd.randrange(0, 40) * 1700)) for i in range(n)]
    got = {r.event_id: r.split for r in ev.chronological_split(spark.createDataFrame(rows, f"event_id long, {TS} timestamp"), seconds=3600).collect()}
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    t = max(1, int(n * 0.6 + 1e-9))
    v = min(max(t + 1, int(n * 0.8 + 1e-9)), n - 1 if n > 2 else n)
    assert got == {i: "train" if k < t else "validation" if k < v else "test" for k, i in enumerate(order)}


def test_calibration_by_group_equals_one_by_one(spark):
    rnd = random.Random(4)
    rows = [(d, s, round(rnd.random() * (0.6 + 0.4 * y), 3), y) for d in ("a", "b") for s in (1, 2) for _ in range(300) for y in [int(rnd.random() < 0.2)]]
    rows += [("one class", 1, 0.3, 0), ("one class", 1, 0.7, 0)]
    df = spark.createDataFrame(rows, "detector string, seed long, score double, y_true int").cache()
    got = {(r.detector, r.seed): (r.threshold, r.metric) for r in ev.calibrate_by(df, ["detector", "seed"]).collect()}
    for d, s in got:
        one = ev.calibrate(df.filter((F.col("detector") == d) & (F.col("seed") == s))).first()
        assert got[d, s] == (one.threshold, one.metric)
    assert got["one class", 1] == (0.5, None)


@pytest.fixture(scope="module")
def small(obs):
    return obs.filter("event_id < 700")


SETS = {"A": fs.SET_A[:3], "B": fs.SET_A[:3] + [f"{TEMP}_delta"]}
PARAMS = fo.ForestParams(trees=12, sample=64)


def fitted(obs):
    rows, labels = ex.variants(obs, seeds=(42,), every=60)
    m = ep.matrix(rows, sp.neighbour_edges(sp.stations(obs)))
    model = ex.ForestGrid(SETS, (42, 7), ["event_id"], PARAMS).fit(m.filter("part = 'train'"))
    scores, calibrated = ex.column_scores(rows)
    scored = ex.with_truth(scores, labels)
    cuts = ev.calibrate_by(scored.filter("part = 'validation'"), ["detector", "seed"]).orderBy("detector").collect()
    return model, cuts, ex.evaluate(scored, labels, calibrated).orderBy("detector").collect()


def test_test_part_changes_neither_model_nor_threshold(spark, small):
    """Readings of the test part altered beyond recognition: same trees, same scaling, same thresholds, other metrics."""
    border = ev.chronological_split(small).filter("split = 'test'").agg(F.min(F.struct(TS, "event_id")).alias("m")).first()["m"]
    later = (F.col(TS) > F.lit(border[TS])) | ((F.col(TS) == F.lit(border[TS])) & (F.col("event_id") >= border["event_id"]))
    changed = small.withColumn(TEMP, F.when(later, F.col(TEMP) * (F.col("event_id") % 7) - 30).otherwise(F.col(TEMP)))
    model, cuts, metrics = fitted(small)
    model2, cuts2, metrics2 = fitted(changed)
    assert model.nodes.equals(model2.nodes) and model.spans == model2.spans and cuts == cuts2
    assert [m.threshold for m in metrics] == [m.threshold for m in metrics2] and metrics != metrics2


def test_grid_holds_every_set_and_seed(spark, small):
    rows = small.select("event_id", KEY, TS, *SETS["A"][:3]).withColumn(f"{TEMP}_delta", F.lit(0.5))
    model = ex.ForestGrid(SETS, (42, 7), ["event_id"], PARAMS).fit(rows)
    per = model.nodes.groupby("spec")["tree"].nunique()
    assert len(per) == 4 and (per == PARAMS.trees).all()
    for k, (name, _) in enumerate(model.specs):
        used = set(model.nodes[(model.nodes.spec == k) & (model.nodes.feature >= 0)].feature)
        assert {model.features[f] for f in used} <= set(SETS[name])
    out = model.transform(rows).select(F.explode("scores").alias("s")).select("s.*").groupBy("set", "seed").agg(F.min("score").alias("a"), F.max("score").alias("b"), F.count("*").alias("n")).collect()
    assert len(out) == 4 and all((r.a, r.b, r.n) == (0.0, 1.0, rows.count()) for r in out)


def test_variants_do_not_mix(small):
    rows, labels = ex.variants(small, seeds=(42, 123), every=60)
    parts = {(r.part, r.seed) for r in rows.select("part", "seed").distinct().collect()}
    assert parts == {("train", None), ("clean", None), ("validation", 42), ("validation", 123), ("test", 42), ("test", 123)}
    assert rows.filter(F.substring_index(KEY, ex.MARK, 1) != F.col("site")).count() == 0
    assert labels.select(KEY).distinct().join(rows.filter("part IN ('train', 'clean')").select(KEY).distinct(), KEY).count() == 0


def test_rows_are_walked_by_the_forests_of_their_seed(spark, small):
    rows = small.select("event_id", KEY, TS, *SETS["A"][:3]).withColumns({f"{TEMP}_delta": F.lit(0.5), "seed": F.get(F.array(*map(F.lit, (42, 7))), (F.col("event_id") % 3).cast("int")).cast("long")})
    model = ex.ForestGrid(SETS, (42, 7), ["event_id"], PARAMS).fit(rows)
    own = F.col("seed").isNull() | (F.col("seed") == F.col("s.seed"))
    every = model.transform(rows).select("event_id", "seed", F.explode("scores").alias("s")).filter(own).collect()
    got = model.transform_own(rows).select("event_id", "seed", F.explode("scores").alias("s")).filter("s IS NOT NULL").collect()
    assert sorted(map(str, got)) == sorted(map(str, every)) and {r.seed for r in got} == {42, 7, None}
    raw = model.with_raw(rows, F.col("seed")).filter("seed = 7").select(F.explode("raw").alias("r")).agg(F.count("r").alias("walked"), F.count(F.lit(1)).alias("n")).first()
    assert raw.n == 2 * raw.walked > 0


def test_features_of_the_matrix_are_computed_once(small, monkeypatch):
    rows = small.withColumns({"part": F.lit("train"), "seed": F.lit(None).cast("long"), "site": F.col(KEY), KEY: F.concat(KEY, F.lit("#train"))})
    edges = sp.neighbour_edges(sp.stations(small))
    monkeypatch.setattr(ep, "staged", lambda df: df)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        ep.matrix(rows, edges).explain("simple")
    assert text.getvalue().count("FlatMapGroupsInArrow") == 1
