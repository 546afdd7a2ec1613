"""Episodes that cover readings, without their pairs: against the pairs themselves, on dense stations with repeated and missing keys."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meteoqc.operators import augment as au
from meteoqc.operators import cover as co
from meteoqc.operators import evaluate as ev
from meteoqc.operators import experiment as ex
from meteoqc.plans import evaluation_plans as plans
from meteoqc.plans import experiment_plans as trials
from meteoqc.schema import KEY, TS

START = datetime(2024, 1, 1, 20)


@pytest.fixture(scope="module")
def dense(spark):
    """Readings that share a time, come twice, or miss station or time; spans that share bounds, an id, or have none."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), START + timedelta(minutes=rnd.randrange(0, 3000)), int(rnd.random() < 0.1)) for i in range(600)]
    rows += rows[:20] + [(900, "a", None, 1), (901, None, None, 0)]
    readings = spark.createDataFrame(rows, f"event_id long, {KEY} string, {TS} timestamp, pred int").cache()
    spans = []
    for i in range(60):
        at = START + timedelta(minutes=rnd.randrange(0, 3000))
        spans.append((f"s{i % 55:02d}", rnd.choice(["a", "b", None]), at, at + timedelta(hours=rnd.choice([0, 3, 24, 30])), rnd.choice(["SPIKE", "DRIFT"]), rnd.choice([True, False]), TS))
    spans += [("none", "a", None, None, "SPIKE", True, TS), ("late", "a", START + timedelta(days=9), START + timedelta(days=9), "SPIKE", True, TS)]
    episodes = spark.createDataFrame(spans, f"anomaly_id string, {KEY} string, start_ts timestamp, end_ts timestamp, anomaly_type string, is_fault boolean, affected string").cache()
    return readings, episodes


def test_cover_equals_pairs(dense):
    readings, episodes = dense
    readings = readings.dropDuplicates(["event_id"])
    pairs = au.affected_rows(readings, episodes).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("spans"), F.max("is_fault").alias("is_fault"), F.min("anomaly_id").alias("anomaly_id"))
    got = co.with_cover(readings, episodes, order="anomaly_id", fields=["anomaly_id"], flags=["is_fault"])
    assert got.count() == readings.count()
    mine = got.filter("cover IS NOT NULL").select("event_id", "cover.spans", "cover.is_fault", "cover.anomaly_id")
    assert mine.count() > 100
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, pairs.select("event_id", "spans", "is_fault", "anomaly_id").collect()))


def test_truth_hits_and_counts_equal_pairs(spark, dense):
    readings, episodes = dense
    rows = readings.filter(F.col(TS).isNotNull()).dropDuplicates([KEY, TS])
    labels = au.affected_rows(readings, episodes).select("anomaly_id", KEY, TS, "anomaly_type", F.col("start_ts").alias("injection_start"), "is_fault")
    events = au.labelled_events(episodes)
    truth = [sorted(map(str, f.select("event_id", "y_true").collect())) for f in (ev.with_truth(rows, labels), ev.with_truth_of_events(rows, events))]
    assert truth[0] == truth[1]
    sure = ["anomaly_id", "detected", "latency_steps", "latency_minutes"]
    found = events.join(labels, "anomaly_id", "left_semi")  # here spans need not hold a reading
    want, got = ({r.anomaly_id: tuple(r) for r in f.select(sure).collect()} for f in (ev.event_hits(rows, labels), ev.hits_of_events(rows, found, readings)))
    assert want == got and any(r[1] for r in got.values()) and not all(r[1] for r in got.values())
    counts = {r.anomaly_id: r.n for r in labels.groupBy("anomaly_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = au.with_affected(events, readings).groupBy("anomaly_id").agg(F.sum("affected").alias("n")).filter("n > 0").collect()
    assert counts == {r.anomaly_id: r.n for r in per}


def no_pairs(*_, **__):
    raise AssertionError("(reading, episode) pairs grow with the square of a station's density")


def test_augmented_readings_need_no_pairs(obs, monkeypatch):
    monkeypatch.setattr(au, "affected_rows", no_pairs)
    assert plans.augmented(obs).count() > 0


def test_recall_by_type_needs_no_pairs(obs, monkeypatch):
    monkeypatch.setattr(au, "affected_rows", no_pairs)
    assert plans.by_type(obs).count() > 0


def test_experiments_need_no_pairs(obs, monkeypatch):
    monkeypatch.setattr(au, "affected_rows", no_pairs)
    rows, labels = ex.variants(obs.filter("event_id < 700"), seeds=(42,), every=60)
    scores, calibrated = ex.column_scores(rows)
    assert ex.evaluate(ex.with_truth(scores, labels), labels, calibrated).count() == 2
    assert trials.parts(obs).agg(F.sum("affected")).first()[0] > 0


def test_audit_runs_each_features_once(obs, monkeypatch):
    """Both feature tables are written and read again; without that the first one is computed three times."""
    held = []
    monkeypatch.setattr(plans, "staged", lambda df: held.append(df) or df)
    plans.causality(obs.filter("event_id < 50"))
    assert len(held) == 2
