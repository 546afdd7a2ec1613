"""Decision gates, spatial categories, source states and physics by hand-made cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meteoqc.functions import physics as ph
from meteoqc.operators import decision as dc
from meteoqc.operators import source_health as sh
from meteoqc.operators import spatial as sp
from meteoqc.schema import DECISIONS, SEVERITIES, SOURCE_STATES

BASE = dict(status="VALID", missing=[], gap=5.0, dup=False, late=False, bounds=False, score=0.1, unchanged=1, rate=False, humid=False, category="REGIONAL_PATTERN", off=0.0, z=0.0)
CASES = [
    ({}, "NORMAL", "INFO", ["NOMINAL_OBSERVATION"]),
    ({"gap": 200.0}, "PROBABLE_DATA_QUALITY_ISSUE", "CRITICAL", ["DATA_GAP"]),
    ({"missing": ["temperature_c"]}, "PROBABLE_DATA_QUALITY_ISSUE", "HIGH", ["MISSING_REQUIRED_VARIABLES"]),
    ({"dup": True, "late": True}, "PROBABLE_DATA_QUALITY_ISSUE", "LOW", ["DUPLICATE_TIMESTAMP", "OUT_OF_ORDER_TIMESTAMP"]),
    ({"status": "CORRUPTED", "bounds": True}, "PROBABLE_DATA_QUALITY_ISSUE", "MEDIUM", []),
    ({"bounds": True}, "PROBABLE_SENSOR_ANOMALY", "CRITICAL", ["OUT_OF_RANGE_PHYSICAL"]),
    ({"unchanged": 6}, "PROBABLE_SENSOR_ANOMALY", "MEDIUM", ["PERSISTENT_VALUE"]),
    ({"unchanged": 12}, "PROBABLE_SENSOR_ANOMALY", "HIGH", ["PERSISTENT_VALUE"]),
    ({"humid": True}, "PROBABLE_SENSOR_ANOMALY", "MEDIUM", ["MULTIVARIATE_DEVIATION"]),
    ({"score": 0.9}, "POSSIBLE_GENUINE_EVENT", "LOW", ["ML_HIGH_ANOMALY_SCORE", "REGIONAL_SPATIAL_AGREEMENT"]),
    ({"rate": True}, "POSSIBLE_GENUINE_EVENT", "INFO", ["REGIONAL_SPATIAL_AGREEMENT", "RAPID_RATE_OF_CHANGE"]),
    ({"score": 0.7, "off": 7.0}, "PROBABLE_SENSOR_ANOMALY", "HIGH", ["ML_MODERATE_ANOMALY_SCORE", "MIXED_REGIONAL_EVENT_WITH_LOCAL_EXCESS", "REGIONAL_SPATIAL_AGREEMENT"]),
    ({"score": 0.85, "category": "LOCAL_ONLY"}, "PROBABLE_SENSOR_ANOMALY", "HIGH", ["ML_HIGH_ANOMALY_SCORE", "LOCAL_SPATIAL_ISOLATION"]),
    ({"score": 0.5, "category": "LOCAL_ONLY"}, "PROBABLE_SENSOR_ANOMALY", "MEDIUM", ["LOCAL_SPATIAL_ISOLATION"]),
    ({"score": 0.7, "category": "LOCAL_CLUSTER"}, "POSSIBLE_GENUINE_EVENT", "LOW", ["ML_MODERATE_ANOMALY_SCORE", "LOCAL_CLUSTER_AGREEMENT"]),
    ({"score": 0.7, "category": "INSUFFICIENT_CONTEXT"}, "UNCERTAIN", "MEDIUM", ["ML_MODERATE_ANOMALY_SCORE", "INSUFFICIENT_SPATIAL_CONTEXT", "CONFLICTING_EVIDENCE"]),
]


def test_decision_gates(spark):
    rows = [(i, *({**BASE, **c}).values()) for i, (c, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, status string, missing array<string>, gap double, dup boolean, late boolean, bounds boolean, score double, unchanged long, rate boolean, humid boolean, category string, off double, z double")
    f = F.lit(False)
    ev = df.select(
        "i", F.struct(F.col("status").alias("quality_status"), F.col("missing").alias("missing_fields"), F.col("gap").alias("communication_gap_minutes"),
                      F.col("dup").alias("is_duplicate"), F.col("late").alias("is_out_of_order"), F.col("bounds").alias("is_physical_out_of_bounds")).alias("data_quality"),
        F.struct(F.col("score").alias("normalized_anomaly_score"), (F.col("score") >= 0.65).alias("ml_is_anomaly")).alias("ml_anomaly"),
        F.struct(F.col("unchanged").alias("consecutive_unchanged_count"), F.col("rate").alias("is_rate_abnormal"), f.alias("is_flatline")).alias("temporal"),
        F.struct(F.col("humid").alias("temp_rh_inconsistent"), f.alias("is_multivariate_abnormal")).alias("multivariate"),
        F.struct(F.col("category").alias("context_category"), F.col("off").alias("temp_target_minus_mean"), F.col("z").alias("temp_target_zscore")).alias("spatial"))
    got = {r.i: r for r in dc.decide(ev).collect()}
    for i, (_, decision, severity, reasons) in enumerate(CASES):
        assert (got[i].decision, got[i].severity, got[i].reason_codes) == (decision, severity, reasons), CASES[i]
        assert got[i].decision in DECISIONS and got[i].severity in SEVERITIES


def test_physics(spark):
    r = spark.range(1).select(
        ph.relative_humidity(F.lit(20.0), F.lit(20.0)).alias("full"), ph.relative_humidity(F.lit(20.0), F.lit(25.0)).alias("over"),
        ph.relative_humidity(F.lit(float("nan")), F.lit(5.0)).alias("nan"), ph.relative_humidity(F.lit(95.0), F.lit(5.0)).alias("hot"),
        ph.sea_level_pressure(ph.station_pressure(F.lit(1013.25), F.lit(216.0), F.lit(25.0)), F.lit(216.0), F.lit(25.0)).alias("back"),
        ph.station_pressure(F.lit(1013.25), F.lit(90000.0), F.lit(25.0)).alias("high")).first()
    assert r.full == 100.0 and r.over == 100.0 and r.nan is None and r.hot is None and r.high is None
    assert abs(r.back - 1013.25) < 0.02


def test_pairs_need_no_neighbouring_longitude(spark):
    """Date line and pole: near on the globe, far apart in degrees."""
    st = spark.createDataFrame([("a", 0.0, 179.9, 0.0), ("b", 0.0, -179.9, 0.0), ("c", 89.9, 10.0, 0.0), ("d", 89.9, -170.0, 0.0), ("e", 40.0, 40.0, 0.0)],
                               "station_id string, latitude double, longitude double, elevation_m double")
    got = {(r.station_id, r.neighbor_id) for r in sp.station_pairs(st, 50.0).collect()}
    assert got == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}


def test_causal_match_ignores_future_and_marks_stale(spark):
    t = datetime(2024, 1, 1, 12)
    rows = [("a", t, 20.0), ("b", t - timedelta(minutes=5), 21.0), ("b", t + timedelta(minutes=1), 99.0), ("c", t - timedelta(hours=5), 22.0)]
    obs = spark.createDataFrame([(s, x, v, 50.0, 1010.0, None, 0.0) for s, x, v in rows],
                                "station_id string, obs_ts timestamp, temperature_c double, relative_humidity_pct double, sea_level_pressure_hpa double, station_pressure_hpa double, elevation_m double")
    edges = spark.createDataFrame([("a", "b", 10.0, 1), ("a", "c", 20.0, 2)], "station_id string, neighbor_id string, distance_km double, rank int")
    got = {r.neighbor_id: r for r in sp.neighbour_matches(obs, edges).filter("station_id = 'a'").collect()}
    assert got["b"].n.temp == 21.0 and not got["b"].is_stale and got["c"].is_stale and not got["c"].is_valid
    near = {r.neighbor_id: r for r in sp.neighbour_matches(obs, edges, causal=False).filter("station_id = 'a'").collect()}
    assert near["b"].n.temp == 99.0


def fold(polls):
    """Reference fold of one source, cycle by cycle."""
    state, fails, wins, out = "HEALTHY", 0, 0, []
    for ok, category, n, failed, stale in polls:
        if not ok:
            fails, wins = fails + 1, 0
            state = sh.CATEGORY_STATE.get(category) or ("DISCONNECTED" if fails >= 3 else "DEGRADED")
        else:
            fails, wins = 0, wins + 1
            if n and failed:
                state = "DEGRADED"
            elif n and stale == n:
                state = "STALE"
            elif n and stale:
                state = "DEGRADED"
            elif n and state != "HEALTHY":
                state = "HEALTHY" if wins >= 2 else "DEGRADED"
        out.append(state)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_source_states_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    t0, rows, expected = datetime(2024, 1, 1), [], {}
    for source in ("x", "y"):
        polls = []
        for _ in range(150):
            ok = rng.random() < 0.7
            n = rng.choice([0, 3, 3, 3])
            failed = rng.choice([0, 0, 0, 1, n]) if n else 0
            polls.append((ok, "NONE" if ok else rng.choice(["HTTP_429", "HTTP_401", "TIMEOUT", "TIMEOUT", "CONFIG_ERROR"]), n, failed, rng.choice([0, 0, 0, 1, 3]) if n and not failed else 0))
        for i, (p, s) in enumerate(zip(polls, fold(polls))):
            rows.append((source, t0 + timedelta(hours=i), *p))
            expected[(source, t0 + timedelta(hours=i))] = s
    df = spark.createDataFrame(rows, "source string, poll_ts timestamp, ok boolean, category string, stations_total int, stations_failed int, stations_stale int")
    got = {(r.source, r.poll_ts): r.state for r in sh.source_states(df, seconds=86_400).collect()}
    assert got == expected and set(got.values()) <= set(SOURCE_STATES)
