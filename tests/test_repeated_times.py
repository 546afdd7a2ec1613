"""Readings of one station at one time: no join on (station, time) multiplies them, no episode meets a whole day."""

import contextlib
import io
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meteoqc.operators import episodes as ep
from meteoqc.operators import repair as rp
from meteoqc.plans import model_plans
from meteoqc.schema import KEY, RH, SLP, TEMP, TS

START = datetime(2024, 1, 1)


def test_every_value_gets_one_correction_input(spark):
    rows = [("S01", START + timedelta(hours=i // 4), float(i), 50.0, 1010.0, 20.0, "NORMAL" if i % 2 else "UNCERTAIN") for i in range(16)]
    d = spark.createDataFrame(rows, f"{KEY} string, {TS} timestamp, {TEMP} double, {RH} double, {SLP} double, idw double, decision string")
    d = d.withColumns({"severity": F.lit("INFO"), **{f"{v}_{s}": F.col("idw") for v in rp.CANONICAL for s in ("idw", "std", "km")}, **{f"{v}_n": F.lit(3) for v in rp.CANONICAL}})
    got = rp.correction_inputs(d).collect()
    assert len(got) == 3 * len(rows)
    own = {(r.x, r.decision, r.idw, r.n) for r in got if r.variable == "temp"}
    assert own == {(r[2], r[6], 20.0, 3) for r in rows}


def test_neighbours_of_dense_stations_are_met_in_short_stretches(spark):
    n = 2000  # a reading every 40 seconds, an episode of two minutes at every 20th
    times = [START + timedelta(seconds=40 * i) for i in range(n)]
    obs = spark.createDataFrame([(s, t, float(i)) for s in ("S01", "S02") for i, t in enumerate(times)], f"{KEY} string, {TS} timestamp, {TEMP} double")
    found = spark.createDataFrame([("S01", times[i], times[i] + timedelta(minutes=2), None) for i in range(0, n - 3, 20)],
                                  f"{KEY} string, onset timestamp, last_ts timestamp, recovery timestamp")
    edges = spark.createDataFrame([("S01", "S02")], f"{KEY} string, neighbor_id string")
    out = ep.neighbours_during(found, obs, edges)
    got = {r.onset: (r.neighbor_stations, r.neighbor_mean, r.neighbor_min, r.neighbor_max) for r in out.collect()}
    assert got == {times[i]: (1, i + 1.5, float(i), i + 3.0) for i in range(0, n - 3, 20)}
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain("simple")
    assert "8.64E10" not in text.getvalue()


def test_one_record_for_every_event(obs):
    few = obs.filter("event_id < 100")
    twice = few.unionByName(few.withColumn("event_id", F.col("event_id") + 1_000_000))
    ids = [r.event_id for r in model_plans.records(twice).collect()]
    assert ids and len(ids) == len(set(ids))
