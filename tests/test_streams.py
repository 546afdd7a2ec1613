"""Keyed state, late rows and sessions over several micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meteoqc.operators import source_health as sh
from meteoqc.operators.source_health import SourceRules, source_states
from meteoqc.plans import stream_plans as sp
from meteoqc.plans.common import oracle, replaced_observations
from meteoqc.plans.decision_plans import DECIDED
from meteoqc.schema import KEY, TEMP, TS
from meteoqc.streaming import keyed, late
from meteoqc.streaming import stream as st

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("name", ["stream_window_corrections", "stream_station_memory", "stream_source_states", "stream_batch_metrics"])  # METEOQC_ALL runs the others
def test_streams_match_oracles(spark, sf, name):
    n, problems = compare(name, entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name])
    assert not problems and n


def test_six_days_of_silence(spark, sf):
    """Readings of ten to fifteen January never come; later ones are decided as if in one batch."""
    day = F.dayofmonth("ts")
    silent = replaced_observations("observations AS (SELECT * FROM raw_observations WHERE day(obs_ts) < 10 OR day(obs_ts) >= 16)")
    sql = oracle("SELECT station_id, obs_ts, CAST(CASE WHEN day(obs_ts) < 10 THEN 0 ELSE 1 END AS BIGINT) AS epoch, decision, severity, reasons FROM decided", *DECIDED, base=silent)
    _, problems = compare("silence", sp.decide_in_parts(spark, sf, (day < 10, day >= 16)), duck(sf), sql)
    assert not problems


def polls(n, seed):
    rnd = random.Random(seed)
    out = []
    for source in ("a", "b"):
        ok = True
        for k in range(n):
            ok = rnd.random() < (0.8 if ok else 0.4)
            total = rnd.choice([0, 4, 4, 4])
            failed = rnd.randint(0, total) if rnd.random() < 0.2 else 0
            stale = rnd.randint(0, total - failed) if rnd.random() < 0.2 else 0
            out.append((source, T0 + timedelta(minutes=15 * k), ok, "NONE" if ok else rnd.choice(["TIMEOUT", "HTTP_401", "HTTP_429", "CONFIG_ERROR"]), total, failed, stale))
    return out


def test_poll_states_equal_the_batch_form(spark):
    """The fold over single cycles gives what runs and windows give, cycles without stations too."""
    rows = polls(300, 1)
    df = spark.createDataFrame(rows, "source string, poll_ts timestamp, ok boolean, category string, stations_total long, stations_failed long, stations_stale long")
    want = {(r.source, r.poll_ts): r.state for r in source_states(df).collect()}
    rules = SourceRules()
    for source in ("a", "b"):
        failures = successes = 0
        state = "HEALTHY"
        for k, r in enumerate(r for r in rows if r[0] == source):
            failures, successes = (0, successes + 1) if r[2] else (failures + 1, 0)
            state = keyed.poll_state(*r[2:], failures, successes, k == 0, state, rules)
            assert state == want[source, r[1]], r


def test_late_polls_change_nothing(spark, tmp_path):
    kind = "source string, poll_ts timestamp, ok boolean, category string, stations_total long, stations_failed long, stations_stale long"
    rows = [(s, t, ok, c, 4, 0, 0) for s, t, ok, c, *_ in polls(12, 2) if s == "a"]
    f = st.Folders(str(tmp_path))
    for batch in (rows[:6], [*rows[6:], ("a", T0 + timedelta(minutes=1), False, "TIMEOUT", 4, 4, 0)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(f.feed)
        with keyed.with_state_store(spark):
            st.run_available(keyed.track_sources(spark.readStream.schema(kind).parquet(f.feed)), st.to_table(f.states), f.checkpoint)
    got = spark.read.parquet(f.states)
    want = {r.poll_ts: r.state for r in source_states(spark.createDataFrame(rows, kind)).collect()}
    assert {r.poll_ts: r.state for r in got.filter("NOT is_late").collect()} == want and got.filter("is_late").count() == 1


def test_silence_is_reported_before_it_ends(spark, tmp_path):
    """One station goes quiet; others carry the stream's time past the limit."""
    kind = f"{KEY} string, {TS} timestamp"
    f = st.Folders(str(tmp_path))
    for hours in (range(0, 5), range(5, 20), range(20, 22)):
        rows = [("loud", T0 + timedelta(hours=h)) for h in hours] + [("quiet", T0 + timedelta(hours=h)) for h in hours if h < 5 or h > 20]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f.feed)
        with keyed.with_state_store(spark):
            st.run_available(keyed.watch_silences(spark.readStream.schema(kind).parquet(f.feed)), st.to_table(f.found), f.checkpoint)
    found = sorted((r.station_id, r.kind, r.since_ts) for r in spark.read.parquet(f.found).collect())
    assert found == [("quiet", "GAP", T0 + timedelta(hours=4)), ("quiet", "SILENT", T0 + timedelta(hours=4))]


def test_repeated_epoch_does_not_count_twice(spark, tmp_path):
    """A micro-batch that runs again after a failure finds the tables as they were before it."""
    kind = f"event_id long, {KEY} string, {TS} timestamp, source string, ingestion_ts timestamp, {TEMP} double"
    rows = [(i, "s", T0 + timedelta(minutes=7 * i), "x", T0 + timedelta(minutes=7 * i), float(i)) for i in range(40)]
    f = st.Folders(str(tmp_path))
    step = late.keep_windows(f)
    first, second = spark.createDataFrame(rows[:25], kind), spark.createDataFrame(rows[20:], kind)
    for epoch, batch in ((0, first), (1, second), (1, second)):
        step(batch, epoch)
    assert late.current_windows(spark, f).agg(F.sum("readings")).first()[0] == 40
    assert spark.read.parquet(f.repeats).count() == 5 and spark.read.parquet(f.unique).count() == 40


def test_sessions_equal_runs_under_the_gap(spark):
    kind = "source string, poll_ts timestamp, state string, trigger string"
    at = [0, 60, 120, 300, 330, 600]
    rows = [("a", T0 + timedelta(minutes=m), "DEGRADED", "TIMEOUT" if m % 120 else "NONE") for m in at] + [("a", T0 + timedelta(minutes=30), "HEALTHY", "NONE")]
    got = sh.outage_sessions(spark.createDataFrame(rows, kind)).orderBy("started_at").collect()
    assert [(r.started_at, r.last_ts, r.cycles, r.categories) for r in got] == [
        (T0, T0 + timedelta(minutes=120), 3, "TIMEOUT"), (T0 + timedelta(minutes=300), T0 + timedelta(minutes=330), 2, "TIMEOUT"), (T0 + timedelta(minutes=600),) * 2 + (1, "")]
