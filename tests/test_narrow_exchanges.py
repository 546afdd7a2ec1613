"""What is written and exchanged on the way to corrections and streamed decisions holds what later steps read, once."""

import contextlib
import io
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meteoqc.operators import repair as rp
from meteoqc.operators import spatial as sp
from meteoqc.plans import decision_plans, model_plans, repair_plans
from meteoqc.schema import KEY, TS
from meteoqc.streaming import stream as st

START = datetime(2024, 1, 1)
WIDE = {"station_name", "latitude", "longitude", "source", "report_type", "ingestion_ts", "value"}


@pytest.fixture
def series(spark):
    """Two series over some chunks with a long silence, missing values and readings at the same time."""
    hours = [*range(0, 30), *range(90, 95), *range(600, 640)]
    rows = [(s, START + timedelta(hours=h // 2), None if (h + k) % 5 == 0 else float(h + 100 * k)) for k, s in enumerate(("a", "b")) for h in hours]
    return spark.createDataFrame(rows + rows[:6], f"series string, {TS} timestamp, x double")


def test_history_holds_the_last_values_strictly_before(series):
    rows = series.collect()
    for r in rp.with_history(series, series, 4, seconds=20 * 3600).collect():
        earlier = sorted(((o[TS], o.x) for o in rows if o.series == r.series and o.x is not None and o[TS] < r[TS]), key=lambda o: o[0])
        times = [t for t, _ in earlier][-4:]
        assert len(r.history) == len(times) and len(rows) == 156
        for t in set(times):  # of values at one time any may come first
            assert {x for x, u in zip(r.history, times) if u == t} <= {x for u, x in earlier if u == t}


def test_single_values_are_exchanged_for_histories(series):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        rp.with_history(series, series).explain("simple")
    lines = text.getvalue().splitlines()
    first = next(i for i, line in enumerate(lines) if "collect_list(x" in line)
    assert not [line for line in lines[:first] if "Exchange" in line]


def test_matches_looked_up_once_for_each_time_are_the_same(obs):
    few = obs.filter("event_id < 300").select(*decision_plans.dc.READ)
    twice = few.unionByName(few)
    edges = decision_plans.edges_of(obs)
    out = [sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in sp.spatial_context(twice, edges, timed=timed).select(
        KEY, TS, "valid_neighbors", "stale_neighbors", "context_category", "temp_n", "rh_n", "slp_n", F.coalesce("temp_idw", F.lit(-1.0)), F.coalesce("rh_km", F.lit(-1.0))).collect())
        for timed in (False, True)]
    assert out[0] == out[1] and len(out[0]) == few.count()


@pytest.mark.parametrize("plans,query", [(repair_plans, repair_plans.corrections), (model_plans, model_plans.records)])
def test_written_decisions_hold_what_is_read(obs, monkeypatch, plans, query):
    written, write = [], plans.staged
    monkeypatch.setattr(plans, "staged", lambda df: written.append(df.columns) or write(df))
    query(obs.filter("event_id < 50"))
    decided = [c for c in written if "decision" in c]
    assert len(decided) == 1 and not WIDE & set(decided[0]) and not [c for c in decided[0] if "_rolling_" in c]


def test_first_batch_is_decided_into_its_table(spark, sf, tmp_path):
    events = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").filter("event_id < 200").write.parquet(events)
    f = st.Folders(str(tmp_path / "out"))
    st.run_available(st.observation_stream(spark, events, "*.parquet"), st.decide_batches(f, decision_plans.RULES), str(tmp_path / "checkpoint"))
    done = spark.read.parquet(f.decisions)
    assert done.count() == 200 and not os.path.exists(f.decided_context)
    assert not WIDE & set(done.columns) and {"event_id", "gate", "decision", "recommended_action", "temporal", "spatial"} <= set(done.columns)
