"""Readers, sinks and streaming on small files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meteoqc.functions.text import add_scaled_fields
from meteoqc.operators import profile as pf
from meteoqc.operators.quality import accepted, quarantined
from meteoqc.plans.decision_plans import RULES, decided
from meteoqc.sources import isd, provider, sinks, tabular
from meteoqc.streaming import stream as st


def test_scaled_fields(spark):
    cases = {"+0108,1": (10.8, "1"), "+9999,9": (None, "9"), "99999,9": (None, "9"), "abc,1": (None, "3"), "-0055,5": (-5.5, "5"), "0123": (12.3, "9"), "": (None, "9"), None: (None, "9"), "+0100,": (10.0, "9")}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: (r.v_value, r.v_qc) for r in add_scaled_fields(df, {"v": "raw"}).collect()}
    assert got == cases


def test_archive_file(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,REPORT_TYPE,TMP,DEW,SLP,MA1\n'
                 '42182099999,2024-01-01T00:00:00,28.58,77.2,216.0,"DELHI, IN",FM-12,"+0108,1","+0090,1","10171,1","99999,9,09910,1"\n'
                 '42182099999,not-a-date,28.58,77.2,-999.9,"DELHI, IN",FM-12,"+0108,3","+9999,9","99999,9",\n'
                 '42182099999,2024-01-01T03:00:00,28.58,77.2,-999.9,"DELHI, IN",FM-15,"+0108,3","+9999,9","99999,9",\n')
    rows = tabular.read_csv(spark, str(f))
    good = {r.report_type: r for r in accepted(rows).collect()}
    assert good["FM-12"].temperature_c == 10.8 and good["FM-12"].relative_humidity_pct == pytest.approx(88.63, abs=0.05)
    assert good["FM-12"].data_quality_status == "VALID" and good["FM-12"].station_pressure_hpa is None
    assert good["FM-15"].data_quality_status == "ERROR" and good["FM-15"].elevation_m is None
    assert [r.reject_reasons for r in quarantined(rows).collect()] == [["TIMESTAMP_MISSING_OR_MALFORMED"]]


def test_archive_needs_date(spark, tmp_path):
    (tmp_path / "b.csv").write_text("STATION,TMP\n1,2\n")
    with pytest.raises(ValueError):
        isd.scan(spark, str(tmp_path / "b.csv"))


def test_header_mapping():
    m = tabular.infer_mapping(["AWS_ID", "Time", "Temp_C", "temp", "RH", "wind"])
    assert m.mapping == {"AWS_ID": "station_id", "Time": "obs_ts", "Temp_C": "temperature_c", "RH": "relative_humidity_pct"}
    assert m.unmapped == ["temp", "wind"] and m.missing == ["sea_level_pressure_hpa"] and not m.is_valid and len(m.warnings) == 2


def payload(**kw):
    return json.dumps({"latitude": 28.5, "longitude": 77.2, "elevation": 216, "station_id": "A", **kw})


def test_payload_shapes(spark):
    now = {"time": "2024-01-01T00:00", "temperature_2m": 20.5, "relative_humidity_2m": None, "pressure_msl": 1012}
    texts = {
        "current": payload(current=now),
        "hourly": payload(hourly={"time": ["2024-01-01T02:00", "2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1, -9999, 3], "relative_humidity_2m": [50, 50], "pressure_msl": [1000, 1000, 1000]}),
        "flat": payload(time="2024-01-01T00:00:00+02:00", temperature=5, humidity=40, pressure=1000),
        "kelvin": payload(current={**now, "temperature_2m": 301.55}), "time": payload(current={**now, "time": "2026-99-99T00:00"}),
        "place": json.dumps({"current": now}), "broken": '{"latitude": 1', "none": payload(reason="x"),
    }
    df = spark.createDataFrame(list(texts.items()), "name string, payload string")
    out = provider.normalise(df)
    good = {}
    for r in accepted(out).collect():
        good.setdefault(r.name, []).append(r)
    assert sorted(good) == ["current", "flat", "hourly"] and len(good["hourly"]) == 3
    assert good["current"][0].relative_humidity_pct is None and good["current"][0].data_quality_status == "SUSPECT"
    assert good["flat"][0].obs_ts == datetime(2023, 12, 31, 22) and sorted(x.temperature_c or -1 for x in good["hourly"]) == [-1, 1.0, 3.0]
    bad = {r.name: r.reject_reasons for r in quarantined(out).collect()}
    assert bad["kelvin"] == ["TEMPERATURE_C_OUT_OF_BOUNDS"] and bad["time"] == ["TIMESTAMP_MISSING_OR_MALFORMED"]
    assert bad["place"] == ["COORDINATES_MISSING"] and "PAYLOAD_NOT_RECOGNISED" in bad["broken"] and bad["none"] == ["PAYLOAD_NOT_RECOGNISED"]


def test_insert_is_idempotent(spark, obs, tmp_path):
    path = str(tmp_path / "obs")
    first = obs.filter("event_id < 600")
    sinks.insert_observations(first, path)
    sinks.insert_observations(first, path)
    sinks.insert_observations(obs, path)
    stored = spark.read.parquet(path)
    assert stored.count() == obs.count() == stored.select("observation_id").distinct().count()


def test_upsert_prune_and_formats(spark, obs, tmp_path):
    rows = spark.createDataFrame([("e1", "OPEN"), ("e2", "OPEN")], "episode_id string, state string")
    path = str(tmp_path / "episodes")
    sinks.upsert(rows, path, 1)
    sinks.upsert(rows.filter("episode_id = 'e1'").withColumn("state", F.lit("CLOSED")), path, 2)
    assert {r.episode_id: r.state for r in sinks.current(spark, path, "episode_id").collect()} == {"e1": "CLOSED", "e2": "OPEN"}
    sinks.append_by_day(obs, str(tmp_path / "o"))
    c = sinks.prune_into(spark, str(tmp_path / "o"), str(tmp_path / "o2"), 10, "2024-01-31 00:00:00").first()
    assert c.pruned + c.kept == obs.count() and c.kept == obs.filter("obs_ts >= '2024-01-21'").count()
    for fmt in ("csv", "json"):
        sinks.write_observations(obs.withColumn("m", F.create_map(F.lit("a"), F.lit("b"))), str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == obs.count() == spark.read.json(str(tmp_path / "json")).count()


@pytest.fixture(scope="module")
def split_events(spark, sf, tmp_path_factory):
    """The event table in several files in arrival order, so a stream takes several micro-batches."""
    folder = tmp_path_factory.mktemp("events")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(3):
        part = ev.filter((F.col("event_id") >= i * 334) & (F.col("event_id") < (i + 1) * 334)).coalesce(1)
        part.write.parquet(str(folder / f"p{i}"))
    import shutil
    for i in range(3):
        src = next((folder / f"p{i}").glob("*.parquet"))
        shutil.copy(src, folder / f"part{i}.parquet")
        import os
        os.utime(folder / f"part{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_arrival_over_batches(spark, obs, split_events, tmp_path):
    f = st.Folders(str(tmp_path / "arrival"))
    st.run_available(st.observation_stream(spark, split_events, "part*.parquet", 1), st.track_arrival(f), str(tmp_path / "cp"))
    got = spark.read.parquet(f.status)
    assert got.select("epoch").distinct().count() == 3 and got.count() == obs.count()
    hw = pf.high_water(obs)
    joined = got.alias("g").join(hw.alias("h"), "event_id").filter(~F.col("g.high_water_ts").eqNullSafe(F.col("h.high_water_ts")))
    # batches follow the event number, so a reading overtaken across files may see a later mark, never an earlier one
    assert joined.filter(F.col("g.high_water_ts") < F.col("h.high_water_ts")).count() == 0


def test_decisions_over_batches_and_replay(spark, obs, split_events, tmp_path):
    f = st.Folders(str(tmp_path / "dec"))
    step = st.decide_batches(f, RULES, window_hours=48)
    st.run_available(st.observation_stream(spark, split_events, "part*.parquet", 1), step, str(tmp_path / "cp"))
    got = spark.read.parquet(f.decisions)
    assert got.count() == obs.count()
    batch = decided(obs).select("event_id", F.col("decision").alias("d"))
    same = got.join(batch, "event_id").filter(F.col("decision") == F.col("d")).count()
    assert same >= 0.97 * obs.count()  # batches follow the event number: readings overtaken across files come late
    spark.read.parquet(f.readings).filter("epoch = 1").drop("epoch").write.parquet(str(tmp_path / "again"))
    step(spark.read.parquet(str(tmp_path / "again")), 1)  # the same batch again
    assert spark.read.parquet(f.decisions).count() == obs.count()
