"""Retention by day, versions with compaction, the payload source and the ring search."""

import os
import random
from datetime import datetime, timedelta

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meteoqc.operators import spatial as sp
from meteoqc.schema import KEY, TS
from meteoqc.sources.payload_source import PayloadFiles, PayloadStream
from meteoqc.sources.retention import Policy, prune, write_table
from meteoqc.sources.versions import VersionedTable

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("name", ["retention_by_table", "versioned_episodes", "payload_source_batch_and_stream", "variant_payload_readings", "imputed_series"])
def test_queries_match_oracles(spark, sf, name):
    n, problems = compare(name, entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name])
    assert not problems and n


def test_variant_schemas_hold_all_fields(spark, sf):
    rows = {r["shape"]: r for r in entry.queries()["variant_payload_schemas"](spark, sf).collect()}
    assert "current: OBJECT<" in rows[0].schema and "hourly: OBJECT<" in rows[1].schema and "temperature_2m" in rows[2].schema and "reason: STRING" in rows[3].schema


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_retention_leaves_other_days_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, T0 + timedelta(hours=5 * i)) for i in range(100)] + [(1000, None)]
    write_table(spark.createDataFrame(rows, f"id long, {TS} timestamp"), path, Policy(7))
    before = files(path)
    assert prune(spark, path, Policy(0), "2024-01-20 12:00:00") == 0 and files(path) == before
    gone = prune(spark, path, Policy(7), "2024-01-20 12:00:00")
    border = datetime(2024, 1, 13, 12)
    assert gone == sum(t is not None and t < border for _, t in rows)
    assert {r.id for r in spark.read.parquet(path).collect()} == {i for i, t in rows if t is None or t >= border}
    after = files(path)
    assert all(after[f] == before[f] for f in before if f in after)
    assert {f for f in before if f not in after} == {f for f in before if "day=2024-01-" in f and int(f.split("day=2024-01-")[1][:2]) <= 13}
    assert prune(spark, path, Policy(7), "2024-01-20 12:00:00") == 0


def test_versions_before_and_after_compaction(spark, tmp_path):
    table = VersionedTable(str(tmp_path), "id", 2)
    kind = "id long, v string"
    table.upsert(spark.createDataFrame([(1, "a"), (2, "a")], kind), 0)
    table.upsert(spark.createDataFrame([(2, "b"), (3, "b")], kind), 1)
    state = lambda upto=None: {r.id: r.v for r in table.state(spark, upto).collect()}
    assert state() == {1: "a", 2: "b", 3: "b"} and state(0) == {1: "a", 2: "a"}
    table.compact(spark, 1)
    table.upsert(spark.createDataFrame([(1, "c")], kind), 2)
    assert table.base(spark) == 1 and state() == {1: "c", 2: "b", 3: "b"} and state(1) == {1: "a", 2: "b", 3: "b"}
    table.compact(spark, 2)
    table.compact(spark, 2)
    assert table.base(spark) == 2 and table.base(spark, 1) == 1 and state() == {1: "c", 2: "b", 3: "b"} and state(0) == {1: "a", 2: "a"}


def test_payload_source_goes_on_behind_the_last_file(spark, tmp_path):
    spark.dataSource.register(PayloadFiles)
    (tmp_path / "a.json").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "_hidden").write_text("no")
    reader = PayloadStream(str(tmp_path))
    first = reader.latestOffset()
    (tmp_path / "b.json").write_text('{"x": "é"}\n')
    new = reader.partitions(first, reader.latestOffset())
    assert [list(reader.read(p)) for p in new] == [[(str(tmp_path / "b.json"), 0, '{"x": "é"}')]]
    got = spark.read.format("payload_files").load(str(tmp_path)).orderBy("payload_file", "line").collect()
    assert [(r.line, r.payload) for r in got] == [(0, '{"x": 1}'), (2, '{"x": 2}'), (0, '{"x": "é"}')]


def network(spark, points):
    return spark.createDataFrame([(f"P{i:05d}", "n", float(a), float(b), float(e)) for i, (a, b, e) in enumerate(points)],
                                 f"{KEY} string, station_name string, latitude double, longitude double, elevation_m double")


@pytest.mark.parametrize("net", [sp.Network(), sp.Network(max_km=40.0, k=3), sp.Network(max_elevation_diff_m=30.0)])
def test_ring_search_equals_all_pairs(spark, net):
    """Dense towns, single stations far away, one place with many stations, the date line and a pole."""
    rnd = random.Random(3)
    points = [(48 + rnd.gauss(0, 0.01), 11 + rnd.gauss(0, 0.01), rnd.uniform(0, 200)) for _ in range(150)]
    points += [(48 + rnd.uniform(-4, 4), 11 + rnd.uniform(-6, 6), rnd.uniform(0, 200)) for _ in range(80)]
    points += [(10.0, 179.99, 5.0)] * 9 + [(10.0, -179.99, 5.0)] * 3 + [(89.9, 10.0, 0.0), (89.9, 190.0 - 360, 0.0), (-60.0, 0.0, 0.0)]
    st = network(spark, points).cache()
    cols = [KEY, "neighbor_id", "rank"]
    want, got = sp.all_pairs_edges(st, net), sp.nearest_edges(st, net)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert set(got.columns) == set(want.columns)


def test_dense_networks_take_the_ring_search(spark, monkeypatch):
    rnd = random.Random(5)
    st = network(spark, [(48 + rnd.uniform(0, 1), 11 + rnd.uniform(0, 1), 0) for _ in range(700)]).cache()
    used = []
    monkeypatch.setattr(sp, "nearest_edges", lambda s, n, f=sp.nearest_edges: used.append(1) or f(s, n))
    assert sp.neighbour_edges(st).count() == 3500 and used == [1]
    assert sp.neighbour_edges(st.limit(300)).filter(F.col("rank") == 1).count() == 300 and used == [1]
