"""Rolling statistics against Spark's own frames, and that no frame with a moving lower end is left."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meteoqc.operators import chunks as ch
from meteoqc.operators import features as ft

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def dense(spark):
    """Repeated times, missing and infinite values, a constant station and one without a name."""
    def x(i):
        return None if i % 7 == 0 else float("inf") if i == 333 else float("nan") if i == 350 else math.sin(i) * 10

    rows = [("a", START + timedelta(minutes=(i * 37 % 400) * 20), x(i)) for i in range(800)]
    rows += [("flat", START + timedelta(minutes=11 * i), 0.1) for i in range(300)] + [(None, START + timedelta(hours=i), float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "station_id string, obs_ts timestamp, t double")


def test_rolling_equals_frames(dense):
    got = ch.drop_halo(ft.add_rolling(ft.prepare(dense), ["t"], ["1h", "24h"]))
    for name, seconds in (("1h", 3600), ("24h", 86_400)):
        w = Window.partitionBy("station_id").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
        frames = dense.withColumn("us", F.unix_micros("obs_ts")).select(
            "station_id", "obs_ts", F.avg("t").over(w).alias("mean"), F.coalesce(F.stddev_samp("t").over(w), F.lit(0.0)).alias("std"),
            F.min("t").over(w).alias("min"), F.max("t").over(w).alias("max"), F.count("t").over(w).alias("count"))
        mine = got.select("station_id", "obs_ts", *[F.col(f"t_rolling_{s}_{name}").alias(s) for s in ft.STATS])
        key = lambda r: (str(r.station_id), r.obs_ts, str(r["count"]))
        a, b = sorted(mine.collect(), key=key), sorted(frames.collect(), key=key)
        assert len(a) == len(b) == dense.count()
        for r, s in zip(a, b):
            for c in r.asDict():
                if isinstance(s[c], float) and math.isfinite(s[c]):
                    assert r[c] == pytest.approx(s[c], rel=1e-9, abs=1e-9), (c, r, s)
                else:
                    assert str(r[c]) == str(s[c]), (c, r, s)


def test_no_frame_is_evaluated_anew_for_every_row(obs):
    plan = ft.time_features(obs)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan and "rangeframe, -" not in plan.lower()


def test_runs_count_own_rows_only(obs):
    whole = ft.add_persistence(ch.drop_halo(ft.mark_changes(ft.prepare(obs, rows=2))))
    marked = ch.drop_halo(ft.add_persistence(ft.mark_changes(ft.prepare(obs, rows=2)), own=ch.OWN))
    cols = ["event_id", *[c for c in whole.columns if "unchanged" in c]]
    assert whole.select(*cols).exceptAll(marked.select(*cols)).count() == 0
