"""Agreement with neighbours: matches are exchanged, not wide partial aggregates, and repeated or missing keys keep their weight."""

import contextlib
import io
from datetime import datetime

import pytest

from meteoqc.operators import spatial as sp
from meteoqc.schema import KEY, TS

T0 = datetime(2024, 1, 1)
MATCH = f"{KEY} string, {TS} timestamp, temp double, rh double, slp double, d_temp double, d_rh double, d_slp double, distance_km double, rank int, " \
    "n struct<temp:double,rh:double,slp:double,d_temp:double,d_rh:double,d_slp:double>, is_valid boolean, is_stale boolean"


def match(key, temp, rank, km, neighbour, valid=True):
    return (key, T0, temp, 50.0, None, 1.0, None, None, km, rank, neighbour and (neighbour, 50.0, None, 0.5, None, None), valid, False)


@pytest.fixture
def matches(spark):
    rows = [match("a", 10.0, 1, 5.0, 12.0), match("a", 10.0, 2, 20.0, 10.5), match("a", 10.0, 3, 30.0, None, False),
            match("b", 10.0, 1, 5.0, 12.0), match("b", 10.0, 1, 5.0, 12.0), match("b", 10.0, 2, 20.0, 9.0), match(None, None, 1, 5.0, 3.0), match("c", 1.0, 1, 5.0, None, False)]
    return spark.createDataFrame(rows, MATCH)


def test_shares_and_means(matches):
    got = {r[KEY]: r for r in sp.consensus(matches).collect()}
    a, b, none, c = got["a"], got["b"], got[None], got["c"]
    assert (a.matched_neighbors, a.valid_neighbors, a.temp_n, a.temp_mean, a.temp_median, a.temp_higher, a.temp_similar, a.temp_lower) == (2, 2, 2, 11.25, 11.25, 0.5, 0.5, 0.0)
    assert (a.temp_km, a.valid_mean_km, a.temp_rising, a.temp_agreement, a.slp_n, a.slp_mean, a.slp_higher, a.slp_km) == (12.5, 12.5, 1.0, 1.0, 0, None, 0.0, None)
    assert a.temp_idw == pytest.approx((12.0 / 5 + 10.5 / 20) / (1 / 5 + 1 / 20))
    assert (b.temp_n, b.temp_mean, b.temp_higher, b.temp_km) == (3, 11.0, 2 / 3, 10.0)  # repeated readings count as often as they come
    assert (none.temp_n, none.temp_higher, none.temp_similar, none.temp_minus_mean) == (1, 0.0, 0.0, None)
    assert (c.temp_n, c.temp_mean, c.temp_similar, c.temp_km, c.temp_std, c.temp_trend_n) == (0, None, 0.0, None, None, 0)


def test_narrow_rows_are_exchanged(matches):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        sp.consensus(matches).explain("simple")
    lines = text.getvalue().splitlines()
    aggregates = [i for i, line in enumerate(lines) if "HashAggregate(" in line]
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(aggregates) == 2 and exchanges and min(exchanges) > max(aggregates)
