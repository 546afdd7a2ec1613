"""Which spans of time cover each reading, at a cost that does not grow with the spans that cover it.

A station that reports twice as often has twice as many episodes, each with twice as many readings, so
(reading, span) pairs grow with the square of its density. Here the spans of one (station, stretch of
time) are cut where one begins or ends; each piece says how many spans hold it and which comes first.
There are at most two pieces per span and stretch, and each reading takes those of the last one begun.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meteoqc.operators.chunks import CHUNK, as_of, chunk_of, scan, with_chunk
from meteoqc.schema import KEY, TS

DAY = 86_400


def _first_held(start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per time of ``at`` (ascending) the lowest row number among the spans [start, end) that hold it, -1 if none does."""
    begun, held, k, out = np.argsort(start, kind="stable"), [], 0, np.full(len(at), -1)
    for i, t in enumerate(at):
        while k < len(begun) and start[begun[k]] <= t:
            heapq.heappush(held, int(begun[k]))
            k += 1
        while held and end[held[0]] <= t:
            heapq.heappop(held)
        if held:
            out[i] = held[0]
    return out


def _pieces(spans: pa.Table, order: str, flags: Sequence[str], schema: pa.Schema) -> pa.Table:
    spans = spans.sort_by(order)
    start, end = spans["_from"].to_numpy(), spans["_until"].to_numpy()
    at = np.unique(np.concatenate([start, end]))
    first = _first_held(start, end, at)

    def held(mark: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.sort(start[mark]), at, side="right") - np.searchsorted(np.sort(end[mark]), at, side="right")

    cols = {"_at": pa.array(at), "spans": pa.array(held(np.ones(len(start), bool)))}
    cols |= {f: pa.array(held(spans[f].fill_null(False).to_numpy()) > 0) for f in flags}
    none = pa.array(first, mask=first < 0)
    own = np.zeros(len(at), int)
    return pa.table([(spans[f.name].take(own) if f.name in (KEY, CHUNK) else cols[f.name] if f.name in cols else spans[f.name].take(none)).cast(f.type) for f in schema], schema=schema)


def with_cover(rows: DataFrame, spans: DataFrame, *, order: str, fields: Sequence[str] = (), flags: Sequence[str] = (),
               start: str = "start_ts", end: str = "end_ts", name: str = "cover", seconds: int = DAY) -> DataFrame:
    """Rows with a struct ``name`` of the spans [start, end] on their station that hold their time, null if none does.

    It has ``spans`` (how many), the boolean ``flags`` (true where any of them has it) and the ``fields``
    of the one that comes first by ``order``.
    """
    us = seconds * 1_000_000
    parts = spans.filter(F.col(KEY).isNotNull() & F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(
        "*", F.explode(F.sequence(chunk_of(start, seconds), chunk_of(end, seconds))).alias(CHUNK))
    parts = parts.select(
        KEY, CHUNK, F.greatest(F.unix_micros(start), F.col(CHUNK) * us).alias("_from"), F.least(F.unix_micros(end) + 1, (F.col(CHUNK) + 1) * us).alias("_until"),
        *dict.fromkeys([order, *fields, *flags]))
    types = {f.name: f.dataType for f in parts.schema}
    schema = T.StructType([T.StructField(KEY, types[KEY]), T.StructField(CHUNK, types[CHUNK]), T.StructField("_at", T.LongType()), T.StructField("spans", T.LongType()),
                           *[T.StructField(c, types[c]) for c in (*flags, *fields)]])
    arrow, marks = to_arrow_schema(schema), list(flags)
    pieces = parts.groupBy(KEY, CHUNK).applyInArrow(lambda t: _pieces(t, order, marks, arrow), schema)
    pieces = pieces.select(KEY, CHUNK, "_at", F.lit(0).alias("_side"), F.struct("spans", *flags, *fields).alias(name))
    given = with_chunk(rows, seconds=seconds).withColumns({"_at": F.unix_micros(TS), "_side": F.lit(1)})
    both = given.unionByName(pieces, allowMissingColumns=True)
    last = F.last(name, ignorenulls=True).over(Window.partitionBy(KEY, CHUNK).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn(name, last).filter(F.col("_side") == 1).drop(CHUNK, "_at", "_side")
    return out.withColumn(name, F.when(F.col(f"{name}.spans") > 0, F.col(name)))


def readings_before(places: DataFrame, rows: DataFrame, at: Column, name: str) -> DataFrame:
    """``places`` with the number of ``rows`` of their station before ``at``."""
    times = with_chunk(rows.groupBy(KEY, TS).agg(F.count(F.lit(1)).alias("n")).filter(F.col(TS).isNotNull()))
    upto = scan(times, {"upto": ("sum", F.col("n"))}).select(KEY, TS, "upto")
    asked = places.select(F.struct("*").alias("_place"), KEY, at.alias(TS))
    found = as_of(asked, upto, key=KEY, ts=TS, payload=["upto"], name="_n", strict=True)
    return found.select("_place.*", F.coalesce("_n.upto", F.lit(0)).alias(name))
