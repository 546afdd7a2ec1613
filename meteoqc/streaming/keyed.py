"""Keyed streaming state: memory per source, station or station and day, kept by Spark's state store.

Every processor holds a bounded memory for its key and gets each micro-batch's rows of that key, so a
stream costs the same per batch at any age and continues from its checkpoint after a restart. Rows
of one key and one micro-batch are put in order in the worker; the size of a micro-batch
(``maxFilesPerTrigger``) bounds them.

The state store must be RocksDB (``with_state_store``), whose files follow the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from meteoqc.operators.source_health import CATEGORY_STATE, SourceRules
from meteoqc.schema import KEY, TEMP, TS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


def poll_state(ok: bool, category: str | None, total: int, failed: int, stale: int, failures: int, successes: int, first: bool, before: str, rules: SourceRules) -> str:
    """State of a source after one poll cycle, from the cycle and the lengths of the current runs."""
    if not ok:
        return CATEGORY_STATE.get(category or "") or ("DISCONNECTED" if failures >= rules.outage_failures else "DEGRADED")
    if total == 0:
        return before
    if failed > 0:
        return "DEGRADED"
    if stale > 0:
        return "STALE" if stale == total else "DEGRADED"
    return "HEALTHY" if first or successes >= rules.recovery_successes else "DEGRADED"


class SourceTracker(StatefulProcessor):
    """State of each source after each poll cycle; one small row of memory per source.

    A cycle older than the last one of its source is marked ``is_late``, shows the present state and
    changes nothing.
    """

    OUTPUT = "source string, poll_ts timestamp, consecutive_failures long, consecutive_successes long, state string, trigger string, from_state string, is_late boolean"
    MEMORY = "cycles long, failures long, successes long, state string, last_us long"

    def __init__(self, rules: SourceRules = SourceRules()):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", self.MEMORY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cycles, failures, successes, state, last = self.memory.get() if self.memory.exists() else (0, 0, 0, "HEALTHY", None)
        out = []
        for r in ordered(rows, ["poll_ts"]).itertuples():
            at, ok, before = r.poll_ts.value // 1000, bool(r.ok), state
            late = last is not None and at < last
            if not late:
                cycles, last = cycles + 1, at
                failures, successes = (0, successes + 1) if ok else (failures + 1, 0)
                state = poll_state(ok, r.category, r.stations_total, r.stations_failed, r.stations_stale, failures, successes, cycles == 1, before, self.rules)
            all_failed = r.stations_total > 0 and r.stations_failed == r.stations_total
            trigger = r.category if not ok else "SCHEMA_VIOLATION" if all_failed else "NETWORK_ERROR" if r.stations_failed > 0 else "NONE"
            out.append((key[0], r.poll_ts, failures, successes, state, trigger, before, late))
        self.memory.update((cycles, failures, successes, state, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def track_sources(polls: DataFrame, rules: SourceRules = SourceRules()) -> DataFrame:
    """Streaming form of ``source_states``; a change of state is a row with ``from_state`` unlike ``state``."""
    cols = polls.select("source", "poll_ts", "ok", "category", *[F.col(c).cast("long").alias(c) for c in ("stations_total", "stations_failed", "stations_stale")])
    return cols.groupBy("source").transformWithStateInPandas(SourceTracker(rules), outputStructType=SourceTracker.OUTPUT, outputMode="append", timeMode="None")


class RepeatFilter(StatefulProcessor):
    """Marks readings whose time was seen before; the memory of a key is the times of one station, source and day."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "times binary", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = ordered(rows, ["arrival_us", "event_id"])
        times = batch["obs_us"].to_numpy()
        known = np.frombuffer(self.seen.get()[0], np.int64) if self.seen.exists() else np.zeros(0, np.int64)
        batch["is_repeat"] = np.isin(times, known) | batch["obs_us"].duplicated().to_numpy()
        self.seen.update((np.union1d(known, times).astype("<i8").tobytes(),))
        yield batch[["event_id", KEY, "source", TS, "is_repeat"]]

    def close(self) -> None:
        pass


def mark_repeats(readings: DataFrame, arrival: str = "ingestion_ts", ttl_ms: int | None = None) -> DataFrame:
    """Every reading with ``is_repeat``, however much later the repetition comes (``ttl_ms``: within that time)."""
    rows = readings.select("event_id", KEY, F.coalesce("source", F.lit("")).alias("source"), TS, F.unix_micros(TS).alias("obs_us"), F.unix_micros(arrival).alias("arrival_us"),
                           F.floor(F.unix_micros(TS) / DAY_US).alias("day"))
    return rows.groupBy(KEY, "source", "day").transformWithStateInPandas(
        RepeatFilter(ttl_ms), outputStructType=f"event_id long, {KEY} string, source string, {TS} timestamp, is_repeat boolean", outputMode="append",
        timeMode="None" if ttl_ms is None else "ProcessingTime")


class StationMemory(StatefulProcessor):
    """High-water mark of a station and its last ``keep`` readings in order of arrival."""

    OUTPUT = f"event_id long, {KEY} string, {TS} timestamp, high_water_ts timestamp, status string, earlier_readings long, earlier_mean double"

    def __init__(self, keep: int = 12):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "us long")
        self.recent = handle.getListState("recent", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = ordered(rows, ["arrival_us", "event_id"])
        own = batch["obs_us"].to_numpy()
        before = np.concatenate([[self.mark.get()[0] if self.mark.exists() else np.iinfo(np.int64).min], own])
        high = np.maximum.accumulate(before)
        held = [v[0] for v in self.recent.get()]
        values = pd.Series([np.nan if v is None else v for v in held] + batch[TEMP].astype(float).tolist(), dtype=float)
        # the mean of up to ``keep`` readings before each one; missing values count as readings, not for the mean
        means = values.shift(1).rolling(self.keep, min_periods=1).mean().to_numpy()[len(held):]
        count = np.minimum(np.arange(len(held), len(values)), self.keep)
        known = high[:-1] > np.iinfo(np.int64).min
        ahead = own > batch["arrival_us"].to_numpy() + 300_000_000
        status = np.where(ahead, "FUTURE_REJECTED", np.where(known & (own < high[:-1]), "OUT_OF_ORDER", "PROCESSED"))
        mark = pd.Series(pd.to_datetime(np.where(known, high[:-1], 0), unit="us", utc=True).tz_localize(None)).where(known)
        self.mark.update((int(high[-1]),))
        self.recent.put([(None if np.isnan(v) else float(v),) for v in values.tolist()[-self.keep:]])
        yield pd.DataFrame({"event_id": batch["event_id"].to_numpy(), KEY: key[0], TS: batch[TS].to_numpy(), "high_water_ts": mark.to_numpy(), "status": status,
                            "earlier_readings": count, "earlier_mean": pd.Series(means).where(~np.isnan(means), None).to_numpy()})

    def close(self) -> None:
        pass


def remember_stations(readings: DataFrame, arrival: str = "ingestion_ts", keep: int = 12) -> DataFrame:
    """Arrival status of every reading, and number and mean temperature of the (up to ``keep``) readings that came before it."""
    rows = readings.select("event_id", KEY, TS, TEMP, F.unix_micros(TS).alias("obs_us"), F.unix_micros(arrival).alias("arrival_us"))
    return rows.groupBy(KEY).transformWithStateInPandas(StationMemory(keep), outputStructType=StationMemory.OUTPUT, outputMode="append", timeMode="None")


class SilenceWatch(StatefulProcessor):
    """Reports silences of a station: ``GAP`` when it speaks again, ``SILENT`` when the stream's time passes the limit first."""

    OUTPUT = f"{KEY} string, kind string, since_ts timestamp, until_ts timestamp, minutes double"

    def __init__(self, limit_minutes: float):
        self.limit_us = int(limit_minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def _rows(self, key, kind: str, since, until) -> pd.DataFrame:
        stamp = lambda us: pd.to_datetime(np.asarray(us, "<i8"), unit="us")
        minutes = (np.asarray(until, float) - np.asarray(since, float)) / 60_000_000
        return pd.DataFrame({KEY: key[0], "kind": kind, "since_ts": stamp(since), "until_ts": stamp(until), "minutes": minutes})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = np.unique(pd.concat(list(rows))["obs_us"].to_numpy())
        before = self.last.get()[0] if self.last.exists() else None
        all_ = own if before is None else np.concatenate([[before], own[own > before]])
        gap = np.flatnonzero(np.diff(all_) > self.limit_us)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((int(all_[-1]),))
        self.handle.registerTimer((int(all_[-1]) + self.limit_us) // 1000 + 1)
        yield self._rows(key, "GAP", all_[gap], all_[gap + 1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        yield self._rows(key, "SILENT", [last], [expiredTimerInfo.getExpiryTimeInMs() * 1000])

    def close(self) -> None:
        pass


def watch_silences(readings: DataFrame, limit_minutes: float = 360.0, watermark: str = "2 hours") -> DataFrame:
    """Silences longer than the limit. Readings behind the watermark are not seen here (``late`` keeps them)."""
    rows = readings.withWatermark(TS, watermark).select(KEY, TS, F.unix_micros(TS).alias("obs_us"))
    return rows.groupBy(KEY).transformWithStateInPandas(SilenceWatch(limit_minutes), outputStructType=SilenceWatch.OUTPUT, outputMode="append", timeMode="EventTime")
