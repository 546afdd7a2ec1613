"""Reads over stored tables: latest rows, pages, histories, cards, inserts, retention, parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meteoqc.schema import KEY, RH, SEVERITIES, SLP, TEMP, TS


def latest_per_key(df: DataFrame, key: Sequence[str] = (KEY,), ts: str = TS) -> DataFrame:
    """Whole latest row per key by a map-side combinable aggregate (no sort, no window)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(*key, "_r.*")


def last_n_per_key(df: DataFrame, n: int, key: Sequence[str] = (KEY,), ts: str = TS) -> DataFrame:
    """Bounded history. ``row_number <= n`` is pruned per task before the shuffle."""
    w = Window.partitionBy(*key).orderBy(F.col(ts).desc())
    return df.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def where(df: DataFrame, *, start=None, end=None, ts: str = TS, **equal) -> DataFrame:
    """Optional filters; only those given are added, so they reach the scan."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page plus the total and whether more follow; the total is its own aggregate."""
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    out = rows.join(F.broadcast(total), F.lit(True))  # exactly one row
    return out.withColumn("has_more", F.col("total_count") > offset + limit)


def severity_rank(col: str = "severity") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(col))


def newest_first(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(severity_rank().desc(), F.col(TS).desc(), KEY).limit(limit)


def station_cards(st: DataFrame, obs: DataFrame, events: DataFrame, health: DataFrame | None = None, hours: int = 24) -> DataFrame:
    """Station with its latest reading, latest health and number of events in the last hours.

    "Now" is the newest stored reading, so the card is reproducible.
    """
    latest = latest_per_key(obs.select(KEY, TS, TEMP, RH, SLP)).withColumnsRenamed(
        {TS: "last_seen", TEMP: "latest_temp", RH: "latest_rh", SLP: "latest_slp"})
    now = obs.agg(F.max(TS).alias("_now"))
    recent = events.join(F.broadcast(now), F.lit(True)).filter(  # exactly one row
        F.unix_micros(TS) >= F.unix_micros("_now") - hours * 3_600_000_000)
    counts = recent.groupBy(KEY).agg(F.count(F.lit(1)).alias("active_anomalies"))
    out = st.join(latest, KEY, "left").join(counts, KEY, "left").fillna(0, ["active_anomalies"])
    return out if health is None else out.join(health, KEY, "left")


def absent(incoming: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows not stored yet, each key once."""
    return incoming.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti")


def keep_latest_version(df: DataFrame, key: str, version: str) -> DataFrame:
    return latest_per_key(df, [key], version)


def retained(df: DataFrame, days: int, now: Column, ts: str = TS, protected: Column | None = None) -> DataFrame:
    """Rows no older than ``days`` (all if ``days <= 0``); ``protected`` rows always stay."""
    if days <= 0:
        return df
    keep = F.col(ts) >= F.timestamp_micros(F.unix_micros(now) - days * 86_400_000_000)  # the bare column, so that it reaches the scan
    return df.filter(keep if protected is None else keep | protected)


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and an order-independent checksum, to compare a table with its copy."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"),
                  F.sum(F.pmod(h, F.lit(1_000_003))).alias("sum_hash"))
