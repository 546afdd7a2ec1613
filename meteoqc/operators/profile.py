"""Data-set profiles: value distributions, cadence, duplicates, counts, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meteoqc.functions.numeric import steady_round
from meteoqc.operators.chunks import CHUNK, FOUR_DAYS, chunk_window, drop_halo, scan, with_chunk, with_halo
from meteoqc.schema import DEW, KEY, RH, SLP, STNP, TEMP, TS

PROFILED = [TEMP, DEW, SLP, STNP, RH]


def long_format(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (KEY,)) -> DataFrame:
    return df.unpivot(list(keep), list(cols), "variable", "x")


def variable_profile(df: DataFrame, cols: Sequence[str] = PROFILED) -> DataFrame:
    """Per station and variable: counts, range, mean, population std, exact quartiles.

    Equal values are counted before the shuffle, so an exact percentile costs one row per distinct
    reading value and a dense station does not gather its readings in one task.
    """
    counted = long_format(df.select(KEY, *cols), cols).groupBy(KEY, "variable", "x").agg(F.count(F.lit(1)).alias("n"))
    x, n = F.col("x"), F.col("n")
    valid = F.when(x.isNotNull(), n)
    total = F.sum("n")
    mean = F.sum(x * n) / F.sum(valid)
    agg = counted.groupBy(KEY, "variable").agg(
        total.alias("total"), F.coalesce(F.sum(valid), F.lit(0)).alias("count_valid"),
        F.min("x").alias("min"), F.max("x").alias("max"), mean.alias("_mean"),
        F.sum(F.pow(x, F.lit(2.0)) * n).alias("_sq"),
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("_q"),
    )
    variance = F.greatest(F.col("_sq") / F.col("count_valid") - F.pow("_mean", F.lit(2.0)), F.lit(0.0))
    return agg.select(
        KEY, "variable", "count_valid",
        steady_round((F.col("total") - F.col("count_valid")) / F.col("total") * 100.0, 2).alias("missing_pct"),
        steady_round("min", 2).alias("min"), steady_round("max", 2).alias("max"), steady_round("_mean", 2).alias("mean"),
        steady_round(F.when(F.col("count_valid") > 0, F.sqrt(variance)), 2).alias("std"),
        steady_round(F.get("_q", F.lit(1)), 2).alias("median"), steady_round(F.get("_q", F.lit(0)), 2).alias("q25"),
        steady_round(F.get("_q", F.lit(2)), 2).alias("q75"),
    )


def gaps(df: DataFrame, seconds: int = FOUR_DAYS) -> DataFrame:
    """Minutes between consecutive distinct times of a station."""
    times = df.select(KEY, TS).distinct()
    w = chunk_window()
    halo = with_halo(times, rows=1, seconds=seconds)
    minutes = (F.unix_micros(TS) - F.lag(F.unix_micros(TS)).over(w)) / 60_000_000.0
    return drop_halo(halo.withColumn("gap_minutes", minutes), CHUNK).filter(F.col("gap_minutes") > 0)


def cadence_profile(df: DataFrame, digits: int = 1) -> DataFrame:
    """Median, min, max and most frequent gap; regular = 90 % within a minute of the latter."""
    counted = gaps(df).select(KEY, F.round("gap_minutes", digits).alias("gap")).groupBy(KEY, "gap").agg(F.count(F.lit(1)).alias("n"))
    stats = counted.groupBy(KEY).agg(
        F.percentile("gap", F.lit(0.5), F.col("n")).alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
        F.max_by("gap", F.struct("n", (-F.col("gap")).alias("smaller_first"))).alias("mode_gap"), F.sum("n").alias("gaps"),
    )
    near = F.sum(F.when(F.abs(F.col("gap") - F.col("mode_gap")) <= 1.0, F.col("n")).otherwise(0))
    regular = counted.join(stats.select(KEY, "mode_gap"), KEY).groupBy(KEY).agg(near.alias("near_mode"))
    return stats.join(regular, KEY).select(
        KEY, "gaps", F.round("median_gap", digits).alias("median_gap"), "min_gap", "max_gap", "mode_gap",
        (F.col("near_mode") / F.col("gaps") >= 0.9).alias("is_regular"))


def arrival_faults(df: DataFrame, arrival: str = "ingestion_ts", tie: str = "event_id", seconds: int = FOUR_DAYS) -> DataFrame:
    """Duplicate times and readings older than the one that arrived just before."""
    halo = with_halo(df.select(KEY, TS, arrival, tie), rows=1, ts=arrival, seconds=seconds)
    w = chunk_window(ts=arrival)
    late = drop_halo(halo.withColumn("_late", F.col(TS) < F.lag(TS).over(w)), CHUNK)
    per_time = late.groupBy(KEY, TS).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_late"), 1)).alias("late"))
    return per_time.groupBy(KEY).agg(F.sum(F.col("n") - 1).alias("duplicates"), F.sum("late").alias("out_of_order"))


def group_shares(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage per value of ``col`` and station; a missing value is UNKNOWN."""
    counted = df.groupBy(KEY, F.coalesce(F.col(col), F.lit("UNKNOWN")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(KEY).agg(F.sum("n").alias("total"))
    return counted.join(total, KEY).select(KEY, F.lit(col).alias("column"), "value", "n", (F.col("n") / F.col("total") * 100.0).alias("pct"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row per station: range, place, cadence, arrival faults, and a text line."""
    base = df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("records"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"),
        F.min_by(F.struct("station_name", "latitude", "longitude", "elevation_m"), TS).alias("p"),
        F.count(F.when(F.col("data_quality_status") == "VALID", 1)).alias("valid_records"),
        *[F.avg(c).alias(f"mean_{n}") for n, c in (("temp", TEMP), ("rh", RH), ("slp", SLP))],
    )
    out = base.join(cadence_profile(df), KEY, "left").join(arrival_faults(df), KEY, "left")
    days = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 86_400_000_000.0
    out = out.withColumn("duration_days", F.round(days, 2))
    return out.select(
        KEY, "p.*", "records", "valid_records", "first_ts", "last_ts", "duration_days", "median_gap", "mode_gap", "is_regular",
        "duplicates", "out_of_order", *[F.round(f"mean_{n}", 2).alias(f"mean_{n}") for n in ("temp", "rh", "slp")],
        F.format_string("# %s (%s): %d records, %d duplicates, %d out of order", KEY, "p.station_name", "records", "duplicates", "out_of_order").alias("headline"),
    )


def csv_preview(df: DataFrame, canonical: Sequence[str], has_labels: bool) -> DataFrame:
    """One-row summary of a mapped CSV: rows, stations, range, cadence and null shares."""
    shares = [
        (F.round(F.count(F.when(F.col(c).isNull(), 1)) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100.0, 1) if c in df.columns else F.lit(100.0)).alias(f"null_pct_{c}")
        for c in canonical
    ]
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"), *shares)
    names = df.select(KEY).distinct()
    count = names.agg(F.count(F.lit(1)).alias("stations"))
    first = names.orderBy(KEY).limit(20).agg(F.array_join(F.array_sort(F.collect_list(KEY)), ",").alias("first_stations"))
    step = gaps(df).groupBy(F.round("gap_minutes", 1).alias("gap")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.round(F.percentile("gap", F.lit(0.5), F.col("n")), 1).alias("cadence_minutes"))
    out = base
    for one_row in (count, first, step):  # each side has exactly one row
        out = out.join(one_row, F.lit(True), "left")
    return out.withColumn("has_ground_truth", F.lit(has_labels))


def latency_stats(df: DataFrame, latency: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, exact p50/p95/p99, range and throughput; equal latencies are counted first."""
    counted = df.groupBy(*by, F.round(latency, 3).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("x", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n"))
    out = counted.groupBy(*by).agg(
        F.sum("n").alias("requests"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"), q.alias("_q"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    return out.select(*by, "requests", "mean", *[F.get("_q", F.lit(i)).alias(p) for i, p in enumerate(("p50", "p95", "p99"))],
                      "min", "max", (F.lit(1000.0) / F.col("mean")).alias("per_second"))


def network_extremes(latest: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Min, median, max, mean over the stations' latest readings, and the station at each extreme."""
    rows = long_format(latest.select(KEY, *[F.col(c).alias(n) for n, c in cols.items()]), list(cols))
    at = F.struct("x", KEY)
    present = F.col("x").isNotNull()
    return rows.groupBy("variable").agg(
        F.min("x").alias("min"), F.percentile("x", F.lit(0.5)).alias("median"), F.max("x").alias("max"), F.avg("x").alias("mean"),
        F.min(F.when(present, at)).alias("_lo"), F.max(F.when(present, at)).alias("_hi"),
    ).select("variable", "min", "median", "max", "mean", F.col(f"_lo.{KEY}").alias("lowest_station"), F.col(f"_hi.{KEY}").alias("highest_station"))


def high_water(df: DataFrame, arrival: str = "ingestion_ts", tie: str = "event_id", seconds: int = FOUR_DAYS) -> DataFrame:
    """Largest reading time that arrived earlier, per station, in arrival order."""
    chunked = with_chunk(df, arrival, seconds)
    return scan(chunked, {"high_water_ts": ("max", F.col(TS))}, order=[arrival, tie], exclusive=True).drop(CHUNK)
