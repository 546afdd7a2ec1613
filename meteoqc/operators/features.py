"""Per-station time features: lags, rolling statistics, rates, persistence, interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meteoqc.functions.timefn import calendar
from meteoqc.operators.chunks import CHUNK, FOUR_DAYS, OWN, chunk_window, drop_halo, run_positions, with_halo
from meteoqc.operators.sliding import with_statistics
from meteoqc.schema import DEW, KEY, MEASURES, RH, SLP, TEMP, TS

# --- fixed values: feature layout ---------------------------------------------
WINDOWS = {"15m": 900, "30m": 1800, "1h": 3600, "3h": 10800, "6h": 21600, "24h": 86400}
LAGS = (1, 2, 3)
STATS = ("mean", "std", "min", "max", "count")
EPSILON = 1e-6
PERSISTENCE_VARS = (TEMP, RH, SLP)
# --- end of fixed values ------------------------------------------------------

US = "_us"


def first_per_key(df: DataFrame, key: Sequence[str] = (KEY, TS), order: Sequence[str] = ("event_id",)) -> DataFrame:
    """Deterministic distinct: the first row per key (time windows need unique times)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter(F.col("_first") == 1).drop("_first")


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar(TS))


def prepare(df: DataFrame, *, rows: int = 3, span: int = 86_400, seconds: int = FOUR_DAYS) -> DataFrame:
    return with_halo(df, rows=rows, span=span, seconds=seconds).withColumn(US, F.unix_micros(TS))


def _row_window():
    return chunk_window(ts=US)


def add_lags(df: DataFrame, cols: Sequence[str] = MEASURES, lags: Sequence[int] = LAGS) -> DataFrame:
    w = _row_window()
    return df.withColumns({f"{c}_lag_{n}": F.lag(c, n).over(w) for c in cols for n in lags})


def add_rolling(df: DataFrame, cols: Sequence[str] = MEASURES, windows: Sequence[str] = tuple(WINDOWS)) -> DataFrame:
    """Statistics over ``(t - w, t]`` of the rows marked own (all rows, where none are marked)."""
    fields = list(df.schema.fields)
    for name in windows:
        for c in cols:
            as_is = df.schema[c].dataType
            kinds = {"mean": T.DoubleType(), "std": T.DoubleType(), "min": as_is, "max": as_is, "count": T.LongType()}
            fields += [T.StructField(f"{c}_rolling_{s}_{name}", kinds[s]) for s in STATS]
    schema = T.StructType(fields)
    arrow, own = to_arrow_schema(schema), OWN if OWN in df.columns else None
    spans = [WINDOWS[name] * 1_000_000 for name in windows]
    return df.groupBy(KEY, CHUNK).applyInArrow(lambda rows: with_statistics(rows, US, cols, spans, arrow, own), schema)


def add_rates(df: DataFrame, cols: Sequence[str] = MEASURES) -> DataFrame:
    w = _row_window()
    df = df.withColumns(
        {
            "elapsed_minutes": (F.col(US) - F.lag(US).over(w)) / 60_000_000.0,
            **{f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in cols},
        }
    )
    out = {}
    for c in cols:
        rate = F.when(F.col("elapsed_minutes") > 0, F.col(f"{c}_delta") / F.col("elapsed_minutes"))
        out[f"{c}_rate_per_minute"] = rate
        out[f"{c}_rate_per_5min"] = rate * 5.0
        out[f"{c}_rate_per_hour"] = rate * 60.0
        out[f"{c}_acceleration"] = F.col(f"{c}_delta") - F.lag(f"{c}_delta").over(w)
    return df.withColumns(out)


def add_deviations(df: DataFrame, cols: Sequence[str] = PERSISTENCE_VARS, ref: str = "1h") -> DataFrame:
    out = {}
    for c in cols:
        mean, std = F.col(f"{c}_rolling_mean_{ref}"), F.col(f"{c}_rolling_std_{ref}")
        residual = F.col(c) - mean
        out[f"{c}_deviation_from_mean_{ref}"] = residual
        out[f"{c}_pct_deviation_{ref}"] = F.when(F.abs(mean) > 0.1, residual / mean * 100.0)
        out[f"{c}_zscore_{ref}"] = F.when(std > EPSILON, residual / std)
    return df.withColumns(out)


def add_interactions(df: DataFrame, ref: str = "1h") -> DataFrame:
    def scaled(c):
        std = F.col(f"{c}_rolling_std_{ref}")
        return F.when(std != 0.0, F.col(f"{c}_delta") / (std + EPSILON))

    squares = [F.pow(F.coalesce(F.col(f"{c}_zscore_{ref}"), F.lit(0.0)), F.lit(2.0)) for c in PERSISTENCE_VARS]
    return df.withColumns(
        {
            "dew_point_spread_c": F.col(TEMP) - F.col(DEW),
            "temp_rh_delta_interaction": F.col(f"{TEMP}_delta") * F.col(f"{RH}_delta"),
            "joint_temp_rh_divergence": scaled(TEMP) - scaled(RH),
            "temp_slp_delta_interaction": F.col(f"{TEMP}_delta") * F.col(f"{SLP}_delta"),
            "joint_standardized_anomaly_magnitude": F.sqrt(squares[0] + squares[1] + squares[2]),
        }
    )


def mark_changes(df: DataFrame, cols: Sequence[str] = PERSISTENCE_VARS, rounded: bool = True) -> DataFrame:
    """Flags ``_chg_*``: the value differs from the previous reading, or one of the two is missing."""
    w = _row_window()

    def changed(value, previous):
        return value.isNull() | previous.isNull() | (value != previous)

    out = {f"_chg_{c}": changed(F.col(c), F.lag(c).over(w)) for c in cols}
    if rounded:
        for c in cols:
            r = F.bround(c, 1)
            out[f"_chr_{c}"] = changed(r, F.lag(r).over(w))
    return df.withColumns(out)


def add_persistence(df: DataFrame, cols: Sequence[str] = PERSISTENCE_VARS, rounded: bool = True, order: str = TS, own: str | None = None) -> DataFrame:
    """Run lengths from the flags of ``mark_changes``; the input must hold own rows only, or mark them in ``own``.

    ``order``: pass the column the frame is already sorted by to save a sort.
    """
    breaks = {f"_p{i}": F.col(f"_chg_{c}") for i, c in enumerate(cols)}
    if rounded:
        breaks |= {f"_q{i}": F.col(f"_chr_{c}") for i, c in enumerate(cols)}
    df = run_positions(df, breaks, order=[order], own=own)
    out = {}
    for i, c in enumerate(cols):
        out[f"{c}_consecutive_unchanged_count"] = F.col(f"_p{i}_since") + 1
        out[f"{c}_duration_unchanged_minutes"] = (F.unix_micros(TS) - F.unix_micros(f"_p{i}_start")) / 60_000_000.0
        if rounded:
            out[f"{c}_rounded_unchanged_count"] = F.col(f"_q{i}_since") + 1
    used = [f"{b}{s}" for b in breaks for s in ("_since", "_start")]
    return df.withColumns(out).drop(*used, "seq", *[c for c in df.columns if c.startswith(("_chg_", "_chr_"))])


def time_features(df: DataFrame, *, windows: Sequence[str] = tuple(WINDOWS), cols: Sequence[str] = MEASURES,
                  lags: Sequence[int] = LAGS, persistence: bool = True, ref: str = "1h",
                  seconds: int = FOUR_DAYS) -> DataFrame:
    """Lags, rolling, rates, deviations, interactions and persistence with one main exchange.

    The rolling statistics, the widest columns, come last, so no exchange or sort carries them.
    """
    span = max(WINDOWS[w] for w in windows)
    out = prepare(df, rows=max(3, *lags) if lags else 2, span=span, seconds=seconds)
    if lags:
        out = add_lags(out, cols, lags)
    given = out.columns
    out = add_rates(out, cols)
    rates = [c for c in out.columns if c not in given]
    if persistence:
        out = add_persistence(mark_changes(out), order=US, own=OWN)
    runs = [c for c in out.columns if c not in {*given, *rates}]
    out = add_rolling(out, cols, windows)
    rolled = [c for c in out.columns if c not in {*given, *rates, *runs}]
    out = drop_halo(add_interactions(add_deviations(out, ref=ref), ref), CHUNK, US)
    rest = [c for c in out.columns if c not in {*given, *rates, *runs, *rolled}]
    return out.select(*[c for c in given if c in out.columns], *rolled, *rates, *rest, *runs)


def missing_runs(df: DataFrame, col: str = TEMP, seconds: int = FOUR_DAYS) -> DataFrame:
    """Consecutive missing steps of ``col`` and minutes since its last valid reading."""
    chunked = with_halo(df, seconds=seconds).drop("_own")
    runs = run_positions(chunked, {"_m": F.col(col).isNotNull()})
    return runs.withColumns(
        {
            "missing_steps": F.col("_m_since"),
            "gap_minutes": F.when(F.col("_m_since") > 0, (F.unix_micros(TS) - F.unix_micros("_m_start")) / 60_000_000.0),
        }
    ).drop("_m_since", "_m_start", "seq", CHUNK)


def rolling_rows(df: DataFrame, col: str = TEMP, size: int = 12, seconds: int = FOUR_DAYS) -> DataFrame:
    """Mean, std and median of the last ``size`` readings including the current one."""
    out = prepare(df, rows=size, span=0, seconds=seconds)
    w = _row_window().rowsBetween(-(size - 1), 0)
    out = out.withColumns(
        {
            f"{col}_last{size}_mean": F.avg(col).over(w),
            f"{col}_last{size}_std": F.coalesce(F.stddev_samp(col).over(w), F.lit(0.0)),
            f"{col}_last{size}_median": F.percentile(col, F.lit(0.5)).over(w),
        }
    )
    return drop_halo(out, US, CHUNK)
