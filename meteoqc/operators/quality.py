"""Physical limits, roll-up of quality codes, qualification of incoming rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meteoqc.functions.text import qc_status
from meteoqc.schema import BOUNDS, DEW, KEY, RH, SLP, TEMP, TS

REJECTS = "reject_reasons"


def outside(name: str, limits: dict[str, tuple[float, float]] = BOUNDS) -> Column:
    low, high = limits[name]
    return F.coalesce((F.col(name) < low) | (F.col(name) > high), F.lit(False))


def with_reject_reasons(df: DataFrame, extra: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """Array of reasons; empty = acceptable. Only columns present in the frame are checked."""
    checks = [(outside(c), f"{c.upper()}_OUT_OF_BOUNDS") for c in BOUNDS if c in df.columns]
    tests = [F.when(cond, F.lit(code)) for cond, code in [*extra, *checks]]
    return df.withColumn(REJECTS, F.array_compact(F.array(*tests)))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.size(REJECTS) == 0).drop(REJECTS)


def quarantined(df: DataFrame) -> DataFrame:
    return df.filter(F.size(REJECTS) > 0)


def rolled_up_status(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Status over (value, qc) pairs; only codes of present values count."""
    present = F.array_compact(F.array(*[F.when(v.isNotNull(), qc_status(q)) for v, q in pairs]))
    return (
        F.when(F.size(present) == 0, "MISSING")
        .when(F.array_contains(present, "ERROR"), "ERROR")
        .when(F.array_contains(present, "SUSPECT"), "SUSPECT")
        .when(F.forall(present, lambda s: s == "VALID"), "VALID")
        .otherwise("UNKNOWN")
    )


def completeness_status() -> Column:
    whole = F.col(TEMP).isNotNull() & F.col(RH).isNotNull() & F.col(SLP).isNotNull()
    return F.when(whole, "VALID").otherwise("SUSPECT")


def report_types(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.filter(F.col("report_type").isin(list(wanted)))


# --- fixed values -------------------------------------------------------------
TRUSTED_SOURCES = ["WEATHER_API", "OPEN_METEO", "NOAA_ISD"]
KNOWN_PRESSURE_MEANINGS = ["MEAN_SEA_LEVEL_PRESSURE", "STATION_SURFACE_PRESSURE"]
GATE_CHECKS = ["station_identity_valid", "timestamp_utc_aware", "latitude_valid", "longitude_valid",
               "temperature_physically_valid", "rh_physically_valid", "pressure_physically_valid",
               "pressure_semantics_confirmed", "physical_consistency_valid", "source_provenance_retained"]
# --- end of fixed values ------------------------------------------------------


def qualification_gate(df: DataFrame, pressure_meaning: Column | str = "MEAN_SEA_LEVEL_PRESSURE",
                       expected_station: Column | None = None) -> DataFrame:
    """Ten named checks per row: ``checks`` map, ``is_qualified``, and the failed check names."""
    meaning = F.lit(pressure_meaning) if isinstance(pressure_meaning, str) else pressure_meaning
    station_ok = F.coalesce(F.length(F.trim(KEY)) > 0, F.lit(False))
    if expected_station is not None:
        station_ok = station_ok & F.coalesce(F.col(KEY) == expected_station, F.lit(False))
    dew_ok = ~F.coalesce(F.col(DEW) > F.col(TEMP) + 0.5, F.lit(False))
    results = [
        station_ok, F.col(TS).isNotNull(),
        F.coalesce(F.col("latitude").between(*BOUNDS["latitude"]), F.lit(False)),
        F.coalesce(F.col("longitude").between(*BOUNDS["longitude"]), F.lit(False)),
        ~outside(TEMP), ~outside(RH), ~outside(SLP),
        F.coalesce(meaning.isin(KNOWN_PRESSURE_MEANINGS), F.lit(False)),
        dew_ok, F.coalesce(F.col("source").isin(TRUSTED_SOURCES), F.lit(False)),
    ]
    checks = F.create_map(*[x for n, r in zip(GATE_CHECKS, results) for x in (F.lit(n), r)])
    df = df.withColumn("checks", checks)
    return df.withColumns(
        {
            "is_qualified": F.forall(F.map_values("checks"), lambda ok: ok),
            "failed_checks": F.map_keys(F.map_filter("checks", lambda _, ok: ~ok)),
        }
    )
