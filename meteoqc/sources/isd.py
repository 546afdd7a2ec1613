"""Hourly archive CSV (ISD layout): scan and normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.functions.physics import relative_humidity
from meteoqc.functions.text import add_scaled_fields, pin, unquoted
from meteoqc.functions.timefn import parse_timestamp
from meteoqc.operators.quality import report_types, rolled_up_status, with_reject_reasons
from meteoqc.schema import DEW, KEY, RH, SLP, STNP, TEMP, TS

REQUIRED = ("DATE",)
TEXT_COLUMNS = ["STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME", "REPORT_TYPE", "QUALITY_CONTROL",
                "TMP", "DEW", "SLP", "MA1", "STP"]


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text. Files that differ in their header must be read in separate calls."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if df.columns and missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def _station_pressure():
    """(value, qc) from the first pair of MA1, else from STP; both must be plausible."""
    ma1 = F.split(unquoted("MA1"), ",")
    number, flag = F.trim(F.get(ma1, F.lit(0))).try_cast("double") / 10.0, F.trim(F.get(ma1, F.lit(1)))
    first = number.between(300.0, 1080.0) & flag.isNotNull()
    second = F.col("p_value").between(300.0, 1080.0)
    return [
        F.when(first, F.round(number, 2)).when(second, F.col("p_value")).alias("stn_value"),
        F.when(first, flag).when(second, F.col("p_qc")).alias("stn_qc"),
    ]


def normalise(df: DataFrame, *, wanted_types: Sequence[str] | None = None, default_station: str = "UNKNOWN_STATION",
              clamp_rh: bool = True) -> DataFrame:
    """Canonical rows with ``reject_reasons``; use ``accepted`` and ``quarantined`` on the result."""
    if not df.columns:
        return df
    df = df.withColumns({c: F.lit(None).cast("string") for c in TEXT_COLUMNS if c not in df.columns})
    df = pin(add_scaled_fields(df, {"t": "TMP", "d": "DEW", "s": "SLP", "p": "STP"}), _station_pressure())
    df = pin(df, [relative_humidity("t_value", "d_value", clamp_rh).alias("_rh")])

    def text(c):
        return F.nullif(unquoted(c), F.lit(""))

    lat, lon = unquoted("LATITUDE").try_cast("double"), unquoted("LONGITUDE").try_cast("double")
    located = lat.isNotNull() & lon.isNotNull()
    elevation = F.when(unquoted("ELEVATION") != "-999.9", unquoted("ELEVATION").try_cast("double"))
    rh = F.col("_rh")
    flags = F.map_filter(
        F.create_map(F.lit("TMP_QC"), F.col("t_qc"), F.lit("DEW_QC"), F.col("d_qc"), F.lit("SLP_QC"), F.col("s_qc"),
                     F.lit("STP_QC"), F.col("stn_qc"), F.lit("RECORD_QC"), unquoted("QUALITY_CONTROL")),
        lambda _, v: v.isNotNull(),
    )
    out = df.select(
        F.coalesce(text("STATION"), F.lit(default_station)).alias(KEY),
        text("NAME").alias("station_name"),
        parse_timestamp(unquoted("DATE")).alias(TS),
        F.when(located, lat).otherwise(0.0).alias("latitude"),
        F.when(located, lon).otherwise(0.0).alias("longitude"),
        elevation.alias("elevation_m"),
        F.col("t_value").alias(TEMP), F.col("d_value").alias(DEW), F.col("s_value").alias(SLP),
        F.col("stn_value").alias(STNP), rh.alias(RH),
        F.when(rh.isNotNull(), "derived_from_temperature_and_dew_point").alias("relative_humidity_source"),
        F.lit("NOAA_ISD").alias("source"), text("REPORT_TYPE").alias("report_type"),
        flags.alias("raw_quality_flags"),
        rolled_up_status([(F.col(f"{v}_value"), F.col(f"{v}_qc")) for v in ("t", "d", "s")]).alias("data_quality_status"),
        F.lit(False).alias("is_synthetic"),
    )
    if wanted_types:
        out = report_types(out, wanted_types)
    return with_reject_reasons(out, [(F.col(TS).isNull(), "TIMESTAMP_MISSING_OR_MALFORMED")])


def as_text(obs: DataFrame) -> DataFrame:
    """The inverse: canonical rows written in the archive's text layout."""
    def packed(c, width):
        tenths = F.round(F.col(c) * 10.0, 0).cast("int")
        sign = F.when(tenths < 0, "-").otherwise("+") if width == 4 else F.lit("")
        number = F.concat(sign, F.lpad(F.abs(tenths).cast("string"), width, "0"), F.lit(",1"))
        return F.coalesce(number, F.lit(("+" + "9" * width if width == 4 else "9" * width) + ",9"))

    return obs.select(
        F.col(KEY).alias("STATION"), F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss").alias("DATE"),
        F.col("latitude").cast("string").alias("LATITUDE"), F.col("longitude").cast("string").alias("LONGITUDE"),
        F.coalesce(F.col("elevation_m").cast("string"), F.lit("-999.9")).alias("ELEVATION"),
        F.col("station_name").alias("NAME"), F.col("report_type").alias("REPORT_TYPE"), F.lit("V020").alias("QUALITY_CONTROL"),
        packed(TEMP, 4).alias("TMP"), packed(DEW, 4).alias("DEW"), packed(SLP, 5).alias("SLP"),
        F.concat(F.coalesce(F.round(F.col(STNP) * 10, 0).cast("int").cast("string"), F.lit("99999")), F.lit(",1,99999,9")).alias("MA1"),
    )
