"""Adapter: the ``events`` table of a table directory read as station observations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.schema import DEW, KEY, RH, SLP, STNP, TEMP, TS

STATION_COUNT = 24


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _base_temperature() -> Column:
    hour = F.hour(TS) + F.minute(TS) / 60.0
    return 22.0 + 6.0 * F.sin(2.0 * math.pi * hour / 24.0) + F.col("value") * 0.03


def as_observations(ev: DataFrame) -> DataFrame:
    """Pure projection: no shuffle, so filters on the result still reach the scan."""
    eid, station = F.col("event_id"), (F.col("user_id") % STATION_COUNT)
    ev = ev.select(
        "event_id", "event_type", "value", "props",
        station.alias("_s"),
        F.col("ts").cast("timestamp").alias(TS),
    )
    s = F.col("_s")
    temp = (
        F.when((F.col("event_type") == "error") & (eid % 3 == 0), F.lit(None).cast("double"))
        .when(F.col("value") > 300, 75.0)
        .when(s == 5, F.floor(_base_temperature()).cast("double"))
        .otherwise(F.round(_base_temperature(), 2))
    )
    rh = F.when(
        ~((F.col("event_type") == "signup") & (eid % 5 == 0)),
        F.get_json_object("props", "$.k").cast("double"),
    )
    slp = F.when(
        ~((F.col("event_type") == "view") & (eid % 7 == 0)),
        F.round(1005.0 + (eid * 37 % 200) / 10.0, 1),
    )
    stnp = F.when(eid % 4 != 1, F.round(1005.0 + (eid * 53 % 180) / 10.0 - 4.8 * s, 1))
    report = (
        F.when(F.col("event_type") == "click", "FM-12")
        .when(F.col("event_type") == "view", "FM-15")
        .when(F.col("event_type") == "purchase", "FM-16")
        .when(F.col("event_type") == "signup", "SAO")
    )
    obs = ev.select(
        eid.alias("event_id"),
        F.concat(F.lit("S"), F.lpad(s.cast("string"), 2, "0")).alias(KEY),
        F.concat(F.lit("Station "), s.cast("string")).alias("station_name"),
        TS,
        (28.0 + (s % 6) * 0.35).alias("latitude"),
        (77.0 + F.floor(s / 6) * 0.4).alias("longitude"),
        (40.0 * s).alias("elevation_m"),
        temp.alias(TEMP),
        rh.alias(RH),
        slp.alias(SLP),
        stnp.alias(STNP),
        F.lit("HISTORICAL_CSV").alias("source"),
        report.alias("report_type"),
        F.timestamp_micros(F.unix_micros(TS) + (eid % 97) * 7_000_000).alias("ingestion_ts"),
        (F.col("value") > 200).alias("is_fault"),
        F.col("event_type"),
        F.col("value"),
    )
    return obs.withColumns(
        {
            DEW: F.col(TEMP) - (100.0 - F.col(RH)) / 5.0,
            "data_quality_status": F.when(
                F.col(TEMP).isNotNull() & F.col(RH).isNotNull() & F.col(SLP).isNotNull(), "VALID"
            ).otherwise("SUSPECT"),
        }
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_observations(events(spark, sf_dir))


#: the same mapping for DuckDB; every oracle starts from it
OBS_SQL = """
obs AS (
  SELECT e.event_id, 'S' || lpad(CAST(s AS VARCHAR), 2, '0') AS station_id,
    'Station ' || CAST(s AS VARCHAR) AS station_name, ts AS obs_ts,
    28.0::DOUBLE + (s % 6) * 0.35::DOUBLE AS latitude,
    77.0::DOUBLE + (s // 6) * 0.4::DOUBLE AS longitude,
    40.0::DOUBLE * s AS elevation_m,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL
         WHEN value > 300 THEN 75.0::DOUBLE
         WHEN s = 5 THEN floor(base_t) ELSE round(base_t, 2) END AS temperature_c,
    CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN NULL
         ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS relative_humidity_pct,
    CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN NULL
         ELSE round(1005.0::DOUBLE + (event_id * 37 % 200) / 10.0::DOUBLE, 1) END AS sea_level_pressure_hpa,
    CASE WHEN event_id % 4 <> 1
         THEN round(1005.0::DOUBLE + (event_id * 53 % 180) / 10.0::DOUBLE - 4.8::DOUBLE * s, 1) END AS station_pressure_hpa,
    'HISTORICAL_CSV' AS source,
    CASE event_type WHEN 'click' THEN 'FM-12' WHEN 'view' THEN 'FM-15' WHEN 'purchase' THEN 'FM-16'
         WHEN 'signup' THEN 'SAO' END AS report_type,
    ts + to_seconds((event_id % 97) * 7) AS ingestion_ts,
    value > 200 AS is_fault, event_type, value
  FROM (SELECT *, user_id % 24 AS s,
          22.0::DOUBLE + 6.0::DOUBLE * sin(2.0::DOUBLE * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24.0::DOUBLE)
            + value * 0.03::DOUBLE AS base_t
        FROM events) e),
observations AS (
  SELECT *, temperature_c - (100.0::DOUBLE - relative_humidity_pct) / 5.0::DOUBLE AS dew_point_c,
    CASE WHEN temperature_c IS NOT NULL AND relative_humidity_pct IS NOT NULL AND sea_level_pressure_hpa IS NOT NULL
         THEN 'VALID' ELSE 'SUSPECT' END AS data_quality_status
  FROM obs)
"""
