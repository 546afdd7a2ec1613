"""Canonical columns, value lists and physical limits shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "station_id"
TS = "obs_ts"

TEMP = "temperature_c"
RH = "relative_humidity_pct"
SLP = "sea_level_pressure_hpa"
STNP = "station_pressure_hpa"
DEW = "dew_point_c"

#: short name -> canonical column
VARS = {"temp": TEMP, "rh": RH, "slp": SLP}
MEASURES = [TEMP, RH, SLP, STNP]

OBSERVATION = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField("station_name", T.StringType()),
        T.StructField(TS, T.TimestampType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("elevation_m", T.DoubleType()),
        T.StructField(TEMP, T.DoubleType()),
        T.StructField(DEW, T.DoubleType()),
        T.StructField(SLP, T.DoubleType()),
        T.StructField(STNP, T.DoubleType()),
        T.StructField(RH, T.DoubleType()),
        T.StructField("relative_humidity_source", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("report_type", T.StringType()),
        T.StructField("data_quality_status", T.StringType()),
        T.StructField("raw_quality_flags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("is_synthetic", T.BooleanType()),
        T.StructField("ingestion_ts", T.TimestampType()),
    ]
)

# --- fixed values: limits and vocabularies that results depend on -------------
BOUNDS = {
    "latitude": (-90.0, 90.0),
    "longitude": (-180.0, 180.0),
    "elevation_m": (-500.0, 9000.0),
    TEMP: (-50.0, 60.0),
    DEW: (-80.0, 60.0),
    SLP: (500.0, 1080.0),
    STNP: (300.0, 1080.0),
    RH: (0.0, 100.0),
}
DECISION_BOUNDS = {TEMP: (-50.0, 60.0), RH: (0.0, 100.0), SLP: (870.0, 1085.0)}

QUALITY_STATUSES = ["VALID", "SUSPECT", "ERROR", "MISSING", "UNKNOWN"]
DECISIONS = [
    "NORMAL",
    "PROBABLE_SENSOR_ANOMALY",
    "PROBABLE_DATA_QUALITY_ISSUE",
    "POSSIBLE_GENUINE_EVENT",
    "UNCERTAIN",
]
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
SPATIAL_CATEGORIES = ["INSUFFICIENT_CONTEXT", "REGIONAL_PATTERN", "LOCAL_CLUSTER", "LOCAL_ONLY"]
SOURCE_STATES = [
    "HEALTHY",
    "DEGRADED",
    "STALE",
    "DISCONNECTED",
    "RATE_LIMITED",
    "AUTH_ERROR",
    "CONFIG_ERROR",
]
# --- end of fixed values ------------------------------------------------------
