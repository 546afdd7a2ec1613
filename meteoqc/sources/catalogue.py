"""Known data sources, run provenance and model registry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
SOURCES = [
    # source, provider, kind, is_live, has_history, needs_key
    ("HISTORICAL_CSV", "csv", "file", False, True, False),
    ("NOAA_ISD", "isd_archive", "file", False, True, False),
    ("OPEN_METEO", "weather_api", "http", True, True, False),
    ("WEATHER_API", "weather_api", "http", True, False, True),
    ("SYNTHETIC_BENCHMARK", "benchmark", "file", False, True, False),
    ("IMD_AWS", "national_service", "http", True, True, True),
]
# --- end of fixed values ------------------------------------------------------


def source_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SOURCES, "source string, provider string, kind string, is_live boolean, has_history boolean, needs_key boolean")


def with_provenance(df: DataFrame, *, run_id: str, dataset_id: str, dataset_version: str = "1.0.0",
                    source_type: str = "HISTORICAL_CSV") -> DataFrame:
    return df.withColumns(
        {"run_id": F.lit(run_id), "dataset_id": F.lit(dataset_id), "dataset_version": F.lit(dataset_version), "source_type": F.lit(source_type)})


def run_history(df: DataFrame) -> DataFrame:
    """One row per run found on the rows themselves."""
    return df.groupBy("run_id", "dataset_id", "dataset_version", "source_type").agg(
        F.count(F.lit(1)).alias("rows"), F.min("obs_ts").alias("first_ts"), F.max("obs_ts").alias("last_ts"),
        F.approx_count_distinct("station_id").alias("stations"))
