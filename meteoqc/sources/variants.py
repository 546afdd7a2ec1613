"""Payloads of any shape as VARIANT values: parsed once, read by path, described by a merged schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: where senders put a reading's values
PATHS = {
    "temperature_c": ["$.current.temperature_2m", "$.hourly.temperature_2m[0]", "$.temperature_2m"],
    "relative_humidity_pct": ["$.current.relative_humidity_2m", "$.hourly.relative_humidity_2m[0]", "$.relative_humidity_2m"],
    "sea_level_pressure_hpa": ["$.current.pressure_msl", "$.hourly.pressure_msl[0]", "$.pressure_msl"],
}


def parsed(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``raw`` with ``doc``, the payload as VARIANT; null where it is not JSON."""
    return raw.withColumn("doc", F.try_parse_json(payload))


def value_at(paths: list[str], kind: str = "double") -> Column:
    """The first of several paths that holds a value of ``kind``."""
    return F.coalesce(*[F.try_variant_get("doc", p, kind) for p in paths])


def readings(docs: DataFrame) -> DataFrame:
    """Station and values of every payload that could be parsed."""
    return docs.filter(F.col("doc").isNotNull()).withColumns(
        {"station": F.try_variant_get("doc", "$.station_id", "string"), "elevation": F.try_variant_get("doc", "$.elevation", "double"), **{c: value_at(p) for c, p in PATHS.items()}})


def quarantine(docs: DataFrame) -> DataFrame:
    """Payloads that are not JSON, as received."""
    return docs.filter(F.col("doc").isNull()).drop("doc")


def merged_schema(docs: DataFrame, by: list[str]) -> DataFrame:
    """One schema per group that all of its payloads fit, found without fixing any beforehand."""
    return docs.filter(F.col("doc").isNotNull()).groupBy(*by).agg(F.schema_of_variant_agg("doc").alias("schema"), F.count(F.lit(1)).alias("payloads"))
