"""Session settings that the operators rely on or profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tuned(builder: SparkSession.Builder, partitions: int | None = None) -> SparkSession.Builder:
    """UTC times, adaptive plans with skew handling, Arrow for the few Python stages.

    ``partitions`` is for local runs; on a cluster adaptive execution sizes shuffles from the
    cluster's own initial number.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    if partitions:
        settings |= {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "8g"}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder
