"""Retention by whole days: old partitions are dropped, only the border day is written again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.operators.staging import staged
from meteoqc.schema import TS
from meteoqc.sources.sinks import DAY, read_or_none


@dataclass(frozen=True)
class Policy:
    """How long rows of a table stay, by the time in ``ts``; rows without that time never go.

    ``days`` of zero or less keeps everything. Outages are kept by ``resolved_at``, so open ones stay.
    """

    days: int
    ts: str = TS


def write_table(df: DataFrame, path: str, policy: Policy) -> None:
    """Parquet parted by the day of the policy's time."""
    df.withColumn(DAY, F.to_date(policy.ts)).write.mode("append").partitionBy(DAY).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system Spark reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def prune(spark: SparkSession, path: str, policy: Policy, now: str) -> int:
    """Drops what is older than the policy allows and returns how many rows went.

    Days before the border are removed as folders; of the border day the rows that stay are written
    aside and put in its place. No other file is touched.
    """
    table = read_or_none(spark, path)
    if table is None or policy.days <= 0:
        return 0
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(policy.days))
    border = spark.range(1).select(F.to_date(cutoff).alias("d")).first()["d"]
    days = [r[DAY] for r in table.filter(F.col(DAY) <= border).select(DAY).distinct().collect()]  # one row for each day
    before = table.filter(F.col(DAY) <= border).count()
    left = staged(table.filter((F.col(DAY) == border) & (F.col(policy.ts) >= cutoff)))
    kept = left.count()
    for day in days:
        if day < border or not kept:
            remove_folder(spark, f"{path}/{DAY}={day.isoformat()}")
    if kept:
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return before - kept


def prune_all(spark: SparkSession, tables: dict[str, tuple[str, Policy]], now: str) -> DataFrame:
    """Runs every policy: table, rows that went, rows that are left (one row for each table)."""
    out = []
    for name, (path, policy) in tables.items():
        gone = prune(spark, path, policy, now)
        left = read_or_none(spark, path)
        out.append((name, gone, 0 if left is None else left.count()))
    return spark.createDataFrame(out, "table_name string, pruned long, kept long")
