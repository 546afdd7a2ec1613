"""Table writers: partitioned appends, idempotent inserts, audit rows, versioned upserts, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from meteoqc.functions.text import observation_id
from meteoqc.operators.lookups import absent, keep_latest_version, retained
from meteoqc.schema import KEY, TS

DAY = "day"
OBSERVATION_KEY = ("source", KEY, TS)


def read_or_none(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table at ``path``, or None where there is none; a table that cannot be read is an error."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_by_day(df: DataFrame, path: str, ts: str = TS) -> None:
    df.withColumn(DAY, F.to_date(ts)).write.mode("append").partitionBy(DAY).parquet(path)


def write_observations(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet by day; CSV and JSON lines with maps as JSON text (CSV has no maps)."""
    if fmt == "parquet":
        append_by_day(df, path)
        return
    if fmt == "csv":
        maps = [f.name for f in df.schema.fields if f.dataType.typeName() in ("map", "array", "struct")]
        df = df.withColumns({c: F.to_json(c) for c in maps})
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_once_per_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """A repeated micro-batch overwrites its own folder, so the sink sees each batch once."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def insert_observations(df: DataFrame, path: str, key: Sequence[str] = OBSERVATION_KEY, ts: str = TS) -> None:
    """Appends rows whose key is not stored yet, with a deterministic id.

    Only the days between the first and last incoming time are read for the comparison.
    """
    spark = df.sparkSession
    rows = df.withColumns({"observation_id": observation_id("source", KEY, ts)})
    stored = read_or_none(spark, path)
    if stored is None:
        append_by_day(rows.dropDuplicates(list(key)), path, ts)
        return
    span = df.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi")).first()
    if span["lo"] is not None:
        append_by_day(absent(rows, stored.filter(F.col(DAY).between(span["lo"], span["hi"])), key), path, ts)


def insert_absent(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Insert-if-absent for events, explanations, health rows, corrections, stations."""
    stored = read_or_none(df.sparkSession, path)
    (df.dropDuplicates(list(key)) if stored is None else absent(df, stored, key)).write.mode("append").parquet(path)


def archive_payloads(df: DataFrame, path: str, payload: str = "payload", retrieved: str = "retrieval_ts") -> None:
    """Raw payload text kept by retrieval day, as received."""
    append_by_day(df.select(KEY, retrieved, F.col(payload).alias("payload")), path, retrieved)


def append_audit(df: DataFrame, path: str, ts: str = TS) -> None:
    """Append-only audit rows (imputations, corrections, bundles)."""
    append_by_day(df, path, ts)


def load_audit(spark: SparkSession, path: str, station: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if station is None else df.filter(F.col(KEY) == station)


def upsert(df: DataFrame, path: str, version: int) -> None:
    """New versions are appended; ``current`` shows the last one of each key."""
    df.withColumn("version", F.lit(version)).write.mode("append").parquet(path)


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    return keep_latest_version(spark.read.parquet(path), key, "version")


def write_labelled(observations: DataFrame, labels: DataFrame, folder: str) -> None:
    """Perturbed rows and their labels in separate tables, so labels never reach features."""
    append_by_day(observations, f"{folder}/observations")
    labels.write.mode("overwrite").parquet(f"{folder}/labels")


def prune_into(spark: SparkSession, path: str, target: str, days: int, now: str, ts: str = TS, protected: str | None = None) -> DataFrame:
    """Writes the retained rows to a new folder and returns how many went and stayed."""
    df = spark.read.parquet(path)
    keep = retained(df, days, F.lit(now).cast("timestamp"), ts, None if protected is None else F.expr(protected))
    keep.write.mode("errorifexists").partitionBy(*[c for c in (DAY,) if c in df.columns]).parquet(target)
    before = df.agg(F.count(F.lit(1)).alias("before"))
    after = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("kept"))
    return before.join(F.broadcast(after), F.lit(True)).select((F.col("before") - F.col("kept")).alias("pruned"), "kept")  # one row each
