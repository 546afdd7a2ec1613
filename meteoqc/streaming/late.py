"""Windows and unique readings that stay right when rows are late or come twice.

A watermark bounds the state of a windowed aggregate by dropping what is behind it. Here the state is
stored instead, by day: keys of readings, and sums of windows. A micro-batch reads only the days that
its own rows fall on, so old days cost nothing until a late row arrives for them, and then only their
own. Rows behind the watermark go to a table of their own, and every window that they change is
written again with what it said before.

Tables (all written once per epoch): ``unique`` and ``repeats`` (readings), ``late`` (readings behind
the watermark when they came), ``windows`` (versions of sums; ``current_windows`` reads the last one of
each), ``corrections`` (windows that late rows changed) and ``marks`` (newest time so far).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meteoqc.operators.lookups import latest_per_key
from meteoqc.schema import KEY, TEMP, TS
from meteoqc.sources.sinks import DAY, read_or_none, write_once_per_epoch
from meteoqc.streaming.stream import LATE_SECONDS, Folders, earlier

IDENTITY = (KEY, TS, "source")


def write_days(df: DataFrame, path: str, epoch: int) -> None:
    """One folder per epoch, parted by day within; a repeated epoch overwrites its own."""
    df.write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/epoch={epoch}")


def stored_days(spark: SparkSession, path: str, epoch: int, days: DataFrame, schema: StructType) -> DataFrame:
    """What earlier epochs stored for the days of ``days`` (a few literals, so that other days are pruned)."""
    wanted = [r[DAY] for r in days.select(DAY).distinct().collect()]  # days of one micro-batch
    df = read_or_none(spark, path, StructType([*schema.fields, StructField("epoch", LongType())]))
    empty = spark.createDataFrame([], StructType([*schema.fields, StructField("epoch", LongType())]))
    return empty if df is None else df.filter((F.col("epoch") < epoch) & F.col(DAY).isin(wanted))


def window_sums(rows: DataFrame, minutes: int) -> DataFrame:
    """Sums per station and window, of which any two can be merged."""
    start = F.window(TS, f"{minutes} minutes")["start"]
    return rows.groupBy(KEY, start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("readings"), F.count(TEMP).alias("values"), F.sum(TEMP).alias("total"), F.min(TEMP).alias("min_temp"), F.max(TEMP).alias("max_temp"))


def merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy(KEY, "window_start").agg(
        F.sum("readings").alias("readings"), F.sum("values").alias("values"), F.sum("total").alias("total"), F.min("min_temp").alias("min_temp"), F.max("max_temp").alias("max_temp"))


def keep_windows(folders: Folders, minutes: int = 30, late_seconds: int = LATE_SECONDS, identity: Sequence[str] = IDENTITY,
                 order: Sequence[str] = ("ingestion_ts", "event_id")) -> Callable[[DataFrame, int], None]:
    """The step of one micro-batch: repeats out, late rows aside, windows merged with what is stored."""
    key = list(identity)

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession

        def written(df: DataFrame, path: str) -> DataFrame:
            write_days(df, path, epoch)
            return spark.read.schema(df.schema).parquet(f"{path}/epoch={epoch}")

        rows = written(batch.withColumns({DAY: F.to_date(TS), "place": F.monotonically_increasing_id()}), folders.arrived)  # read several times
        rest = [c for c in rows.columns if c not in key]
        first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
        stored = stored_days(spark, folders.unique, epoch, rows, first.schema)
        new = written(first.join(stored.select(*key), key, "left_anti"), folders.unique)
        write_once_per_epoch(rows.join(new.select("place"), "place", "left_anti").drop("place"), folders.repeats, epoch)

        marks = earlier(spark, folders.marks, epoch)
        mark = None if marks is None else marks.agg(F.max("mark")).first()[0]
        behind = F.lit(False) if mark is None else F.unix_micros(TS) < F.unix_micros(F.lit(mark)) - late_seconds * 1_000_000
        late = new.filter(behind).drop("place")
        write_once_per_epoch(late, folders.late, epoch)
        write_once_per_epoch(rows.agg(F.max(TS).alias("mark")), folders.marks, epoch)

        sums = window_sums(new, minutes).withColumn(DAY, F.to_date("window_start"))
        before = latest_per_key(stored_days(spark, folders.windows, epoch, sums, sums.schema), [KEY, "window_start"], "epoch").drop("epoch", DAY)
        old = before.join(sums.select(KEY, "window_start"), [KEY, "window_start"], "left_semi")
        now = written(merged(sums.drop(DAY).unionByName(old)).withColumn(DAY, F.to_date("window_start")), folders.windows)
        changed = window_sums(late, minutes).select(KEY, "window_start", F.col("readings").alias("late_readings"))
        now, was = (df.select(KEY, "window_start", F.col("readings").alias(n)) for df, n in ((now, "readings_after"), (old, "readings_before")))
        write_once_per_epoch(changed.join(now, [KEY, "window_start"]).join(was, [KEY, "window_start"], "left").fillna(0, ["readings_before"]), folders.corrections, epoch)

    return each


def current_windows(spark: SparkSession, folders: Folders) -> DataFrame:
    """Every window with all readings that have come so far."""
    last = latest_per_key(spark.read.parquet(folders.windows), [KEY, "window_start"], "epoch")
    return last.select(KEY, "window_start", "readings", F.when(F.col("values") > 0, F.col("total") / F.col("values")).alias("mean_temp"), "min_temp", "max_temp")
