"""Structured Streaming forms: arrival order, decisions and change rows per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.operators.chunks import CHUNK, scan, with_chunk
from meteoqc.operators.decision import EVIDENCE, READ, Rules, anomaly_events, decisions
from meteoqc.operators.spatial import neighbour_edges, stations
from meteoqc.operators.staging import new_folder  # noqa: F401  (for the plans)
from meteoqc.schema import KEY, RH, SLP, TEMP, TS
from meteoqc.sources.sinks import read_or_none, write_once_per_epoch
from meteoqc.sources.tables import as_observations

LATE_SECONDS = 7200


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.readStream.schema(spark.read.option("pathGlobFilter", pattern).parquet(folder).schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def observation_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    return as_observations(event_stream(spark, folder, pattern, files_per_trigger))


def run_available(df: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes everything there is, then stops; a restart continues from the checkpoint."""
    (df.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, epoch: write_once_per_epoch(batch, path, epoch)


@dataclass(frozen=True)
class Folders:
    """Tables of one streaming job, all keyed by epoch."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return f"{self.root}/{name}"


def earlier(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """What earlier epochs wrote; a repeated epoch does not see its own output."""
    df = read_or_none(spark, path)
    return None if df is None else df.filter(F.col("epoch") < epoch).drop("epoch")


def track_arrival(folders: Folders, arrival: str = "ingestion_ts", tie: str = "event_id") -> Callable[[DataFrame, int], None]:
    """Status of every reading in arrival order, from the stored high-water mark per station.

    Writes ``status`` (all rows), ``late`` (older than the watermark) and ``marks`` (one row per
    station and epoch).
    """
    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = earlier(spark, folders.marks, epoch)
        rows = batch.select(tie, KEY, TS, "source", arrival)
        ranked = scan(with_chunk(rows, arrival), {"in_batch": ("max", F.col(TS))}, order=[arrival, tie], exclusive=True).drop(CHUNK)
        if marks is None:
            ranked = ranked.withColumn("stored", F.lit(None).cast("timestamp"))
        else:
            ranked = ranked.join(marks.groupBy(KEY).agg(F.max("mark").alias("stored")), KEY, "left")
        high = F.greatest("in_batch", "stored")
        future = F.unix_micros(TS) > F.unix_micros(arrival) + 300_000_000
        status = F.when(future, "FUTURE_REJECTED").when(F.col(TS) < high, "OUT_OF_ORDER").otherwise("PROCESSED")
        out = ranked.withColumns({
            "high_water_ts": high, "status": status,
            "is_late": F.coalesce(F.unix_micros(TS) < F.unix_micros("stored") - LATE_SECONDS * 1_000_000, F.lit(False))}).drop("in_batch", "stored")
        write_once_per_epoch(out, folders.status, epoch)
        write_once_per_epoch(out.filter("is_late"), folders.late, epoch)
        write_once_per_epoch(rows.groupBy(KEY).agg(F.max(TS).alias("mark")), folders.marks, epoch)

    return each


def last_epoch(df: DataFrame | None) -> DataFrame | None:
    """Rows of the newest epoch of a table that is rewritten in every epoch."""
    newest = None if df is None else df.agg(F.max("epoch")).first()[0]
    return None if newest is None else df.filter(F.col("epoch") == newest).drop("epoch")


def tails_of(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """What later readings of a station can depend on, however long it is silent: its last two readings and its unchanged run."""
    last = decided.groupBy(KEY).agg(F.max(TS).alias("last_ts"), F.max_by("temporal.flatline_duration_minutes", TS).alias("held"))
    second = rows.select(KEY, TS).join(last.select(KEY, "last_ts"), KEY).filter(F.col(TS) < F.col("last_ts")).groupBy(KEY).agg(F.max(TS).alias("second_ts"))
    run = F.timestamp_micros((F.unix_micros("last_ts") - (F.coalesce("held", F.lit(0.0)) * 60_000_000 + 1_000_000).cast("long")))
    start = last.join(second, KEY, "left").select(KEY, F.least("second_ts", run).alias("start_ts"))
    return rows.join(start, KEY).filter(F.col(TS) >= F.col("start_ts")).drop("start_ts")


def context_of(fresh: DataFrame, past: DataFrame, tails: DataFrame, window_hours: int) -> DataFrame:
    """Stored readings that the decisions of ``fresh`` need.

    All readings of the last ``window_hours`` before the batch (no feature looks back further by
    time), and of every station its tail, which holds what features look back to by row: the
    previous reading, the last one of each neighbour, the whole unchanged run. A station with late
    readings from before its tail gives its whole history.
    """
    first = fresh.agg(F.min(F.unix_micros(TS))).first()[0]
    if first is None:
        return past.limit(0)
    start = F.timestamp_micros(F.lit(first - window_hours * 3_600_000_000))
    behind = fresh.groupBy(KEY).agg(F.min(TS).alias("first_ts")).join(tails.groupBy(KEY).agg(F.min(TS).alias("kept_ts")), KEY)
    behind = behind.filter(F.col("first_ts") < F.col("kept_ts")).select(KEY)
    older = tails.filter(F.col(TS) < start).join(behind, KEY, "left_anti")
    whole = past.filter(F.col(TS) < start).join(behind, KEY, "left_semi")
    return past.filter(F.col(TS) >= start).unionByName(older).unionByName(whole)


def decide_batches(folders: Folders, rules: Rules = Rules(), window_hours: int = 48) -> Callable[[DataFrame, int], None]:
    """Runs the batch operators on the micro-batch together with the stored readings it depends on.

    Writes ``readings``, ``places``, ``tails``, ``decisions``, ``events_out`` (typed change rows) and ``batch_metrics``.
    Decisions hold the reading's id, values and evidence; what else is known of it stands in ``readings`` and ``places``.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        past = earlier(spark, folders.readings, epoch)
        stored_tails = read_or_none(spark, folders.tails)
        tails = last_epoch(None if stored_tails is None else stored_tails.filter(F.col("epoch") < epoch))
        write_once_per_epoch(batch, folders.readings, epoch)
        fresh = spark.read.parquet(f"{folders.readings}/epoch={epoch}")
        together = fresh if past is None or tails is None else fresh.unionByName(context_of(fresh, past, tails, window_hours))
        known = earlier(spark, folders.places, epoch)
        seen = stations(fresh)
        if known is not None:
            seen = known.unionByName(seen.join(known, KEY, "left_anti"))
        # the network is kept as one row per station and epoch of first sight, not re-read from the readings
        new = seen if known is None else seen.join(known, KEY, "left_anti")
        write_once_per_epoch(new, folders.places, epoch)
        network = spark.read.parquet(folders.places).drop("epoch").dropDuplicates([KEY])
        decided = decisions(together.select("event_id", *READ), neighbour_edges(network), rules).select(
            "event_id", KEY, TS, TEMP, RH, SLP, *EVIDENCE, "gate", "decision", "severity", "reason_codes", "recommended_action")
        if together is fresh and fresh.filter(F.col("event_id").isNull()).isEmpty():  # nothing but the batch was decided
            write_once_per_epoch(decided, folders.decisions, epoch)
            done = decided = spark.read.parquet(f"{folders.decisions}/epoch={epoch}")
        else:
            write_once_per_epoch(decided, folders.decided_context, epoch)
            decided = spark.read.parquet(f"{folders.decided_context}/epoch={epoch}")
            write_once_per_epoch(decided.join(fresh.select("event_id"), "event_id", "left_semi"), folders.decisions, epoch)
            done = spark.read.parquet(f"{folders.decisions}/epoch={epoch}")
        if tails is not None:  # stations without readings in this context keep their tail
            together = together.unionByName(tails.join(together.select(KEY).distinct(), KEY, "left_anti"))
        write_once_per_epoch(tails_of(together, decided), folders.tails, epoch)
        write_once_per_epoch(change_events(done), folders.events_out, epoch)
        metrics = fresh.agg(F.lit(epoch).alias("batch"), F.count(F.lit(1)).alias("rows"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"),
                            F.approx_count_distinct(KEY).alias("stations"))
        write_once_per_epoch(metrics, folders.batch_metrics, epoch)

    return each


def change_events(decided: DataFrame) -> DataFrame:
    """Typed change rows: every reading, and every anomaly, in one table."""
    seen = decided.select(F.lit("OBSERVATION_UPDATE").alias("event_type"), KEY, TS, F.to_json(F.struct(TEMP, "decision")).alias("payload"))
    anomalies = anomaly_events(decided).select(
        F.lit("ANOMALY_DETECTED").alias("event_type"), KEY, TS, F.to_json(F.struct("event_id", "severity", "reason_codes")).alias("payload"))
    return seen.unionByName(anomalies)
