"""Metrics of micro-batches, counted while the rows pass, without another read of them."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from meteoqc.schema import KEY, TEMP, TS

NAME = "batch"
SCHEMA = "batch long, rows long, missing long, first_ts timestamp, last_ts timestamp, stations long"


def observed(stream: DataFrame) -> DataFrame:
    """``stream`` with the metrics attached to whatever reads it."""
    return stream.observe(NAME, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(TEMP).isNull()).alias("missing"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"),
                          F.approx_count_distinct(KEY).alias("stations"))


class BatchMetrics(StreamingQueryListener):
    """Hands one row per finished micro-batch to ``sink`` and tells when the query has ended."""

    def __init__(self, sink: Callable[[tuple], None]):
        self.sink, self.ended = sink, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None and row["rows"]:
            self.sink((event.progress.batchId, *row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def run_with_metrics(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 60.0) -> list[tuple]:
    """Processes everything there is and returns one row of metrics (``SCHEMA``) for each micro-batch."""
    spark, rows = stream.sparkSession, []
    listener = BatchMetrics(rows.append)
    spark.streams.addListener(listener)
    try:
        query = observed(stream).writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        listener.ended.wait(seconds)  # events come on a thread of their own
    finally:
        spark.streams.removeListener(listener)
    return rows
