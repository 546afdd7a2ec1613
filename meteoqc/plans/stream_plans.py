"""Streaming queries run to the end of their input, then read back from their sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.plans.common import oracle, publish
from meteoqc.plans.decision_plans import DECIDED, RULES
from meteoqc.schema import KEY, TS
from meteoqc.streaming import stream as st

ID = [KEY, TS]


def arrival(spark, sf_dir):
    f = st.Folders(st.new_folder(spark, "arrival"))
    st.run_available(st.observation_stream(spark, sf_dir), st.track_arrival(f), f"{f.root}-checkpoint")
    return publish(spark.read.parquet(f.status).select("event_id", *ID, "high_water_ts", "status", "is_late"))


def _decided(spark, sf_dir):
    f = st.Folders(st.new_folder(spark, "decisions"))
    st.run_available(st.observation_stream(spark, sf_dir), st.decide_batches(f, RULES), f"{f.root}-checkpoint")
    return f


def decided(spark, sf_dir):
    f = _decided(spark, sf_dir)
    return publish(spark.read.parquet(f.decisions).select(*ID, "decision", "severity", F.array_join("reason_codes", ",").alias("reasons")))


def changes(spark, sf_dir):
    f = _decided(spark, sf_dir)
    return publish(spark.read.parquet(f.events_out).groupBy("event_type", KEY).agg(F.count(F.lit(1)).alias("n"), F.max(TS).alias("last_ts")))


def decide_in_parts(spark, sf_dir, parts):
    """A query started from its checkpoint for each part of the events."""
    f = st.Folders(st.new_folder(spark, "batches"))
    feed, events = f"{f.root}-feed", spark.read.parquet(f"{sf_dir}/events.parquet")
    step = st.decide_batches(f, RULES)
    for part in parts:
        events.filter(part).write.mode("append").parquet(feed)
        st.run_available(st.observation_stream(spark, feed, "*.parquet"), step, f"{f.root}-checkpoint")
    return publish(spark.read.parquet(f.decisions).select(*ID, "epoch", "decision", "severity", F.array_join("reason_codes", ",").alias("reasons")))


def decided_over_batches(spark, sf_dir):
    """All readings in three micro-batches in order of time; every row as in one batch."""
    day = F.dayofmonth("ts")
    return decide_in_parts(spark, sf_dir, (day < 5, (day >= 5) & (day < 16), day >= 16))


QUERIES = {
    "stream_decisions_over_batches": decided_over_batches,
    "stream_arrival_status": arrival,
    "stream_decisions": decided,
    "stream_change_events": changes,
}

EPOCH = "CAST(CASE WHEN day(obs_ts) < 5 THEN 0 WHEN day(obs_ts) < 16 THEN 1 ELSE 2 END AS BIGINT) AS epoch"
ORACLES = {
    "stream_decisions_over_batches": oracle(f"SELECT station_id, obs_ts, {EPOCH}, decision, severity, reasons FROM decided", *DECIDED),
    "stream_arrival_status": oracle(
        """SELECT event_id, station_id, obs_ts, hw AS high_water_ts, CASE WHEN obs_ts < hw THEN 'OUT_OF_ORDER' ELSE 'PROCESSED' END AS status, FALSE AS is_late FROM
        (SELECT *, max(obs_ts) OVER (PARTITION BY station_id ORDER BY ingestion_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw FROM observations)"""),
    "stream_decisions": oracle("SELECT station_id, obs_ts, decision, severity, reasons FROM decided", *DECIDED),
    "stream_change_events": oracle(
        """SELECT event_type, station_id, count(*) AS n, max(obs_ts) AS last_ts FROM (SELECT 'OBSERVATION_UPDATE' AS event_type, station_id, obs_ts FROM decided
        UNION ALL SELECT 'ANOMALY_DETECTED', station_id, obs_ts FROM event_rows) GROUP BY 1, 2""", *DECIDED),
}
