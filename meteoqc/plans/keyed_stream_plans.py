"""Streams over several micro-batches, with a restart before each, late rows and repetitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.operators import source_health as sh
from meteoqc.plans.common import oracle, publish
from meteoqc.plans.source_plans import POLLS, polls
from meteoqc.schema import KEY, TS
from meteoqc.sources.tables import events, observations
from meteoqc.streaming import keyed, late, metrics
from meteoqc.streaming import stream as st

PARTS = 3


def part_of(ts):
    day = F.dayofmonth(ts)
    return F.when(day < 10, 0).when(day < 20, 1).otherwise(2)


def deliveries(spark, sf_dir):
    """Events with the number of the micro-batch that brings them: every 53rd comes one batch late, every 31st once more."""
    ev = events(spark, sf_dir)
    own = ev.withColumn("part", F.least(F.lit(PARTS - 1), part_of("ts") + (F.col("event_id") % 53 == 0).cast("int")))
    again = own.filter(F.col("event_id") % 31 == 0).withColumn("part", F.least(F.lit(PARTS - 1), F.col("part") + 1))
    return own.unionByName(again)


def in_batches(folders, table, each):
    """Appends one part after the other to a feed and runs ``each`` (which starts a query from its checkpoint) after every one."""
    feed = f"{folders.root}-feed"
    for part in range(PARTS):
        table.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(feed)
        each(feed)


def windows_kept(spark, sf_dir):
    f = st.Folders(st.new_folder(spark, "late"))
    step = late.keep_windows(f)
    in_batches(f, deliveries(spark, sf_dir), lambda feed: st.run_available(st.observation_stream(spark, feed, "*.parquet"), step, f"{f.root}-checkpoint"))
    return f


def windows(spark, sf_dir):
    """Every window over all readings, those that came late or twice too."""
    f = windows_kept(spark, sf_dir)
    return publish(late.current_windows(spark, f))


def unique(spark, sf_dir):
    f = windows_kept(spark, sf_dir)
    return publish(spark.read.parquet(f.unique).select(KEY, TS, "source"))


def late_rows(spark, sf_dir):
    f = windows_kept(spark, sf_dir)
    return publish(spark.read.parquet(f.late).select("epoch", "event_id", KEY, TS))


def corrections(spark, sf_dir):
    f = windows_kept(spark, sf_dir)
    return publish(spark.read.parquet(f.corrections).select("epoch", KEY, "window_start", "late_readings", "readings_before", "readings_after"))


def repeats(spark, sf_dir):
    f = st.Folders(st.new_folder(spark, "repeats"))

    def run(feed):
        with keyed.with_state_store(spark):
            st.run_available(keyed.mark_repeats(st.observation_stream(spark, feed, "*.parquet")), st.to_table(f.marked), f"{f.root}-checkpoint")

    in_batches(f, deliveries(spark, sf_dir), run)
    return publish(spark.read.parquet(f.marked).select("event_id", KEY, TS, "is_repeat"))


def memory(spark, sf_dir):
    """Readings come in order of arrival; each station remembers its newest time and its last twelve readings."""
    f = st.Folders(st.new_folder(spark, "memory"))
    arrived = events(spark, sf_dir).withColumn("part", part_of(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 97) * 7_000_000)))

    def run(feed):
        with keyed.with_state_store(spark):
            st.run_available(keyed.remember_stations(st.observation_stream(spark, feed, "*.parquet")), st.to_table(f.status), f"{f.root}-checkpoint")

    in_batches(f, arrived, run)
    return publish(spark.read.parquet(f.status).drop("epoch"))


def silences(spark, sf_dir):
    """Gaps of more than six hours between readings of a station (silences that still last are in the job's output as SILENT)."""
    f = st.Folders(st.new_folder(spark, "silences"))

    def run(feed):
        with keyed.with_state_store(spark):
            st.run_available(keyed.watch_silences(st.observation_stream(spark, feed, "*.parquet")), st.to_table(f.found), f"{f.root}-checkpoint")

    in_batches(f, events(spark, sf_dir).withColumn("part", part_of("ts")), run)
    return publish(spark.read.parquet(f.found).filter(F.col("kind") == "GAP").select(KEY, "since_ts", "until_ts", "minutes"))


def tracked_sources(spark, sf_dir):
    f = st.Folders(st.new_folder(spark, "sources"))
    log = polls(observations(spark, sf_dir)).withColumn("part", part_of("poll_ts"))

    def run(feed):
        stream = spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
        with keyed.with_state_store(spark):
            st.run_available(keyed.track_sources(stream), st.to_table(f.states), f"{f.root}-checkpoint")

    in_batches(f, log, run)
    return f


def source_states(spark, sf_dir):
    f = tracked_sources(spark, sf_dir)
    return publish(spark.read.parquet(f.states).select("source", "poll_ts", "consecutive_failures", "consecutive_successes", "from_state", "state", "trigger", "is_late"))


def outage_sessions(spark, sf_dir):
    """Outages from the stream of source states; a clock two days ahead closes the last of them."""
    f = tracked_sources(spark, sf_dir)
    states = spark.read.parquet(f.states).select("source", "poll_ts", "state", "trigger", F.col("epoch").alias("part"))
    clock = states.agg(F.lit("clock").alias("source"), F.timestamp_micros(F.max(F.unix_micros("poll_ts")) + 2 * 86_400_000_000).alias("poll_ts"),
                       F.lit("DEGRADED").alias("state"), F.lit("NONE").alias("trigger"), F.lit(PARTS - 1).alias("part"))
    g = st.Folders(st.new_folder(spark, "sessions"))

    def run(feed):
        stream = spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
        st.run_available(sh.outage_sessions(stream), st.to_table(g.sessions), f"{g.root}-checkpoint")

    in_batches(g, states.unionByName(clock), run)
    return publish(spark.read.parquet(g.sessions).filter(F.col("source") != "clock").drop("epoch"))


def batch_metrics(spark, sf_dir):
    f = st.Folders(st.new_folder(spark, "metrics"))
    rows = []

    def run(feed):
        rows.extend(metrics.run_with_metrics(st.observation_stream(spark, feed, "*.parquet"), st.to_table(f.readings), f"{f.root}-checkpoint"))

    in_batches(f, deliveries(spark, sf_dir), run)
    return publish(spark.createDataFrame(rows, metrics.SCHEMA))  # one row for each micro-batch


QUERIES = {
    "stream_half_hour_windows": windows,
    "stream_duplicate_suppression": unique,
    "stream_late_readings": late_rows,
    "stream_window_corrections": corrections,
    "stream_keyed_repeats": repeats,
    "stream_station_memory": memory,
    "stream_station_silences": silences,
    "stream_source_states": source_states,
    "stream_outage_sessions": outage_sessions,
    "stream_batch_metrics": batch_metrics,
}

PART = "CASE WHEN day({0}) < 10 THEN 0 WHEN day({0}) < 20 THEN 1 ELSE 2 END"
FEED = f"""
feed AS (SELECT *, least(2, {PART.format('obs_ts')} + (event_id % 53 = 0)::INT) AS part FROM observations),
again AS (SELECT * REPLACE (least(2, part + 1) AS part) FROM feed WHERE event_id % 31 = 0),
marks AS (SELECT p.part, (SELECT max(obs_ts) FROM feed f WHERE f.part < p.part) AS mark FROM (VALUES (0), (1), (2)) p(part)),
late AS (SELECT f.* FROM feed f JOIN marks USING (part) WHERE obs_ts < mark - INTERVAL 2 HOUR)"""
BUCKET = "time_bucket(INTERVAL '30 minutes', obs_ts)"
ORACLES = {
    "stream_half_hour_windows": oracle(
        f"""SELECT station_id, {BUCKET} AS window_start, count(*) AS readings, avg(temperature_c) AS mean_temp, min(temperature_c) AS min_temp, max(temperature_c) AS max_temp
        FROM observations GROUP BY 1, 2""", doubles=["mean_temp"]),
    "stream_duplicate_suppression": oracle("SELECT station_id, obs_ts, source FROM observations"),
    "stream_late_readings": oracle("SELECT part AS epoch, event_id, station_id, obs_ts FROM late", FEED, ints=["epoch"]),
    "stream_window_corrections": oracle(
        f"""SELECT l.part AS epoch, l.station_id, w AS window_start, late_readings, count(CASE WHEN f.part < l.part THEN 1 END) AS readings_before, count(*) AS readings_after
        FROM (SELECT part, station_id, {BUCKET} AS w, count(*) AS late_readings FROM late GROUP BY ALL) l JOIN feed f ON f.station_id = l.station_id AND {BUCKET.replace('obs_ts', 'f.obs_ts')} = w AND f.part <= l.part GROUP BY ALL""",
        FEED, ints=["epoch"]),
    "stream_keyed_repeats": oracle("SELECT event_id, station_id, obs_ts, FALSE AS is_repeat FROM feed UNION ALL SELECT event_id, station_id, obs_ts, TRUE FROM again", FEED),
    "stream_station_memory": oracle(
        """SELECT event_id, station_id, obs_ts, hw AS high_water_ts, CASE WHEN obs_ts < hw THEN 'OUT_OF_ORDER' ELSE 'PROCESSED' END AS status, earlier_readings, earlier_mean FROM
        (SELECT *, max(obs_ts) OVER w AS hw, count(*) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS earlier_readings, avg(temperature_c) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS earlier_mean
        FROM observations WINDOW w AS (PARTITION BY station_id ORDER BY ingestion_ts, event_id))""".replace(
            "max(obs_ts) OVER w", "max(obs_ts) OVER (PARTITION BY station_id ORDER BY ingestion_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), doubles=["earlier_mean"]),
    "stream_station_silences": oracle(
        """SELECT station_id, prev AS since_ts, obs_ts AS until_ts, (epoch_us(obs_ts) - epoch_us(prev)) / 60000000.0::DOUBLE AS minutes FROM
        (SELECT station_id, obs_ts, lag(obs_ts) OVER (PARTITION BY station_id ORDER BY obs_ts) AS prev FROM observations) WHERE epoch_us(obs_ts) - epoch_us(prev) > 21600000000""", doubles=["minutes"]),
    "stream_source_states": oracle(
        """SELECT source, poll_ts, cf AS consecutive_failures, cs AS consecutive_successes, coalesce(lag(state) OVER (PARTITION BY source ORDER BY poll_ts), 'HEALTHY') AS from_state, state, trigger, FALSE AS is_late FROM st""",
        POLLS, ints=["consecutive_failures", "consecutive_successes"]),
    "stream_outage_sessions": oracle(
        """SELECT source, min(poll_ts) AS started_at, max(poll_ts) AS last_ts, max(poll_ts) + INTERVAL 90 MINUTE AS closed_at, count(*) AS cycles, arg_min(state, poll_ts) AS initial_state, arg_max(state, poll_ts) AS last_state,
        coalesce(string_agg(DISTINCT CASE WHEN trigger <> 'NONE' THEN trigger END, ',' ORDER BY CASE WHEN trigger <> 'NONE' THEN trigger END), '') AS categories FROM
        (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 5400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY poll_ts) AS g FROM
        (SELECT *, epoch_us(poll_ts) - lag(epoch_us(poll_ts)) OVER (PARTITION BY source ORDER BY poll_ts) AS gap FROM st WHERE state <> 'HEALTHY')) GROUP BY source, g""", POLLS),
    "stream_batch_metrics": oracle(
        """SELECT part AS batch, count(*) AS rows, count(*) - count(temperature_c) AS missing, min(obs_ts) AS first_ts, max(obs_ts) AS last_ts, count(DISTINCT station_id) AS stations
        FROM (FROM feed UNION ALL FROM again) GROUP BY 1""", FEED, ints=["batch"]),
}
