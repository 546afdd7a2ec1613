"""Source health over a poll log derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.functions.text import error_category
from meteoqc.operators import source_health as sh
from meteoqc.operators.staging import staged
from meteoqc.plans.common import oracle, publish
from meteoqc.plans.ingest_plans import MESSAGES
from meteoqc.schema import KEY, TS
from meteoqc.sources.tables import observations


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def polls(obs):
    """One poll cycle per feed and hour: stations asked, failed, stale; the first event decides success."""
    feed = F.concat(F.lit("feed_"), (F.substring(KEY, 2, 2).cast("int") % 3).cast("string"))
    rows = obs.select(feed.alias("source"), F.date_trunc("hour", TS).alias("poll_ts"), KEY, TS, "event_id", "event_type", "value")
    per = rows.groupBy("source", "poll_ts", KEY).agg(
        F.max((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0)).alias("failed"), F.max(F.col("value") > 120).alias("stale"),
        F.min(F.struct(TS, "event_id", "event_type")).alias("first"), F.sum("value").alias("ms"))
    cyc = per.groupBy("source", "poll_ts").agg(
        F.count(F.lit(1)).alias("stations_total"), F.count(F.when(F.col("failed"), 1)).alias("stations_failed"),
        F.count(F.when(F.col("stale") & ~F.col("failed"), 1)).alias("stations_stale"), F.min("first").alias("f"), F.sum("ms").alias("latency_ms"),
        F.collect_set(KEY).alias("affected"))  # stations of one feed polled in one hour
    msg = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("f.event_id") % 7 + 1).cast("int"))
    ok = F.col("f.event_type") != "error"
    return cyc.withColumns({"ok": ok, "category": F.when(~ok, error_category(msg)).otherwise("NONE")}).drop("f")


def states(obs):
    return sh.source_states(polls(obs)).select("source", "poll_ts", "consecutive_failures", "consecutive_successes", "state", "trigger")


def changes(obs):
    return sh.transitions(staged(sh.source_states(polls(obs))))


def outage_rows(obs):
    return sh.outages(staged(sh.source_states(polls(obs))))


def live(obs):
    p = obs.select(KEY, F.col("ingestion_ts").alias("poll_ts"), TS, (F.col("event_type") != "error").alias("ok"))
    return sh.station_live_status(p)


QUERIES = {
    "source_states": _q(states),
    "source_transitions": _q(changes),
    "outage_episodes": _q(outage_rows),
    "source_reachability": _q(lambda o: sh.reachability(polls(o))),
    "station_live_status": _q(live),
}

CATS = "['HTTP_429','HTTP_401','TIMEOUT','HTTP_5XX','PARSE_ERROR','SCHEMA_VIOLATION','NETWORK_ERROR']"
POLLS = f"""
per AS (SELECT 'feed_' || CAST(CAST(substr(station_id, 2, 2) AS INT) % 3 AS VARCHAR) AS source, date_trunc('hour', obs_ts) AS poll_ts, station_id, bool_or(event_type = 'error' AND event_id % 4 = 0) AS failed, bool_or(value > 120) AS stale,
  min(obs_ts) AS first_ts, arg_min(event_id, obs_ts) AS fid, arg_min(event_type, obs_ts) AS ft, sum(value) AS ms FROM observations GROUP BY ALL),
polls AS (SELECT source, poll_ts, count(*) AS n, count(CASE WHEN failed THEN 1 END) AS nf, count(CASE WHEN stale AND NOT failed THEN 1 END) AS ns, arg_min(fid, first_ts) AS fid, arg_min(ft, first_ts) <> 'error' AS ok,
  sum(ms) AS latency_ms, list(station_id) AS affected FROM per GROUP BY ALL),
cats AS (SELECT *, CASE WHEN ok THEN 'NONE' ELSE {CATS}[fid % 7 + 1] END AS category FROM polls),
pg AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS gf, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS gs, row_number() OVER w AS seq FROM cats WINDOW w AS (PARTITION BY source ORDER BY poll_ts)),
pc AS (SELECT *, CASE WHEN ok THEN 0 ELSE sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY source, gf ORDER BY poll_ts) END AS cf, CASE WHEN ok THEN sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source, gs ORDER BY poll_ts) ELSE 0 END AS cs FROM pg),
st AS (SELECT *, CASE WHEN NOT ok THEN CASE category WHEN 'HTTP_401' THEN 'AUTH_ERROR' WHEN 'HTTP_429' THEN 'RATE_LIMITED' ELSE CASE WHEN cf >= 3 THEN 'DISCONNECTED' ELSE 'DEGRADED' END END
  WHEN nf > 0 THEN 'DEGRADED' WHEN ns = n THEN 'STALE' WHEN ns > 0 THEN 'DEGRADED' WHEN cs >= 2 OR seq = 1 THEN 'HEALTHY' ELSE 'DEGRADED' END AS state,
  CASE WHEN NOT ok THEN category WHEN nf = n THEN 'SCHEMA_VIOLATION' WHEN nf > 0 THEN 'NETWORK_ERROR' ELSE 'NONE' END AS trigger FROM pc)"""
OUT = """
og AS (SELECT *, sum(CASE WHEN state = 'HEALTHY' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY poll_ts) AS g FROM st),
ob AS (SELECT source, g, min(poll_ts) AS started_at, max(poll_ts) AS last_ts, max(seq) AS last_seq, count(*) AS cycles, arg_min(state, poll_ts) AS initial_state, arg_max(state, poll_ts) AS cur,
  coalesce(string_agg(DISTINCT CASE WHEN trigger <> 'NONE' THEN trigger END, ',' ORDER BY CASE WHEN trigger <> 'NONE' THEN trigger END), '') AS categories FROM og WHERE state <> 'HEALTHY' GROUP BY ALL),
oa AS (SELECT source, g, count(DISTINCT s) AS affected_stations FROM (SELECT source, g, unnest(affected) AS s FROM og WHERE state <> 'HEALTHY') GROUP BY ALL),
oe AS (SELECT o.*, a.affected_stations, (SELECT poll_ts FROM og x WHERE x.source = o.source AND x.seq = o.last_seq + 1 AND x.state = 'HEALTHY') AS resolved_at FROM ob o JOIN oa a USING (source, g)),
od AS (SELECT *, (epoch_us(coalesce(resolved_at, last_ts)) - epoch_us(started_at)) / 1000000.0::DOUBLE AS duration_seconds FROM oe)"""

ORACLES = {
    "source_states": oracle("SELECT source, poll_ts, cf AS consecutive_failures, cs AS consecutive_successes, state, trigger FROM st", POLLS, ints=["consecutive_failures", "consecutive_successes"]),
    "source_transitions": oracle(
        """SELECT source, poll_ts, from_state, state AS to_state, trigger, cf AS consecutive_failures, cs AS consecutive_successes FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY source ORDER BY poll_ts), 'HEALTHY') AS from_state FROM st)
        WHERE from_state <> state""", POLLS, ints=["consecutive_failures", "consecutive_successes"]),
    "outage_episodes": oracle(
        """SELECT source, started_at, last_ts, cycles, initial_state, CASE WHEN resolved_at IS NULL THEN cur ELSE 'HEALTHY' END AS current_state, categories, affected_stations, resolved_at, duration_seconds,
        CAST(floor(duration_seconds / 900.0) AS BIGINT) * affected_stations AS loss_estimate, resolved_at IS NULL AS is_ongoing FROM od""", POLLS, OUT),
    "source_reachability": oracle(
        """SELECT source, count(*) AS polls, arg_max(cf, poll_ts) AS consecutive_failures, arg_max(latency_ms, poll_ts) AS last_latency_ms, max(CASE WHEN ok THEN poll_ts END) AS last_success,
        count(CASE WHEN NOT ok AND category = 'PARSE_ERROR' THEN 1 END) AS malformed, max(cf) AS longest_failure_run, arg_max(cf, poll_ts) >= 3 AS is_unreachable FROM st GROUP BY 1""", POLLS,
        doubles=["last_latency_ms"], ints=["consecutive_failures", "longest_failure_run"]),
    "station_live_status": oracle(
        """SELECT station_id, last_poll, consecutive_failures, last_success, age_seconds, CASE WHEN lok THEN CASE WHEN age_seconds > 3600 THEN 'STALE' ELSE 'LIVE' END WHEN consecutive_failures >= 3 THEN 'OFFLINE' ELSE 'STALE' END AS status
        FROM (SELECT station_id, max(ingestion_ts) AS last_poll, arg_max(cf, ingestion_ts) AS consecutive_failures, max(CASE WHEN ok THEN ingestion_ts END) AS last_success,
        arg_max((epoch_us(ingestion_ts) - epoch_us(obs_ts)) / 1000000.0::DOUBLE, ingestion_ts) AS age_seconds, arg_max(ok, ingestion_ts) AS lok FROM
        (SELECT *, CASE WHEN ok THEN 0 ELSE sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY station_id, g ORDER BY ingestion_ts) END AS cf FROM
        (SELECT *, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY ingestion_ts) AS g FROM observations)) GROUP BY 1)""",
        doubles=["age_seconds"], ints=["consecutive_failures"]),
}
