"""Health of data sources from their poll log: states, transitions, outages, station freshness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meteoqc.operators.chunks import CHUNK, FOUR_DAYS, chunk_window, drop_halo, run_positions, scan, with_chunk, with_halo


@dataclass(frozen=True)
class SourceRules:
    """Failures until an outage, successes until recovery, stale age, cadence."""

    outage_failures: int = 3
    recovery_successes: int = 2
    stale_seconds: float = 3600.0
    cadence_seconds: float = 900.0


CATEGORY_STATE = {  # fixed values
    "HTTP_401": "AUTH_ERROR", "HTTP_403": "AUTH_ERROR", "HTTP_429": "RATE_LIMITED", "CONFIG_ERROR": "CONFIG_ERROR",
}


def source_states(polls: DataFrame, rules: SourceRules = SourceRules(), *, key: Sequence[str] = ("source",), ts: str = "poll_ts",
                  seconds: int = FOUR_DAYS) -> DataFrame:
    """State after every poll cycle.

    Input: ok, category, stations_total, stations_failed, stations_stale. The next state depends on
    the cycle and on the lengths of the current failure and success runs only, so no fold in order
    is needed: a fresh cycle after a failure is a warm-up, one after another success is a recovery.
    """
    rows = run_positions(with_chunk(polls, ts, seconds), {"_f": F.col("ok"), "_s": ~F.col("ok")}, key=key, order=[ts], ts=ts)
    rows = rows.withColumns({"consecutive_failures": F.when(~F.col("ok"), F.col("_f_since")).otherwise(0), "consecutive_successes": F.when(F.col("ok"), F.col("_s_since")).otherwise(0)})
    n, failed, stale = F.col("stations_total"), F.col("stations_failed"), F.col("stations_stale")
    special = F.lit(None).cast("string")
    for c, s in CATEGORY_STATE.items():
        special = F.when(F.col("category") == c, s).otherwise(special)
    state = (
        F.when(~F.col("ok"), F.coalesce(special, F.when(F.col("consecutive_failures") >= rules.outage_failures, "DISCONNECTED").otherwise("DEGRADED")))
        .when(n == 0, F.lit(None).cast("string"))
        .when(failed > 0, "DEGRADED")
        .when(stale == n, "STALE")
        .when(stale > 0, "DEGRADED")
        .when((F.col("consecutive_successes") >= rules.recovery_successes) | (F.col("seq") == 1), "HEALTHY")
        .otherwise("DEGRADED"))
    rows = rows.withColumn("_state", state).drop("_f_since", "_f_start", "_s_since", "_s_start")
    # a cycle without stations keeps the state before it
    kept = scan(rows, {"state": ("last", F.col("_state"))}, key=key, order=[ts])
    trigger = F.when(~F.col("ok"), F.col("category")).when((n > 0) & (failed == n), "SCHEMA_VIOLATION").when(failed > 0, "NETWORK_ERROR").otherwise("NONE")
    return kept.withColumns({"state": F.coalesce("state", F.lit("HEALTHY")), "trigger": trigger}).drop("_state", "seq", CHUNK)


def transitions(states: DataFrame, *, key: Sequence[str] = ("source",), ts: str = "poll_ts", seconds: int = FOUR_DAYS) -> DataFrame:
    """Cycles whose state differs from the one before (HEALTHY at the start)."""
    halo = with_halo(states.select(*key, ts, "state", "trigger", "consecutive_failures", "consecutive_successes"), rows=1, key=key, ts=ts, seconds=seconds)
    before = F.coalesce(F.lag("state").over(chunk_window(key, ts)), F.lit("HEALTHY"))
    return drop_halo(halo.withColumn("from_state", before), CHUNK).filter(F.col("from_state") != F.col("state")).withColumnRenamed("state", "to_state")


def outages(states: DataFrame, rules: SourceRules = SourceRules(), *, key: Sequence[str] = ("source",), ts: str = "poll_ts",
            seconds: int = FOUR_DAYS) -> DataFrame:
    """Episodes without a HEALTHY state; the next HEALTHY cycle resolves them.

    ``affected`` (array of stations per cycle) is optional; the loss is whole cycles times stations.
    """
    if "affected" not in states.columns:
        states = states.withColumn("affected", F.array().cast("array<string>"))
    rows = run_positions(with_chunk(states, ts, seconds), {"_h": F.col("state") == "HEALTHY"}, key=key, order=[ts], ts=ts)
    bad = rows.filter(F.col("state") != "HEALTHY")
    group = bad.groupBy(*key, "_h_start")
    main = group.agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_ts"), F.max("seq").alias("_last"), F.count(F.lit(1)).alias("cycles"),
        F.min_by("state", ts).alias("initial_state"), F.max_by("state", ts).alias("current_state"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("trigger") != "NONE", F.col("trigger")))), ",").alias("categories"))  # closed list of categories
    hit = bad.select(*key, "_h_start", F.explode("affected").alias("station")).distinct().groupBy(*key, "_h_start").agg(F.count(F.lit(1)).alias("affected_stations"))
    nxt = rows.filter(F.col("state") == "HEALTHY").select(*key, (F.col("seq") - 1).alias("_last"), F.col(ts).alias("resolved_at"))
    on = [*[F.col(f"m.{k}") == F.col(f"h.{k}") for k in key], F.col("m._h_start").eqNullSafe(F.col("h._h_start"))]
    out = main.alias("m").join(hit.alias("h"), on, "left").select("m.*", F.coalesce("h.affected_stations", F.lit(0)).alias("affected_stations"))
    out = out.join(nxt, [*key, "_last"], "left")
    seconds_ = (F.unix_micros(F.coalesce("resolved_at", "last_ts")) - F.unix_micros("started_at")) / 1_000_000.0
    out = out.withColumn("duration_seconds", seconds_)
    loss = F.floor(F.col("duration_seconds") / rules.cadence_seconds) * F.col("affected_stations")
    return out.withColumns(
        {
            "loss_estimate": F.when(F.col("affected_stations") > 0, loss),
            "is_ongoing": F.col("resolved_at").isNull(),
            "current_state": F.when(F.col("resolved_at").isNotNull(), "HEALTHY").otherwise(F.col("current_state")),
        }
    ).drop("_h_start", "_last")


def station_live_status(polls: DataFrame, rules: SourceRules = SourceRules(), *, seconds: int = FOUR_DAYS) -> DataFrame:
    """Latest status per station from station polls (station_id, poll_ts, obs_ts, ok)."""
    rows = run_positions(with_chunk(polls, "poll_ts", seconds), {"_f": F.col("ok")}, order=["poll_ts"], ts="poll_ts")
    rows = rows.withColumn("failures", F.when(~F.col("ok"), F.col("_f_since")).otherwise(0))
    last = rows.groupBy("station_id").agg(
        F.max_by(F.struct("poll_ts", "obs_ts", "ok", "failures"), "poll_ts").alias("p"),
        F.max(F.when(F.col("ok"), F.col("poll_ts"))).alias("last_success"))
    age = (F.unix_micros("p.poll_ts") - F.unix_micros("p.obs_ts")) / 1_000_000.0
    status = (
        F.when(F.col("p.ok"), F.when(age > rules.stale_seconds, "STALE").otherwise("LIVE"))
        .when(F.col("p.failures") >= rules.outage_failures, "OFFLINE").otherwise("STALE"))
    return last.select("station_id", F.col("p.poll_ts").alias("last_poll"), F.col("p.failures").alias("consecutive_failures"), "last_success", age.alias("age_seconds"), status.alias("status"))


def reachability(polls: DataFrame, rules: SourceRules = SourceRules(), *, key: Sequence[str] = ("source",), ts: str = "poll_ts", seconds: int = FOUR_DAYS) -> DataFrame:
    """Counters per provider: current failure run, malformed answers, last success and latency."""
    rows = run_positions(with_chunk(polls, ts, seconds), {"_f": F.col("ok")}, key=key, order=[ts], ts=ts)
    rows = rows.withColumn("failures", F.when(~F.col("ok"), F.col("_f_since")).otherwise(0))
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("polls"), F.max_by(F.struct("failures", "latency_ms"), ts).alias("p"), F.max(F.when(F.col("ok"), F.col(ts))).alias("last_success"),
        F.count(F.when(~F.col("ok") & (F.col("category") == "PARSE_ERROR"), 1)).alias("malformed"), F.max("failures").alias("longest_failure_run"))
    return out.select(*key, "polls", F.col("p.failures").alias("consecutive_failures"), F.col("p.latency_ms").alias("last_latency_ms"), "last_success", "malformed",
                      "longest_failure_run", (F.col("p.failures") >= rules.outage_failures).alias("is_unreachable"))


def outage_sessions(states: DataFrame, gap: str = "90 minutes", watermark: str = "2 hours", *, ts: str = "poll_ts") -> DataFrame:
    """Outages as sessions: cycles without a HEALTHY state that follow each other within ``gap``.

    The same call serves a table and a stream. A stream emits a session once the watermark has passed
    its end, and holds one row for each source that is out at the time.
    """
    bad = states.withWatermark(ts, watermark).filter(F.col("state") != "HEALTHY")
    out = bad.groupBy("source", F.session_window(ts, gap).alias("w")).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("cycles"), F.min_by("state", ts).alias("initial_state"),
        F.max_by("state", ts).alias("last_state"), F.sort_array(F.collect_set("trigger")).alias("triggers"))  # closed list of triggers
    categories = F.array_join(F.filter("triggers", lambda t: t != "NONE"), ",")
    return out.select("source", "started_at", "last_ts", F.col("w.end").alias("closed_at"), "cycles", "initial_state", "last_state", categories.alias("categories"))
