"""Stored tables over their life: retention by day, versions with compaction, payload files and variants."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meteoqc.operators import feature_sets as fs
from meteoqc.operators import health as hl
from meteoqc.operators import profile as pf
from meteoqc.operators import quality as ql
from meteoqc.operators import repair as rp
from meteoqc.operators import source_health as sh
from meteoqc.operators import spatial as sp
from meteoqc.operators.staging import new_folder, staged
from meteoqc.plans.common import oracle, publish
from meteoqc.plans.decision_plans import DECIDED, HEALTH, HEALTH_CTE, SUMMARY_CTE, decided_table, edges_of
from meteoqc.plans.profile_plans import freshness
from meteoqc.plans.repair_plans import ERR, MISSING_CTE, RULES, error_sql, hist_cte, impute_cte
from meteoqc.plans.spatial_plans import CONTEXT
from meteoqc.plans.source_plans import OUT, POLLS, polls
from meteoqc.schema import KEY, RH, SLP, TEMP, TS
from meteoqc.sources import provider, sinks, tabular, variants
from meteoqc.sources.payload_source import PayloadFiles
from meteoqc.sources.retention import Policy, prune_all, write_table
from meteoqc.sources.tables import observations
from meteoqc.sources.versions import VersionedTable
from meteoqc.streaming import stream as st

NOW = "2024-01-31 00:00:00"
POLICIES = {"observations": Policy(14), "payloads": Policy(7, "ingestion_ts"), "outages": Policy(10, "resolved_at"), "corrections": Policy(0)}


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def retention(obs):
    """Four tables under policies of their own; only resolved outages go, and zero days keep all."""
    spark = obs.sparkSession
    content = {
        "observations": obs.select("event_id", KEY, TS, TEMP), "payloads": obs.select("event_id", "ingestion_ts"),
        "outages": sh.outages(staged(sh.source_states(polls(obs)))), "corrections": obs.filter(F.col(TEMP).isNull()).select("event_id", KEY, TS)}
    tables = {name: (new_folder(spark, name), POLICIES[name]) for name in content}
    for name, (path, policy) in tables.items():
        write_table(content[name], path, policy)
    return prune_all(spark, tables, NOW)


def episodes(obs):
    """Outages as they are known at three times, compacted after the second; the last state of each is read."""
    spark = obs.sparkSession
    table = VersionedTable(new_folder(spark, "episodes"), "episode_id", 4)
    log = staged(polls(obs))
    for version, until in enumerate(("2024-01-08", "2024-01-19", "2025-01-01")):
        known = sh.outages(staged(sh.source_states(log.filter(F.col("poll_ts") < F.lit(until).cast("timestamp")))))
        key = F.concat_ws("@", "source", F.date_format("started_at", "yyyyMMddHH")).alias("episode_id")
        table.upsert(known.select(key, "source", "started_at", "last_ts", "cycles", "current_state", "is_ongoing", F.lit(version).alias("seen")), version)
        if version == 1:
            table.compact(spark, version)
    return table.state(spark)


def _send(obs, folder, part):
    rows = obs.filter(F.col("event_id") % 2 == part)
    provider.as_payload(rows).select("payload").coalesce(2).write.text(f"{folder}/part-{part}")


def _counted(raw, via):
    rows = ql.accepted(provider.normalise(raw.select("payload", "payload_file")))
    return rows.groupBy("report_type").agg(F.lit(via).alias("via"), F.count(F.lit(1)).alias("readings"), F.sum(F.round(RH, 2)).alias("humidity"))


def payload_files(obs):
    """The same payload files through the batch reader and, in two deliveries, through the stream reader."""
    spark = obs.sparkSession
    spark.dataSource.register(PayloadFiles)
    folder, f = new_folder(spark, "payload-files"), st.Folders(new_folder(spark, "payload-stream"))
    for part in (0, 1):
        _send(obs, folder, part)
        st.run_available(spark.readStream.format("payload_files").load(folder), st.to_table(f.raw), f"{f.root}-checkpoint")
    streamed = spark.read.parquet(f.raw)
    return _counted(spark.read.format("payload_files").load(folder), "batch").unionByName(_counted(streamed, "stream"))


def _payloads(obs):
    """Payloads of four shapes; every 41st is cut off in the middle."""
    raw = provider.as_payload(obs)
    return variants.parsed(raw.withColumn("payload", F.when(F.col("event_id") % 41 == 0, F.expr("left(payload, 40)")).otherwise(F.col("payload"))))


def variant_readings(obs):
    return variants.readings(_payloads(obs)).select("event_id", F.col("station").alias(KEY), "elevation", TEMP, RH, SLP)


def variant_quarantine(obs):
    return variants.quarantine(_payloads(obs)).select("event_id", F.length("payload").alias("length"))


def variant_schemas(obs):
    shape = F.col("event_id") % 4
    return variants.merged_schema(_payloads(obs).withColumn("shape", shape), ["shape"])


def _labelled_files(obs):
    """Benchmark files of two senders: labels under another name, other column order."""
    folder, when = new_folder(obs.sparkSession, "labelled-csv"), F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    truth = (F.col("value") > 200).cast("int")
    kind = F.when(F.col("value") > 200, "SPIKE").otherwise("NONE")
    one = obs.filter("event_id % 2 = 0").select(F.col(KEY).alias("station"), when.alias("time"), F.col(TEMP).alias("temp"), F.col(RH).alias("rh"), F.col(SLP).alias("mslp"),
                                              F.lit("SC1").alias("scenario_id"), truth.alias("is_anomaly"))
    two = obs.filter("event_id % 2 = 1").select(kind.alias("anomaly_type"), truth.alias("ground_truth_anomaly"), F.col(SLP).alias("pressure"), F.col(RH).alias("humidity"), F.col(TEMP).alias("tmp"),
                                              when.alias("obs_time"), F.col(KEY).alias("stn"))
    for name, part in (("one", one), ("two", two)):
        part.write.option("header", True).csv(f"{folder}/{name}")
    return tabular.read_labelled(obs.sparkSession, f"{folder}/*")


def labelled_rows(obs):
    return _labelled_files(obs)[0].select(KEY, TS, TEMP, RH, SLP, "is_fault", "is_synthetic")


def labelled_labels(obs):
    truth = F.coalesce("is_anomaly", "ground_truth_anomaly").cast("long")
    return _labelled_files(obs)[1].select(KEY, TS, "scenario_id", "anomaly_type", truth.alias("truth"))


def old_names(obs):
    """Tables written under earlier column names get the canonical ones added; a canonical column that is there stays."""
    old = obs.select("event_id", F.col(TEMP).alias("temperature"), F.col(RH).alias("humidity"), F.col(RH).alias(RH))
    named = tabular.with_canonical_aliases(old.withColumn("humidity", F.lit(-1.0)), {"temperature": TEMP, "humidity": RH, "pressure": SLP})
    return named.select("event_id", TEMP, RH, F.lit(SLP in named.columns).alias("has_pressure"))


def feature_sink(obs):
    """Feature rows stored by day with the version of their layout, read back for one week."""
    path = new_folder(obs.sparkSession, "features")
    f = fs.calendar_features(obs).select("event_id", KEY, TS, *fs.SET_A, F.lit("A").alias("feature_set"))
    sinks.append_by_day(f, path)
    week = obs.sparkSession.read.parquet(path).filter(F.col(sinks.DAY).between("2024-01-08", "2024-01-14"))
    return week.groupBy(KEY, "feature_set").agg(F.count(F.lit(1)).alias("rows"), F.sum("sin_hour").alias("sum_sin"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))


def profile_file(obs):
    """The profile of the variables as JSON lines, read back."""
    path = new_folder(obs.sparkSession, "profile")
    profile = pf.variable_profile(obs, [TEMP, RH, SLP])
    profile.coalesce(1).write.json(path)  # one row for each station and variable
    return obs.sparkSession.read.schema(profile.schema).json(path).select(KEY, "variable", "count_valid", "missing_pct", "median", "mean")


def imputed_variables(obs):
    """Missing temperature, humidity and pressure readings alike."""
    near = [f"{v}_{x}" for v in ("temp", "rh", "slp") for x in ("idw", "n", "std", "km")]
    ctx = staged(sp.spatial_context(obs, edges_of(obs)).select(KEY, TS, *near))
    out = None
    for v in ("temp", "rh", "slp"):
        rows = rp.impute(rp.missing_readings(obs, ctx, v, rules=RULES), RULES).select(KEY, TS, "variable", "missing_steps", "method", "status", "estimate", "method_quality", *ERR)
        out = rows if out is None else out.unionByName(rows)
    return out


def network_summary(obs):
    """The network in one row: stations by freshness (silent for a day: offline), readings processed, mean health, worst station."""
    d = decided_table(obs)
    fresh = freshness(obs).withColumn("status", F.when(F.col("age_seconds") > 86_400, "OFFLINE").otherwise(F.col("status")))
    h = hl.station_health(d, HEALTH).select(KEY, F.round("overall_health", 6).alias("overall_health"))
    per = fresh.join(h, KEY, "left")
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(f"{s.lower()}_stations") for s in ("LIVE", "STALE", "OFFLINE")]
    one = per.agg(F.count(F.lit(1)).alias("total_stations"), *counts, F.avg("overall_health").alias("mean_health"),
                  F.min(F.when(F.col("overall_health").isNotNull(), F.struct("overall_health", KEY)))[KEY].alias("lowest_health_station"), F.max(TS).alias("last_ts"))
    return one.join(F.broadcast(d.agg(F.count(F.lit(1)).alias("processed"))), F.lit(True))  # one row each


QUERIES = {
    "labelled_csv_rows": _q(labelled_rows),
    "labelled_csv_labels": _q(labelled_labels),
    "old_column_names": _q(old_names),
    "feature_sink": _q(feature_sink),
    "profile_json": _q(profile_file),
    "imputed_variables": _q(imputed_variables),
    "network_summary": _q(network_summary),
    "retention_by_table": _q(retention),
    "versioned_episodes": _q(episodes),
    "payload_source_batch_and_stream": _q(payload_files),
    "variant_payload_readings": _q(variant_readings),
    "variant_payload_quarantine": _q(variant_quarantine),
    "variant_payload_schemas": _q(variant_schemas),
}

JSON_COUNTS = """SELECT CASE event_id % 4 WHEN 0 THEN 'LIVE_API_CURRENT' WHEN 1 THEN 'LIVE_API_HOURLY' ELSE 'LIVE_API_FLAT' END AS report_type, relative_humidity_pct AS rh
  FROM observations WHERE event_id % 4 <> 3 AND NOT coalesce(temperature_c > 60, FALSE) UNION ALL SELECT 'LIVE_API_HOURLY', 50.0 FROM observations WHERE event_id % 4 = 1"""


def _kept(table, ts, days):
    cut = f"TIMESTAMP '{NOW}' - INTERVAL {days} DAY"
    gone = f"{ts} < {cut}" if days > 0 else "FALSE"
    return f"count(CASE WHEN coalesce({gone}, FALSE) THEN 1 END) AS pruned, count(CASE WHEN NOT coalesce({gone}, FALSE) THEN 1 END) AS kept FROM {table}"


def _until(until, version):
    """Outages from the polls before a time, as a subquery."""
    ctes = POLLS.strip().replace("FROM observations GROUP BY ALL)", f"FROM observations WHERE date_trunc('hour', obs_ts) < TIMESTAMP '{until}' GROUP BY ALL)")
    return f"(WITH {ctes}, {OUT.strip()} SELECT source, started_at, last_ts, cycles, CASE WHEN resolved_at IS NULL THEN cur ELSE 'HEALTHY' END AS current_state, resolved_at IS NULL AS is_ongoing, {version}::BIGINT AS seen FROM od)"


def impute_sql(v, column):
    """Imputation of one variable as a query of its own."""
    low, high = rp.ESTIMATE_BOUNDS[v]
    est = impute_cte(False).replace("'temp' AS variable", f"'{v}' AS variable").replace("c.temp_", f"c.{v}_").replace("greatest(-50.0, least(60.0,", f"greatest({low}, least({high},")
    return oracle(f"SELECT station_id, obs_ts, variable, missing_steps, method, status, estimate, method_quality, {', '.join(ERR)} FROM judged", *CONTEXT, MISSING_CTE.replace("temperature_c", column),
                  hist_cte("mseries"), est, error_sql("coalesce(gap_minutes, 0)"), doubles=["estimate", *ERR])


WEEK = "obs_ts >= TIMESTAMP '2024-01-08' AND obs_ts < TIMESTAMP '2024-01-15'"
ORACLES = {
    "labelled_csv_rows": oracle("SELECT station_id, obs_ts, temperature_c, relative_humidity_pct, sea_level_pressure_hpa, value > 200 AS is_fault, TRUE AS is_synthetic FROM observations"),
    "labelled_csv_labels": oracle(
        """SELECT station_id, obs_ts, CASE WHEN event_id % 2 = 0 THEN 'SC1' END AS scenario_id, CASE WHEN event_id % 2 = 1 THEN CASE WHEN value > 200 THEN 'SPIKE' ELSE 'NONE' END END AS anomaly_type,
        (value > 200)::BIGINT AS truth FROM observations"""),
    "old_column_names": oracle("SELECT event_id, temperature_c, relative_humidity_pct, FALSE AS has_pressure FROM observations"),
    "feature_sink": oracle(
        f"""SELECT station_id, 'A' AS feature_set, count(*) AS rows, sum(sin({2 * math.pi!r}::DOUBLE * (hour(obs_ts) + minute(obs_ts) / 60.0::DOUBLE) / 24.0)) AS sum_sin, min(obs_ts) AS first_ts, max(obs_ts) AS last_ts
        FROM observations WHERE {WEEK} GROUP BY 1""", doubles=["sum_sin"]),
    "profile_json": oracle(
        """SELECT station_id, variable, count(x) AS count_valid, round((count(*) - count(x)) / count(*) * 100.0 + 1e-9::DOUBLE, 2) AS missing_pct, round(quantile_cont(x, 0.5) + 1e-9::DOUBLE, 2) AS median,
        round(avg(x) + 1e-9::DOUBLE, 2) AS mean FROM (SELECT station_id, unnest(['temperature_c', 'relative_humidity_pct', 'sea_level_pressure_hpa']) AS variable,
        unnest([temperature_c, relative_humidity_pct, sea_level_pressure_hpa]) AS x FROM observations) GROUP BY 1, 2""", doubles=["missing_pct", "median", "mean"]),
    "imputed_variables": " UNION ALL ".join(f"SELECT * FROM ({impute_sql(v, c)})" for v, c in (("temp", TEMP), ("rh", RH), ("slp", SLP))),
    "network_summary": oracle(
        """SELECT count(*) AS total_stations, count(CASE WHEN age <= 3600 THEN 1 END) AS live_stations, count(CASE WHEN age > 3600 AND age <= 86400 THEN 1 END) AS stale_stations,
        count(CASE WHEN age > 86400 THEN 1 END) AS offline_stations, avg(round(overall_health, 6)) AS mean_health, arg_min(station_id, (round(overall_health, 6), station_id)) FILTER (overall_health IS NOT NULL) AS lowest_health_station, max(obs_ts) AS last_ts,
        (SELECT count(*) FROM decided) AS processed FROM (SELECT station_id, max(obs_ts) AS obs_ts, ((SELECT max(epoch_us(ingestion_ts)) FROM observations) - max(epoch_us(obs_ts))) / 1000000.0::DOUBLE AS age
        FROM observations GROUP BY 1) LEFT JOIN health USING (station_id)""", *DECIDED, HEALTH_CTE, SUMMARY_CTE, doubles=["mean_health"]),
    "retention_by_table": oracle(
        f"""SELECT 'observations' AS table_name, {_kept('observations', 'obs_ts', 14)} UNION ALL SELECT 'payloads', {_kept('observations', 'ingestion_ts', 7)}
        UNION ALL SELECT 'outages', {_kept('od', 'resolved_at', 10)} UNION ALL SELECT 'corrections', {_kept('(FROM observations WHERE temperature_c IS NULL)', 'obs_ts', 0)}""", POLLS, OUT),
    "versioned_episodes": oracle(
        f"""SELECT source || '@' || strftime(started_at, '%Y%m%d%H') AS episode_id, * FROM ({' UNION ALL '.join(f'FROM {_until(u, v)}' for v, u in enumerate(('2024-01-08', '2024-01-19', '2025-01-01')))})
        QUALIFY row_number() OVER (PARTITION BY source, strftime(started_at, '%Y%m%d%H') ORDER BY seen DESC) = 1"""),
    "payload_source_batch_and_stream": oracle(
        f"SELECT report_type, via, count(*) AS readings, sum(round(rh, 2)) AS humidity FROM ({JSON_COUNTS}), (VALUES ('batch'), ('stream')) v(via) GROUP BY ALL", doubles=["humidity"]),
    "variant_payload_readings": oracle(
        """SELECT event_id, station_id, elevation_m AS elevation, CASE WHEN event_id % 4 <> 3 THEN temperature_c END AS temperature_c, CASE WHEN event_id % 4 <> 3 THEN relative_humidity_pct END AS relative_humidity_pct,
        CASE WHEN event_id % 4 <> 3 THEN sea_level_pressure_hpa END AS sea_level_pressure_hpa FROM observations WHERE event_id % 41 <> 0"""),
    "variant_payload_quarantine": oracle("SELECT event_id, 40::BIGINT AS length FROM observations WHERE event_id % 41 = 0"),
}
