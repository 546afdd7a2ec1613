"""Profiles, histories, latest rows, inserts and table checks over the observation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.operators import lookups as lk
from meteoqc.operators import profile as pf
from meteoqc.operators.features import first_per_key
from meteoqc.plans.common import oracle, publish
from meteoqc.schema import DEW, KEY, RH, SLP, TEMP, TS
from meteoqc.sources import tabular
from meteoqc.sources.tables import observations

P = "PARTITION BY station_id ORDER BY obs_ts"


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def history(obs):
    rows = lk.where(obs, station_id="S07", start="2024-01-03", end="2024-01-28")
    return lk.page(rows, [F.col(TS).desc(), F.col("event_id")], limit=50, offset=10).select("event_id", KEY, TS, TEMP, RH, SLP, "total_count", "has_more")


def point(obs):
    return lk.where(obs, event_id=77).select("event_id", KEY, TS, TEMP)


def preview(obs):
    return pf.csv_preview(obs, ["station_id", "temperature_c", "relative_humidity_pct", "sea_level_pressure_hpa", "dew_point_c", "wind_speed"], True)


def repeated(obs):
    """Readings plus a late second copy of every 50th, as a feed that repeats itself sends them."""
    again = obs.filter(F.col("event_id") % 50 == 0).withColumns(
        {"event_id": F.col("event_id") + 10_000_000, "ingestion_ts": F.timestamp_micros(F.unix_micros("ingestion_ts") + 3_600_000_000)})
    return obs.unionByName(again)


def duplicates_dropped(obs):
    return first_per_key(repeated(obs), [KEY, TS, "source"], ["ingestion_ts", "event_id"]).select("event_id", KEY, TS)


def arrival_status(obs):
    """Processing status of every arriving reading: duplicate, out of order, future or processed."""
    rows = repeated(obs)
    hw = pf.high_water(rows.select("event_id", KEY, TS, "source", "ingestion_ts"))
    first = rows.groupBy(KEY, TS, "source").agg(F.min(F.struct("ingestion_ts", "event_id")).alias("_f"))
    both = hw.join(first, [KEY, TS, "source"])
    future = F.unix_micros(TS) > F.unix_micros("ingestion_ts") + 300_000_000
    status = (
        F.when(F.col("_f.event_id") != F.col("event_id"), "DUPLICATE_SKIPPED").when(future, "FUTURE_REJECTED")
        .when(F.col(TS) < F.col("high_water_ts"), "OUT_OF_ORDER").otherwise("PROCESSED"))
    return both.select("event_id", KEY, TS, "high_water_ts", status.alias("status"))


def not_stored(obs):
    stored = obs.filter(F.col("event_id") % 3 != 0)
    return lk.absent(repeated(obs), stored, [KEY, TS, "source"]).select(KEY, TS, "source", TEMP)


def latencies(obs):
    ms = (F.unix_micros("ingestion_ts") - F.unix_micros(TS)) / 1000.0 + F.col("value")
    return pf.latency_stats(obs.withColumn("latency_ms", ms), "latency_ms", ["event_type"])


def extremes(obs):
    return pf.network_extremes(lk.latest_per_key(obs.select(KEY, TS, TEMP, RH, SLP)), {"temp": TEMP, "rh": RH, "slp": SLP})


def freshness(obs):
    """Station status against the newest arrival in the table."""
    latest = lk.latest_per_key(obs.select(KEY, TS, "ingestion_ts"))
    now = obs.agg(F.max("ingestion_ts").alias("_now"))
    age = (F.unix_micros("_now") - F.unix_micros(TS)) / 1_000_000.0
    rows = latest.join(F.broadcast(now), F.lit(True))  # one row
    return rows.select(KEY, TS, age.alias("age_seconds"), ((F.unix_micros("ingestion_ts") - F.unix_micros(TS)) / 1_000_000.0).alias("delay_seconds"),
                       F.when(age > 3600.0, "STALE").otherwise("LIVE").alias("status"))


def network_status(obs):
    return freshness(obs).agg(F.count(F.lit(1)).alias("total_stations"), F.count(F.when(F.col("status") == "LIVE", 1)).alias("live_stations"),
                              F.count(F.when(F.col("status") == "STALE", 1)).alias("stale_stations"), F.max(TS).alias("last_ts"))


def kept(obs):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    out = lk.retained(obs, 10, now, protected=F.col("is_fault"))
    return out.groupBy(KEY).agg(F.count(F.lit(1)).alias("kept"), F.min(TS).alias("oldest"))


def station_sync(obs):
    known = obs.filter(F.col("event_type") == "signup").select(KEY).distinct().filter(F.col(KEY) < "S12")
    return lk.absent(obs.select(KEY, "station_name"), known, [KEY])


def fingerprints(spark, sf_dir):
    """Counts per table and whether a copy that went through a shuffle has the same checksum."""
    obs = observations(spark, sf_dir)
    out = None
    for name, df in (("observations", obs), ("stations", obs.select(KEY, "station_name").distinct())):
        a, b = lk.table_fingerprint(df, name), lk.table_fingerprint(df.repartition(7), name)
        row = a.alias("a").join(b.alias("b"), "table_name").select(
            "table_name", F.col("a.rows").alias("rows"), ((F.col("a.xor_hash") == F.col("b.xor_hash")) & (F.col("a.sum_hash") == F.col("b.sum_hash"))).alias("same"))
        out = row if out is None else out.unionByName(row)
    return publish(out)


def header_mapping(spark, sf_dir):
    """Header names of the observation table, the canonical column each maps to, and how full it is."""
    obs = observations(spark, sf_dir).withColumnsRenamed({TEMP: "Temp_C", RH: "rhum", SLP: "MSLP", KEY: "AWS_ID"})
    m = tabular.infer_mapping(obs.columns)
    counts = obs.agg(*[F.count(c).alias(c) for c in m.mapping]).unpivot([], list(m.mapping), "header", "filled")
    pairs = spark.createDataFrame(list(m.mapping.items()), "header string, canonical string")
    return publish(counts.join(pairs, "header"))


V = pf.PROFILED
QUERIES = {
    "variable_profile": _q(pf.variable_profile),
    "cadence_profile": _q(pf.cadence_profile),
    "arrival_fault_counts": _q(lambda o: pf.arrival_faults(repeated(o))),
    "report_type_shares": _q(lambda o: pf.group_shares(o, "report_type")),
    "quality_status_shares": _q(lambda o: pf.group_shares(o, "data_quality_status")),
    "dataset_profile": _q(pf.dataset_profile),
    "csv_preview": _q(preview),
    "csv_header_mapping": header_mapping,
    "observation_history_page": _q(history),
    "point_lookup": _q(point),
    "latest_observation_per_station": _q(lambda o: lk.latest_per_key(o.select(KEY, TS, TEMP, RH, SLP))),
    "bounded_station_history": _q(lambda o: lk.last_n_per_key(o.select(KEY, TS, TEMP), 120)),
    "duplicate_suppression": _q(duplicates_dropped),
    "arrival_status": _q(arrival_status),
    "idempotent_insert": _q(not_stored),
    "latency_statistics": _q(latencies),
    "network_extremes": _q(extremes),
    "station_freshness": _q(freshness),
    "network_status": _q(network_status),
    "retention": _q(kept),
    "station_dimension_sync": _q(station_sync),
    "table_fingerprints": fingerprints,
}

REPEATED = """
rep AS (SELECT event_id, station_id, obs_ts, source, ingestion_ts, temperature_c FROM observations
  UNION ALL SELECT event_id + 10000000, station_id, obs_ts, source, ingestion_ts + INTERVAL 1 HOUR, temperature_c FROM observations WHERE event_id % 50 = 0)"""
_long = " UNION ALL ".join(f"SELECT station_id, '{v}' AS variable, {v} AS x FROM observations" for v in V)
GAPS = f"""
gaps AS (SELECT station_id, (epoch_us(obs_ts) - lag(epoch_us(obs_ts)) OVER ({P})) / 60000000.0::DOUBLE AS g FROM (SELECT DISTINCT station_id, obs_ts FROM observations)),
gapr AS (SELECT station_id, round(g, 1) AS gap FROM gaps WHERE g > 0),
modes AS (SELECT station_id, arg_max(gap, n * 1000000.0 - gap) AS mode_gap FROM (SELECT station_id, gap, count(*) AS n FROM gapr GROUP BY ALL) GROUP BY 1),
cadence AS (SELECT station_id, count(*) AS gaps, round(quantile_cont(gap, 0.5), 1) AS median_gap, min(gap) AS min_gap, max(gap) AS max_gap, any_value(mode_gap) AS mode_gap,
  sum(CASE WHEN abs(gap - mode_gap) <= 1.0 THEN 1 ELSE 0 END) / count(*) >= 0.9 AS is_regular FROM gapr JOIN modes USING (station_id) GROUP BY 1)"""


def faults(src):
    return f"""
faults AS (SELECT station_id, count(*) - count(DISTINCT obs_ts) AS duplicates, sum(CASE WHEN late THEN 1 ELSE 0 END) AS out_of_order
  FROM (SELECT station_id, obs_ts, obs_ts < lag(obs_ts) OVER (PARTITION BY station_id ORDER BY ingestion_ts) AS late FROM {src}) GROUP BY 1)"""


FRESH = """
fresh AS (SELECT station_id, obs_ts, (SELECT max(epoch_us(ingestion_ts)) FROM observations) / 1000000.0::DOUBLE - epoch_us(obs_ts) / 1000000.0::DOUBLE AS age_seconds,
  (epoch_us(ingestion_ts) - epoch_us(obs_ts)) / 1000000.0::DOUBLE AS delay_seconds FROM observations QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY obs_ts DESC) = 1)"""

ORACLES = {
    "variable_profile": oracle(
        """SELECT station_id, variable, count(x) AS count_valid, round((count(*) - count(x)) / count(*) * 100.0 + 1e-9::DOUBLE, 2) AS missing_pct, round(min(x) + 1e-9::DOUBLE, 2) AS min, round(max(x) + 1e-9::DOUBLE, 2) AS max,
        round(avg(x) + 1e-9::DOUBLE, 2) AS mean, round(stddev_pop(x) + 1e-9::DOUBLE, 2) AS std, round(median(x) + 1e-9::DOUBLE, 2) AS median, round(quantile_cont(x, 0.25) + 1e-9::DOUBLE, 2) AS q25, round(quantile_cont(x, 0.75) + 1e-9::DOUBLE, 2) AS q75 FROM long GROUP BY ALL""",
        f"long AS ({_long})", doubles=["missing_pct", "min", "max", "mean", "std", "median", "q25", "q75"]),
    "cadence_profile": oracle("SELECT * FROM cadence", GAPS, doubles=["median_gap", "min_gap", "max_gap", "mode_gap"]),
    "arrival_fault_counts": oracle("SELECT * FROM faults", REPEATED, faults("rep"), ints=["out_of_order"]),
    "report_type_shares": oracle(
        """SELECT *, n / sum(n) OVER (PARTITION BY station_id) * 100.0 AS pct FROM (SELECT station_id, 'report_type' AS "column", coalesce(report_type, 'UNKNOWN') AS value, count(*) AS n
        FROM observations GROUP BY ALL)""", doubles=["pct"]),
    "quality_status_shares": oracle(
        """SELECT *, n / sum(n) OVER (PARTITION BY station_id) * 100.0 AS pct FROM (SELECT station_id, 'data_quality_status' AS "column", data_quality_status AS value, count(*) AS n
        FROM observations GROUP BY ALL)""", doubles=["pct"]),
    "dataset_profile": oracle(
        """SELECT station_id, station_name, latitude, longitude, elevation_m, records, valid_records, first_ts, last_ts, round((epoch_us(last_ts) - epoch_us(first_ts)) / 86400000000.0::DOUBLE, 2) AS duration_days,
        median_gap, mode_gap, is_regular, duplicates, out_of_order, mean_temp, mean_rh, mean_slp,
        '# ' || station_id || ' (' || station_name || '): ' || records || ' records, ' || duplicates || ' duplicates, ' || CAST(out_of_order AS BIGINT) || ' out of order' AS headline
        FROM (SELECT station_id, arg_min(station_name, obs_ts) AS station_name, arg_min(latitude, obs_ts) AS latitude, arg_min(longitude, obs_ts) AS longitude, arg_min(elevation_m, obs_ts) AS elevation_m,
        count(*) AS records, count(CASE WHEN data_quality_status = 'VALID' THEN 1 END) AS valid_records, min(obs_ts) AS first_ts, max(obs_ts) AS last_ts, round(avg(temperature_c), 2) AS mean_temp,
        round(avg(relative_humidity_pct), 2) AS mean_rh, round(avg(sea_level_pressure_hpa), 2) AS mean_slp FROM observations GROUP BY 1) LEFT JOIN cadence USING (station_id) LEFT JOIN faults USING (station_id)""",
        GAPS, faults("observations"), doubles=["latitude", "longitude", "duration_days", "median_gap", "mode_gap", "mean_temp", "mean_rh", "mean_slp"], ints=["out_of_order"]),
    "csv_preview": oracle(
        """SELECT count(*) AS rows, min(obs_ts) AS first_ts, max(obs_ts) AS last_ts, 0.0::DOUBLE AS null_pct_station_id,
        """ + ", ".join(f"round(count(CASE WHEN {c} IS NULL THEN 1 END) / count(*) * 100.0, 1) AS null_pct_{c}" for c in (TEMP, RH, SLP, DEW)) + """,
        100.0::DOUBLE AS null_pct_wind_speed, count(DISTINCT station_id) AS stations,
        (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT station_id AS s FROM observations ORDER BY 1 LIMIT 20)) AS first_stations,
        (SELECT round(quantile_cont(gap, 0.5), 1) FROM gapr) AS cadence_minutes, TRUE AS has_ground_truth FROM observations""", GAPS,
        doubles=["cadence_minutes", *[f"null_pct_{c}" for c in (TEMP, RH, SLP, DEW)]]),
    "csv_header_mapping": oracle(
        """SELECT header, canonical, filled FROM (SELECT unnest(['AWS_ID','station_name','obs_ts','latitude','longitude','elevation_m','Temp_C','rhum','MSLP','station_pressure_hpa','dew_point_c']) AS header,
        unnest(['station_id','station_name','obs_ts','latitude','longitude','elevation_m','temperature_c','relative_humidity_pct','sea_level_pressure_hpa','station_pressure_hpa','dew_point_c']) AS canonical,
        unnest([count(station_id), count(station_name), count(obs_ts), count(latitude), count(longitude), count(elevation_m), count(temperature_c), count(relative_humidity_pct), count(sea_level_pressure_hpa),
        count(station_pressure_hpa), count(dew_point_c)]) AS filled FROM observations)"""),
    "observation_history_page": oracle(
        """SELECT event_id, station_id, obs_ts, temperature_c, relative_humidity_pct, sea_level_pressure_hpa, total_count, total_count > 60 AS has_more FROM
        (SELECT *, count(*) OVER () AS total_count FROM observations WHERE station_id = 'S07' AND obs_ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28')
        ORDER BY obs_ts DESC, event_id LIMIT 50 OFFSET 10"""),
    "point_lookup": oracle("SELECT event_id, station_id, obs_ts, temperature_c FROM observations WHERE event_id = 77"),
    "latest_observation_per_station": oracle(
        "SELECT station_id, obs_ts, temperature_c, relative_humidity_pct, sea_level_pressure_hpa FROM observations QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY obs_ts DESC) = 1"),
    "bounded_station_history": oracle(
        "SELECT station_id, obs_ts, temperature_c, row_number() OVER (PARTITION BY station_id ORDER BY obs_ts DESC) AS recency FROM observations QUALIFY recency <= 120"),
    "duplicate_suppression": oracle("SELECT event_id, station_id, obs_ts FROM rep QUALIFY row_number() OVER (PARTITION BY station_id, obs_ts, source ORDER BY ingestion_ts, event_id) = 1", REPEATED),
    "arrival_status": oracle(
        """SELECT event_id, station_id, obs_ts, hw AS high_water_ts, CASE WHEN rn > 1 THEN 'DUPLICATE_SKIPPED' WHEN epoch_us(obs_ts) > epoch_us(ingestion_ts) + 300000000 THEN 'FUTURE_REJECTED'
        WHEN obs_ts < hw THEN 'OUT_OF_ORDER' ELSE 'PROCESSED' END AS status FROM (SELECT *, max(obs_ts) OVER (PARTITION BY station_id ORDER BY ingestion_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw,
        row_number() OVER (PARTITION BY station_id, obs_ts, source ORDER BY ingestion_ts, event_id) AS rn FROM rep)""", REPEATED),
    "idempotent_insert": oracle("SELECT DISTINCT station_id, obs_ts, source, temperature_c FROM rep r WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.event_id % 3 <> 0 AND o.station_id = r.station_id AND o.obs_ts = r.obs_ts)", REPEATED),
    "latency_statistics": oracle(
        """SELECT event_type, count(*) AS requests, avg(x) AS mean, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, min(x) AS min, max(x) AS max, 1000.0 / avg(x) AS per_second
        FROM (SELECT event_type, round((epoch_us(ingestion_ts) - epoch_us(obs_ts)) / 1000.0::DOUBLE + value, 3) AS x FROM observations) GROUP BY 1""", doubles=["mean", "p50", "p95", "p99", "per_second"]),
    "network_extremes": oracle(
        """SELECT variable, min(x) AS min, median(x) AS median, max(x) AS max, avg(x) AS mean, arg_min(station_id, (x, station_id)) FILTER (x IS NOT NULL) AS lowest_station, arg_max(station_id, (x, station_id)) FILTER (x IS NOT NULL) AS highest_station
        FROM (SELECT station_id, unnest(['temp', 'rh', 'slp']) AS variable, unnest([temperature_c, relative_humidity_pct, sea_level_pressure_hpa]) AS x FROM
        (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY obs_ts DESC) = 1)) GROUP BY 1""", doubles=["median", "mean"]),
    "station_freshness": oracle("SELECT *, CASE WHEN age_seconds > 3600 THEN 'STALE' ELSE 'LIVE' END AS status FROM fresh", FRESH, doubles=["age_seconds", "delay_seconds"]),
    "network_status": oracle(
        "SELECT count(*) AS total_stations, count(CASE WHEN age_seconds <= 3600 THEN 1 END) AS live_stations, count(CASE WHEN age_seconds > 3600 THEN 1 END) AS stale_stations, max(obs_ts) AS last_ts FROM fresh", FRESH),
    "retention": oracle("SELECT station_id, count(*) AS kept, min(obs_ts) AS oldest FROM observations WHERE obs_ts >= TIMESTAMP '2024-01-21' OR is_fault GROUP BY 1"),
    "station_dimension_sync": oracle(
        "SELECT DISTINCT station_id, station_name FROM observations WHERE station_id NOT IN (SELECT station_id FROM observations WHERE event_type = 'signup' AND station_id < 'S12')"),
    "table_fingerprints": oracle("SELECT 'observations' AS table_name, count(*) AS rows, TRUE AS same FROM observations UNION ALL SELECT 'stations', count(DISTINCT station_id), TRUE FROM observations"),
}
