"""Readers and writers over real files: written to a new shared folder, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.operators import quality as ql
from meteoqc.operators.staging import new_folder
from meteoqc.plans.common import oracle, publish
from meteoqc.plans.profile_plans import repeated
from meteoqc.schema import KEY, RH, SLP, TEMP, TS
from meteoqc.sources import provider, sinks, tabular
from meteoqc.sources.tables import observations

ID = [KEY, TS]
VALUES = [TEMP, RH, SLP]


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def mixed_headers(obs):
    """CSV files of two senders whose columns have other names and another order."""
    folder = new_folder(obs.sparkSession, "csv")
    when = F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    one = obs.filter("event_id % 2 = 0").select(F.col(KEY).alias("station"), when.alias("time"), F.col(TEMP).alias("temp"), F.col(RH).alias("rh"), F.col(SLP).alias("mslp"))
    two = obs.filter("event_id % 2 = 1").select(F.col(RH).alias("humidity"), F.col(SLP).alias("pressure"), when.alias("obs_time"), F.col(TEMP).alias("tmp"), F.col(KEY).alias("stn"))
    for name, part in (("one", one), ("two", two)):
        part.write.option("header", True).csv(f"{folder}/{name}")
    return ql.accepted(tabular.read_csv(obs.sparkSession, f"{folder}/*")).select(*ID, *VALUES)


def json_lines(obs):
    """Provider payloads as lines of large files, so that a file can be split."""
    folder = new_folder(obs.sparkSession, "payloads")
    provider.as_payload(obs).select("payload").write.text(folder)
    raw = provider.scan(obs.sparkSession, folder, lines=True)
    return ql.accepted(provider.normalise(raw)).groupBy("report_type").agg(
        F.count(F.lit(1)).alias("readings"), F.countDistinct(TS).alias("times"), F.sum(F.round(RH, 2)).alias("humidity"))


def stored_once(obs):
    """Two deliveries of overlapping readings inserted by key: each reading is stored once."""
    path = new_folder(obs.sparkSession, "readings")
    sinks.insert_observations(obs.filter("event_id % 3 <> 0"), path)
    sinks.insert_observations(repeated(obs), path)
    return obs.sparkSession.read.parquet(path).select(*ID, "source", TEMP, F.length("observation_id").alias("id_length"))


def audit_trail(obs):
    """Audit rows appended in two turns and loaded for one station."""
    path = new_folder(obs.sparkSession, "audit")
    for k in (0, 1):
        sinks.append_audit(obs.filter(F.col("event_id") % 2 == k).select(*ID, "event_id", TEMP), path)
    return sinks.load_audit(obs.sparkSession, path, "S03").select("event_id", *ID, TEMP)


def kept_payloads(obs):
    """Raw payloads filed by the day they were fetched."""
    path = new_folder(obs.sparkSession, "raw")
    rows = obs.select(KEY, F.col("ingestion_ts").alias("retrieval_ts"), F.concat_ws("|", KEY, F.col("event_id").cast("string")).alias("body"))
    sinks.archive_payloads(rows, path, payload="body")
    return obs.sparkSession.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("payloads"), F.max("payload").alias("last"))


def absent_rows_of_all(obs):
    """The whole table in two overlapping deliveries; rows with a new key only."""
    path = new_folder(obs.sparkSession, "events")
    rows = obs.select("event_id", *ID)
    sinks.insert_absent(rows.filter("event_id % 3 <> 0"), path, ["event_id"])
    sinks.insert_absent(rows.filter("event_id % 2 = 0 OR event_id % 3 = 0"), path, ["event_id"])
    return obs.sparkSession.read.parquet(path).select("event_id", *ID)


def pruned(obs):
    """What a retention run of 14 days takes and leaves; missing readings are protected."""
    path = new_folder(obs.sparkSession, "old")
    sinks.write_observations(obs.select("event_id", *ID, TEMP), path)
    return sinks.prune_into(obs.sparkSession, path, f"{path}-kept", 14, "2024-01-31 00:00:00", protected=f"{TEMP} IS NULL")


def labelled_tables(obs):
    """Perturbed readings and their labels in tables of their own."""
    folder = new_folder(obs.sparkSession, "labelled")
    marks = obs.filter("event_id % 10 = 0").select(*ID, F.lit(True).alias("is_fault"))
    sinks.write_labelled(obs.select(*ID, TEMP), marks, folder)
    spark = obs.sparkSession
    return spark.read.parquet(f"{folder}/observations").select(*ID, TEMP).join(spark.read.parquet(f"{folder}/labels"), ID)


def text_formats(obs):
    """CSV and JSON copies of the table read back."""
    folder, spark = new_folder(obs.sparkSession, "copies"), obs.sparkSession
    rows = obs.select("event_id", KEY, TEMP)
    for fmt in ("csv", "json"):
        sinks.write_observations(rows, f"{folder}/{fmt}", fmt)
    schema = f"event_id long, {KEY} string, {TEMP} double"
    copies = spark.read.schema(schema).option("header", True).csv(f"{folder}/csv").withColumn("format", F.lit("csv")).unionByName(
        spark.read.schema(schema).json(f"{folder}/json").withColumn("format", F.lit("json")))
    return copies.select("format", "event_id", KEY, TEMP)


QUERIES = {
    "csv_files_with_mixed_headers": _q(mixed_headers),
    "json_lines_payload_counts": _q(json_lines),
    "readings_stored_once": _q(stored_once),
    "audit_trail": _q(audit_trail),
    "archived_payloads": _q(kept_payloads),
    "absent_rows_of_all_inserted": _q(absent_rows_of_all),
    "retention_run": _q(pruned),
    "labelled_tables": _q(labelled_tables),
    "text_format_copies": _q(text_formats),
}

ORACLES = {
    "csv_files_with_mixed_headers": oracle(
        "SELECT station_id, obs_ts, temperature_c, relative_humidity_pct, sea_level_pressure_hpa FROM observations WHERE NOT coalesce(temperature_c > 60, FALSE)"),
    "json_lines_payload_counts": oracle(
        """SELECT report_type, count(*) AS readings, count(DISTINCT obs_ts) AS times, sum(round(rh, 2)) AS humidity FROM (
        SELECT CASE event_id % 4 WHEN 0 THEN 'LIVE_API_CURRENT' WHEN 1 THEN 'LIVE_API_HOURLY' ELSE 'LIVE_API_FLAT' END AS report_type, obs_ts, relative_humidity_pct AS rh
        FROM observations WHERE event_id % 4 <> 3 AND NOT coalesce(temperature_c > 60, FALSE)
        UNION ALL SELECT 'LIVE_API_HOURLY', obs_ts + INTERVAL 30 MINUTE, 50.0 FROM observations WHERE event_id % 4 = 1) GROUP BY 1""", doubles=["humidity"]),
    "readings_stored_once": oracle("SELECT station_id, obs_ts, source, temperature_c, 39::BIGINT AS id_length FROM observations"),
    "audit_trail": oracle("SELECT event_id, station_id, obs_ts, temperature_c FROM observations WHERE station_id = 'S03'"),
    "archived_payloads": oracle(
        "SELECT strftime(ingestion_ts, '%Y-%m-%d') AS day, count(*) AS payloads, max(station_id || '|' || CAST(event_id AS VARCHAR)) AS last FROM observations GROUP BY 1"),
    "absent_rows_of_all_inserted": oracle("SELECT event_id, station_id, obs_ts FROM observations"),
    "retention_run": oracle(
        """SELECT count(CASE WHEN NOT keep THEN 1 END) AS pruned, count(CASE WHEN keep THEN 1 END) AS kept FROM
        (SELECT obs_ts >= TIMESTAMP '2024-01-17 00:00:00' OR temperature_c IS NULL AS keep FROM observations)"""),
    "labelled_tables": oracle("SELECT station_id, obs_ts, temperature_c, TRUE AS is_fault FROM observations WHERE event_id % 10 = 0"),
    "text_format_copies": oracle("SELECT unnest(['csv', 'json']) AS format, event_id, station_id, temperature_c FROM observations"),
}
