"""Readers, physics and qualification over texts and payloads derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.functions import physics as ph
from meteoqc.functions import text as tx
from meteoqc.functions.timefn import parse_timestamp, round_to_minutes
from meteoqc.operators import quality as ql
from meteoqc.plans.common import oracle, publish
from meteoqc.plans.spatial_plans import FILLED
from meteoqc.schema import DEW, KEY, RH, SLP, STNP, TEMP, TS
from meteoqc.sources import catalogue as sc
from meteoqc.sources import isd, provider, tabular
from meteoqc.sources.tables import observations

FLAT = [KEY, TS, TEMP, DEW, RH, SLP, STNP, "report_type", "data_quality_status"]


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def _isd(obs):
    return isd.normalise(isd.as_text(obs))


def isd_rows(obs):
    out = ql.accepted(_isd(obs))
    return out.select(*FLAT, F.element_at("raw_quality_flags", "TMP_QC").alias("tmp_qc"),
                      F.element_at("raw_quality_flags", "STP_QC").alias("stp_qc"), "relative_humidity_source")


def isd_rejects(obs):
    return ql.quarantined(_isd(obs)).select(KEY, TS, TEMP, F.array_join(ql.REJECTS, ",").alias("reasons"))


def scaled_fields(obs):
    text = isd.as_text(obs).select("STATION", "TMP", "SLP", "MA1")
    # damaged variants of the same field, chosen by content
    broken = F.when(F.col("TMP").endswith("0,1"), F.concat(F.lit("x"), F.col("TMP"))).when(F.col("TMP").endswith("5,1"), F.lit("")).otherwise(F.col("TMP"))
    f = tx.add_scaled_fields(text.withColumn("broken", broken), {"x": "broken"})
    return f.groupBy(tx.qc_status("x_qc").alias("status"), F.col("x_qc").alias("qc")).agg(
        F.count(F.lit(1)).alias("n"), F.count("x_value").alias("with_value"), F.sum("x_value").alias("total"))


def generic_csv(obs):
    raw = obs.select(
        F.col(KEY).alias("AWS_ID"), F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Date_Time"),
        F.coalesce(F.col(TEMP).cast("string"), F.lit("-9999")).alias("air_temp"), F.coalesce(F.col(RH).cast("string"), F.lit("NaN")).alias("rhum"),
        F.col(SLP).cast("string").alias("MSLP"), F.col(STNP).cast("string").alias("stp"), F.col("latitude").cast("string").alias("lat"),
        F.col("is_fault").cast("string").alias("is_anomaly"), F.lit("x").alias("comment"))
    out = tabular.normalise(raw)
    return ql.accepted(out).select(KEY, TS, TEMP, RH, SLP, STNP, "latitude", "longitude", "elevation_m", "data_quality_status", "is_fault")


def payload_rows(obs):
    return ql.accepted(provider.normalise(provider.as_payload(obs))).select("event_id", *[c for c in FLAT if c != DEW])


def payload_rejects(obs):
    bad = ql.quarantined(provider.normalise(provider.as_payload(obs)))
    return bad.select("event_id", KEY, F.array_join(ql.REJECTS, ",").alias("reasons"))


def humidity(obs):
    return obs.select("event_id", ph.saturation_vapour_pressure(TEMP).alias("saturation_hpa"), ph.saturation_vapour_pressure(DEW).alias("actual_hpa"),
                      ph.relative_humidity(TEMP, DEW).alias("rh_clamped"), ph.relative_humidity(TEMP, DEW, clamp=False).alias("rh_raw"))


def pressures(obs):
    return obs.select("event_id", ph.station_pressure(SLP, "elevation_m", TEMP).alias("as_station"),
                      ph.sea_level_pressure(STNP, "elevation_m", TEMP).alias("as_sea_level"), ph.filled_slp().alias("slp_filled"))


def trio(obs):
    t = ph.humidity_consistency()
    return obs.select("event_id", t["ok"].alias("ok"), t["reason"].alias("reason"))


def violations(obs):
    return obs.select("event_id", F.array_join(ph.joint_violations(), ",").alias("violations"))


def bounds(obs):
    return ql.with_reject_reasons(obs).select("event_id", F.array_join(ql.REJECTS, ",").alias("reasons"))


def gate(obs):
    src = F.when(F.col("event_id") % 11 == 0, "MQTT").otherwise("OPEN_METEO")
    meaning = F.when(F.col("event_id") % 13 == 0, "UNSPECIFIED_OR_UNKNOWN").otherwise("MEAN_SEA_LEVEL_PRESSURE")
    expected = F.when(F.col("event_id") % 17 == 0, F.lit("S00")).otherwise(F.col(KEY))
    out = ql.qualification_gate(obs.withColumn("source", src), meaning, expected)
    order = F.array(*[F.lit(c) for c in ql.GATE_CHECKS])
    return out.select("event_id", "is_qualified", F.array_join(F.filter(order, lambda c: F.array_contains("failed_checks", c)), ",").alias("failed"))


def qc_rollup(obs):
    code = F.element_at(F.array(*[F.lit(c) for c in "0123456798"]), (F.col("event_id") % 10 + 1).cast("int"))
    code2 = F.element_at(F.array(*[F.lit(c) for c in "1459"]), (F.col("event_id") % 4 + 1).cast("int"))
    status = ql.rolled_up_status([(F.col(TEMP), code), (F.col(RH), code2), (F.col(SLP), F.lit("1"))])
    return obs.select("event_id", status.alias("status"))


def report_filter(obs):
    return ql.report_types(obs, ["FM-12", "FM-15"]).groupBy(KEY, "report_type").agg(F.count(F.lit(1)).alias("n"))


def cleaned(obs):
    text = F.when(F.col("event_id") % 9 == 0, "NaN").when(F.col("event_id") % 9 == 1, " -9999 ").when(F.col("event_id") % 9 == 2, "9999.0").when(
        F.col("event_id") % 9 == 3, "abc").otherwise(F.col("value").cast("string"))
    return obs.select("event_id", tx.clean_number(text).alias("cleaned"))


def times(obs):
    iso = F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    text = (F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+05:30"))).when(k == 2, iso)
            .when(k == 3, F.unix_seconds(TS).cast("string")).otherwise(F.lit("2026-99-99T00:00:00Z")))
    return obs.select("event_id", parse_timestamp(text).alias("parsed"), round_to_minutes(TS, 30).alias("half_hour"))


def identifiers(obs):
    return obs.select("event_id", tx.observation_id("source", KEY, TS).alias("observation_id"), tx.hash16(KEY, TEMP).alias("short_hash"))


MESSAGES = ["HTTP 429 too many", "HTTP 401 denied", "Read Timeout", "HTTP 503 upstream", "malformed body", "Quality Gate failed", "reset by peer"]


def categorised(obs):
    """Category and redacted address of every row."""
    msg = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % 7 + 1).cast("int"))
    url = F.concat(F.lit("https://x.test/v1?apikey=k"), F.col("event_id").cast("string"), F.lit("&lat=1"))
    return obs.select("event_id", tx.error_category(msg).alias("category"), tx.redact_keys(url).alias("url"))


def sources(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("source", F.when(F.col("event_id") % 3 == 0, "OPEN_METEO").otherwise(F.col("source")))
    counted = obs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return publish(sc.source_catalogue(spark).join(counted, "source", "left").fillna(0, ["rows"]).select("source", "provider", "kind", "is_live", "rows"))


def runs(obs):
    r = sc.with_provenance(obs, run_id="run_1", dataset_id="events")
    return sc.run_history(r).drop("stations")


def flags_json(obs):
    flags = F.create_map(F.lit("TMP_QC"), F.when(F.col(TEMP).isNotNull(), "1").otherwise("9"), F.lit("SRC"), F.col("event_type"))
    text = F.to_json(flags)
    back = F.from_json(text, "map<string,string>")
    return obs.select("event_id", F.element_at(back, "TMP_QC").alias("tmp_qc"), F.element_at(back, "SRC").alias("src"))


QUERIES = {
    "archive_csv_observations": _q(isd_rows),
    "archive_csv_quarantine": _q(isd_rejects),
    "archive_scaled_fields": _q(scaled_fields),
    "generic_csv_observations": _q(generic_csv),
    "provider_json_observations": _q(payload_rows),
    "provider_json_quarantine": _q(payload_rejects),
    "humidity_functions": _q(humidity),
    "pressure_functions": _q(pressures),
    "humidity_trio_consistency": _q(trio),
    "joint_state_violations": _q(violations),
    "physical_bounds_check": _q(bounds),
    "qualification_gate": _q(gate),
    "qc_code_rollup": _q(qc_rollup),
    "report_type_filter": _q(report_filter),
    "missing_value_cleaning": _q(cleaned),
    "timestamp_parsing_and_rounding": _q(times),
    "deterministic_identifiers": _q(identifiers),
    "error_categories_of_all_rows": _q(categorised),
    "source_catalogue": sources,
    "run_history": _q(runs),
    "json_flag_access": _q(flags_json),
}

RH_RAW = "100.0 * exp(17.625::DOUBLE * d / (243.04::DOUBLE + d) - 17.625::DOUBLE * t / (243.04::DOUBLE + t))"


def rh_sql(t, d, clamp=True):
    raw = RH_RAW.replace(" t ", f" {t} ").replace("+ t)", f"+ {t})").replace(" d ", f" {d} ").replace("+ d)", f"+ {d})")
    body = f"CASE WHEN {raw} < 0 THEN 0.0::DOUBLE WHEN {raw} > 100 THEN 100.0::DOUBLE ELSE round({raw}, 2) END" if clamp else f"round({raw}, 2)"
    return f"CASE WHEN {t} BETWEEN -80 AND 80 AND {d} BETWEEN -90 AND 60 THEN {body} END"


BARO = "pow(1.0::DOUBLE - 0.0065::DOUBLE * elevation_m / (coalesce(temperature_c, 15.0) + 273.15::DOUBLE), (9.80665::DOUBLE * 0.0289644::DOUBLE) / (8.31447::DOUBLE * 0.0065::DOUBLE))"

ISD_CTE = f"""
parsed AS (SELECT *, CASE WHEN temperature_c IS NOT NULL THEN round(round(temperature_c * 10, 0) / 10.0::DOUBLE, 2) END AS t,
  CASE WHEN dew_point_c IS NOT NULL THEN round(round(dew_point_c * 10, 0) / 10.0::DOUBLE, 2) END AS d FROM observations),
isd AS (SELECT station_id, date_trunc('second', obs_ts) AS obs_ts, t AS temperature_c, d AS dew_point_c, {rh_sql('t', 'd')} AS relative_humidity_pct,
  sea_level_pressure_hpa, CASE WHEN station_pressure_hpa BETWEEN 300 AND 1080 THEN station_pressure_hpa END AS station_pressure_hpa, report_type,
  CASE WHEN t IS NULL AND d IS NULL AND sea_level_pressure_hpa IS NULL THEN 'MISSING' ELSE 'VALID' END AS data_quality_status,
  CASE WHEN t IS NULL THEN '9' ELSE '1' END AS tmp_qc, CASE WHEN station_pressure_hpa BETWEEN 300 AND 1080 THEN '1' END AS stp_qc,
  CASE WHEN ({rh_sql('t', 'd')}) IS NOT NULL THEN 'derived_from_temperature_and_dew_point' END AS relative_humidity_source,
  concat_ws(',', CASE WHEN t > 60 OR t < -50 THEN 'TEMPERATURE_C_OUT_OF_BOUNDS' END, CASE WHEN d > 60 OR d < -80 THEN 'DEW_POINT_C_OUT_OF_BOUNDS' END) AS reasons FROM parsed)"""

VIOLATIONS = f"""concat_ws(',', CASE WHEN temperature_c < -50 OR temperature_c > 60 THEN 'TEMPERATURE_OUT_OF_BOUNDS' END,
  CASE WHEN relative_humidity_pct < 0 OR relative_humidity_pct > 100 THEN 'HUMIDITY_OUT_OF_BOUNDS' END,
  CASE WHEN sea_level_pressure_hpa < 500 OR sea_level_pressure_hpa > 1080 THEN 'PRESSURE_OUT_OF_BOUNDS' END,
  CASE WHEN coalesce(dew_point_c > temperature_c + 0.2, FALSE) OR coalesce(abs({rh_sql('temperature_c', 'dew_point_c')} - relative_humidity_pct) > 15, FALSE) THEN 'HUMIDITY_TRIO_INCONSISTENT' END,
  CASE WHEN abs(round(sea_level_pressure_hpa * {BARO}, 2) - station_pressure_hpa) > 6 THEN 'PRESSURE_PAIR_INCONSISTENT' END)"""

ORACLES = {
    "archive_csv_observations": oracle("SELECT * EXCLUDE (reasons) FROM isd WHERE reasons = ''", ISD_CTE,
                                       doubles=[TEMP, DEW, RH, SLP, STNP]),
    "archive_csv_quarantine": oracle("SELECT station_id, obs_ts, temperature_c, reasons FROM isd WHERE reasons <> ''", ISD_CTE, doubles=[TEMP]),
    "archive_scaled_fields": oracle(
        """SELECT CASE qc WHEN '1' THEN 'VALID' WHEN '3' THEN 'ERROR' ELSE 'UNKNOWN' END AS status, qc, count(*) AS n, count(v) AS with_value, sum(v) AS total FROM (
        SELECT CASE WHEN t10 IS NULL THEN '9' WHEN abs(t10) % 10 = 0 THEN '3' WHEN abs(t10) % 10 = 5 THEN '9' ELSE '1' END AS qc,
        CASE WHEN abs(t10) % 10 NOT IN (0, 5) THEN t10 / 10.0::DOUBLE END AS v FROM (SELECT CAST(round(temperature_c * 10, 0) AS BIGINT) AS t10 FROM observations)) GROUP BY 1, 2""",
        doubles=["total"]),
    "generic_csv_observations": oracle(
        """SELECT station_id, obs_ts, temperature_c, relative_humidity_pct, sea_level_pressure_hpa, station_pressure_hpa, latitude, 77.2090::DOUBLE AS longitude,
        216.0::DOUBLE AS elevation_m, data_quality_status, is_fault FROM observations WHERE NOT coalesce(temperature_c > 60, FALSE)""", doubles=["latitude"]),
    "provider_json_observations": oracle(
        """SELECT event_id, station_id, obs_ts, temperature_c, relative_humidity_pct, sea_level_pressure_hpa, station_pressure_hpa,
        CASE event_id % 4 WHEN 0 THEN 'LIVE_API_CURRENT' WHEN 1 THEN 'LIVE_API_HOURLY' ELSE 'LIVE_API_FLAT' END AS report_type, data_quality_status
        FROM observations WHERE event_id % 4 <> 3 AND NOT coalesce(temperature_c > 60, FALSE)
        UNION ALL SELECT event_id, station_id, obs_ts + INTERVAL 30 MINUTE, NULL, 50.0, 1010.5, NULL, 'LIVE_API_HOURLY', 'SUSPECT' FROM observations WHERE event_id % 4 = 1"""),
    "provider_json_quarantine": oracle(
        """SELECT event_id, station_id, CASE WHEN event_id % 4 = 3 THEN 'PAYLOAD_NOT_RECOGNISED' ELSE 'TEMPERATURE_C_OUT_OF_BOUNDS' END AS reasons
        FROM observations WHERE event_id % 4 = 3 OR temperature_c > 60"""),
    "humidity_functions": oracle(
        f"""SELECT event_id, 6.1078::DOUBLE * exp(17.625::DOUBLE * temperature_c / (243.04::DOUBLE + temperature_c)) AS saturation_hpa,
        6.1078::DOUBLE * exp(17.625::DOUBLE * dew_point_c / (243.04::DOUBLE + dew_point_c)) AS actual_hpa,
        {rh_sql('temperature_c', 'dew_point_c')} AS rh_clamped, {rh_sql('temperature_c', 'dew_point_c', False)} AS rh_raw FROM observations""",
        doubles=["saturation_hpa", "actual_hpa"]),
    "pressure_functions": oracle(
        f"""SELECT event_id, round(sea_level_pressure_hpa * {BARO}, 2) AS as_station, round(station_pressure_hpa / {BARO}, 2) AS as_sea_level, {FILLED} AS slp_filled FROM observations"""),
    "humidity_trio_consistency": oracle(
        f"""SELECT event_id, reason IS NULL AS ok, reason FROM (SELECT event_id, CASE WHEN dew_point_c > temperature_c + 0.2 THEN 'DEW_POINT_ABOVE_TEMPERATURE'
        WHEN abs({rh_sql('temperature_c', 'dew_point_c')} - relative_humidity_pct) > 5 THEN 'RH_DIVERGES_FROM_DEW_POINT' END AS reason FROM observations)"""),
    "joint_state_violations": oracle(f"SELECT event_id, {VIOLATIONS} AS violations FROM observations"),
    "physical_bounds_check": oracle(
        """SELECT event_id, concat_ws(',', CASE WHEN temperature_c < -50 OR temperature_c > 60 THEN 'TEMPERATURE_C_OUT_OF_BOUNDS' END,
        CASE WHEN dew_point_c < -80 OR dew_point_c > 60 THEN 'DEW_POINT_C_OUT_OF_BOUNDS' END) AS reasons FROM observations"""),
    "qualification_gate": oracle(
        """SELECT event_id, failed = '' AS is_qualified, failed FROM (SELECT event_id, concat_ws(',',
        CASE WHEN event_id % 17 = 0 AND station_id <> 'S00' THEN 'station_identity_valid' END,
        CASE WHEN temperature_c > 60 OR temperature_c < -50 THEN 'temperature_physically_valid' END,
        CASE WHEN event_id % 13 = 0 THEN 'pressure_semantics_confirmed' END,
        CASE WHEN dew_point_c > temperature_c + 0.5 THEN 'physical_consistency_valid' END,
        CASE WHEN event_id % 11 = 0 THEN 'source_provenance_retained' END) AS failed FROM observations)"""),
    "qc_code_rollup": oracle(
        """SELECT event_id, CASE WHEN len(s) = 0 THEN 'MISSING' WHEN list_contains(s, 'ERROR') THEN 'ERROR' WHEN list_contains(s, 'SUSPECT') THEN 'SUSPECT'
        WHEN list_contains(s, 'UNKNOWN') THEN 'UNKNOWN' ELSE 'VALID' END AS status FROM (SELECT event_id, list_filter([
        CASE WHEN temperature_c IS NOT NULL THEN ['VALID','VALID','SUSPECT','ERROR','VALID','VALID','SUSPECT','ERROR','UNKNOWN','UNKNOWN'][event_id % 10 + 1] END,
        CASE WHEN relative_humidity_pct IS NOT NULL THEN ['VALID','VALID','VALID','UNKNOWN'][event_id % 4 + 1] END,
        CASE WHEN sea_level_pressure_hpa IS NOT NULL THEN 'VALID' END], lambda x: x IS NOT NULL) AS s FROM observations)"""),
    "report_type_filter": oracle("SELECT station_id, report_type, count(*) AS n FROM observations WHERE report_type IN ('FM-12', 'FM-15') GROUP BY 1, 2"),
    "missing_value_cleaning": oracle("SELECT event_id, CASE WHEN event_id % 9 > 3 THEN value END AS cleaned FROM observations"),
    "timestamp_parsing_and_rounding": oracle(
        """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 1 THEN date_trunc('second', obs_ts) - INTERVAL 330 MINUTE ELSE date_trunc('second', obs_ts) END AS parsed,
        make_timestamp(CAST(round_even(epoch_us(obs_ts) / 1800000000.0::DOUBLE, 0) AS BIGINT) * 1800000000) AS half_hour FROM observations"""),
    "deterministic_identifiers": oracle(
        """SELECT event_id, 'obs_' || lower(source) || '_' || right(station_id, 6) || '_' || substr(sha256(concat_ws('::', source, station_id, strftime(obs_ts, '%Y-%m-%d %H:%M:%S.%f'))), 1, 16) AS observation_id,
        substr(sha256(concat_ws('::', station_id, CAST(temperature_c AS VARCHAR))), 1, 16) AS short_hash FROM observations"""),
    "error_categories_of_all_rows": oracle(
        """SELECT event_id, ['HTTP_429','HTTP_401','TIMEOUT','HTTP_5XX','PARSE_ERROR','SCHEMA_VIOLATION','NETWORK_ERROR'][event_id % 7 + 1] AS category,
        'https://x.test/v1?apikey=[REDACTED]&lat=1' AS url FROM observations"""),
    "source_catalogue": oracle(
        "SELECT c.source, c.provider, c.kind, c.is_live, count(o.event_id) AS rows FROM (VALUES "
        + ", ".join(f"('{s[0]}', '{s[1]}', '{s[2]}', {str(s[3]).upper()})" for s in sc.SOURCES)
        + """) c(source, provider, kind, is_live) LEFT JOIN (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'OPEN_METEO' ELSE source END AS source FROM observations) o USING (source) GROUP BY ALL"""),
    "run_history": oracle("""SELECT 'run_1' AS run_id, 'events' AS dataset_id, '1.0.0' AS dataset_version, 'HISTORICAL_CSV' AS source_type, count(*) AS rows,
        min(obs_ts) AS first_ts, max(obs_ts) AS last_ts FROM observations"""),
    "json_flag_access": oracle("SELECT event_id, CASE WHEN temperature_c IS NULL THEN '9' ELSE '1' END AS tmp_qc, event_type AS src FROM observations"),
}
