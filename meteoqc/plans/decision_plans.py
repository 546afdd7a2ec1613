"""Scores, evidence, decisions, events and station health over the observation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.functions import scores as sco
from meteoqc.operators import decision as dc
from meteoqc.operators import features as ft
from meteoqc.operators import health as hl
from meteoqc.operators import lookups as lk
from meteoqc.operators import spatial as sp
from meteoqc.operators.staging import staged
from meteoqc.plans.common import oracle, publish
from meteoqc.plans.feature_plans import deviation_cte, persistence_cte, rate_cte, roll_cte
from meteoqc.plans.ingest_plans import rh_sql
from meteoqc.plans.profile_plans import repeated
from meteoqc.plans.spatial_plans import CONTEXT
from meteoqc.schema import KEY, RH, SLP, TEMP, TS
from meteoqc.sources.tables import observations

# the event table reports a station every hour or two, not every five minutes
RULES = dc.Rules(gap_minutes=240.0, gap_critical_minutes=480.0)
HEALTH = hl.HealthRules(window_hours=168.0, nominal_minutes=60.0)
ID = [KEY, TS]


def edges_of(obs):
    return sp.neighbour_edges(sp.stations(obs))


def decided(obs):
    return dc.decisions(obs, edges_of(obs), RULES)


def decided_table(obs):
    return staged(decided(obs))


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def scores(obs):
    f = ft.time_features(obs, windows=("24h",), cols=[TEMP, RH, SLP], lags=(), ref="24h", persistence=False)
    return f.select(*ID, sco.threshold_score(F.col(f"{TEMP}_rate_per_5min")).alias("threshold_score"), sco.max_abs_z("24h").alias("max_z"),
                    sco.zscore_score("24h").alias("zscore_score"), (sco.max_abs_z("24h") >= 3.0).alias("z_flag"))


def evidence(obs):
    e = dc.evidence(dc.evidence_inputs(obs, edges_of(obs), "24h"), RULES, ref="24h")
    return e.select(
        *ID, F.array_join("data_quality.missing_fields", ",").alias("missing_fields"), F.col("data_quality.is_physical_out_of_bounds").alias("out_of_bounds"),
        F.col("data_quality.communication_gap_minutes").alias("gap_minutes"), F.col("ml_anomaly.normalized_anomaly_score").alias("score"),
        F.col("ml_anomaly.ml_is_anomaly").alias("is_anomaly"), F.col("temporal.temp_rate_per_min").alias("rate"),
        F.col("temporal.consecutive_unchanged_count").alias("unchanged"), F.col("temporal.is_rate_abnormal").alias("rate_abnormal"),
        F.col("multivariate.temp_rh_inconsistent").alias("humidity_inconsistent"), F.col("spatial.context_category").alias("category"),
        F.col("spatial.temp_target_minus_mean").alias("minus_mean"))


def decision_rows(obs):
    return decided(obs).select(*ID, "gate", "decision", "severity", F.array_join("reason_codes", ",").alias("reasons"), "recommended_action")


def events(obs):
    return dc.anomaly_events(decided(obs)).select("event_id", *ID, "decision", "severity", F.array_join("reason_codes", ",").alias("reasons"))


def cube(obs):
    return dc.decision_cube(decided(obs)).select(KEY, "decision", "severity", "period", "n")


def event_page(obs):
    ev = dc.anomaly_events(decided_table(obs))
    rows = lk.where(ev, severity="HIGH", start="2024-01-05", end="2024-01-25")
    return lk.page(rows, [F.col(TS).desc(), F.col(KEY)], limit=20, offset=5).select("event_id", *ID, "decision", "severity", "total_count", "has_more")


def alerts(obs):
    return lk.newest_first(dc.anomaly_events(decided(obs)), 25).select("event_id", *ID, "severity")


def statistics(obs):
    s = hl.window_statistics(hl.windowed(decided_table(obs), HEALTH), HEALTH)
    return s.select(KEY, "window", *STAT_INTS, *STAT_DOUBLES, *STAT_BOOLS)


def components(obs):
    s = hl.component_scores(hl.window_statistics(hl.windowed(decided_table(obs), HEALTH), HEALTH), HEALTH)
    return s.select(KEY, "window", *HEALTHS, F.array_join("reason_codes", ",").alias("reasons"))


def health(obs):
    h = hl.station_health(decided_table(obs), HEALTH)
    return h.withColumn("reasons", F.array_join("reason_codes", ",")).drop("reason_codes", "summary")


def channels(obs):
    return hl.parameter_health(hl.window_statistics(hl.windowed(decided_table(obs), HEALTH), HEALTH))


def cards(obs):
    d = decided_table(obs)
    h = hl.station_health(d, HEALTH).select(KEY, "overall_health", "status_band")
    ev = dc.anomaly_events(d)
    return lk.station_cards(sp.stations(obs), obs, ev, h)


STAT_INTS = ["observations", "anomalies", "genuine_events", "longest_run", "missing_fields", "duplicates", "out_of_order", "malformed",
             "gap_episodes", "flatline_episodes", "max_flatline_steps", "isolated", "agreeing", "regional"]
STAT_DOUBLES = ["severity_weighted", "anomaly_rate", "defect_rate", "isolation_rate", "gap_minutes", "max_gap_minutes", "flatline_minutes",
                "dt_drift", "dt_persistence", "dt_trend", "z_drift", "z_persistence", "z_trend"]
STAT_BOOLS = ["is_repeated", "is_persistent", "is_stuck", "dt_significant", "z_significant"]
HEALTHS = ["anomaly_health", "quality_health", "communication_health", "temporal_health", "spatial_health"]

def feed_rows(obs):
    d = dc.feed_decisions(repeated(obs), edges_of(obs), RULES)
    return d.select("event_id", *ID, "decision", "severity", F.array_join("reason_codes", ",").alias("reasons"))


QUERIES = {
    "decision_cascade_of_repeated_feed": _q(feed_rows),
    "detector_scores": _q(scores),
    "evidence_package": _q(evidence),
    "decision_cascade": _q(decision_rows),
    "anomaly_events": _q(events),
    "decision_cube": _q(cube),
    "decision_reason_counts": _q(lambda o: dc.reason_counts(decided(o))),
    "anomaly_event_page": _q(event_page),
    "newest_alerts_by_severity": _q(alerts),
    "health_window_statistics": _q(statistics),
    "health_components": _q(components),
    "station_health": _q(health),
    "parameter_health": _q(channels),
    "station_cards": _q(cards),
}

# --- oracle side ---------------------------------------------------------------------------
Z24 = "greatest(" + ", ".join(f"coalesce(abs({c}_zscore_24h), 0.0)" for c in (TEMP, RH, SLP)) + ")"
FEATURES = (roll_cte(["24h"], [TEMP, RH, SLP]), rate_cte("rolled", [TEMP, RH, SLP]), deviation_cte("24h"), persistence_cte())
BAD = "(temperature_c < -50 OR temperature_c > 60 OR relative_humidity_pct < 0 OR relative_humidity_pct > 100 OR sea_level_pressure_hpa < 870 OR sea_level_pressure_hpa > 1085)"
EVIDENCE_CTE = f"""
ev AS (SELECT p.event_id AS eid, p.station_id, p.obs_ts, p.temperature_c, p.relative_humidity_pct, p.sea_level_pressure_hpa, p.is_fault,
  concat_ws(',', CASE WHEN temperature_c IS NULL THEN 'temperature_c' END, CASE WHEN relative_humidity_pct IS NULL THEN 'relative_humidity_pct' END,
    CASE WHEN sea_level_pressure_hpa IS NULL THEN 'sea_level_pressure_hpa' END) AS missing_fields,
  (temperature_c IS NULL)::INT + (relative_humidity_pct IS NULL)::INT + (sea_level_pressure_hpa IS NULL)::INT AS n_missing,
  coalesce({BAD}, FALSE) AS out_of_bounds, elapsed_minutes AS gap_minutes, tanh({Z24} / 3.0) AS score, tanh({Z24} / 3.0) >= 0.65 AS is_anomaly,
  temperature_c_rate_per_minute AS rate, temperature_c_consecutive_unchanged_count AS unchanged,
  temperature_c_duration_unchanged_minutes AS flat_minutes, temperature_c_zscore_24h AS z24,
  coalesce(abs(temperature_c_rate_per_minute) > 0.5, FALSE) AS rate_abnormal,
  coalesce(dew_point_c > temperature_c + 0.2, FALSE) OR coalesce(abs({rh_sql('temperature_c', 'dew_point_c')} - relative_humidity_pct) > 15, FALSE) AS humidity_inconsistent,
  coalesce(context_category, 'INSUFFICIENT_CONTEXT') AS category, c.temp_minus_mean AS minus_mean, c.temp_zscore AS sz,
  c.temp_idw, c.rh_idw, c.slp_idw, c.temp_n, c.rh_n, c.slp_n, c.temp_std, c.rh_std, c.slp_std, c.temp_km, c.rh_km, c.slp_km, p.station_pressure_hpa, p.dew_point_c, p.elevation_m, c.valid_neighbors
  FROM persisted p LEFT JOIN context c USING (station_id, obs_ts))"""
STRONG = "(score >= 0.65)"
ACT = """CASE gate WHEN 'data_quality' THEN 'Leave the sensors alone until a sound record arrives.' WHEN 'bounds' THEN 'Take the value out of forecasts until the sensor has been bypassed or replaced.'
  WHEN 'flatline' THEN 'Read the channel at the logger. If it does not move there either, clean or thaw the sensor head.' WHEN 'multivariate' THEN 'Put a reference hygrometer beside the station for a day.'
  WHEN 'regional_mixed' THEN 'Judge this station again once the weather has passed.' WHEN 'local' THEN 'Look through the service log of the station for the last days. Swap in a spare sensor and compare both for a day.'
  WHEN 'no_context' THEN 'Wait until more of the surroundings report, then judge again.' WHEN 'nominal' THEN 'Nothing to do.' ELSE 'Keep the reading; it is weather.' END"""
DECISION_CTE = f"""
gated AS (SELECT *, CASE WHEN n_missing > 0 OR coalesce(gap_minutes, 0) > 240 THEN 'data_quality' WHEN out_of_bounds THEN 'bounds'
  WHEN unchanged >= 6 THEN 'flatline' WHEN humidity_inconsistent THEN 'multivariate' WHEN NOT (score >= 0.40 OR rate_abnormal) THEN 'nominal'
  WHEN category = 'REGIONAL_PATTERN' AND (abs(coalesce(sz, 0)) >= 3 OR abs(coalesce(minus_mean, 0)) >= 6.25) THEN 'regional_mixed'
  WHEN category = 'REGIONAL_PATTERN' THEN 'regional' WHEN category = 'LOCAL_ONLY' THEN 'local' WHEN category = 'LOCAL_CLUSTER' THEN 'cluster'
  ELSE 'no_context' END AS gate FROM ev),
decided AS (SELECT *, CASE gate {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in dc.GATE_DECISION.items())} END AS decision,
  CASE gate WHEN 'data_quality' THEN CASE WHEN coalesce(gap_minutes, 0) >= 480 THEN 'CRITICAL' WHEN temperature_c IS NULL OR n_missing >= 2 THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN 'bounds' THEN 'CRITICAL' WHEN 'flatline' THEN CASE WHEN unchanged >= 12 THEN 'HIGH' ELSE 'MEDIUM' END WHEN 'regional_mixed' THEN 'HIGH'
  WHEN 'regional' THEN CASE WHEN {STRONG} THEN 'LOW' ELSE 'INFO' END WHEN 'local' THEN CASE WHEN score >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN 'cluster' THEN 'LOW' WHEN 'nominal' THEN 'INFO' ELSE 'MEDIUM' END AS severity,
  CASE gate WHEN 'data_quality' THEN concat_ws(',', CASE WHEN n_missing > 0 THEN 'MISSING_REQUIRED_VARIABLES' END, CASE WHEN coalesce(gap_minutes, 0) > 240 THEN 'DATA_GAP' END)
  WHEN 'bounds' THEN 'OUT_OF_RANGE_PHYSICAL' WHEN 'flatline' THEN 'PERSISTENT_VALUE' WHEN 'multivariate' THEN 'MULTIVARIATE_DEVIATION' WHEN 'nominal' THEN 'NOMINAL_OBSERVATION'
  ELSE concat_ws(',', CASE WHEN score >= 0.8 THEN 'ML_HIGH_ANOMALY_SCORE' WHEN {STRONG} THEN 'ML_MODERATE_ANOMALY_SCORE' END,
    CASE gate WHEN 'regional_mixed' THEN 'MIXED_REGIONAL_EVENT_WITH_LOCAL_EXCESS,REGIONAL_SPATIAL_AGREEMENT'
    WHEN 'regional' THEN 'REGIONAL_SPATIAL_AGREEMENT' || CASE WHEN rate_abnormal THEN ',RAPID_RATE_OF_CHANGE' ELSE '' END
    WHEN 'local' THEN 'LOCAL_SPATIAL_ISOLATION' WHEN 'cluster' THEN 'LOCAL_CLUSTER_AGREEMENT' ELSE 'INSUFFICIENT_SPATIAL_CONTEXT,CONFLICTING_EVIDENCE' END) END AS reasons FROM gated),
event_rows AS (SELECT 'ANOM-' || strftime(obs_ts, '%Y%m%d') || '-' || right(station_id, 6) || '-' ||
  lpad(CAST(row_number() OVER (PARTITION BY station_id, strftime(obs_ts, '%Y%m%d') ORDER BY obs_ts) AS VARCHAR), 4, '0') AS event_id, * EXCLUDE (eid)
  FROM decided WHERE decision NOT IN ('NORMAL', 'POSSIBLE_GENUINE_EVENT'))"""
DECIDED = (*CONTEXT, *FEATURES, EVIDENCE_CTE, DECISION_CTE)


def _drift(p, v, i):
    return (f"count({v}) AS {p}_n, avg(abs({v})) AS {p}_ma, avg(CASE WHEN {v} IS NOT NULL THEN CASE WHEN {v} >= 1.5 THEN 1.0 ELSE 0.0 END END) AS {p}_hi, "
            f"avg(CASE WHEN {v} IS NOT NULL THEN CASE WHEN {v} <= -1.5 THEN 1.0 ELSE 0.0 END END) AS {p}_lo, regr_slope({v}, CASE WHEN {v} IS NOT NULL THEN {i} END) AS {p}_sl")


def _drift_out(p):
    return (f"round(coalesce({p}_ma, 0), 3) AS {p}_drift, round(coalesce(greatest({p}_hi, {p}_lo), 0)::DOUBLE, 3) AS {p}_persistence, "
            f"round(CASE WHEN {p}_n >= 5 THEN {p}_sl ELSE 0.0 END, 4) AS {p}_trend, coalesce(greatest({p}_hi, {p}_lo), 0) >= 0.4 AND coalesce({p}_ma, 0) >= 2.0 AS {p}_significant")


PEN = "CASE severity WHEN 'INFO' THEN 0.0 WHEN 'LOW' THEN 0.25 WHEN 'MEDIUM' THEN 0.6 WHEN 'HIGH' THEN 1.0 ELSE 2.0 END"
HEALTH_CTE = f"""
aged AS (SELECT *, (epoch_us(max(obs_ts) OVER (PARTITION BY station_id)) - epoch_us(obs_ts)) / 3600000000.0::DOUBLE AS age FROM decided),
win AS (SELECT *, CASE WHEN age <= 168 THEN 'cur' ELSE 'prev' END AS "window", CASE WHEN age <= 168 THEN exp(-1.5::DOUBLE * age / 168.0) ELSE 1.0::DOUBLE END AS w,
  decision IN ('PROBABLE_SENSOR_ANOMALY', 'PROBABLE_DATA_QUALITY_ISSUE') AS anom, decision = 'POSSIBLE_GENUINE_EVENT' AS genuine,
  CASE WHEN decision <> 'POSSIBLE_GENUINE_EVENT' THEN coalesce(minus_mean, z24) END AS dt, CASE WHEN decision <> 'POSSIBLE_GENUINE_EVENT' THEN z24 END AS zz,
  CASE WHEN gap_minutes > 120 THEN gap_minutes END AS gap, unchanged >= 6 AS flat FROM aged WHERE age <= 336),
idx AS (SELECT *, sum(CASE WHEN dt IS NOT NULL THEN 1 ELSE 0 END) OVER wo AS it, sum(CASE WHEN zz IS NOT NULL THEN 1 ELSE 0 END) OVER wo AS iz,
  sum(CASE WHEN anom THEN 0 ELSE 1 END) OVER wo AS grp FROM win WINDOW wo AS (PARTITION BY station_id, "window" ORDER BY obs_ts)),
runs AS (SELECT station_id, "window", max(c) AS longest_run FROM (SELECT station_id, "window", grp, count(*) AS c FROM idx WHERE anom GROUP BY ALL) GROUP BY ALL),
sums AS (SELECT station_id, "window", count(*) AS observations, count(CASE WHEN anom THEN 1 END) AS anomalies, count(CASE WHEN genuine THEN 1 END) AS genuine_events,
  sum(CASE WHEN anom THEN w * {PEN} END) AS sev, sum(w) AS sw, sum(CASE WHEN n_missing > 0 THEN w END) AS defw, sum(n_missing) AS missing_fields,
  0 AS duplicates, 0 AS out_of_order, 0 AS malformed, round(coalesce(sum(gap), 0), 1) AS gap_minutes, count(gap) AS gap_episodes, round(coalesce(max(gap), 0), 1) AS max_gap_minutes,
  count(CASE WHEN flat THEN 1 END) AS flatline_episodes, round(coalesce(sum(CASE WHEN flat THEN flat_minutes END), 0), 1) AS flatline_minutes,
  coalesce(max(CASE WHEN flat THEN unchanged END), 0) AS max_flatline_steps, count(CASE WHEN category = 'LOCAL_ONLY' THEN 1 END) AS isolated,
  count(CASE WHEN category IN ('REGIONAL_PATTERN', 'LOCAL_CLUSTER') THEN 1 END) AS agreeing, count(CASE WHEN category = 'REGIONAL_PATTERN' THEN 1 END) AS regional,
  {_drift('dt', 'dt', 'it')}, {_drift('z', 'zz', 'iz')} FROM idx GROUP BY ALL),
stats AS (SELECT s.*, coalesce(r.longest_run, 0) AS longest_run, round(coalesce(sev, 0) / (sw / observations), 3) AS severity_weighted,
  round(anomalies / observations * 100.0, 2) AS anomaly_rate, round(coalesce(defw, 0) / (sw / observations) / observations, 3) AS defect_rate,
  round(isolated / observations, 3) AS isolation_rate, anomalies >= 3 AS is_repeated, coalesce(r.longest_run, 0) >= 4 AS is_persistent,
  max_flatline_steps >= 12 OR flatline_minutes >= 60 AS is_stuck, {_drift_out('dt')}, {_drift_out('z')} FROM sums s LEFT JOIN runs r USING (station_id, "window")),
comp AS (SELECT *, round(100.0 - least(100.0, severity_weighted / greatest(1.0, 0.12::DOUBLE * observations) * 100.0), 1) AS anomaly_health,
  round(100.0 - least(100.0, defect_rate / 0.15::DOUBLE * 100.0), 1) AS quality_health,
  round(100.0 - least(100.0, gap_minutes / {max(1.0, 168.0 * 60.0 * 0.15)!r}::DOUBLE * 100.0), 1) AS communication_health,
  round(100.0 - least(100.0, flatline_minutes / {max(1.0, 168.0 * 60.0 * 0.10)!r}::DOUBLE * 100.0), 1) AS temporal_health,
  round(100.0 - least(100.0, least(100.0, isolation_rate / 0.15::DOUBLE * 100.0) + CASE WHEN dt_significant THEN 30.0 ELSE 0.0 END), 1) AS spatial_health,
  CASE WHEN r = '' THEN 'NOMINAL_OPERATION' ELSE r END AS reasons FROM (SELECT *, concat_ws(',', CASE WHEN is_persistent THEN 'PERSISTENT_ANOMALY' WHEN is_repeated THEN 'REPEATED_ANOMALIES' END,
    CASE WHEN missing_fields > 0 THEN 'HIGH_MISSING_RATE' END, CASE WHEN gap_episodes > 0 THEN 'COMMUNICATION_INSTABILITY' END, CASE WHEN is_stuck THEN 'PERSISTENT_FLATLINE' END,
    CASE WHEN dt_significant THEN 'INCREASING_DRIFT' END, CASE WHEN isolated >= 3 THEN 'REPEATED_LOCAL_SPATIAL_DEVIATION' END) AS r FROM stats)),
overall AS (SELECT *, round(0.30::DOUBLE * anomaly_health + 0.20::DOUBLE * quality_health + 0.15::DOUBLE * communication_health + 0.20::DOUBLE * temporal_health + 0.15::DOUBLE * spatial_health, 6) AS raw FROM comp),
channel AS (SELECT station_id, p AS parameter, greatest(0.0::DOUBLE, round(100.0 - CASE WHEN sig THEN least(40.0, d * 8.0) ELSE 0.0 END
  - CASE WHEN is_stuck THEN least(50.0, flatline_minutes * 0.5) ELSE 0.0 END - least(30.0, anomalies * 5.0), 1)) AS health_score, CASE WHEN sig THEN d END AS drift_indicator, flatline_minutes
  FROM (SELECT *, 'temperature_c' AS p, dt_drift AS d, dt_significant AS sig FROM overall WHERE "window" = 'cur'
  UNION ALL SELECT *, 'relative_humidity', z_drift, z_significant FROM overall WHERE "window" = 'cur'
  UNION ALL SELECT *, 'sea_level_pressure_hpa', z_drift, z_significant FROM overall WHERE "window" = 'cur'))"""


def band_sql(x):
    return f"CASE WHEN {x} >= 90 THEN 'HEALTHY' WHEN {x} >= 75 THEN 'GOOD' WHEN {x} >= 50 THEN 'ATTENTION' WHEN {x} >= 25 THEN 'DEGRADED' WHEN {x} IS NOT NULL THEN 'CRITICAL' END"


SUMMARY_CTE = f"""
h1 AS (SELECT c.*, c.observations >= 12 AS enough, CASE WHEN c.observations >= 12 THEN round(c.raw, 1) END AS overall_health,
  CASE WHEN c.observations >= 12 AND p.observations >= 12 THEN round(round(c.raw, 1) - p.raw, 1) END AS health_delta,
  (SELECT bool_or({band_sql('ch.health_score')} IN ('CRITICAL', 'DEGRADED')) FROM channel ch WHERE ch.station_id = c.station_id) AS bad_channel
  FROM overall c LEFT JOIN (SELECT * FROM overall WHERE "window" = 'prev') p USING (station_id) WHERE c."window" = 'cur'),
h2 AS (SELECT *, coalesce({band_sql('overall_health')}, 'INSUFFICIENT_HISTORY') AS status_band,
  CASE WHEN NOT enough THEN 'INSUFFICIENT_HISTORY' WHEN health_delta >= 3 THEN 'IMPROVING' WHEN health_delta <= -3 THEN 'DEGRADING' ELSE 'STABLE' END AS trend FROM h1),
health AS (SELECT station_id, observations, overall_health, health_delta, status_band, trend,
  CASE WHEN NOT enough THEN 'MONITOR' WHEN status_band = 'CRITICAL' OR (status_band = 'DEGRADED' AND trend = 'DEGRADING') THEN 'PRIORITY_INSPECTION'
  WHEN status_band = 'DEGRADED' OR (status_band = 'ATTENTION' AND trend = 'DEGRADING') OR bad_channel OR is_stuck OR is_persistent THEN 'INSPECT'
  WHEN status_band = 'ATTENTION' OR trend = 'DEGRADING' THEN 'MONITOR' ELSE 'NO_ACTION' END AS recommendation,
  CASE WHEN NOT enough THEN 'INSUFFICIENT_OBSERVATION_HISTORY' WHEN trend = 'IMPROVING' THEN reasons || ',RECENT_RECOVERY_OBSERVED' ELSE reasons END AS reasons,
  {', '.join(f'CASE WHEN enough THEN {c} ELSE 100.0::DOUBLE END AS {c}' for c in HEALTHS)} FROM h2)"""

EV_D = ["gap_minutes", "score", "rate", "minus_mean"]
FEED_CTE = """
feed AS (SELECT event_id, station_id, obs_ts, source, ingestion_ts FROM observations UNION ALL
  SELECT event_id + 10000000, station_id, obs_ts, source, ingestion_ts + INTERVAL 1 HOUR FROM observations WHERE event_id % 50 = 0),
arrived AS (SELECT event_id AS row_id, station_id, obs_ts, row_number() OVER (PARTITION BY station_id, obs_ts, source ORDER BY ingestion_ts, event_id) > 1 AS dup,
  coalesce(obs_ts < max(obs_ts) OVER (PARTITION BY station_id ORDER BY ingestion_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ooo FROM feed)"""
ORACLES = {
    "decision_cascade_of_repeated_feed": oracle(
        """SELECT row_id AS event_id, station_id, obs_ts, CASE WHEN dup OR ooo THEN 'PROBABLE_DATA_QUALITY_ISSUE' ELSE decision END AS decision,
        CASE WHEN NOT (dup OR ooo) THEN severity WHEN coalesce(gap_minutes, 0) >= 480 THEN 'CRITICAL' WHEN n_missing >= 2 OR contains(missing_fields, 'temperature_c') THEN 'HIGH' ELSE 'LOW' END AS severity,
        CASE WHEN NOT (dup OR ooo) THEN reasons ELSE concat_ws(',', CASE WHEN dup THEN 'DUPLICATE_TIMESTAMP' END, CASE WHEN ooo THEN 'OUT_OF_ORDER_TIMESTAMP' END,
        CASE WHEN n_missing > 0 THEN 'MISSING_REQUIRED_VARIABLES' END, CASE WHEN gap_minutes > 240 THEN 'DATA_GAP' END) END AS reasons
        FROM arrived JOIN decided USING (station_id, obs_ts)""", *DECIDED, FEED_CTE),
    "detector_scores": oracle(
        f"""SELECT station_id, obs_ts, greatest(coalesce(least(1.0, greatest(0.0, greatest(-50.0 - temperature_c, temperature_c - 60.0)) / 10.0), 0.0),
        coalesce(least(1.0, greatest(0.0, greatest(-relative_humidity_pct, relative_humidity_pct - 100.0)) / 20.0), 0.0),
        coalesce(least(1.0, greatest(0.0, greatest(500.0 - sea_level_pressure_hpa, sea_level_pressure_hpa - 1080.0)) / 50.0), 0.0),
        coalesce(least(1.0, greatest(0.0, (abs(temperature_c_rate_per_5min) - 5.0) / 5.0)), 0.0)) AS threshold_score, {Z24} AS max_z, tanh({Z24} / 3.0) AS zscore_score, {Z24} >= 3.0 AS z_flag FROM interacted""",
        *FEATURES[:3], doubles=["threshold_score", "max_z", "zscore_score"]),
    "evidence_package": oracle(
        "SELECT station_id, obs_ts, missing_fields, out_of_bounds, gap_minutes, score, is_anomaly, rate, unchanged, rate_abnormal, humidity_inconsistent, category, minus_mean FROM ev",
        *DECIDED[:-1], doubles=EV_D),
    "decision_cascade": oracle(f"SELECT station_id, obs_ts, gate, decision, severity, reasons, {ACT} AS recommended_action FROM decided", *DECIDED),
    "anomaly_events": oracle("SELECT event_id, station_id, obs_ts, decision, severity, reasons FROM event_rows", *DECIDED),
    "decision_cube": oracle(
        """SELECT station_id, decision, severity, period, count(*) AS n FROM (SELECT *, CASE WHEN hour(obs_ts) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS period FROM decided)
        GROUP BY GROUPING SETS ((station_id, decision), (station_id, severity), (station_id, decision, period), (decision))""", *DECIDED),
    "decision_reason_counts": oracle("SELECT station_id, reason, count(*) AS n FROM (SELECT station_id, unnest(string_split(reasons, ',')) AS reason FROM decided) GROUP BY ALL", *DECIDED),
    "anomaly_event_page": oracle(
        """SELECT event_id, station_id, obs_ts, decision, severity, total_count, total_count > 25 AS has_more FROM (SELECT *, count(*) OVER () AS total_count FROM event_rows
        WHERE severity = 'HIGH' AND obs_ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25') ORDER BY obs_ts DESC, station_id LIMIT 20 OFFSET 5""", *DECIDED),
    "newest_alerts_by_severity": oracle(
        """SELECT event_id, station_id, obs_ts, severity FROM event_rows ORDER BY list_position(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], severity) DESC, obs_ts DESC, station_id LIMIT 25""", *DECIDED),
    "health_window_statistics": oracle(f'SELECT station_id, "window", {", ".join(STAT_INTS + STAT_DOUBLES + STAT_BOOLS)} FROM stats', *DECIDED, HEALTH_CTE,
                                       doubles=STAT_DOUBLES, ints=STAT_INTS),
    "health_components": oracle(f'SELECT station_id, "window", {", ".join(HEALTHS)}, reasons FROM overall', *DECIDED, HEALTH_CTE, doubles=HEALTHS),
    "station_health": oracle("SELECT * FROM health", *DECIDED, HEALTH_CTE, SUMMARY_CTE, doubles=["overall_health", "health_delta", *HEALTHS]),
    "parameter_health": oracle(f"SELECT station_id, parameter, health_score, {band_sql('health_score')} AS status_band, drift_indicator, flatline_minutes FROM channel",
                               *DECIDED, HEALTH_CTE, doubles=["health_score", "drift_indicator", "flatline_minutes"]),
    "station_cards": oracle(
        """SELECT s.*, l.obs_ts AS last_seen, l.temperature_c AS latest_temp, l.relative_humidity_pct AS latest_rh, l.sea_level_pressure_hpa AS latest_slp,
        (SELECT count(*) FROM event_rows e WHERE e.station_id = s.station_id AND epoch_us(e.obs_ts) >= (SELECT max(epoch_us(obs_ts)) FROM observations) - 86400000000) AS active_anomalies,
        h.overall_health, h.status_band FROM stations s LEFT JOIN (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY obs_ts DESC) = 1) l USING (station_id)
        LEFT JOIN health h USING (station_id)""", *DECIDED, HEALTH_CTE, SUMMARY_CTE, doubles=["latitude", "longitude", "overall_health"]),
}
