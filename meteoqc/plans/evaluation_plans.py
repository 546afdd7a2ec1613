"""Labelled perturbation and detector evaluation over the observation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.functions import scores as sco
from meteoqc.operators import augment as au
from meteoqc.operators import decision as dc
from meteoqc.operators import episodes as ep
from meteoqc.operators import evaluate as ev
from meteoqc.operators import explain as xp
from meteoqc.operators import features as ft
from meteoqc.operators import spatial as sp
from meteoqc.operators.staging import staged
from meteoqc.plans.common import oracle, publish, replaced_observations
from meteoqc.plans.decision_plans import DECIDED, RULES, Z24, decided_table, edges_of
from meteoqc.plans.feature_plans import P, deviation_cte, rate_cte, roll_cte
from meteoqc.plans.repair_plans import MISSING_CTE, error_sql, hist_cte, impute_cte
from meteoqc.plans.spatial_plans import CONTEXT, NET, STATIONS_CTE, pairs_cte
from meteoqc.schema import KEY, RH, SLP, TEMP, TS
from meteoqc.sources.tables import observations

ID = [KEY, TS]
THRESHOLD = 0.6
VALUES = ["temperature_c", "relative_humidity_pct", "sea_level_pressure_hpa"]


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def _episodes(obs):
    return staged(au.choose_episodes(obs.sparkSession, obs))


def augmented(obs):
    return au.apply_episodes(obs, _episodes(obs)).select("event_id", *ID, *VALUES, "ingestion_ts")


def labelled(obs, windows=("24h",)):
    """(scored rows, episodes): perturbed readings with a z-score detector and the truth."""
    e = _episodes(obs)
    data = staged(ft.first_per_key(au.apply_episodes(obs, e)))
    return scored(data, au.labelled_events(e), windows[0]), e


def predicted(data, ref):
    f = ft.time_features(data, windows=(ref,), cols=[TEMP, RH, SLP], lags=(), ref=ref, persistence=False)
    rows = f.select("event_id", *ID, sco.zscore_score(ref).alias("score"), sco.threshold_score(F.col(f"{TEMP}_rate_per_5min")).alias("threshold_score"))
    return rows.withColumn("pred", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def scored(data, events, ref):
    return staged(ev.with_truth_of_events(predicted(data, ref), events))


def metrics(obs):
    rows, _ = labelled(obs)
    return ev.confusion(rows).join(F.broadcast(ev.curve_areas(rows)), F.lit(True))  # one row each


def events(obs):
    rows, e = labelled(obs)
    return ev.event_metrics(rows, staged(au.labels(obs, e)))


def hits(obs):
    rows, e = labelled(obs)
    return ev.hits_of_events(rows, au.labelled_events(e), obs)


def by_type(obs):
    return ev.recall_by(hits(obs), "anomaly_type")


def by_tier(obs):
    rows, e = labelled(obs)
    return ev.recall_by_tier(rows, staged(au.labels(obs, e)))


def genuine(obs):
    rows, e = labelled(obs)
    return ev.genuine_event_alarms(rows, staged(au.labels(obs, e)))


def clean_rows(obs):
    rows, e = labelled(obs)
    return ev.false_alarm_starts(rows, staged(au.labels(obs, e))).groupBy(KEY).agg(F.count(F.lit(1)).alias("clean_rows"), F.count(F.when(F.col("rising"), 1)).alias("false_alarms"))


def calibration(obs):
    rows, _ = labelled(obs)
    parts = [ev.calibrate(rows, m).withColumn("target", F.lit(m)) for m in ("f1", "precision", "balanced")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def comparison(obs):
    """Detectors and windows side by side: metrics per set, then mean and spread."""
    e = _episodes(obs)
    data = staged(ft.first_per_key(au.apply_episodes(obs, e)))
    per = None
    for ref in ("3h", "6h", "24h"):
        m = ev.confusion(scored(data, au.labelled_events(e), ref)).withColumn("set", F.lit(f"zscore_{ref}"))
        per = m if per is None else per.unionByName(m)
    return ev.compare_sets(staged(per), "set", ["precision", "recall", "f1", "fpr"])


def sweep(obs):
    rows, _ = labelled(obs)
    return ev.sweep_thresholds(rows, [0.3, 0.4, 0.5, 0.6, 0.65, 0.7, 0.8])


RADII = [25.0, 50.0, 100.0, 150.0, 300.0, 600.0, 1000.0, 1500.0]


def radius_sweep(obs):
    """Neighbour supply per search radius, a row for each radius; pairs are found once at the largest one."""
    pairs = sp.station_pairs(sp.stations(obs), max(RADII))
    radii = obs.sparkSession.createDataFrame([(r,) for r in RADII], "radius_km double")
    x = pairs.select("*", F.explode(F.array(*[F.lit(r) for r in RADII])).alias("radius_km")).filter(F.col("distance_km") <= F.col("radius_km"))
    per = x.groupBy("radius_km", KEY).agg(F.count(F.lit(1)).alias("n"), F.min("distance_km").alias("d"))
    found = per.groupBy("radius_km").agg(F.count(F.lit(1)).alias("connected"), F.avg("n").alias("mean_neighbours"), F.min("d").alias("nearest_km"))
    return radii.join(found, "radius_km", "left").fillna(0, ["connected", "mean_neighbours"])


def tolerance_sweep(obs):
    """Valid neighbours per reading for several time tolerances, from one as-of join."""
    m = sp.neighbour_matches(obs, edges_of(obs))
    tol = F.explode(F.array(*[F.lit(t) for t in (10, 30, 60, 120)])).alias("tolerance_minutes")
    fresh = F.abs("time_delta_seconds") <= F.col("tolerance_minutes") * 60
    return m.select("*", tol).groupBy("tolerance_minutes").agg(
        F.count(F.lit(1)).alias("pairs"), F.count(F.when(fresh, 1)).alias("fresh"), F.avg(F.when(fresh, F.abs("time_delta_seconds"))).alias("mean_age_seconds"))


def split(obs):
    s = ev.chronological_split(obs.select("event_id", *ID))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))


def date_split(obs):
    s = ev.split_by_dates(obs, "2024-01-19", "2024-01-25")
    return s.groupBy("split", KEY).agg(F.count(F.lit(1)).alias("rows"))


def causality(obs):
    """Rows of the features up to day 20 that change when everything later is altered (none)."""
    cut = F.lit("2024-01-20").cast("timestamp")
    changed = obs.withColumn(TEMP, F.when(F.col(TS) > cut, F.col(TEMP) + 30.0).otherwise(F.col(TEMP)))

    def run(df):
        f = ft.time_features(df, windows=("1h", "24h"), cols=[TEMP, RH, SLP])
        return f.filter(F.col(TS) <= cut).select(*ID, *[F.round(c, 6).alias(c) for c in f.columns if c.startswith(TEMP)])

    a = staged(run(obs))  # read three times
    diff = ev.first_missing(a, staged(run(changed))).agg(F.count(F.lit(1)).alias("differences"))
    return diff.join(F.broadcast(a.agg(F.count(F.lit(1)).alias("compared"))), F.lit(True))  # one row each


def episodes(obs):
    d = decided_table(obs)
    return ep.reconstruct(d)


def surroundings(obs):
    return ep.surroundings(decided_table(obs)).select(KEY, "onset", "side", TS, TEMP, "decision")


def meanwhile(obs):
    return ep.neighbours_during(ep.reconstruct(decided_table(obs)), obs, edges_of(obs))


def regional(obs):
    return au.regional_event(obs, edges_of(obs), "S07", "2024-01-10", 48, excess=6.5).select("event_id", *ID, *VALUES, "is_changed")


def outage(obs):
    left = au.regional_event(obs, edges_of(obs), "S07", "2024-01-10", 48, outage=True)
    return left.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"))


def scenarios(obs):
    s = au.apply_scenarios(au.with_steps(obs), au.scenario_table(obs))
    return s.select("event_id", KEY, "step", "scenario_id", "applied", *VALUES, "data_quality_status", "ts_text", "expected", "copy")


def scenario_rows(obs):
    w = au.scenario_window(au.with_steps(obs), au.scenario_table(obs))
    return w.groupBy("scenario_id", KEY).agg(F.count(F.lit(1)).alias("rows"), F.min("step").alias("first"), F.max("step").alias("last"))


def scenario_checks(obs):
    """Checks per scenario on what its transform left behind, and the pass rate of each check."""
    s = au.apply_scenarios(au.with_steps(obs), au.scenario_table(obs)).filter(F.col("applied") != "NONE")
    bad = F.col("data_quality_status").isin("ERROR", "MISSING", "SUSPECT")
    missing = F.col(TEMP).isNull() | F.col(RH).isNull() | F.col(SLP).isNull()
    checks = {
        "status_marked": F.when(F.col("applied").isin("IMPOSSIBLE_TEMPERATURE", "INVALID_RH", "INVALID_PRESSURE", "MISSING_TEMPERATURE", "MISSING_RH", "MISSING_PRESSURE", "OUT_OF_ORDER"), bad).otherwise(True),
        "value_missing": F.when(F.col("applied").startswith("MISSING"), missing).otherwise(True),
        "time_readable": F.col("applied").eqNullSafe("CORRUPTED_TIMESTAMP") != F.try_to_timestamp("ts_text").isNotNull(),
        "no_rows_left": F.col("expected") != "NO_ROWS",
    }
    long = s.select("scenario_id", *[c.alias(n) for n, c in checks.items()]).unpivot(["scenario_id"], list(checks), "check", "ok")
    return long.groupBy("check").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("ok"), 1)).alias("passed"))


def scenario_decisions(obs):
    """The decision cascade once over all scenarios side by side, judged where a scenario acts: detected, as expected, stored, explained."""
    changed = au.apply_scenarios(au.with_steps(obs), au.scenario_table(obs)).filter("copy = 1").drop("copy", "ts_text", "step", KEY, TS)
    rest = obs.drop(TEMP, RH, SLP, "data_quality_status")
    feed = staged(rest.join(changed, "event_id"))
    d = dc.decisions(feed, edges_of(obs), RULES).filter("applied != 'NONE'")
    told = xp.explain(d, RULES.gap_minutes).select("event_id", F.length("summary").alias("told"))
    stored = ~F.col("decision").isin("NORMAL", "POSSIBLE_GENUINE_EVENT")
    hit = F.col("decision") != "NORMAL"
    per = d.join(told, "event_id").groupBy("scenario_id", "applied", "expected").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(hit, 1)).alias("detected"), F.count(F.when(F.col("decision") == F.col("expected"), 1)).alias("as_expected"),
        F.count(F.when(stored, 1)).alias("stored"), F.count(F.when(F.col("severity").isin("HIGH", "CRITICAL"), 1)).alias("severe"),
        F.count(F.when(hit & (F.col("told") > 0) & (F.size("reason_codes") > 0), 1)).alias("explained"))
    wanted = F.col("expected") != "NORMAL"
    return per.withColumns({
        "detection_ok": F.when(wanted, F.col("detected") > 0).otherwise(F.col("stored") == 0), "classification_ok": F.col("as_expected") > 0,
        "explanation_ok": F.col("explained") == F.col("detected"), "protected_ok": (F.col("expected") != "POSSIBLE_GENUINE_EVENT") | (F.col("severe") == 0)})


QUERIES = {
    "scenario_decisions": _q(scenario_decisions),
    "augmented_observations": _q(augmented),
    "augmentation_labels": _q(lambda o: au.labels(o, _episodes(o))),
    "label_accounting": _q(lambda o: ev.label_accounting(staged(au.labels(o, _episodes(o))))),
    "detector_metrics": _q(metrics),
    "detector_metrics_per_station": _q(lambda o: ev.confusion(labelled(o)[0], [KEY])),
    "event_metrics": _q(events),
    "event_detections": _q(hits),
    "recall_by_anomaly_type": _q(by_type),
    "recall_by_severity_tier": _q(by_tier),
    "genuine_event_false_alarms": _q(genuine),
    "false_alarm_episodes": _q(clean_rows),
    "threshold_calibration": _q(calibration),
    "detector_set_comparison": _q(comparison),
    "threshold_sweep": _q(sweep),
    "radius_sweep": _q(radius_sweep),
    "tolerance_sweep": _q(tolerance_sweep),
    "chronological_split": _q(split),
    "date_split": _q(date_split),
    "causality_audit": _q(causality),
    "anomaly_episodes": _q(episodes),
    "episode_surroundings": _q(surroundings),
    "neighbours_during_episodes": _q(meanwhile),
    "regional_event_augmentation": _q(regional),
    "neighbour_outage_augmentation": _q(outage),
    "scenario_transforms": _q(scenarios),
    "scenario_windows": _q(scenario_rows),
    "scenario_checks": _q(scenario_checks),
}

# --- oracle side ---------------------------------------------------------------------------
KINDS = ", ".join(f"({i}, '{t}', {h}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {str(f).upper()}, '{v}')" for i, (t, h, a, b, c, f, v) in enumerate(au.EPISODES))


def bucket_sql(n, expr):
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT % {n})"


def episode_ctes(src):
    hours = "((epoch_us(o.obs_ts) - epoch_us(e.start_ts)) / 3600000000.0::DOUBLE)"
    temp = f"""CASE WHEN (anomaly_type = 'FROZEN_SENSOR' OR (anomaly_type = 'INTERMITTENT_FREEZE' AND CAST(floor({hours}) AS BIGINT) % 2 = 0)) AND o.temperature_c IS NOT NULL THEN start_temp
      ELSE round(o.temperature_c + CASE anomaly_type WHEN 'DRIFT' THEN d_temp * {hours} WHEN 'RANDOM_NOISE' THEN ({bucket_sql(2001, "CAST(o.event_id AS VARCHAR)")} - 1000) / 1000.0::DOUBLE * d_temp ELSE d_temp END + 1e-9::DOUBLE, 2) END"""
    return f"""
episodes AS (SELECT 'ANOM-' || substr(h, 1, 12) AS anomaly_id, station_id, obs_ts AS start_ts, obs_ts + to_hours(hours) AS end_ts, anomaly_type, temperature_c AS start_temp,
  d_temp, d_rh, d_slp, kf AS is_fault, affected FROM (SELECT station_id, obs_ts, temperature_c, md5('42|' || event_id) AS h FROM {src} WHERE temperature_c IS NOT NULL)
  JOIN (VALUES {KINDS}) kinds(i, anomaly_type, hours, d_temp, d_rh, d_slp, kf, affected) ON ('0x' || substr(h, 9, 8))::BIGINT % {len(au.EPISODES)} = i WHERE ('0x' || substr(h, 1, 8))::BIGINT % 300 = 0),
hit AS (SELECT o.event_id, o.station_id, o.obs_ts, e.anomaly_id, e.anomaly_type, e.affected, e.start_ts, e.end_ts, e.is_fault, o.temperature_c AS original_value, {temp} AS new_temp,
  CASE WHEN o.relative_humidity_pct IS NOT NULL THEN greatest(0.0, least(100.0, o.relative_humidity_pct + d_rh)) END AS new_rh, round(o.sea_level_pressure_hpa + d_slp + 1e-9::DOUBLE, 2) AS new_slp
  FROM {src} o JOIN episodes e ON o.station_id = e.station_id AND o.obs_ts BETWEEN e.start_ts AND e.end_ts),
labels AS (SELECT anomaly_id, station_id, obs_ts, anomaly_type, affected AS affected_variable, original_value, CASE WHEN anomaly_type NOT IN ('MISSING_DATA', 'COMMUNICATION_GAP') THEN new_temp END AS modified_value,
  start_ts AS injection_start, end_ts AS injection_end, is_fault FROM hit)"""


APPLIED = """
first_hit AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY anomaly_id) = 1),
applied AS (SELECT o.* REPLACE (CASE WHEN f.event_id IS NULL THEN o.temperature_c ELSE new_temp END AS temperature_c, CASE WHEN f.event_id IS NULL THEN o.relative_humidity_pct ELSE new_rh END AS relative_humidity_pct,
  CASE WHEN f.event_id IS NULL THEN o.sea_level_pressure_hpa ELSE new_slp END AS sea_level_pressure_hpa, o.ingestion_ts + CASE WHEN anomaly_type = 'OUT_OF_ORDER_DATA' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS ingestion_ts), f.anomaly_type
  FROM raw_observations o LEFT JOIN first_hit f ON o.event_id = f.event_id WHERE coalesce(f.anomaly_type NOT IN ('MISSING_DATA', 'COMMUNICATION_GAP'), TRUE)),
doubled AS (SELECT * EXCLUDE (anomaly_type) FROM applied UNION ALL SELECT * EXCLUDE (anomaly_type) REPLACE (event_id + 20000000 AS event_id, ingestion_ts + INTERVAL 1 HOUR AS ingestion_ts) FROM applied WHERE anomaly_type = 'DUPLICATE_DATA'),
observations AS (SELECT * FROM doubled QUALIFY row_number() OVER (PARTITION BY station_id, obs_ts ORDER BY event_id) = 1)"""
BASE = replaced_observations(episode_ctes("raw_observations"), APPLIED)


def scored_ctes(ref="24h", suffix=""):
    z = Z24.replace("24h", ref)
    return (roll_cte([ref], [TEMP, RH, SLP]), rate_cte("rolled", [TEMP, RH, SLP]), deviation_cte(ref),
            f"""scored{suffix} AS (SELECT *, CASE WHEN score >= {THRESHOLD} THEN 1 ELSE 0 END AS pred, EXISTS (SELECT 1 FROM labels l WHERE l.is_fault AND l.station_id = s.station_id AND l.obs_ts = s.obs_ts)::INT AS y
  FROM (SELECT event_id, station_id, obs_ts, tanh({z} / 3.0) AS score FROM interacted) s)""")


CONF = ("count(*) AS observations, count(CASE WHEN pred = 1 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN pred = 1 AND y = 0 THEN 1 END) AS fp, "
        "count(CASE WHEN pred = 0 AND y = 0 THEN 1 END) AS tn, count(CASE WHEN pred = 0 AND y = 1 THEN 1 END) AS fn")


def rates(src):
    def ratio(a, b):
        return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END"
    p, r = ratio("tp::DOUBLE", "(tp + fp)"), ratio("tp::DOUBLE", "(tp + fn)")
    return f"""(SELECT *, round({p} + 1e-9::DOUBLE, 4) AS precision, round({r} + 1e-9::DOUBLE, 4) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END + 1e-9::DOUBLE, 4) AS f1,
  round({ratio('fp::DOUBLE', '(fp + tn)')} + 1e-9::DOUBLE, 4) AS fpr, round({ratio('fn::DOUBLE', '(fn + tp)')} + 1e-9::DOUBLE, 4) AS fnr FROM ({src}))"""


CURVE = """
sg AS (SELECT round(score + 1e-9::DOUBLE, 6) AS s, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sg),
areas AS (SELECT round(sum(pos / P * tp / (tp + fp)) + 1e-9::DOUBLE, 4) AS pr_auc, round(sum(neg / N * (tp - pos / 2.0) / P) + 1e-9::DOUBLE, 4) AS roc_auc FROM cum)"""
HITS = """
lp AS (SELECT l.*, coalesce(s.pred, 0) AS pred, row_number() OVER (PARTITION BY anomaly_id ORDER BY l.obs_ts) - 1 AS step FROM labels l LEFT JOIN scored s USING (station_id, obs_ts)),
hits AS (SELECT anomaly_id, any_value(station_id) AS station_id, any_value(anomaly_type) AS anomaly_type, any_value(is_fault) AS is_fault, max(pred) = 1 AS detected, min(CASE WHEN pred = 1 THEN step END) AS latency_steps,
  greatest(0.0, (min(CASE WHEN pred = 1 THEN epoch_us(obs_ts) END) - min(epoch_us(injection_start))) / 60000000.0::DOUBLE) AS lm FROM lp GROUP BY 1)"""
ALARMS = """
clean AS (SELECT * FROM scored WHERE obs_ts NOT IN (SELECT obs_ts FROM labels WHERE is_fault)),
edges_up AS (SELECT station_id, pred = 1 AND coalesce(lag(pred) OVER (PARTITION BY station_id ORDER BY obs_ts), 0) = 0 AS rising FROM clean)"""


def calibrated(target):
    p, r = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "CASE WHEN P > 0 THEN tp / P ELSE 0 END"
    metric = {"f1": f"CASE WHEN tp > 0 THEN 2.0 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END", "precision": p, "balanced": f"(({p}) + ({r})) / 2.0"}[target]
    return f"""(SELECT c AS threshold, m AS metric, '{target}' AS target FROM (SELECT c, round({metric}, 9) AS m FROM (SELECT c, (SELECT sum(pos) FROM sg WHERE s >= c)::DOUBLE AS tp, (SELECT sum(neg) FROM sg WHERE s >= c)::DOUBLE AS fp,
  (SELECT sum(pos) FROM sg)::DOUBLE AS P FROM cands)) ORDER BY m DESC, c LIMIT 1)"""


CANDS = """
cands AS (SELECT DISTINCT round(unnest(quantile_cont(round(score + 1e-9::DOUBLE, 6), [""" + ", ".join(f"{i / 100.0!r}" for i in range(1, 100)) + """])), 9) AS c FROM scored)"""
SC = scored_ctes()
MET = ["precision", "recall", "f1", "fpr", "fnr"]
RUNS_CTE = f"""
marked AS (SELECT *, decision <> 'NORMAL' OR coalesce(score >= 0.5, FALSE) AS is_anom FROM decided),
grp AS (SELECT *, sum(CASE WHEN is_anom THEN 0 ELSE 1 END) OVER ({P}) AS g, row_number() OVER ({P}) AS seq, lead(obs_ts) OVER ({P}) AS next_ts FROM marked),
runs AS (SELECT station_id, g, min(obs_ts) AS onset, max(obs_ts) AS last_ts, arg_max(next_ts, obs_ts) AS rec0, count(*) AS length, min(seq) AS a, max(seq) AS b, arg_max(next_ts IS NULL, obs_ts) AS open
  FROM grp WHERE is_anom GROUP BY 1, 2),
peaks AS (SELECT station_id, g, obs_ts AS peak_ts, temperature_c AS peak_value, score AS peak_score FROM grp WHERE is_anom QUALIFY row_number() OVER (PARTITION BY station_id, g ORDER BY score DESC NULLS LAST, obs_ts) = 1),
eps AS (SELECT station_id, onset, last_ts, CASE WHEN open THEN NULL ELSE (SELECT q.obs_ts FROM grp q WHERE q.station_id = r.station_id AND q.seq = r.b + 1) END AS recovery, length, peak_ts, peak_value,
  round(peak_score + 1e-9::DOUBLE, 3) AS peak_score, a, b FROM runs r JOIN peaks USING (station_id, g))"""
SCN = ", ".join(f"({n}, '{i}', '{k}', {a}, {b}, {v}::DOUBLE, '{e}')" for n, (i, k, a, b, v, e) in enumerate(au.SCENARIOS))
SCN_CTE = f"""
scn AS (SELECT v.* EXCLUDE (i), station_id FROM (VALUES {SCN}) v(i, scenario_id, kind, first_step, last_step, amount, expected) JOIN
  (SELECT station_id, (row_number() OVER (ORDER BY station_id) - 1) % {len(au.SCENARIOS)} AS i FROM (SELECT DISTINCT station_id FROM observations)) USING (i)),
stepped AS (SELECT *, row_number() OVER ({P}) - 1 AS step FROM observations),
sj AS (SELECT s.*, c.scenario_id, c.first_step, c.last_step, c.amount AS am, c.expected AS exp0, step BETWEEN first_step AND last_step AS inside, CASE WHEN step BETWEEN first_step AND last_step THEN kind ELSE 'NONE' END AS k FROM stepped s JOIN scn c USING (station_id)),
transformed AS (SELECT event_id, station_id, step, scenario_id, k AS applied,
  CASE WHEN k IN ('SPIKE_POSITIVE', 'SPIKE_NEGATIVE', 'STEP_CHANGE', 'RATE_OF_CHANGE_VIOLATION', 'SPATIAL_OUTLIER', 'REGIONAL_EVENT') THEN round(temperature_c + am + 1e-9::DOUBLE, 2) WHEN k = 'DRIFT' THEN round(temperature_c + am * (step - first_step + 1) + 1e-9::DOUBLE, 2)
    WHEN k = 'OSCILLATION' THEN round(temperature_c + CASE WHEN step % 2 = 0 THEN am ELSE -am END + 1e-9::DOUBLE, 2) WHEN k IN ('FLATLINE', 'IMPOSSIBLE_TEMPERATURE', 'MULTIVARIATE_INCONSISTENCY') THEN am WHEN k = 'MISSING_TEMPERATURE' THEN NULL ELSE temperature_c END AS temperature_c,
  CASE k WHEN 'FLATLINE' THEN 60.0 WHEN 'INVALID_RH' THEN am WHEN 'MULTIVARIATE_INCONSISTENCY' THEN 98.0 WHEN 'REGIONAL_EVENT' THEN CASE WHEN relative_humidity_pct IS NOT NULL THEN greatest(10.0, least(98.0, relative_humidity_pct + 28.0)) END
    WHEN 'MISSING_RH' THEN NULL ELSE relative_humidity_pct END AS relative_humidity_pct,
  CASE k WHEN 'FLATLINE' THEN 1013.25 WHEN 'INVALID_PRESSURE' THEN am WHEN 'REGIONAL_EVENT' THEN round(sea_level_pressure_hpa + 3.5 + 1e-9::DOUBLE, 2) WHEN 'MISSING_PRESSURE' THEN NULL ELSE sea_level_pressure_hpa END AS sea_level_pressure_hpa,
  CASE WHEN k IN ('IMPOSSIBLE_TEMPERATURE', 'INVALID_RH', 'INVALID_PRESSURE') THEN 'ERROR' WHEN k LIKE 'MISSING%' THEN 'MISSING' WHEN k = 'OUT_OF_ORDER' THEN 'SUSPECT' ELSE data_quality_status END AS data_quality_status,
  CASE k WHEN 'CORRUPTED_TIMESTAMP' THEN '2026-99-99 00:00:00' WHEN 'OUT_OF_ORDER' THEN strftime(obs_ts - to_minutes(CAST(am AS BIGINT)), '%Y-%m-%d %H:%M:%S') ELSE strftime(obs_ts, '%Y-%m-%d %H:%M:%S') END AS ts_text,
  CASE WHEN inside THEN exp0 ELSE 'NORMAL' END AS expected, unnest(CASE WHEN k IN ('TIMESTAMP_GAP', 'PARTIAL_OUTAGE', 'FULL_OUTAGE') THEN []::INT[] WHEN k = 'DUPLICATE' THEN [1, 2] ELSE [1] END) AS copy FROM sj)"""
AREA = "(SELECT neighbor_id FROM edges WHERE station_id = 'S07')"
IN10 = "obs_ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'"
FAC = f"(0.85::DOUBLE + {bucket_sql(301, 'station_id')} / 1000.0::DOUBLE)"
MASK_BASE = replaced_observations(f"""
observations AS (SELECT * EXCLUDE (t0) REPLACE (CASE WHEN hidden THEN NULL ELSE t0 END AS temperature_c) FROM (SELECT *, temperature_c AS t0,
  coalesce(temperature_c BETWEEN -50 AND 60, FALSE) AND {bucket_sql(10, 'CAST(event_id AS VARCHAR)')} = 0 AS hidden FROM raw_observations))""")
SWEEP = ", ".join(f"({t}::DOUBLE)" for t in (0.3, 0.4, 0.5, 0.6, 0.65, 0.7, 0.8))


def set_sql(ref):
    """One detector window as a self-contained subquery."""
    ctes = ",\n".join([BASE.strip(), *scored_ctes(ref)])
    return f"(WITH {ctes} SELECT 'zscore_{ref}' AS \"set\", * FROM {rates('SELECT ' + CONF + ' FROM scored')})"


SCENARIO_BASE = replaced_observations(SCN_CTE.strip().replace("FROM observations", "FROM raw_observations").replace("stepped", "placed"), """
observations AS (SELECT r.* REPLACE (t.temperature_c AS temperature_c, t.relative_humidity_pct AS relative_humidity_pct, t.sea_level_pressure_hpa AS sea_level_pressure_hpa, t.data_quality_status AS data_quality_status)
  FROM raw_observations r JOIN transformed t ON r.event_id = t.event_id AND t.copy = 1)""")
ORACLES = {
    "scenario_decisions": oracle(
        """SELECT *, CASE WHEN expected <> 'NORMAL' THEN detected > 0 ELSE stored = 0 END AS detection_ok, as_expected > 0 AS classification_ok, explained = detected AS explanation_ok,
        expected <> 'POSSIBLE_GENUINE_EVENT' OR severe = 0 AS protected_ok FROM (SELECT scenario_id, applied, expected, count(*) AS rows, count(CASE WHEN decision <> 'NORMAL' THEN 1 END) AS detected,
        count(CASE WHEN decision = expected THEN 1 END) AS as_expected, count(CASE WHEN decision NOT IN ('NORMAL', 'POSSIBLE_GENUINE_EVENT') THEN 1 END) AS stored,
        count(CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 1 END) AS severe, count(CASE WHEN decision <> 'NORMAL' AND reasons <> '' THEN 1 END) AS explained
        FROM (SELECT scenario_id, applied, expected, CASE WHEN bad THEN 'PROBABLE_DATA_QUALITY_ISSUE' ELSE decision END AS decision, CASE WHEN bad THEN 'MEDIUM' ELSE severity END AS severity,
        CASE WHEN bad THEN '' ELSE reasons END AS reasons FROM (SELECT d.decision, d.severity, d.reasons, t.*, t.sent = 'ERROR' AND d.gate <> 'data_quality' AS bad
        FROM decided d JOIN (SELECT o.station_id, o.obs_ts, t.scenario_id, t.applied, t.expected, t.data_quality_status AS sent FROM raw_observations o JOIN transformed t ON o.event_id = t.event_id AND t.copy = 1
        WHERE applied <> 'NONE') t ON t.station_id = d.station_id AND t.obs_ts = d.obs_ts))
        GROUP BY 1, 2, 3)""", *DECIDED, base=SCENARIO_BASE),
    "augmented_observations": oracle("SELECT event_id, station_id, obs_ts, temperature_c, relative_humidity_pct, sea_level_pressure_hpa, ingestion_ts FROM doubled", base=BASE),
    "augmentation_labels": oracle("SELECT * FROM labels", base=BASE),
    "label_accounting": oracle(
        """SELECT count(*) AS events, CAST(sum(n) AS BIGINT) AS affected_rows, round(avg(n) + 1e-9::DOUBLE, 2) AS mean_rows_per_event,
        (SELECT count(*) FROM (SELECT 1 FROM labels GROUP BY station_id, obs_ts HAVING count(*) > 1)) AS overlapping FROM (SELECT anomaly_id, count(*) AS n FROM labels GROUP BY 1)""", base=BASE, doubles=["mean_rows_per_event"]),
    "detector_metrics": oracle(f"SELECT * FROM {rates('SELECT ' + CONF + ' FROM scored')}, areas", *SC, CURVE, base=BASE, doubles=[*MET, "pr_auc", "roc_auc"]),
    "detector_metrics_per_station": oracle(f"SELECT * FROM {rates('SELECT station_id, ' + CONF + ' FROM scored GROUP BY 1')}", *SC, base=BASE, doubles=MET),
    "event_metrics": oracle(
        """SELECT events, detected, events - detected AS missed, round(detected / events + 1e-9::DOUBLE, 4) AS event_recall, mean_latency_steps, mean_latency_minutes, false_alarms,
        round(false_alarms / (st * greatest(1.0, days)) + 1e-9::DOUBLE, 4) AS false_alarms_per_station_day FROM (SELECT count(*) AS events, count(CASE WHEN detected THEN 1 END) AS detected,
        round(coalesce(avg(latency_steps), 0) + 1e-9::DOUBLE, 2) AS mean_latency_steps, round(coalesce(avg(CASE WHEN detected THEN lm END), 0) + 1e-9::DOUBLE, 2) AS mean_latency_minutes FROM hits WHERE is_fault),
        (SELECT count(CASE WHEN rising THEN 1 END) AS false_alarms FROM edges_up), (SELECT (max(epoch_us(obs_ts)) - min(epoch_us(obs_ts))) / 86400000000.0::DOUBLE AS days, count(DISTINCT station_id) AS st FROM scored)""",
        *SC, HITS, ALARMS, base=BASE, doubles=["event_recall", "mean_latency_steps", "mean_latency_minutes", "false_alarms_per_station_day"]),
    "event_detections": oracle("SELECT anomaly_id, station_id, anomaly_type, is_fault, detected, latency_steps, CASE WHEN detected THEN lm END AS latency_minutes FROM hits", *SC, HITS, base=BASE, doubles=["latency_minutes"]),
    "recall_by_anomaly_type": oracle(
        "SELECT anomaly_type, count(*) AS events, count(CASE WHEN detected THEN 1 END) AS detected, round(count(CASE WHEN detected THEN 1 END) / count(*) + 1e-9::DOUBLE, 4) AS recall FROM hits GROUP BY 1", *SC, HITS, base=BASE, doubles=["recall"]),
    "recall_by_severity_tier": oracle(
        """SELECT tier, count(*) AS events, sum(h)::BIGINT AS detected, round(sum(h) / count(*) + 1e-9::DOUBLE, 4) AS recall FROM (SELECT tier, anomaly_id, max(pred) AS h FROM (SELECT *, CASE WHEN coalesce(abs(modified_value - original_value), 3.0) <= 2
        OR anomaly_type = 'SMALL_SPIKE' THEN 'subtle' WHEN coalesce(abs(modified_value - original_value), 3.0) <= 5 THEN 'moderate' ELSE 'obvious' END AS tier FROM lp WHERE is_fault) GROUP BY 1, 2) GROUP BY 1""", *SC, HITS, base=BASE, doubles=["recall"]),
    "genuine_event_false_alarms": oracle(
        """SELECT count(*) AS evaluated, count(CASE WHEN pred = 1 THEN 1 END) AS flagged, round(avg(pred) + 1e-9::DOUBLE, 4) AS false_alarm_rate, round(avg(score) + 1e-9::DOUBLE, 4) AS mean_score FROM scored
        WHERE obs_ts IN (SELECT obs_ts FROM labels WHERE anomaly_type = 'POSSIBLE_GENUINE_EVENT')""", *SC, base=BASE, doubles=["false_alarm_rate", "mean_score"]),
    "false_alarm_episodes": oracle("SELECT station_id, count(*) AS clean_rows, count(CASE WHEN rising THEN 1 END) AS false_alarms FROM edges_up GROUP BY 1", *SC, ALARMS, base=BASE),
    "threshold_calibration": oracle(" UNION ALL ".join(f"SELECT * FROM {calibrated(t)}" for t in ("f1", "precision", "balanced")), *SC, CURVE, CANDS, base=BASE, doubles=["threshold", "metric"]),
    "detector_set_comparison": f"""SELECT metric, count(*) AS sets, round(avg(v) + 1e-9::DOUBLE, 6) + 0.0 AS mean, round(stddev_pop(v) + 1e-9::DOUBLE, 6) + 0.0 AS std, arg_max("set", (v, "set")) AS best_set
        FROM (SELECT "set", unnest(['precision', 'recall', 'f1', 'fpr']) AS metric, unnest([precision, recall, f1, fpr]) AS v FROM ({set_sql('3h')} UNION ALL {set_sql('6h')} UNION ALL {set_sql('24h')})) GROUP BY 1""",
    "threshold_sweep": oracle(
        f"SELECT * FROM {rates('SELECT t AS threshold, ' + CONF.replace('count(*) AS observations, ', '').replace('pred = 1', 'sr >= t').replace('pred = 0', 'sr < t') + f' FROM (SELECT y, round(score + 1e-9::DOUBLE, 6) AS sr FROM scored), (VALUES {SWEEP}) v(t) GROUP BY 1')}",
        *SC, base=BASE, doubles=MET),
    "radius_sweep": oracle(
        f"""SELECT r AS radius_km, count(station_id) AS connected, coalesce(avg(n), 0.0) AS mean_neighbours, min(d) AS nearest_km FROM (VALUES {', '.join(f'({r}::DOUBLE)' for r in RADII)}) v(r)
        LEFT JOIN (SELECT q AS radius, station_id, count(*) AS n, min(distance_km) AS d FROM pairs, (VALUES {', '.join(f'({r}::DOUBLE)' for r in RADII)}) w(q)
        WHERE distance_km <= q GROUP BY 1, 2) ON radius = r GROUP BY 1""", STATIONS_CTE, pairs_cte(max(RADII)), doubles=["mean_neighbours", "nearest_km"]),
    "tolerance_sweep": oracle(
        """SELECT tol AS tolerance_minutes, count(*) AS pairs, count(CASE WHEN abs(time_delta_seconds) <= tol * 60 THEN 1 END) AS fresh, avg(CASE WHEN abs(time_delta_seconds) <= tol * 60 THEN abs(time_delta_seconds) END) AS mean_age_seconds
        FROM matches, (VALUES (10), (30), (60), (120)) v(tol) GROUP BY 1""", *CONTEXT[:5], doubles=["mean_age_seconds"], ints=["tolerance_minutes"]),
    "chronological_split": oracle(
        """SELECT CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, min(obs_ts) AS first_ts, max(obs_ts) AS last_ts
        FROM (SELECT obs_ts, row_number() OVER (ORDER BY obs_ts, event_id) AS r, count(*) OVER () AS n FROM observations) GROUP BY 1"""),
    "date_split": oracle(
        """SELECT CASE WHEN obs_ts < TIMESTAMP '2024-01-19' THEN 'train' WHEN obs_ts < TIMESTAMP '2024-01-25' THEN 'validation' ELSE 'test' END AS split, station_id, count(*) AS rows FROM observations GROUP BY 1, 2"""),
    "causality_audit": oracle("SELECT 0 AS differences, count(*) AS compared FROM observations WHERE obs_ts <= TIMESTAMP '2024-01-20'", ints=["differences"]),
    "anomaly_episodes": oracle(
        """SELECT station_id, onset, last_ts, recovery, length, peak_ts, peak_value, peak_score, round((epoch_us(coalesce(recovery, last_ts)) - epoch_us(onset)) / 60000000.0::DOUBLE + 1e-9::DOUBLE, 1) AS duration_minutes,
        recovery IS NULL AS is_ongoing FROM eps""", *DECIDED, RUNS_CTE, doubles=["peak_score", "duration_minutes"]),
    "episode_surroundings": oracle(
        """SELECT e.station_id, e.onset, CASE WHEN q.seq < e.a THEN 'before' ELSE 'after' END AS side, q.obs_ts, q.temperature_c, q.decision FROM eps e JOIN grp q ON q.station_id = e.station_id
        AND (q.seq BETWEEN e.a - 5 AND e.a - 1 OR q.seq BETWEEN e.b + 1 AND e.b + 5)""", *DECIDED, RUNS_CTE),
    "neighbours_during_episodes": oracle(
        """SELECT e.station_id, e.onset, count(DISTINCT n.station_id) AS neighbor_stations, round(avg(n.temperature_c) + 1e-9::DOUBLE, 3) AS neighbor_mean, round(min(n.temperature_c) + 1e-9::DOUBLE, 3) AS neighbor_min,
        round(max(n.temperature_c) + 1e-9::DOUBLE, 3) AS neighbor_max FROM eps e JOIN edges g ON g.station_id = e.station_id JOIN observations n ON n.station_id = g.neighbor_id AND n.obs_ts BETWEEN e.onset AND coalesce(e.recovery, e.last_ts) GROUP BY 1, 2""",
        *DECIDED, RUNS_CTE, doubles=["neighbor_mean", "neighbor_min", "neighbor_max"]),
    "regional_event_augmentation": oracle(
        f"""SELECT event_id, station_id, obs_ts, CASE WHEN hit THEN round(temperature_c - 8.0 * f + x + 1e-9::DOUBLE, 2) ELSE temperature_c END AS temperature_c,
        CASE WHEN hit THEN CASE WHEN relative_humidity_pct IS NOT NULL THEN greatest(0.0, least(100.0, relative_humidity_pct + 28.0 * f)) END ELSE relative_humidity_pct END AS relative_humidity_pct,
        CASE WHEN hit THEN round(sea_level_pressure_hpa + 3.5 * f + 1e-9::DOUBLE, 2) ELSE sea_level_pressure_hpa END AS sea_level_pressure_hpa, hit AS is_changed FROM (SELECT *, {IN10} AND (station_id = 'S07' OR station_id IN {AREA}) AS hit,
        CASE WHEN station_id = 'S07' THEN 1.0::DOUBLE ELSE {FAC} END AS f, CASE WHEN station_id = 'S07' THEN 6.5::DOUBLE ELSE 0.0::DOUBLE END AS x FROM observations)""", *NET, doubles=[RH]),
    "neighbour_outage_augmentation": oracle(f"SELECT station_id, count(*) AS rows FROM observations WHERE NOT ({IN10} AND station_id IN {AREA}) GROUP BY 1", *NET),
    "scenario_transforms": oracle("SELECT * FROM transformed", SCN_CTE, ints=["copy"]),
    "scenario_windows": oracle(
        "SELECT scenario_id, station_id, count(*) AS rows, min(step) AS first, max(step) AS last FROM stepped JOIN scn USING (station_id) WHERE step BETWEEN first_step - 24 AND last_step + 4 GROUP BY 1, 2", SCN_CTE),
    "scenario_checks": oracle(
        "SELECT \"check\", count(*) AS rows, count(*) AS passed FROM (SELECT unnest(['status_marked', 'value_missing', 'time_readable', 'no_rows_left']) AS \"check\" FROM transformed WHERE applied <> 'NONE') GROUP BY 1", SCN_CTE),
    "reconstruction_benchmark": oracle(
        """SELECT count(*) AS points, count(CASE WHEN hidden THEN 1 END) AS anomalous, count(err) AS estimated, round(avg(err) + 1e-9::DOUBLE, 3) AS mae, round(sqrt(avg(err * err)) + 1e-9::DOUBLE, 3) AS rmse,
        round(avg(CASE WHEN abs(truth) > 1e-3 THEN err / abs(truth) * 100.0 END) + 1e-9::DOUBLE, 2) AS relative_error_pct, round(count(err) / count(CASE WHEN hidden THEN 1 END) + 1e-9::DOUBLE, 3) AS coverage,
        0.0::DOUBLE AS unsafe_rate, 0.0::DOUBLE AS unnecessary_rate FROM (SELECT r.temperature_c AS truth, o.hidden, CASE WHEN o.hidden THEN abs(r.temperature_c - j.estimate) END AS err FROM observations o JOIN raw_observations r ON o.event_id = r.event_id AND r.temperature_c IS NOT NULL
        LEFT JOIN judged j ON j.station_id = o.station_id AND j.obs_ts = o.obs_ts)""",
        *CONTEXT, MISSING_CTE, hist_cte("mseries"), impute_cte(False), error_sql("coalesce(gap_minutes, 0)"), base=MASK_BASE, doubles=["mae", "rmse", "relative_error_pct", "coverage"]),
}
