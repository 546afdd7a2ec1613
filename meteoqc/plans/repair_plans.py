"""Imputation, correction proposals, resampling and the reconstruction benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.functions.numeric import hash_bucket
from meteoqc.operators import decision as dc
from meteoqc.operators import health as hl
from meteoqc.operators import lookups as lk
from meteoqc.operators import repair as rp
from meteoqc.operators import spatial as sp
from meteoqc.operators.staging import staged
from meteoqc.plans.common import oracle, publish
from meteoqc.plans.decision_plans import DECIDED, HEALTH, HEALTH_CTE, SUMMARY_CTE, edges_of
from meteoqc.plans.decision_plans import RULES as DECISION_RULES
from meteoqc.plans.ingest_plans import VIOLATIONS
from meteoqc.plans.spatial_plans import CONTEXT, P
from meteoqc.schema import KEY, TEMP, TS
from meteoqc.sources.tables import observations

RULES = rp.RepairRules(max_gap_minutes=600.0)
ID = [KEY, TS]
ERR = ["standard_error", "confidence", "range_low", "range_high"]


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def imputed(obs, retrospective):
    rows = rp.missing_readings(obs, sp.spatial_context(obs, edges_of(obs)), "temp", rules=RULES, retrospective=retrospective)
    return rp.impute(rows, RULES, retrospective).select(*ID, "missing_steps", "gap_minutes", "method", "status", "estimate", "method_quality", *ERR)


def series(obs):
    ctx = sp.spatial_context(obs, edges_of(obs))
    return rp.impute_series(obs, ctx, rules=rp.RepairRules(), cadence_minutes=5.0)


def recommended(obs):
    used = [*dc.READ[:-1], "decision", "severity", "data_quality", "temporal", "spatial", *[f"{v}_{s}" for v in rp.CANONICAL for s in ("idw", "n", "std", "km")]]
    d = staged(dc.decisions(obs.select(*dc.READ), edges_of(obs), DECISION_RULES).select(*used))
    return rp.recommend(rp.correction_inputs(d, rules=RULES), hl.station_health(d, HEALTH), RULES), d


def corrections(obs):
    r, _ = recommended(obs)
    return r.select("recommendation_id", *ID, "variable", F.col("x").alias("observed"), "estimate", "departure", "method", "status", "method_quality", *ERR)


def correction_page(obs):
    r, _ = recommended(obs)
    rows = lk.where(r, variable="temp", status="CORRECTION_CANDIDATE")
    return lk.page(rows, [F.col(TS).desc(), F.col(KEY)], limit=30, offset=10).select("recommendation_id", *ID, "status", "estimate", "total_count", "has_more")


def bundled(obs):
    r, d = recommended(obs)
    b = rp.bundles(r, d.select(*ID, "temperature_c", "relative_humidity_pct", "sea_level_pressure_hpa", "dew_point_c", "station_pressure_hpa", "elevation_m"))
    return b.withColumn("violations", F.array_join("violations", ","))


def baseline(obs):
    s = obs.select(KEY, TS, F.col(TEMP).alias("x"), F.col(KEY).alias("series"))
    h = rp.with_history(s, s, 12)
    return h.select(*ID, F.size("history").alias("n"), rp.array_median(rp.tail(F.col("history"), 6)).alias("median6"), rp.array_median(F.col("history")).alias("median12"),
                    rp.array_std(F.col("history")).alias("std12"))


def benchmark(obs):
    """Hides every tenth plausible temperature (by hash), imputes it and compares with the truth; all readings stay in the series."""
    pick = F.coalesce(F.col(TEMP).between(-50, 60), F.lit(False)) & (hash_bucket(10, F.col("event_id")) == 0)
    truth = obs.withColumns({"truth": F.col(TEMP), "hidden": pick})
    masked = staged(truth.withColumn(TEMP, F.when(~F.col("hidden"), F.col(TEMP))))
    rows = rp.impute(rp.missing_readings(masked, sp.spatial_context(masked, edges_of(masked)), "temp", rules=RULES), RULES)
    joined = masked.filter("truth IS NOT NULL").join(rows.select(*ID, "estimate"), ID, "left")
    return rp.reconstruction_metrics(joined.select("truth", F.col(TEMP).alias("observed"), "estimate", F.col("hidden").alias("is_anomalous")))


QUERIES = {
    "temporal_baselines": _q(baseline),
    "imputed_readings": _q(lambda o: imputed(o, False)),
    "imputed_readings_two_sided": _q(lambda o: imputed(o, True)),
    "imputed_series": _q(series),
    "correction_recommendations": _q(corrections),
    "correction_page": _q(correction_page),
    "correction_bundles": _q(bundled),
    "resampled_grid": _q(lambda o: rp.resample(o, "temp", 3600)),
    "reconstruction_benchmark": _q(benchmark),
}

MED = "list_median({0})"


def med(a):
    return f"CASE WHEN len({a}) > 0 THEN list_median({a}) END"


def hist_cte(src: str, name: str = "h") -> str:
    """Last 12 valid values strictly before every row of ``src`` (series, obs_ts, x)."""
    return f"""
{name}_valid AS (SELECT series, obs_ts, array_agg(x) OVER (PARTITION BY series ORDER BY obs_ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS history FROM {src} WHERE x IS NOT NULL),
{name} AS (SELECT p.*, coalesce(v.history, []) AS history FROM {src} p ASOF LEFT JOIN {name}_valid v ON p.series = v.series AND p.obs_ts > v.obs_ts)"""


def error_sql(gap: str) -> str:
    """SE, quality and range columns over variable, estimate, n, n_std, km, history."""
    def pick(d):
        return "CASE variable " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in d.items()) + " END"
    lo, hi = pick({k: b[0] for k, b in rp.ESTIMATE_BOUNDS.items()}), pick({k: b[1] for k, b in rp.ESTIMATE_BOUNDS.items()})
    return f"""
e1 AS (SELECT *, {pick(rp.ERROR_FLOOR)} AS fl, {lo} AS lo, {hi} AS hi, {gap} AS gp, len(history) AS t, coalesce(n, 0) AS nn FROM est),
e2 AS (SELECT *, CASE WHEN nn >= 2 THEN coalesce(n_std, 0) WHEN nn = 1 THEN fl * 1.5 ELSE 0 END AS ss, CASE WHEN t >= 2 THEN list_stddev_samp(history) WHEN t = 1 THEN fl * 1.5 ELSE 0 END AS ts,
  CASE WHEN nn >= 2 AND km IS NOT NULL THEN greatest(1.0, 1.0 + (km - 100.0) / 400.0) ELSE 1.0 END AS far FROM e1),
e3 AS (SELECT *, (CASE method WHEN 'SPATIAL_IDW_CONSENSUS' THEN CASE WHEN nn >= 2 THEN greatest(fl, ss * far / sqrt(nn)) WHEN nn = 1 THEN greatest(fl * 1.5, ss * far) ELSE fl * 3.0 END
  WHEN 'CAUSAL_TEMPORAL_INTERPOLATION' THEN CASE WHEN t >= 2 THEN greatest(fl, ts / sqrt(t)) ELSE fl * 2.5 END WHEN 'ROLLING_BASELINE' THEN CASE WHEN t >= 2 THEN greatest(fl, ts / sqrt(t)) ELSE fl * 2.5 END
  WHEN 'COMBINED_TEMPORAL_SPATIAL' THEN sqrt(0.6::DOUBLE * pow(greatest(fl, ss / sqrt(greatest(1, nn))), 2) + 0.4::DOUBLE * pow(greatest(fl, ts / sqrt(greatest(1, t))), 2)) * far
  WHEN 'RETROSPECTIVE_INTERPOLATION' THEN CASE WHEN t >= 2 THEN greatest(fl * 0.8, ts / sqrt(t) * 0.8) ELSE fl * 2.0 END END) * CASE WHEN gp > 5 THEN sqrt(1.0 + (gp - 5.0) / 30.0) ELSE 1.0 END AS se,
  CASE WHEN method = 'COMBINED_TEMPORAL_SPATIAL' AND nn >= 3 AND t >= 3 THEN 'HIGH' WHEN method = 'SPATIAL_IDW_CONSENSUS' AND nn >= 3 THEN 'HIGH' WHEN method = 'RETROSPECTIVE_INTERPOLATION' AND t >= 4 AND gp <= 15 THEN 'HIGH'
  WHEN (nn >= 2 OR t >= 3) AND gp <= 30 THEN 'MEDIUM' WHEN nn = 1 OR t = 2 OR gp <= 60 THEN 'LOW' ELSE 'POOR' END AS q FROM e2),
judged AS (SELECT * EXCLUDE (q), CASE WHEN estimate IS NOT NULL THEN q END AS method_quality, CASE WHEN estimate IS NOT NULL THEN round(se + 1e-9::DOUBLE, 3) END AS standard_error,
  CASE WHEN estimate IS NOT NULL THEN round(greatest(0.1, least(0.98, CASE q WHEN 'HIGH' THEN 0.9 WHEN 'MEDIUM' THEN 0.75 WHEN 'LOW' THEN 0.5 ELSE 0.25 END::DOUBLE * (1.0 - 0.5 * least(1.0, se * 2.0 / ((hi - lo) * 0.1))))) + 1e-9::DOUBLE, 3) END AS confidence,
  CASE WHEN estimate IS NOT NULL THEN round(greatest(lo, estimate - 1.96::DOUBLE * se) + 1e-9::DOUBLE, 3) END AS range_low,
  CASE WHEN estimate IS NOT NULL THEN round(least(hi, estimate + 1.96::DOUBLE * se) + 1e-9::DOUBLE, 3) END AS range_high FROM e3)"""


MISSING_CTE = f"""
mr AS (SELECT *, sum(CASE WHEN temperature_c IS NOT NULL THEN 1 ELSE 0 END) OVER ({P}) AS grp FROM observations),
mseries AS (SELECT station_id, station_id AS series, obs_ts, temperature_c AS x, row_number() OVER (PARTITION BY station_id, grp ORDER BY obs_ts) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS missing_steps,
  CASE WHEN temperature_c IS NULL AND grp > 0 THEN (epoch_us(obs_ts) - epoch_us(first(obs_ts) OVER (PARTITION BY station_id, grp ORDER BY obs_ts))) / 60000000.0::DOUBLE END AS gap_minutes FROM mr)"""


def impute_cte(retro: bool) -> str:
    return f"""
mn AS (SELECT h.*, v.x AS next_x FROM h ASOF LEFT JOIN (SELECT * FROM mseries WHERE x IS NOT NULL) v ON h.series = v.series AND h.obs_ts < v.obs_ts),
mi AS (SELECT mn.*, 'temp' AS variable, c.temp_idw AS idw, c.temp_n AS n, c.temp_std AS n_std, c.temp_km AS km FROM mn LEFT JOIN context c USING (station_id, obs_ts) WHERE mn.x IS NULL),
mm AS (SELECT *, CASE WHEN coalesce(gap_minutes, 0) > 600 OR missing_steps > 12 THEN 'NO_ESTIMATE' WHEN {str(retro).upper()} AND len(history) > 0 AND next_x IS NOT NULL THEN 'RETROSPECTIVE_INTERPOLATION'
  WHEN idw IS NOT NULL AND len(history) >= 3 THEN 'COMBINED_TEMPORAL_SPATIAL' WHEN idw IS NOT NULL THEN 'SPATIAL_IDW_CONSENSUS' WHEN len(history) >= 3 THEN 'CAUSAL_TEMPORAL_INTERPOLATION'
  WHEN len(history) >= 1 THEN 'ROLLING_BASELINE' ELSE 'NO_ESTIMATE' END AS method FROM mi),
est AS (SELECT *, CASE WHEN method = 'NO_ESTIMATE' THEN 'NOT_IMPUTABLE' ELSE 'IMPUTED' END AS status, CASE WHEN method <> 'NO_ESTIMATE' THEN greatest(-50.0, least(60.0, round(CASE method WHEN 'RETROSPECTIVE_INTERPOLATION' THEN 0.5 * (history[-1] + next_x)
  WHEN 'COMBINED_TEMPORAL_SPATIAL' THEN 0.6::DOUBLE * idw + 0.4::DOUBLE * list_median(history) WHEN 'SPATIAL_IDW_CONSENSUS' THEN idw
  WHEN 'CAUSAL_TEMPORAL_INTERPOLATION' THEN history[-1] + greatest(-1.0, least(1.0, (history[-1] - history[-3]) / 2.0 * 0.5)) * missing_steps ELSE list_avg(history) END + 1e-9::DOUBLE, 3))) END AS estimate FROM mm)"""


IMP_OUT = f"SELECT station_id, obs_ts, missing_steps, gap_minutes, method, status, estimate, method_quality, {', '.join(ERR)} FROM judged"
CORR_CTE = """
cs AS (SELECT station_id, obs_ts, variable, x, station_id || '/' || variable AS series, decision, idw, n, n_std, km FROM (SELECT station_id, obs_ts, decision, unnest(['temp', 'rh', 'slp']) AS variable,
  unnest([temperature_c, relative_humidity_pct, sea_level_pressure_hpa]) AS x, unnest([temp_idw, rh_idw, slp_idw]) AS idw, unnest([temp_n, rh_n, slp_n]) AS n, unnest([temp_std, rh_std, slp_std]) AS n_std,
  unnest([temp_km, rh_km, slp_km]) AS km FROM decided))"""
CORR_EST = """
cm AS (SELECT h.*, hh.overall_health, CASE WHEN decision IN ('POSSIBLE_GENUINE_EVENT', 'NORMAL') THEN 'NO_ESTIMATE' WHEN idw IS NOT NULL AND coalesce(n, 0) >= 2 AND len(history) >= 2 THEN 'COMBINED_TEMPORAL_SPATIAL'
  WHEN idw IS NOT NULL AND coalesce(n, 0) >= 2 THEN 'SPATIAL_IDW_CONSENSUS' WHEN len(history) >= 2 THEN 'ROLLING_BASELINE' ELSE 'NO_ESTIMATE' END AS method FROM h LEFT JOIN health hh USING (station_id) WHERE x IS NOT NULL),
est AS (SELECT *, CASE WHEN method <> 'NO_ESTIMATE' THEN greatest(CASE variable WHEN 'temp' THEN -50.0 WHEN 'rh' THEN 0.0 ELSE 870.0 END::DOUBLE, least(CASE variable WHEN 'temp' THEN 60.0 WHEN 'rh' THEN 100.0 ELSE 1085.0 END::DOUBLE,
  round(CASE method WHEN 'COMBINED_TEMPORAL_SPATIAL' THEN 0.65::DOUBLE * idw + 0.35::DOUBLE * list_median(history[-6:]) WHEN 'SPATIAL_IDW_CONSENSUS' THEN idw ELSE list_median(history[-6:]) END + 1e-9::DOUBLE, 2))) END AS estimate FROM cm)"""
CORR_OUT = """
corr AS (SELECT substr(sha256(concat_ws('::', station_id, strftime(obs_ts, '%Y-%m-%d %H:%M:%S.%f'), variable)), 1, 16) AS recommendation_id, station_id, obs_ts, variable, x AS observed, estimate, abs(x - estimate) AS departure, method,
  CASE WHEN decision IN ('POSSIBLE_GENUINE_EVENT', 'NORMAL') THEN 'NO_CORRECTION_RECOMMENDED' WHEN method = 'NO_ESTIMATE' THEN 'INSUFFICIENT_EVIDENCE'
  WHEN standard_error > CASE variable WHEN 'temp' THEN 5 WHEN 'rh' THEN 25 ELSE 6 END OR abs(x - estimate) > CASE variable WHEN 'temp' THEN 15 WHEN 'rh' THEN 50 ELSE 20 END THEN 'REVIEW_RECOMMENDED'
  WHEN idw IS NOT NULL AND nn >= 2 AND method_quality IN ('HIGH', 'MEDIUM') AND (coalesce(overall_health < 60, FALSE) OR decision IN ('PROBABLE_SENSOR_ANOMALY', 'PROBABLE_DATA_QUALITY_ISSUE')) THEN 'CORRECTION_CANDIDATE'
  ELSE 'REVIEW_RECOMMENDED' END AS status, method_quality, standard_error, confidence, range_low, range_high FROM judged)"""
CORRECTED = (*DECIDED, HEALTH_CTE, SUMMARY_CTE, CORR_CTE, hist_cte("cs"), CORR_EST, error_sql("0.0"), CORR_OUT)
BUNDLE = f"""
wide AS (SELECT station_id, obs_ts, max(CASE WHEN variable = 'temp' THEN estimate END) AS new_temp, max(CASE WHEN variable = 'rh' THEN estimate END) AS new_rh, max(CASE WHEN variable = 'slp' THEN estimate END) AS new_slp,
  count(*) AS proposals, count(CASE WHEN status = 'CORRECTION_CANDIDATE' THEN 1 END) AS candidates FROM corr WHERE estimate IS NOT NULL GROUP BY ALL),
state AS (SELECT w.*, coalesce(new_temp, o.temperature_c) AS temperature_c, coalesce(new_rh, o.relative_humidity_pct) AS relative_humidity_pct, coalesce(new_slp, o.sea_level_pressure_hpa) AS sea_level_pressure_hpa,
  o.dew_point_c, o.station_pressure_hpa, o.elevation_m FROM wide w JOIN observations o USING (station_id, obs_ts)),
checked AS (SELECT *, {VIOLATIONS} AS violations FROM state)"""

BOUND = "greatest(CASE variable WHEN 'temp' THEN -50.0 WHEN 'rh' THEN 0.0 ELSE 870.0 END::DOUBLE, least(CASE variable WHEN 'temp' THEN 60.0 WHEN 'rh' THEN 100.0 ELSE 1085.0 END::DOUBLE, {0}))"
STEP_SQL = """round(CASE method WHEN 'COMBINED_TEMPORAL_SPATIAL' THEN 0.6::DOUBLE * idw + 0.4::DOUBLE * list_median(past) WHEN 'SPATIAL_IDW_CONSENSUS' THEN idw
    WHEN 'CAUSAL_TEMPORAL_INTERPOLATION' THEN past[-1] + greatest(-1.0, least(1.0, (past[-1] - past[-3]) / 2.0 * 0.5)) * steps ELSE list_avg(past) END + 1e-9::DOUBLE, 3)"""
FOLD_CTE = f"""
ls AS (SELECT station_id, obs_ts, unnest(['temp', 'rh', 'slp']) AS variable, unnest([temperature_c, relative_humidity_pct, sea_level_pressure_hpa]) AS x FROM observations),
li AS (SELECT station_id, obs_ts, unnest(['temp', 'rh', 'slp']) AS variable, unnest([temp_idw, rh_idw, slp_idw]) AS idw FROM context),
lr AS (SELECT *, row_number() OVER (PARTITION BY station_id, variable ORDER BY obs_ts) AS seq FROM ls LEFT JOIN li USING (station_id, obs_ts, variable)),
fold(station_id, variable, seq, obs_ts, x, past, steps, method, estimate) AS (
  SELECT DISTINCT station_id, variable, 0::BIGINT, NULL::TIMESTAMP, 0.0::DOUBLE, []::DOUBLE[], 0::BIGINT, NULL::VARCHAR, NULL::DOUBLE FROM lr
  UNION ALL
  SELECT station_id, variable, seq, obs_ts, x, CASE WHEN coalesce(x, estimate) IS NULL THEN past ELSE list_append(past, coalesce(x, estimate))[-12:] END, steps, method, estimate FROM
  (SELECT *, CASE WHEN x IS NULL AND method <> 'NO_ESTIMATE' THEN {BOUND.format(STEP_SQL)} END AS estimate FROM
  (SELECT *, CASE WHEN x IS NULL THEN CASE WHEN steps * 5.0 > 60 OR steps > 12 THEN 'NO_ESTIMATE' WHEN idw IS NOT NULL AND len(past) >= 3 THEN 'COMBINED_TEMPORAL_SPATIAL' WHEN idw IS NOT NULL THEN 'SPATIAL_IDW_CONSENSUS'
    WHEN len(past) >= 3 THEN 'CAUSAL_TEMPORAL_INTERPOLATION' WHEN len(past) > 0 THEN 'ROLLING_BASELINE' ELSE 'NO_ESTIMATE' END END AS method FROM
  (SELECT l.station_id, l.variable, l.seq, l.obs_ts, l.x, l.idw, f.past, CASE WHEN l.x IS NULL THEN f.steps + 1 ELSE 0 END AS steps FROM fold f JOIN lr l ON l.station_id = f.station_id AND l.variable = f.variable AND l.seq = f.seq + 1))))"""

ORACLES = {
    "imputed_series": oracle("SELECT station_id, variable, obs_ts, steps AS missing_steps, estimate, method FROM fold WHERE seq > 0 AND x IS NULL", *CONTEXT, FOLD_CTE, doubles=["estimate"]).replace("WITH ", "WITH RECURSIVE ", 1),
    "temporal_baselines": oracle(
        f"SELECT station_id, obs_ts, len(history) AS n, {med('history[-6:]')} AS median6, {med('history')} AS median12, CASE WHEN len(history) > 1 THEN list_stddev_samp(history) END AS std12 FROM h",
        "bs AS (SELECT station_id, station_id AS series, obs_ts, temperature_c AS x FROM observations)", hist_cte("bs"), doubles=["median6", "median12", "std12"]),
    "imputed_readings": oracle(IMP_OUT, *CONTEXT, MISSING_CTE, hist_cte("mseries"), impute_cte(False), error_sql("coalesce(gap_minutes, 0)"), doubles=["gap_minutes", "estimate", *ERR]),
    "imputed_readings_two_sided": oracle(IMP_OUT, *CONTEXT, MISSING_CTE, hist_cte("mseries"), impute_cte(True), error_sql("coalesce(gap_minutes, 0)"), doubles=["gap_minutes", "estimate", *ERR]),
    "correction_recommendations": oracle("SELECT * FROM corr", *CORRECTED, doubles=["estimate", "departure", *ERR]),
    "correction_page": oracle(
        """SELECT recommendation_id, station_id, obs_ts, status, estimate, total_count, total_count > 40 AS has_more FROM (SELECT *, count(*) OVER () AS total_count FROM corr WHERE variable = 'temp' AND status = 'CORRECTION_CANDIDATE')
        ORDER BY obs_ts DESC, station_id LIMIT 30 OFFSET 10""", *CORRECTED, doubles=["estimate"]),
    "correction_bundles": oracle(
        """SELECT station_id, obs_ts, new_temp, new_rh, new_slp, proposals, candidates, violations, violations = '' AS is_consistent, CASE WHEN violations = '' THEN candidates ELSE 0 END AS candidates_kept,
        CASE WHEN candidates > 0 AND violations = '' THEN 'CORRECTION_CANDIDATE' ELSE 'REVIEW_RECOMMENDED' END AS bundle_status FROM checked""", *CORRECTED, BUNDLE, doubles=["new_temp", "new_rh", "new_slp"]),
    "resampled_grid": oracle(
        """SELECT g.station_id, g.obs_ts, g.elevation_m, CASE WHEN a_ts IS NULL THEN n.x WHEN n.obs_ts IS NULL THEN a_x WHEN n.obs_ts > a_ts
        THEN a_x + (n.x - a_x) * ((epoch_us(g.obs_ts) - epoch_us(a_ts)) / (epoch_us(n.obs_ts) - epoch_us(a_ts))) ELSE a_x END AS value
        FROM (SELECT g.*, a.obs_ts AS a_ts, a.x AS a_x FROM grid g ASOF LEFT JOIN vx a ON g.station_id = a.station_id AND g.obs_ts >= a.obs_ts) g ASOF LEFT JOIN vx n ON g.station_id = n.station_id AND g.obs_ts <= n.obs_ts""",
        """vx AS (SELECT station_id, obs_ts, temperature_c AS x FROM observations WHERE temperature_c IS NOT NULL),
        grid AS (SELECT station_id, elevation_m, make_timestamp(unnest(generate_series(CAST(ceil(lo / 3600000000.0::DOUBLE) AS BIGINT), CAST(floor(hi / 3600000000.0::DOUBLE) AS BIGINT))) * 3600000000) AS obs_ts
        FROM (SELECT station_id, min(epoch_us(obs_ts)) AS lo, max(epoch_us(obs_ts)) AS hi, arg_min(elevation_m, obs_ts) AS elevation_m FROM observations GROUP BY 1))""", doubles=["value"]),
}
