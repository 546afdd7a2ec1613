"""Feature matrix, isolation forest, attributions and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.operators import decision as dc
from meteoqc.operators import evaluate as ev
from meteoqc.operators import explain as xp
from meteoqc.operators import feature_sets as fs
from meteoqc.operators import forest as fo
from meteoqc.operators import spatial as sp
from meteoqc.operators.features import first_per_key
from meteoqc.operators.staging import staged
from meteoqc.plans.common import oracle, publish
from meteoqc.plans.decision_plans import DECIDED, RULES, decided, decided_table, edges_of
from meteoqc.plans.feature_plans import deviation_cte, persistence_cte, rate_cte, roll_cte
from meteoqc.plans.spatial_plans import BUCKET_SQL, NET, VARS, _slp
from meteoqc.schema import DEW, KEY, MEASURES, RH, SLP, TEMP, TS
from meteoqc.sources.tables import observations

ID = [KEY, TS]
TRAIN = [TEMP, RH, SLP, f"{TEMP}_rolling_mean_24h", f"{TEMP}_rolling_std_24h", f"{TEMP}_delta", f"{TEMP}_rate_per_minute", "joint_standardized_anomaly_magnitude"]


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def matrix(obs):
    f = fs.feature_pipeline(obs, windows=("1h",))
    return fs.feature_set(f, "D")


def coverage(obs):
    """Catalogue entries that the time features supply and how many readings have a value."""
    f = fs.time_features(fs.calendar_features(obs), windows=("1h",))
    names = [c for c in fs.feature_columns(f) if c not in ("pressure", "temp")]
    known = fs.catalogue(obs.sparkSession).filter("for_training")
    filled = f.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "filled")
    return known.join(filled, "feature").groupBy("category").agg(F.count(F.lit(1)).alias("features"), F.sum("filled").alias("filled"))


def _rows(obs):
    obs = obs.select("event_id", *ID, TEMP, RH, SLP, DEW, "is_fault")
    return staged(fs.time_features(obs, windows=("24h",), cols=[TEMP, RH, SLP], lags=(), ref="24h", persistence=False).select("event_id", *ID, *TRAIN, "is_fault"))


def forest(rows):
    return fo.IsolationForest(TRAIN, ["event_id"]).fit(rows)


def scores(obs):
    rows = _rows(obs)
    return forest(rows).transform(rows).select(*ID, "raw", "score", "pred", "is_fault")


def registry(obs):
    rows = _rows(obs)
    return forest(rows).registry_row(obs.sparkSession, "isolation_forest_s42", rows)


def calibrated(obs):
    rows = _rows(obs)
    scored = staged(forest(rows).transform(rows).withColumn("y_true", F.col("is_fault").cast("int")))
    best = ev.calibrate(scored)
    cut = scored.join(F.broadcast(best.select("threshold")), F.lit(True))  # one row
    return ev.confusion(cut.withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))).join(F.broadcast(best), F.lit(True))


def attributions(obs):
    """The strongest features of every reading; ``flagged`` marks scores of 0.5 and more."""
    rows = _rows(obs)
    m = forest(rows)
    scored = m.transform(rows).withColumn("flagged", F.col("score") >= 0.5)
    out = m.with_contributions(scored).withColumn("top", fo.ranked("contributions", 5))
    return out.select(*ID, "score", "flagged", F.explode("top").alias("t")).select(*ID, "score", "flagged", "t.*")


def fallback(obs):
    rows = obs.select(*ID, TEMP, RH, SLP).withColumn("contributions", fo.value_contributions([TEMP, RH, SLP]))
    return rows.select(*ID, F.explode(fo.ranked("contributions", 2)).alias("t")).select(*ID, "t.*")


def explained(obs):
    e = xp.explain(decided(obs), RULES.gap_minutes)
    return e.select(*ID, "summary", F.array_join("investigation_steps", "; ").alias("steps"), F.col("evidence.operational").alias("interpretation"),
                    F.col("evidence.contextual.category").alias("category"), F.col("evidence.direct.temperature_c").alias("measured"))


def keyword_rates(obs):
    return xp.pass_rates(xp.keyword_check(xp.explain(decided(obs), RULES.gap_minutes)))


def records(obs):
    """Explanation records of all stored events: text, neighbours, and the strongest features."""
    d = dc.decisions(obs.select("event_id", *dc.READ), edges_of(obs), RULES).select(
        "event_id", *ID, TEMP, RH, SLP, *dc.EVIDENCE, "gate", "decision", "severity", "reason_codes")
    rows = _rows(obs)
    m = forest(rows)
    # readings may share station and time, so features are found by the reading's own id as well
    reading = F.coalesce(F.col("event_id").cast("string"), F.lit("")).alias("reading")
    events = staged(dc.anomaly_events(d.select("*", reading)))
    own = [*ID, "reading"]
    feats = first_per_key(rows.select("*", reading).join(events.select(*own), own, "left_semi"), own, TRAIN)
    top = m.with_contributions(feats).select(*own, fo.ranked("contributions", 5).alias("top"))
    near = sp.compare_neighbours(obs, edges_of(obs)).select(*ID, "neighbor_median", "deviation", "alignment")
    full = xp.explain(events.join(top, own, "left").join(near, ID, "left"), RULES.gap_minutes, "top")
    return full.select("event_id", *ID, "decision", "severity", "summary", "alignment", "deviation", F.size("top").alias("features"))


def event_explanations(obs):
    """Events joined with their explanation by id."""
    d = decided_table(obs)
    ev_rows = dc.anomaly_events(d)
    events = ev_rows.select("event_id", *ID, "severity")
    text = xp.explain(ev_rows, RULES.gap_minutes).select("event_id", "summary")
    return events.join(text, "event_id")


QUERIES = {
    "feature_matrix_set_d": _q(matrix),
    "feature_catalogue_coverage": _q(coverage),
    "forest_scores": _q(scores),
    "forest_model_registry": _q(registry),
    "forest_calibration": _q(calibrated),
    "forest_attributions": _q(attributions),
    "value_contributions": _q(fallback),
    "explanation_texts": _q(explained),
    "explanation_keyword_rates": _q(keyword_rates),
    "explanation_records": _q(records),
    "event_explanations": _q(event_explanations),
}

# --- oracle side ---------------------------------------------------------------------------
def _steps_sql():
    codes = ", ".join(f"CASE WHEN contains(reasons, '{c}') THEN '{t}' END" for c, t in xp.RECORD_ACTIONS.items() if not c.startswith(("DUPLICATE", "OUT_OF")))
    lines = " ".join(f"WHEN '{g}' THEN '{'; '.join(s)}'" for g, s in xp.ACTIONS.items())
    return f"CASE gate WHEN 'data_quality' THEN concat_ws('; ', {codes}, '{xp.AFTER_RECORD_ACTIONS}') {lines} END"


def _fixed(number, digits):
    return f"round({number} + 1e-9::DOUBLE, {digits})"


FACT_SQL = {
    "absent": "CASE WHEN n_missing > 0 THEN 'Absent: ' || replace(missing_fields, ',', ', ') || '.' END",
    "silence": f"CASE WHEN gap_minutes > 240 THEN printf('Nothing came for %.1f minutes.', {_fixed('gap_minutes', 1)}) END",
    "stuck": f"printf('Same value %d times over %.1f minutes.', unchanged, {_fixed('flat_minutes', 1)})",
    "witnesses": "printf('%d stations nearby report.', valid_neighbors)",
    "pace": f"CASE WHEN rate_abnormal THEN printf('It moved %.2f C per minute.', {_fixed('rate', 2)}) END",
    "departs": f"CASE WHEN minus_mean IS NOT NULL THEN printf('It is %.2f C off the mean of the stations nearby.', {_fixed('minus_mean', 2)}) END",
    "score": f"printf('Its anomaly score is %.2f.', {_fixed('score', 2)})",
}
SUMMARY = "CASE gate " + " ".join(
    f"WHEN '{g}' THEN concat_ws(' ', " + ", ".join([f"'{h}'", *(FACT_SQL[f] for f in xp.FACTS.get(g, []) if f in FACT_SQL)]) + ")" for g, h in xp.HEADLINE.items()) + " END"
INTERP = "CASE decision " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in xp.INTERPRETATION.items()) + " END"
CAT = "CASE WHEN gate = 'local' AND rate_abnormal THEN 'SPIKE' WHEN gate = 'local' AND minus_mean IS NOT NULL THEN 'DRIFT' ELSE (CASE gate " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in xp.GATE_CATEGORY.items()) + " ELSE 'OTHER' END) END"
HITS = "CASE cat " + " ".join(f"WHEN '{k}' THEN " + " + ".join(f"contains(corpus, '{w}')::INT" for w in v) for k, v in xp.TERMS.items()) + " END"
D_DOUBLES = [c for c in fs.SET_D if c not in ("spatial_neighbor_count",)]
_cal = "sin(6.283185307179586::DOUBLE * (hour(obs_ts) + minute(obs_ts) / 60.0::DOUBLE) / 24.0) AS sin_hour, cos(6.283185307179586::DOUBLE * (hour(obs_ts) + minute(obs_ts) / 60.0::DOUBLE) / 24.0) AS cos_hour, " \
       "sin(6.283185307179586::DOUBLE * (dayofyear(obs_ts) - 1) / 365.25::DOUBLE) AS sin_day_of_year, cos(6.283185307179586::DOUBLE * (dayofyear(obs_ts) - 1) / 365.25::DOUBLE) AS cos_day_of_year"

_wins = tuple(f"_{w}" for w in ("15m", "30m", "3h", "6h", "24h"))
_known = [(n, c) for n, c, t in fs.catalogue_rows() if t and c != "spatial" and c != "raw" and not n.endswith(_wins)] + [(n, "raw") for n in (TEMP, RH, SLP, "station_pressure_hpa", "dew_point_c")]
_always = {"hour", "minute", "day_of_year", "month", "day_of_week"}
_count = ", ".join(f"count({n})" if c != "temporal" else "count(*)" for n, c in _known)
_lag = ", ".join(f"lag({c}, {k}) OVER (PARTITION BY station_id ORDER BY obs_ts) AS {c}_lag_{k}" for c in MEASURES for k in (1, 2, 3))

ORACLES = {
    "feature_catalogue_coverage": oracle(
        f"""SELECT category, count(*) AS features, CAST(sum(filled) AS BIGINT) AS filled FROM (SELECT unnest([{', '.join(f"'{c}'" for _, c in _known)}]) AS category, unnest([{_count}]) AS filled
        FROM (SELECT *, {_lag} FROM persisted)) GROUP BY 1""", roll_cte(["1h"]), rate_cte(), deviation_cte(), persistence_cte()),
    "feature_matrix_set_d": oracle(
        f"""SELECT station_id, obs_ts, {', '.join(c for c in fs.SET_C if not c.startswith(('sin_', 'cos_')))}, {_cal}, coalesce(spatial_neighbor_count, 0) AS spatial_neighbor_count,
        {', '.join(f'{_slp[v]} - spatial_neighbor_{v}_mean AS spatial_{v}_delta_from_neighbor_mean' for v in VARS)} FROM persisted JOIN (SELECT event_id, fslp FROM b) USING (event_id) LEFT JOIN around USING (event_id)""",
        *NET, BUCKET_SQL, roll_cte(["1h"]), rate_cte(), deviation_cte(), persistence_cte(), doubles=D_DOUBLES),
    "value_contributions": oracle(
        """SELECT station_id, obs_ts, row_number() OVER (PARTITION BY station_id, obs_ts ORDER BY abs(v) DESC, f DESC) AS rank, f AS feature, v AS value, v AS contribution,
        CASE WHEN abs(v) < 1e-4 THEN 'neutral' WHEN v > 0 THEN 'increases_anomaly' ELSE 'decreases_anomaly' END AS direction FROM (SELECT station_id, obs_ts, unnest(['temperature_c', 'relative_humidity_pct', 'sea_level_pressure_hpa']) AS f,
        unnest([coalesce(temperature_c, 0.0), coalesce(relative_humidity_pct, 0.0), coalesce(sea_level_pressure_hpa, 0.0)]) AS v FROM observations) QUALIFY rank <= 2"""),
    "explanation_texts": oracle(
        f"SELECT station_id, obs_ts, {SUMMARY} AS summary, {_steps_sql()} AS steps, {INTERP} AS interpretation, category, temperature_c AS measured FROM decided", *DECIDED),
    "explanation_keyword_rates": oracle(
        f"""SELECT cat AS expected_category, count(*) AS evaluated, count(CASE WHEN h > 0 THEN 1 END) AS passed, avg(h) AS mean_matches FROM (SELECT *, {HITS} AS h FROM
        (SELECT {CAT} AS cat, lower({SUMMARY} || ' ' || replace({_steps_sql()}, '; ', ' ')) AS corpus FROM decided)) GROUP BY 1""", *DECIDED, doubles=["mean_matches"]),
    "event_explanations": oracle(f"SELECT event_id, station_id, obs_ts, severity, {SUMMARY} AS summary FROM event_rows", *DECIDED),
}
