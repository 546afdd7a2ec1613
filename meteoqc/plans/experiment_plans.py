"""Detectors fitted, calibrated and evaluated on separate parts of the observation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.operators import evaluate as ev
from meteoqc.operators import experiment as ex
from meteoqc.operators import feature_sets as fs
from meteoqc.operators import features as ft
from meteoqc.operators import spatial as sp
from meteoqc.operators.staging import staged
from meteoqc.plans.common import publish
from meteoqc.plans.evaluation_plans import APPLIED, CONF, P, Z24, deviation_cte, episode_ctes, rate_cte, rates, roll_cte
from meteoqc.schema import KEY, RH, SLP, TEMP
from meteoqc.sources.tables import OBS_SQL, observations

EVERY = 100
ID_COLUMNS = ["event_id", KEY, "obs_ts", "part", "seed", "site"]


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def baselines(obs):
    """The two detectors without training, per seed."""
    rows, labels = ex.variants(obs, every=EVERY)
    scores, calibrated = ex.column_scores(rows)
    return ex.evaluate(ex.with_truth(scores, labels), labels, calibrated)


def matrix(rows, edges):
    """Features of sets A to D; the neighbours of a variant's station are those of the same variant."""
    names = rows.select(KEY, "site").distinct()
    twin = F.concat("neighbor_id", F.lit(ex.MARK), F.substring_index(KEY, ex.MARK, -1))
    near = names.join(edges.withColumnRenamed(KEY, "site"), "site").select(KEY, twin.alias("neighbor_id"), "distance_km", "rank")
    timed = ft.time_features(fs.calendar_features(rows), windows=("1h",), cols=[TEMP, RH, SLP], lags=())  # what the sets name
    full = sp.bucketed_neighbours(timed, near, readings=rows)
    return staged(full.select(*ID_COLUMNS, *fs.SET_D))


def forests(obs):
    """Isolation forests of sets A to D and of three seeds, all grown in one job, per set and seed."""
    rows, labels = ex.variants(obs, every=EVERY)
    m = matrix(rows, sp.neighbour_edges(sp.stations(obs)))
    model = ex.ForestGrid(fs.SETS, ex.SEEDS, ["event_id"]).fit(m.filter(F.col("part") == "train"))
    # each perturbed part is scored by the forests of its seed
    s = model.transform_own(m.filter(F.col("part") != "train")).select(*ID_COLUMNS, F.explode("scores").alias("s"))
    s = s.filter(F.col("s").isNotNull()).select("part", F.col("s.seed").alias("seed"), F.concat(F.lit("forest_"), F.col("s.set")).alias("detector"), KEY, "obs_ts", F.col("s.score").alias("score"))
    return ex.evaluate(ex.with_truth(s, labels), labels, None)


def compared(metrics):
    return lambda obs: ex.stability(staged(metrics(obs)))


def parts(obs):
    """Readings, faults and detector-independent figures of every variant."""
    rows, labels = ex.variants(obs, every=EVERY, counted=True)
    events = labels.groupBy("part", "seed").agg(F.count_distinct("anomaly_id").alias("events"), F.sum("affected").alias("affected"))
    out = rows.groupBy("part", "seed").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("site").alias("stations"), F.min("obs_ts").alias("first_ts"), F.max("obs_ts").alias("last_ts"))
    same = out["part"].eqNullSafe(events["part"]) & out["seed"].eqNullSafe(events["seed"])
    return out.join(events, same, "left").select(out["part"], out["seed"], "rows", "stations", "first_ts", "last_ts", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("affected", F.lit(0)).alias("affected"))


QUERIES = {
    "experiment_parts": _q(parts),
    "experiment_baselines": _q(baselines),
    "experiment_baseline_stability": _q(compared(baselines)),
    "experiment_forests": _q(forests),
    "experiment_forest_stability": _q(compared(forests)),
}

# --- oracle side ---------------------------------------------------------------------------
SPLIT_SQL = OBS_SQL.replace("observations AS (", "all_observations AS (").rstrip() + """,
parted AS (SELECT * EXCLUDE (r, n), CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY obs_ts, event_id) AS r, count(*) OVER () AS n FROM all_observations))"""
VARIANTS = [("train", "train", None, None), ("clean", "test", None, None)] + [
    (part, part, seed, own) for seed in ex.SEEDS for part, own in (("validation", seed), ("test", seed + ex.TEST_OFFSET))]
THRESHOLD_SQL = """greatest(coalesce(least(1.0, greatest(0.0, greatest(-50.0 - temperature_c, temperature_c - 60.0)) / 10.0), 0.0),
  coalesce(least(1.0, greatest(0.0, greatest(-relative_humidity_pct, relative_humidity_pct - 100.0)) / 20.0), 0.0),
  coalesce(least(1.0, greatest(0.0, greatest(500.0 - sea_level_pressure_hpa, sea_level_pressure_hpa - 1080.0)) / 50.0), 0.0),
  coalesce(least(1.0, greatest(0.0, (abs(temperature_c_rate_per_5min) - 5.0) / 5.0)), 0.0))"""
NO_LABELS = "labels AS (SELECT NULL::VARCHAR AS anomaly_id, NULL::VARCHAR AS station_id, NULL::TIMESTAMP AS obs_ts, FALSE AS is_fault WHERE FALSE)"


def variant_sql(split, own_seed, select):
    """``select`` over one variant: ``observations`` as perturbed with its seed, and its ``labels``."""
    ctes = [SPLIT_SQL.strip(), f"raw_observations AS (SELECT * EXCLUDE (split) FROM parted WHERE split = '{split}')"]
    if own_seed is None:
        ctes += ["observations AS (SELECT * FROM raw_observations QUALIFY row_number() OVER (PARTITION BY station_id, obs_ts ORDER BY event_id) = 1)", NO_LABELS]
    else:
        ctes += [episode_ctes("raw_observations").strip().replace("'42|'", f"'{own_seed}|'").replace("% 300 = 0", f"% {EVERY} = 0"), APPLIED.strip()]
    ctes += [roll_cte(["24h"], [TEMP, RH, SLP]), rate_cte("rolled", [TEMP, RH, SLP]), deviation_cte("24h")]
    return f"(WITH {','.join(ctes)} {select})"


def union_sql(select):
    return " UNION ALL ".join(
        variant_sql(split, own, select.format(part=part, seed="NULL::BIGINT" if seed is None else f"{seed}::BIGINT")) for part, split, seed, own in VARIANTS)


SCORED_SQL = "scored AS (" + union_sql(
    """SELECT '{part}' AS part, {seed} AS seed, detector, station_id, obs_ts, round(s + 1e-9::DOUBLE, 6) AS score,
  EXISTS (SELECT 1 FROM labels l WHERE l.is_fault AND l.station_id = i.station_id AND l.obs_ts = i.obs_ts)::INT AS y FROM
  (SELECT station_id, obs_ts, unnest(['fixed_threshold', 'rolling_zscore']) AS detector, unnest([""" + THRESHOLD_SQL + ", tanh(" + Z24 + """ / 3.0)]) AS s FROM interacted) i""") + ")"
FAULTS_SQL = "faults AS (" + union_sql("SELECT '{part}' AS part, {seed} AS seed, anomaly_id, station_id, obs_ts FROM labels WHERE is_fault") + ")"
PRECISION, RECALL = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END", "CASE WHEN np > 0 THEN tp / np ELSE 0.0 END"
CUTS_SQL = f"""
val AS (SELECT detector, seed, score, y FROM scored WHERE part = 'validation'),
cand AS (SELECT DISTINCT detector, seed, np, nn, round(c, 9) AS c FROM (SELECT detector, seed, sum(y) AS np, sum(1 - y) AS nn, unnest(quantile_cont(score, [{", ".join(f"{i / 100.0!r}" for i in range(1, 100))}])) AS c FROM val GROUP BY 1, 2)),
tried AS (SELECT detector, seed, np, nn, c, sum(y) FILTER (score >= c)::DOUBLE AS tp, sum(1 - y) FILTER (score >= c)::DOUBLE AS fp FROM cand JOIN val USING (detector, seed) GROUP BY ALL),
rated AS (SELECT *, round(CASE WHEN tp > 0 THEN 2.0 * ({PRECISION}) * ({RECALL}) / (({PRECISION}) + ({RECALL})) ELSE 0.0 END, 9) AS m FROM tried),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY detector, seed ORDER BY m DESC, c) = 1),
cuts AS (SELECT detector, seed, CASE WHEN detector = 'fixed_threshold' OR np = 0 OR nn = 0 THEN 0.5 ELSE c END AS threshold, CASE WHEN detector <> 'fixed_threshold' AND np > 0 AND nn > 0 THEN m END AS metric FROM best),
judged AS (SELECT s.*, threshold, metric, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pred FROM scored s JOIN cuts USING (detector, seed) WHERE part = 'test'),
clean AS (SELECT c.detector, c.seed, count(*) AS clean_observations, count(CASE WHEN score >= threshold THEN 1 END) AS clean_alarms FROM scored s JOIN cuts c ON s.detector = c.detector WHERE part = 'clean' GROUP BY 1, 2),
ev AS (SELECT seed, count(DISTINCT anomaly_id) AS events FROM faults WHERE part = 'test' GROUP BY 1),
got AS (SELECT detector, seed, count(DISTINCT anomaly_id) AS detected FROM faults f JOIN judged j USING (part, seed, station_id, obs_ts) WHERE pred = 1 GROUP BY 1, 2),
metrics AS (SELECT r.*, threshold, metric, clean_observations, clean_alarms, coalesce(events, 0) AS events, coalesce(detected, 0) AS detected,
  round(CASE WHEN coalesce(events, 0) > 0 THEN coalesce(detected, 0) / events ELSE 0.0 END + 1e-9::DOUBLE, 4) AS event_recall
  FROM {rates('SELECT detector, seed, ' + CONF + ' FROM judged GROUP BY 1, 2')} r JOIN cuts USING (detector, seed) JOIN clean USING (detector, seed) LEFT JOIN ev USING (seed) LEFT JOIN got USING (detector, seed))"""


def _rounded(cols):
    return ", ".join(f"round({c} + 1e-9::DOUBLE, 6) + 0.0 AS {c}" for c in cols)


BASELINE_SQL = f"WITH {SCORED_SQL}, {FAULTS_SQL}, {CUTS_SQL.strip()}"
ORACLES = {
    "experiment_parts": f"""SELECT part, seed, count(*) AS rows, count(DISTINCT station_id) AS stations, min(obs_ts) AS first_ts, max(obs_ts) AS last_ts, any_value(events) AS events, any_value(affected) AS affected
      FROM ({union_sql("SELECT '{part}' AS part, {seed} AS seed, station_id, obs_ts, (SELECT count(DISTINCT anomaly_id) FROM labels) AS events, (SELECT count(*) FROM labels) AS affected FROM observations")}) GROUP BY 1, 2""",
    "experiment_baselines": f"{BASELINE_SQL} SELECT * REPLACE ({_rounded(['precision', 'recall', 'f1', 'fpr', 'fnr', 'threshold', 'metric', 'event_recall'])}) FROM metrics",
    "experiment_baseline_stability": f"""{BASELINE_SQL} SELECT detector, metric, count(v) AS seeds, round(avg(v) + 1e-9::DOUBLE, 6) + 0.0 AS mean, round(stddev_pop(v) + 1e-9::DOUBLE, 6) + 0.0 AS std
      FROM (SELECT detector, unnest(['precision', 'recall', 'f1', 'fpr', 'event_recall']) AS metric, unnest([precision, recall, f1, fpr, event_recall]) AS v FROM metrics) GROUP BY 1, 2""",
}
