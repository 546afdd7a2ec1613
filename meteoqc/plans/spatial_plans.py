"""Station network and neighbour comparison over the observation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meteoqc.operators import spatial as sp
from meteoqc.plans.common import oracle, publish
from meteoqc.schema import KEY, TEMP, TS, VARS
from meteoqc.sources.tables import observations

P = "PARTITION BY station_id ORDER BY obs_ts"

STATIONS_CTE = """
stations AS (SELECT station_id, arg_min(station_name, obs_ts) AS station_name, arg_min(latitude, obs_ts) AS latitude,
  arg_min(longitude, obs_ts) AS longitude, arg_min(coalesce(elevation_m, 0.0), obs_ts) AS elevation_m
  FROM observations GROUP BY station_id)"""


def pairs_cte(km: float = 600.0) -> str:
    hav = ("pow(sin(radians(b.latitude - a.latitude) / 2.0), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) "
           "* pow(sin(radians(b.longitude - a.longitude) / 2.0), 2)")
    return f"""
pairs AS (SELECT * FROM (SELECT a.station_id, b.station_id AS neighbor_id,
  2.0::DOUBLE * 6371.0088::DOUBLE * atan2(sqrt({hav}), sqrt(1.0::DOUBLE - ({hav}))) AS distance_km,
  fmod(degrees(atan2(sin(radians(b.longitude - a.longitude)) * cos(radians(b.latitude)),
    cos(radians(a.latitude)) * sin(radians(b.latitude)) - sin(radians(a.latitude)) * cos(radians(b.latitude))
    * cos(radians(b.longitude - a.longitude)))) + 360.0::DOUBLE, 360.0::DOUBLE) AS bearing_deg,
  b.elevation_m - a.elevation_m AS elevation_diff_m
  FROM stations a JOIN stations b ON a.station_id <> b.station_id) WHERE distance_km <= {km})"""


def edges_cte(k: int = 5, where: str = "TRUE") -> str:
    return f"""
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round(distance_km, 6), neighbor_id) AS rank
  FROM pairs WHERE {where}) WHERE rank <= {k})"""


FILLED = """coalesce(sea_level_pressure_hpa, CASE WHEN temperature_c IS NOT NULL THEN round(station_pressure_hpa /
  pow(1.0::DOUBLE - 0.0065::DOUBLE * elevation_m / (temperature_c + 273.15::DOUBLE),
      (9.80665::DOUBLE * 0.0289644::DOUBLE) / (8.31447::DOUBLE * 0.0065::DOUBLE)), 2) END)"""

SERIES_CTE = f"""
filled AS (SELECT station_id, obs_ts, temperature_c AS temp, relative_humidity_pct AS rh, {FILLED} AS slp FROM observations),
series AS (SELECT *, temp - lag(temp) OVER ({P}) AS d_temp, rh - lag(rh) OVER ({P}) AS d_rh, slp - lag(slp) OVER ({P}) AS d_slp FROM filled)"""

N_COLS = "n.obs_ts AS n_ts, n.temp AS n_temp, n.rh AS n_rh, n.slp AS n_slp, n.d_temp AS n_d_temp, n.d_rh AS n_d_rh, n.d_slp AS n_d_slp"
MATCH_CTE = f"""
probes AS (SELECT s.*, e.neighbor_id, e.distance_km, e.rank FROM series s JOIN edges e USING (station_id)),
matched AS (SELECT p.*, {N_COLS} FROM probes p ASOF LEFT JOIN series n ON p.neighbor_id = n.station_id AND p.obs_ts >= n.obs_ts),
matches AS (SELECT *, (epoch_us(n_ts) - epoch_us(obs_ts)) / 1000000.0::DOUBLE AS time_delta_seconds,
  abs(epoch_us(n_ts) - epoch_us(obs_ts)) > 1800 * 1000000 AS is_stale,
  coalesce(abs(epoch_us(n_ts) - epoch_us(obs_ts)) <= 1800 * 1000000 AND coalesce(n_temp, n_rh, n_slp) IS NOT NULL, FALSE) AS is_valid FROM matched)"""


def consensus_cte() -> str:
    agg, post = [], []
    for v in VARS:
        tol, tr = sp.TOLERANCE[v], sp.TREND_TOLERANCE[v]
        x, d = f"CASE WHEN is_valid THEN n_{v} END", f"CASE WHEN is_valid AND n_{v} IS NOT NULL THEN n_d_{v} END"
        w = f"CASE WHEN is_valid AND n_{v} IS NOT NULL THEN 1.0::DOUBLE / greatest(distance_km, 1.0) END"

        def share(cond, value):
            return f"coalesce(avg(CASE WHEN ({value}) IS NOT NULL THEN CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 0.0::DOUBLE)"

        agg += [f"count({x}) AS {v}_n", f"avg({x}) AS {v}_mean", f"quantile_cont({x}, 0.5) AS {v}_median",
                f"CASE WHEN count({x}) > 0 THEN coalesce(stddev_samp({x}), 0.0) END AS {v}_std", f"min({x}) AS {v}_min", f"max({x}) AS {v}_max",
                f"{share(f'({x}) > {v} + {tol}', x)} AS {v}_higher", f"{share(f'({x}) < {v} - {tol}', x)} AS {v}_lower",
                f"{share(f'abs(({x}) - {v}) <= {tol}', x)} AS {v}_similar", f"{share(f'({d}) > {tr}', d)} AS {v}_rising",
                f"{share(f'({d}) < -{tr}', d)} AS {v}_falling", f"{share(f'abs({d}) <= {tr}', d)} AS {v}_stable",
                f"count({d}) AS {v}_trend_n", f"sum(({w}) * n_{v}) / sum({w}) AS {v}_idw",
                f"avg(CASE WHEN ({x}) IS NOT NULL THEN distance_km END) AS {v}_km"]
        off = f"({v} - {v}_mean)"
        agree = (f"CASE WHEN d_{v} > {tr} THEN {v}_rising - {v}_falling WHEN d_{v} < -{tr} THEN {v}_falling - {v}_rising "
                 f"ELSE {v}_stable - ({v}_rising + {v}_falling) END")
        post += [f"{off} AS {v}_minus_mean", f"{v} - {v}_median AS {v}_minus_median", f"{v} - {v}_idw AS {v}_minus_idw",
                 f"CASE WHEN {off} IS NULL THEN NULL WHEN {v}_std > 1e-4 THEN {off} / {v}_std WHEN abs({off}) <= {tol} THEN 0.0::DOUBLE ELSE {off} / {tol}::DOUBLE END AS {v}_zscore",
                 f"CASE WHEN d_{v} IS NOT NULL AND {v}_trend_n > 0 THEN {agree} END AS {v}_agreement"]
    keep = ", ".join(f"any_value({c}) AS {c}" for c in ("temp", "rh", "slp", "d_temp", "d_rh", "d_slp"))
    return f"""
grouped AS (SELECT station_id, obs_ts, count(n_ts) AS matched_neighbors, count(CASE WHEN is_valid THEN 1 END) AS valid_neighbors,
  count(CASE WHEN is_stale THEN 1 END) AS stale_neighbors, avg(CASE WHEN is_valid THEN distance_km END) AS valid_mean_km,
  arg_min(n_temp, rank) FILTER (NOT is_stale AND n_temp IS NOT NULL) AS nearest_temp, {keep},
  {', '.join(agg)} FROM matches GROUP BY station_id, obs_ts),
consensus AS (SELECT *, {', '.join(post)} FROM grouped)"""


def context_cte() -> str:
    dep, corr, level = {}, {}, []
    for v in VARS:
        tol, tr = sp.TOLERANCE[v], sp.TREND_TOLERANCE[v]
        dep[v] = f"({v}_similar < 0.5 AND (abs(coalesce({v}_zscore, 0.0)) >= 2.2 OR abs(coalesce({v}_minus_median, 0.0)) > {2.0 * tol}))"
        corr[v] = f"({v}_similar >= 0.5 OR (coalesce(abs(d_{v}) >= {2.5 * tr!r}::DOUBLE, FALSE) AND coalesce({v}_agreement >= 0.5, FALSE)))"
        level.append(f"CASE WHEN {v}_n > 0 AND {v} IS NOT NULL THEN 0.6::DOUBLE * {v}_similar + 0.4::DOUBLE * coalesce(({v}_agreement + 1.0) / 2.0, 0.5) END")
    alone = " OR ".join(f"({dep[v]} AND NOT {corr[v]})" for v in VARS)
    return f"""
context AS (SELECT *, coalesce(list_avg([x FOR x IN [{', '.join(level)}] IF x IS NOT NULL]), 0.0) AS coherence,
  CASE WHEN valid_neighbors < 2 THEN 'INSUFFICIENT_CONTEXT' WHEN NOT ({' OR '.join(dep.values())}) THEN 'REGIONAL_PATTERN'
  WHEN NOT ({alone}) THEN 'REGIONAL_PATTERN' WHEN coalesce(abs(temp - nearest_temp) <= 1.5, FALSE) THEN 'LOCAL_CLUSTER'
  ELSE 'LOCAL_ONLY' END AS context_category FROM consensus)"""


NET = (STATIONS_CTE, pairs_cte(), edges_cte())
CONTEXT = (*NET, SERIES_CTE, MATCH_CTE, consensus_cte(), context_cte())

CONS = [f"{v}_{s}" for v in VARS for s in ("mean", "median", "std", "min", "max", "higher", "lower", "similar", "rising", "falling",
                                            "stable", "idw", "minus_mean", "minus_median", "minus_idw", "zscore", "agreement")]
CONS_INT = ["matched_neighbors", "valid_neighbors", "stale_neighbors"] + [f"{v}_n" for v in VARS]
BUCKET = [f"spatial_neighbor_{v}_{s}" for v in VARS for s in ("mean", "median", "std")]
BUCKET_D = [f"spatial_{v}_delta_from_neighbor_mean" for v in VARS]


def _edges(obs, net=sp.Network()):
    return sp.neighbour_edges(sp.stations(obs), net)


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def bucketed(o):
    return sp.bucketed_neighbours(o, _edges(o)).select(KEY, TS, "spatial_neighbor_count", "spatial_nearest_neighbor_dist_km", *BUCKET, *BUCKET_D)


def matches(o, causal):
    m = sp.neighbour_matches(o, _edges(o), causal=causal)
    return m.select(KEY, TS, "neighbor_id", F.col("n.obs_ts").alias("neighbor_ts"), F.col("n.temp").alias("neighbor_temp"), "time_delta_seconds", "is_stale")


def bucket_windows(o):
    """Tumbling half-hour aggregate per station, the form a stream keeps."""
    return o.groupBy(KEY, F.window(TS, "30 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("readings"), F.avg(TEMP).alias("mean_temp"), F.min(TEMP).alias("min_temp"), F.max(TEMP).alias("max_temp"),
    ).select(KEY, F.col("w.start").alias("window_start"), "readings", "mean_temp", "min_temp", "max_temp")


COMPARE = ["own", "neighbor_median", "deviation"]

QUERIES = {
    "station_dimension": _q(sp.stations),
    "station_pair_distances": _q(lambda o: sp.station_pairs(sp.stations(o))),
    "nearest_neighbour_edges": _q(lambda o: _edges(o)),
    "nearest_neighbours_similar_elevation": _q(lambda o: _edges(o, sp.Network(k=3, max_km=150.0, max_elevation_diff_m=200.0))),
    "bucketed_neighbour_features": _q(bucketed),
    "causal_neighbour_matches": _q(lambda o: matches(o, True)),
    "nearest_in_time_neighbour_matches": _q(lambda o: matches(o, False)),
    "trend_deltas": _q(lambda o: sp.with_deltas(o).select(KEY, TS, "temp", "rh", "slp", "d_temp", "d_rh", "d_slp")),
    "neighbour_consensus": _q(lambda o: sp.consensus(sp.neighbour_matches(o, _edges(o))).select(KEY, TS, *CONS_INT, *CONS)),
    "spatial_context_category": _q(lambda o: sp.spatial_context(o, _edges(o)).select(
        KEY, TS, "valid_neighbors", "stale_neighbors", "coherence", "context_category")),
    "trailing_neighbour_comparison": _q(lambda o: sp.compare_neighbours(o, _edges(o)).select(KEY, TS, "configured", "active", "agreeing", "alignment", *COMPARE)),
    "network_topology_report": _q(lambda o: sp.topology_report(sp.stations(o), _edges(o))),
    "half_hour_station_windows": _q(bucket_windows),
}

_slp = {"temp": "temperature_c", "rh": "relative_humidity_pct", "slp": "fslp"}
_bucket_aggs = ", ".join(
    f"avg(n.{v}) AS spatial_neighbor_{v}_mean, quantile_cont(n.{v}, 0.5) AS spatial_neighbor_{v}_median, "
    f"CASE WHEN count(n.{v}) > 0 THEN coalesce(stddev_samp(n.{v}), 0.0) END AS spatial_neighbor_{v}_std" for v in VARS)
BUCKET_SQL = f"""
b AS (SELECT *, {FILLED} AS fslp, CAST(round_even(epoch_us(obs_ts) / 1800000000.0::DOUBLE, 0) AS BIGINT) AS bucket FROM observations),
latest AS (SELECT station_id, bucket, arg_max(row(temperature_c, relative_humidity_pct, fslp), obs_ts) AS v FROM b GROUP BY 1, 2),
flat AS (SELECT station_id, bucket, v[1] AS temp, v[2] AS rh, v[3] AS slp FROM latest),
around AS (SELECT r.event_id, count(n.bucket) AS spatial_neighbor_count, min(CASE WHEN n.bucket IS NOT NULL THEN e.distance_km END) AS spatial_nearest_neighbor_dist_km, {_bucket_aggs}
  FROM b r JOIN edges e ON r.station_id = e.station_id LEFT JOIN flat n ON n.station_id = e.neighbor_id AND n.bucket = r.bucket GROUP BY r.event_id)"""

NEAREST_SQL = """
back AS (SELECT p.*, n.obs_ts AS b_ts, n.temp AS b_temp FROM probes p ASOF LEFT JOIN series n ON p.neighbor_id = n.station_id AND p.obs_ts >= n.obs_ts),
both_sides AS (SELECT p.*, n.obs_ts AS f_ts, n.temp AS f_temp FROM back p ASOF LEFT JOIN series n ON p.neighbor_id = n.station_id AND p.obs_ts <= n.obs_ts),
chosen AS (SELECT *, b_ts IS NULL OR (f_ts IS NOT NULL AND epoch_us(f_ts) - epoch_us(obs_ts) < epoch_us(obs_ts) - epoch_us(b_ts)) AS fwd FROM both_sides)"""

TRAIL_SQL = f"""
tr AS (SELECT s.station_id, s.obs_ts, s.temp AS own, e.neighbor_id FROM series s JOIN edges e USING (station_id)),
tm AS (SELECT t.*, CASE WHEN epoch_us(t.obs_ts) - epoch_us(n.obs_ts) <= 900 * 1000000 THEN n.temp END AS x
  FROM tr t ASOF LEFT JOIN (SELECT * FROM series WHERE temp IS NOT NULL) n ON t.neighbor_id = n.station_id AND t.obs_ts >= n.obs_ts)"""

ORACLES = {
    "station_dimension": oracle("SELECT * FROM stations", STATIONS_CTE, doubles=["latitude", "longitude"]),
    "station_pair_distances": oracle("SELECT * FROM pairs", STATIONS_CTE, pairs_cte(), doubles=["distance_km", "bearing_deg"]),
    "nearest_neighbour_edges": oracle("SELECT * FROM edges", *NET, doubles=["distance_km", "bearing_deg"]),
    "nearest_neighbours_similar_elevation": oracle(
        "SELECT * FROM edges", STATIONS_CTE, pairs_cte(150.0), edges_cte(3, "abs(elevation_diff_m) <= 200"), doubles=["distance_km", "bearing_deg"]),
    "bucketed_neighbour_features": oracle(
        f"""SELECT station_id, obs_ts, coalesce(spatial_neighbor_count, 0) AS spatial_neighbor_count, spatial_nearest_neighbor_dist_km, {', '.join(BUCKET)},
        {', '.join(f'{_slp[v]} - spatial_neighbor_{v}_mean AS spatial_{v}_delta_from_neighbor_mean' for v in VARS)} FROM b LEFT JOIN around USING (event_id)""",
        *NET, BUCKET_SQL, doubles=["spatial_nearest_neighbor_dist_km", *BUCKET, *BUCKET_D]),
    "causal_neighbour_matches": oracle(
        "SELECT station_id, obs_ts, neighbor_id, n_ts AS neighbor_ts, n_temp AS neighbor_temp, time_delta_seconds, is_stale FROM matches",
        *NET, SERIES_CTE, MATCH_CTE, doubles=["time_delta_seconds"]),
    "nearest_in_time_neighbour_matches": oracle(
        """SELECT station_id, obs_ts, neighbor_id, CASE WHEN fwd THEN f_ts ELSE b_ts END AS neighbor_ts, CASE WHEN fwd THEN f_temp ELSE b_temp END AS neighbor_temp,
        (epoch_us(CASE WHEN fwd THEN f_ts ELSE b_ts END) - epoch_us(obs_ts)) / 1000000.0::DOUBLE AS time_delta_seconds,
        abs(epoch_us(CASE WHEN fwd THEN f_ts ELSE b_ts END) - epoch_us(obs_ts)) > 1800 * 1000000 AS is_stale FROM chosen""",
        *NET, SERIES_CTE, MATCH_CTE, NEAREST_SQL, doubles=["time_delta_seconds"]),
    "trend_deltas": oracle("SELECT * FROM series", SERIES_CTE, doubles=["temp", "rh", "slp", "d_temp", "d_rh", "d_slp"]),
    "neighbour_consensus": oracle(f"SELECT station_id, obs_ts, {', '.join(CONS_INT + CONS)} FROM consensus", *CONTEXT[:-1], doubles=CONS),
    "spatial_context_category": oracle("SELECT station_id, obs_ts, valid_neighbors, stale_neighbors, coherence, context_category FROM context",
                                       *CONTEXT, doubles=["coherence"]),
    "trailing_neighbour_comparison": oracle(
        """SELECT *, own - neighbor_median AS deviation, CASE WHEN active = 0 THEN 'STALE_OR_MISSING' WHEN active >= 3 THEN 'ALIGNED' ELSE 'SPARSE' END AS alignment
        FROM (SELECT station_id, obs_ts, any_value(own) AS own, count(*) AS configured, count(x) AS active, quantile_cont(x, 0.5) AS neighbor_median,
        count(CASE WHEN abs(x - own) <= 2.0 THEN 1 END) AS agreeing FROM tm GROUP BY 1, 2)""", *NET, SERIES_CTE, TRAIL_SQL, doubles=COMPARE),
    "network_topology_report": oracle(
        """SELECT s.station_id, count(e.rank) AS neighbors, coalesce(string_agg(e.neighbor_id, ',' ORDER BY e.rank), '') AS neighbor_ids,
        min(e.distance_km) AS nearest_km, count(e.rank) > 0 AS is_connected FROM stations s LEFT JOIN edges e USING (station_id) GROUP BY 1""",
        *NET, doubles=["nearest_km"]),
    "half_hour_station_windows": oracle(
        """SELECT station_id, time_bucket(INTERVAL '30 minutes', obs_ts) AS window_start, count(*) AS readings, avg(temperature_c) AS mean_temp,
        min(temperature_c) AS min_temp, max(temperature_c) AS max_temp FROM observations GROUP BY 1, 2""", doubles=["mean_temp"]),
}
