"""Time features over the observation table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meteoqc.operators import features as ft
from meteoqc.operators.chunks import drop_halo
from meteoqc.plans.common import oracle, publish
from meteoqc.schema import KEY, MEASURES, RH, SLP, TEMP, TS
from meteoqc.sources.tables import observations

ID = [KEY, TS]
P = "PARTITION BY station_id ORDER BY obs_ts"


def frame(name: str) -> str:
    return f"({P} RANGE BETWEEN INTERVAL '{ft.WINDOWS[name] - 0.000001:.6f}' SECOND PRECEDING AND CURRENT ROW)"


def rolling_sql(cols, windows):
    out = []
    for w in windows:
        for c in cols:
            over = f"OVER {frame(w)}"
            out += [
                f"avg({c}) {over} AS {c}_rolling_mean_{w}",
                f"coalesce(stddev_samp({c}) {over}, 0.0) AS {c}_rolling_std_{w}",
                f"min({c}) {over} AS {c}_rolling_min_{w}",
                f"max({c}) {over} AS {c}_rolling_max_{w}",
                f"count({c}) {over} AS {c}_rolling_count_{w}",
            ]
    return out


def rolling_names(cols, windows):
    return [f"{c}_rolling_{s}_{w}" for w in windows for c in cols for s in ft.STATS if s != "count"]


# CTE steps, each adding columns to the one before
def roll_cte(windows, cols=MEASURES):
    return f"rolled AS (SELECT *, {', '.join(rolling_sql(cols, windows))} FROM observations)"


def rate_cte(source="rolled", cols=MEASURES):
    deltas = ", ".join(f"{c} - lag({c}) OVER ({P}) AS {c}_delta" for c in cols)
    rates = []
    for c in cols:
        r = f"CASE WHEN elapsed_minutes > 0 THEN {c}_delta / elapsed_minutes END"
        rates += [f"{r} AS {c}_rate_per_minute", f"({r}) * 5.0 AS {c}_rate_per_5min", f"({r}) * 60.0 AS {c}_rate_per_hour",
                  f"{c}_delta - lag({c}_delta) OVER ({P}) AS {c}_acceleration"]
    return (f"stepped AS (SELECT *, (epoch_us(obs_ts) - lag(epoch_us(obs_ts)) OVER ({P})) / 60000000.0::DOUBLE AS elapsed_minutes, {deltas} FROM {source}),\n"
            f"rated AS (SELECT *, {', '.join(rates)} FROM stepped)")


RATE_NAMES = ["elapsed_minutes"] + [f"{c}_{s}" for c in MEASURES for s in
                                    ("delta", "rate_per_minute", "rate_per_5min", "rate_per_hour", "acceleration")]
DEVIATION_NAMES = [f"{c}_{s}_1h" for c in ft.PERSISTENCE_VARS for s in ("deviation_from_mean", "pct_deviation", "zscore")]
INTERACTION_NAMES = ["dew_point_spread_c", "temp_rh_delta_interaction", "joint_temp_rh_divergence",
                     "temp_slp_delta_interaction", "joint_standardized_anomaly_magnitude"]
PERSISTENCE_NAMES = [f"{c}_duration_unchanged_minutes" for c in ft.PERSISTENCE_VARS]
PERSISTENCE_INTS = [f"{c}_{s}" for c in ft.PERSISTENCE_VARS for s in ("consecutive_unchanged_count", "rounded_unchanged_count")]


def deviation_cte(ref="1h"):
    out = []
    for c in ft.PERSISTENCE_VARS:
        m, s = f"{c}_rolling_mean_{ref}", f"{c}_rolling_std_{ref}"
        out += [f"{c} - {m} AS {c}_deviation_from_mean_{ref}",
                f"CASE WHEN abs({m}) > 0.1 THEN ({c} - {m}) / {m} * 100.0 END AS {c}_pct_deviation_{ref}",
                f"CASE WHEN {s} > 1e-6 THEN ({c} - {m}) / {s} END AS {c}_zscore_{ref}"]
    def scaled(c):
        return f"CASE WHEN {c}_rolling_std_{ref} <> 0.0 THEN {c}_delta / ({c}_rolling_std_{ref} + 1e-6) END"
    norm = " + ".join(f"pow(coalesce({c}_zscore_{ref}, 0.0), 2)" for c in ft.PERSISTENCE_VARS)
    return (f"deviated AS (SELECT *, {', '.join(out)} FROM rated),\n"
            f"interacted AS (SELECT *, temperature_c - dew_point_c AS dew_point_spread_c, "
            f"{TEMP}_delta * {RH}_delta AS temp_rh_delta_interaction, {scaled(TEMP)} - {scaled(RH)} AS joint_temp_rh_divergence, "
            f"{TEMP}_delta * {SLP}_delta AS temp_slp_delta_interaction, sqrt({norm}) AS joint_standardized_anomaly_magnitude FROM deviated)")


def persistence_cte(source="interacted"):
    flags, ids, out = [], [], []
    for i, c in enumerate(ft.PERSISTENCE_VARS):
        for tag, x in (("p", c), ("q", f"round_even({c}, 1)")):
            prev = f"lag({x}) OVER ({P})"
            flags.append(f"CASE WHEN {x} IS NULL OR {prev} IS NULL OR {x} <> {prev} THEN 1 ELSE 0 END AS {tag}{i}_flag")
            ids.append(f"sum({tag}{i}_flag) OVER ({P}) AS {tag}{i}_run")
        run = f"PARTITION BY station_id, p{i}_run ORDER BY obs_ts"
        out += [f"row_number() OVER ({run}) AS {c}_consecutive_unchanged_count",
                f"(epoch_us(obs_ts) - epoch_us(first(obs_ts) OVER ({run}))) / 60000000.0::DOUBLE AS {c}_duration_unchanged_minutes",
                f"row_number() OVER (PARTITION BY station_id, q{i}_run ORDER BY obs_ts) AS {c}_rounded_unchanged_count"]
    return (f"flagged AS (SELECT *, {', '.join(flags)} FROM {source}),\n"
            f"run_ids AS (SELECT *, {', '.join(ids)} FROM flagged),\n"
            f"persisted AS (SELECT *, {', '.join(out)} FROM run_ids)")


def _q(fn):
    return lambda spark, sf_dir: publish(fn(observations(spark, sf_dir)))


def departures(obs):
    out = ft.time_features(obs, windows=("6h",), cols=[TEMP, RH, SLP], lags=(), persistence=False, ref="6h")
    departs = F.coalesce(F.abs(f"{TEMP}_zscore_6h") >= 1.5, F.lit(False))
    return out.select(*ID, TEMP, f"{TEMP}_rolling_mean_6h", f"{TEMP}_zscore_6h", f"{TEMP}_rate_per_hour", departs.alias("departs"))


def elapsed_and_rates(obs):
    return drop_halo(ft.add_rates(ft.prepare(obs, rows=2, span=0))).select(*ID, *RATE_NAMES)


def lags(obs):
    cols = [f"{c}_lag_{n}" for c in MEASURES for n in ft.LAGS]
    return drop_halo(ft.add_lags(ft.prepare(obs, rows=3, span=0))).select(*ID, *cols)


def rolling(obs):
    out = drop_halo(ft.add_rolling(ft.prepare(obs, rows=0)))
    return out.select(*ID, *[f"{c}_rolling_{s}_{w}" for w in ft.WINDOWS for c in MEASURES for s in ft.STATS])


def persistence(obs):
    marked = drop_halo(ft.mark_changes(ft.prepare(obs, rows=1, span=0)), "_us")
    return ft.add_persistence(marked).select(*ID, *PERSISTENCE_NAMES, *PERSISTENCE_INTS)


def deviations(obs):
    out = ft.time_features(obs, windows=("1h",), lags=(), persistence=False)
    return out.select(*ID, *DEVIATION_NAMES, *INTERACTION_NAMES)


def full_features(obs):
    out = ft.time_features(ft.calendar_features(obs))
    cols = ["sin_hour", "cos_hour", *[f"{c}_lag_{n}" for c in MEASURES for n in ft.LAGS], *RATE_NAMES,
            *DEVIATION_NAMES, *INTERACTION_NAMES, *PERSISTENCE_NAMES, *PERSISTENCE_INTS,
            *[f"{c}_rolling_{s}_{w}" for w in ft.WINDOWS for c in MEASURES for s in ft.STATS]]
    return out.select(*ID, *cols)


CAL = ["hour", "minute", "day_of_year", "month", "day_of_week", "sin_hour", "cos_hour", "sin_day_of_year",
       "cos_day_of_year", "sin_day_of_week", "cos_day_of_week"]
LAG_NAMES = [f"{c}_lag_{n}" for c in MEASURES for n in ft.LAGS]
LAG_SQL = ", ".join(f"lag({c}, {n}) OVER ({P}) AS {c}_lag_{n}" for c in MEASURES for n in ft.LAGS)


def _idcols(names):
    return f"SELECT station_id, obs_ts, {', '.join(names)}"


QUERIES = {
    "departures_from_recent_mean": _q(departures),
    "calendar_features": _q(lambda o: ft.calendar_features(o).select("event_id", *ID, *CAL)),
    "lag_features": _q(lags),
    "rolling_window_features": _q(rolling),
    "elapsed_and_rate_features": _q(elapsed_and_rates),
    "unchanged_run_features": _q(persistence),
    "deviation_and_interaction_features": _q(deviations),
    "full_time_features": _q(full_features),
    "missing_value_runs": _q(lambda o: ft.missing_runs(o).select(*ID, TEMP, "missing_steps", "gap_minutes")),
    "last_twelve_reading_stats": _q(lambda o: ft.rolling_rows(o).select(*ID, *[f"{TEMP}_last12_{s}" for s in ("mean", "std", "median")])),
}

ORACLES = {
    "departures_from_recent_mean": oracle(
        f"{_idcols([TEMP, TEMP + '_rolling_mean_6h', TEMP + '_zscore_6h', TEMP + '_rate_per_hour'])}, coalesce(abs({TEMP}_zscore_6h) >= 1.5, FALSE) AS departs FROM deviated",
        roll_cte(["6h"]), rate_cte(), deviation_cte("6h"), doubles=[f"{TEMP}_rolling_mean_6h", f"{TEMP}_zscore_6h", f"{TEMP}_rate_per_hour"]),
    "calendar_features": oracle(
        f"""SELECT event_id, station_id, obs_ts, hour(obs_ts) AS hour, minute(obs_ts) AS minute, dayofyear(obs_ts) AS day_of_year,
        month(obs_ts) AS month, isodow(obs_ts) - 1 AS day_of_week,
        sin({2 * math.pi!r}::DOUBLE * (hour(obs_ts) + minute(obs_ts) / 60.0::DOUBLE) / 24.0) AS sin_hour,
        cos({2 * math.pi!r}::DOUBLE * (hour(obs_ts) + minute(obs_ts) / 60.0::DOUBLE) / 24.0) AS cos_hour,
        sin({2 * math.pi!r}::DOUBLE * (dayofyear(obs_ts) - 1) / 365.25::DOUBLE) AS sin_day_of_year,
        cos({2 * math.pi!r}::DOUBLE * (dayofyear(obs_ts) - 1) / 365.25::DOUBLE) AS cos_day_of_year,
        sin({2 * math.pi!r}::DOUBLE * (isodow(obs_ts) - 1) / 7.0::DOUBLE) AS sin_day_of_week,
        cos({2 * math.pi!r}::DOUBLE * (isodow(obs_ts) - 1) / 7.0::DOUBLE) AS cos_day_of_week FROM observations""",
        doubles=CAL[5:]),
    "lag_features": oracle(f"SELECT station_id, obs_ts, {LAG_SQL} FROM observations", doubles=LAG_NAMES),
    "rolling_window_features": oracle(
        f"SELECT station_id, obs_ts, {', '.join(rolling_sql(MEASURES, ft.WINDOWS))} FROM observations",
        doubles=rolling_names(MEASURES, ft.WINDOWS)),
    "elapsed_and_rate_features": oracle(f"{_idcols(RATE_NAMES)} FROM rated", rate_cte("observations"), doubles=RATE_NAMES),
    "unchanged_run_features": oracle(f"{_idcols(PERSISTENCE_NAMES + PERSISTENCE_INTS)} FROM persisted",
                                     persistence_cte("observations"), doubles=PERSISTENCE_NAMES),
    "deviation_and_interaction_features": oracle(
        f"{_idcols(DEVIATION_NAMES + INTERACTION_NAMES)} FROM interacted", roll_cte(["1h"]), rate_cte(), deviation_cte(),
        doubles=DEVIATION_NAMES + INTERACTION_NAMES),
    "full_time_features": oracle(
        f"""SELECT station_id, obs_ts, sin({2 * math.pi!r}::DOUBLE * (hour(obs_ts) + minute(obs_ts) / 60.0::DOUBLE) / 24.0) AS sin_hour,
        cos({2 * math.pi!r}::DOUBLE * (hour(obs_ts) + minute(obs_ts) / 60.0::DOUBLE) / 24.0) AS cos_hour,
        {LAG_SQL}, {', '.join(RATE_NAMES + DEVIATION_NAMES + INTERACTION_NAMES + PERSISTENCE_NAMES + PERSISTENCE_INTS)},
        {', '.join(f'{c}_rolling_{s}_{w}' for w in ft.WINDOWS for c in MEASURES for s in ft.STATS)} FROM persisted""",
        roll_cte(ft.WINDOWS), rate_cte(), deviation_cte(), persistence_cte(),
        doubles=["sin_hour", "cos_hour", *LAG_NAMES, *RATE_NAMES, *DEVIATION_NAMES, *INTERACTION_NAMES, *PERSISTENCE_NAMES,
                 *rolling_names(MEASURES, ft.WINDOWS)]),
    "missing_value_runs": oracle(
        """SELECT station_id, obs_ts, temperature_c, CAST(row_number() OVER (PARTITION BY station_id, grp ORDER BY obs_ts) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS BIGINT) AS missing_steps,
        CASE WHEN temperature_c IS NULL AND grp > 0 THEN (epoch_us(obs_ts) - epoch_us(first(obs_ts) OVER (PARTITION BY station_id, grp ORDER BY obs_ts))) / 60000000.0::DOUBLE END AS gap_minutes FROM m""",
        f"m AS (SELECT *, sum(CASE WHEN temperature_c IS NOT NULL THEN 1 ELSE 0 END) OVER ({P}) AS grp FROM observations)",
        doubles=["gap_minutes"]),
    "last_twelve_reading_stats": oracle(
        f"""SELECT station_id, obs_ts, avg(temperature_c) OVER w AS temperature_c_last12_mean,
        coalesce(stddev_samp(temperature_c) OVER w, 0.0) AS temperature_c_last12_std,
        quantile_cont(temperature_c, 0.5) OVER w AS temperature_c_last12_median FROM observations
        WINDOW w AS ({P} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
        doubles=[f"{TEMP}_last12_{s}" for s in ("mean", "std", "median")]),
}
