"""Feature catalogue, named feature sets and the full feature matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from meteoqc.operators.features import LAGS, PERSISTENCE_VARS, STATS, WINDOWS, calendar_features, time_features
from meteoqc.operators.spatial import Network, bucketed_neighbours, neighbour_edges, stations
from meteoqc.schema import DEW, MEASURES, RH, SLP, STNP, TEMP

# --- fixed values: feature sets ----------------------------------------------
SET_A = [TEMP, RH, SLP, "sin_hour", "cos_hour", "sin_day_of_year", "cos_day_of_year"]
SET_B = SET_A + [
    f"{TEMP}_rolling_mean_1h", f"{TEMP}_rolling_std_1h", f"{TEMP}_delta", f"{TEMP}_rate_per_minute", f"{TEMP}_duration_unchanged_minutes",
    f"{RH}_rolling_mean_1h", f"{RH}_rolling_std_1h", f"{RH}_delta", f"{SLP}_rolling_mean_1h", f"{SLP}_delta",
]
SET_C = SET_B + ["temp_rh_delta_interaction", "joint_temp_rh_divergence", "temp_slp_delta_interaction", "joint_standardized_anomaly_magnitude"]
SET_D = SET_C + ["spatial_neighbor_count", "spatial_temp_delta_from_neighbor_mean", "spatial_rh_delta_from_neighbor_mean", "spatial_slp_delta_from_neighbor_mean"]
SETS = {"A": SET_A, "B": SET_B, "C": SET_C, "D": SET_D}
FORBIDDEN = ["wind_speed", "wind_speed_mps", "precipitation", "dew_point_c", "dew_point"]
METADATA = ["event_id", "station_id", "station_name", "obs_ts", "latitude", "longitude", "elevation_m", "source", "report_type", "ingestion_ts",
            "data_quality_status", "raw_quality_flags", "run_id", "dataset_id", "is_synthetic", "event_type", "value"]
LABELS = ["is_fault", "y_true", "anomaly_type", "anomaly_id", "scenario_id"]
# --- end of fixed values ------------------------------------------------------

#: user-registered features: name -> (category, column factory)
REGISTERED: dict[str, tuple[str, Callable[[], Column]]] = {}


def register(name: str, category: str, factory: Callable[[], Column]) -> None:
    REGISTERED[name] = (category, factory)


def add_registered(df: DataFrame) -> DataFrame:
    return df.withColumns({n: f() for n, (_, f) in REGISTERED.items()}) if REGISTERED else df


def catalogue_rows() -> list[tuple[str, str, bool]]:
    """(name, category, usable for training) of every feature, built from the layout rules."""
    rows = [(c, "raw", True) for c in (TEMP, RH, SLP, STNP, DEW)]
    rows += [(c, "temporal", True) for c in ("hour", "minute", "day_of_year", "month", "day_of_week")]
    rows += [(f"{t}_{u}", "temporal", True) for u in ("hour", "day_of_year", "day_of_week") for t in ("sin", "cos")]
    rows += [(f"{c}_lag_{n}", "rolling", True) for c in MEASURES for n in LAGS]
    rows += [(f"{c}_rolling_{s}_{w}", "rolling", s != "count") for c in MEASURES for w in WINDOWS for s in STATS]
    rows += [("elapsed_minutes", "change", False)]
    rows += [(f"{c}_{s}", "change", True) for c in MEASURES for s in ("delta", "rate_per_minute", "rate_per_5min", "rate_per_hour", "acceleration")]
    rows += [(f"{c}_{s}", "persistence", True) for c in PERSISTENCE_VARS for s in ("consecutive_unchanged_count", "duration_unchanged_minutes", "rounded_unchanged_count")]
    rows += [(f"{c}_{s}_1h", "deviation", True) for c in PERSISTENCE_VARS for s in ("deviation_from_mean", "pct_deviation", "zscore")]
    rows += [(c, "multivariate", True) for c in ("dew_point_spread_c", *SET_C[-4:])]
    rows += [(c, "spatial", True) for c in ("spatial_neighbor_count", "spatial_nearest_neighbor_dist_km")]
    rows += [(f"spatial_neighbor_{v}_{s}", "spatial", True) for v in ("temp", "rh", "slp") for s in ("mean", "median", "std")]
    rows += [(f"spatial_{v}_delta_from_neighbor_mean", "spatial", True) for v in ("temp", "rh", "slp")]
    return rows + [(n, c, True) for n, (c, _) in REGISTERED.items()]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalogue_rows(), "feature string, category string, for_training boolean")


def check_names(names: Sequence[str]) -> None:
    bad = [n for n in names if any(n == f or n.startswith(f"{f}_") for f in FORBIDDEN)]
    if bad:
        raise ValueError(f"features outside the three-variable scope: {bad}")


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that are features: no metadata, no labels, no internal names."""
    return [c for c in df.columns if c not in METADATA and c not in LABELS and not c.startswith("_")]


def feature_pipeline(obs: DataFrame, net: Network = Network(), windows: Sequence[str] = tuple(WINDOWS)) -> DataFrame:
    """Calendar, time and bucketed neighbour features of every reading."""
    time = time_features(calendar_features(obs), windows=windows)
    return add_registered(bucketed_neighbours(time, neighbour_edges(stations(obs), net), net.tolerance_minutes, readings=obs))


def feature_set(df: DataFrame, name: str, keep: Sequence[str] = ("station_id", "obs_ts")) -> DataFrame:
    check_names(SETS[name])
    return df.select(*keep, *SETS[name])
