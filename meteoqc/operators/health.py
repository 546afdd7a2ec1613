"""Station health from decisions: windows, component statistics, scores, recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meteoqc.operators.chunks import run_positions, scan, with_chunk
from meteoqc.schema import KEY, TS


@dataclass(frozen=True)
class HealthRules:
    """Weights, limits and window of the health index."""

    window_hours: float = 24.0
    nominal_minutes: float = 5.0
    min_rows: int = 12
    recency: float = 1.5
    w_anomaly: float = 0.30
    w_quality: float = 0.20
    w_comm: float = 0.15
    w_temporal: float = 0.20
    w_spatial: float = 0.15


PENALTY = {"INFO": 0.0, "LOW": 0.25, "MEDIUM": 0.60, "HIGH": 1.00, "CRITICAL": 2.00}  # fixed values
WINDOW = "window"


def severity_penalty(col: str = "severity") -> Column:
    out = F.lit(1.0)
    for name, value in PENALTY.items():
        out = F.when(F.col(col) == name, value).otherwise(out)
    return out


def windowed(decided: DataFrame, rules: HealthRules = HealthRules()) -> DataFrame:
    """Rows of the window ending at each station's newest row ("cur") and of the one before ("prev").

    The newest time comes from an aggregate that combines before its shuffle, not from a window
    over the whole series.
    """
    newest = decided.groupBy(KEY).agg(F.max(TS).alias("_latest"))
    age_h = (F.unix_micros("_latest") - F.unix_micros(TS)) / 3_600_000_000.0
    w = rules.window_hours
    rows = decided.join(newest, KEY).withColumn("_age", age_h).filter(F.col("_age") <= 2 * w)
    return rows.withColumns(
        {
            WINDOW: F.when(F.col("_age") <= w, "cur").otherwise("prev"),
            "_weight": F.when(F.col("_age") <= w, F.exp(-rules.recency * F.col("_age") / w)).otherwise(1.0),
        }
    ).drop("_latest", "_age")


def window_statistics(rows: DataFrame, rules: HealthRules = HealthRules()) -> DataFrame:
    """All statistics of one station window in one aggregate."""
    key = [KEY, WINDOW]
    dq, tm, sp = F.col("data_quality"), F.col("temporal"), F.col("spatial")
    genuine = F.col("decision") == "POSSIBLE_GENUINE_EVENT"
    anomalous = F.col("decision").isin("PROBABLE_SENSOR_ANOMALY", "PROBABLE_DATA_QUALITY_ISSUE")
    malformed = F.coalesce(dq["quality_status"].isin("REJECTED", "CORRUPTED"), F.lit(False))
    n_missing = F.size(dq["missing_fields"])
    defect = (n_missing > 0) | dq["is_duplicate"] | dq["is_out_of_order"] | malformed
    gap = F.when(dq["communication_gap_minutes"] > 2.0 * rules.nominal_minutes, dq["communication_gap_minutes"])
    flat = tm["is_flatline"] | (tm["consecutive_unchanged_count"] >= 6)
    z = F.when(~genuine, tm["baseline_deviation_zscore"])
    delta_t = F.when(~genuine, F.coalesce(sp["temp_target_minus_mean"], tm["baseline_deviation_zscore"]))
    rows = with_chunk(rows).withColumns({"_anom": anomalous, "_dt": delta_t, "_z": z})
    rows = scan(rows, {"_it": ("sum", F.col("_dt").isNotNull().cast("long")), "_iz": ("sum", F.col("_z").isNotNull().cast("long"))}, key=key)
    rows = run_positions(rows, {"_run": ~F.col("_anom")}, key=key)

    def n(cond):
        return F.count(F.when(cond, 1))

    def drift(prefix, value, index):
        v, i = F.col(value), F.when(F.col(value).isNotNull(), F.col(index))
        return [
            F.count(v).alias(f"{prefix}_n"), F.avg(F.abs(v)).alias(f"{prefix}_mean_abs"),
            F.avg(F.when(v.isNotNull(), F.when(v >= 1.5, 1.0).otherwise(0.0))).alias(f"{prefix}_high"),
            F.avg(F.when(v.isNotNull(), F.when(v <= -1.5, 1.0).otherwise(0.0))).alias(f"{prefix}_low"),
            F.regr_slope(v, i.cast("double")).alias(f"{prefix}_slope"),
        ]

    w = F.col("_weight")
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("observations"), n(F.col("_anom")).alias("anomalies"), n(genuine).alias("genuine_events"),
        F.sum(F.when(F.col("_anom"), w * severity_penalty())).alias("_sev"), F.sum(w).alias("_w"), F.sum(F.when(defect, w)).alias("_defw"),
        F.max(F.when(F.col("_anom"), F.col("_run_since")).otherwise(0)).alias("longest_run"),
        F.sum(n_missing).alias("missing_fields"), n(dq["is_duplicate"]).alias("duplicates"), n(dq["is_out_of_order"]).alias("out_of_order"),
        n(malformed).alias("malformed"),
        F.round(F.coalesce(F.sum(gap), F.lit(0.0)), 1).alias("gap_minutes"), F.count(gap).alias("gap_episodes"),
        F.round(F.coalesce(F.max(gap), F.lit(0.0)), 1).alias("max_gap_minutes"),
        n(flat).alias("flatline_episodes"), F.round(F.coalesce(F.sum(F.when(flat, tm["flatline_duration_minutes"])), F.lit(0.0)), 1).alias("flatline_minutes"),
        F.coalesce(F.max(F.when(flat, tm["consecutive_unchanged_count"])), F.lit(0)).alias("max_flatline_steps"),
        n(sp["context_category"] == "LOCAL_ONLY").alias("isolated"), n(sp["context_category"].isin("REGIONAL_PATTERN", "LOCAL_CLUSTER")).alias("agreeing"),
        n(sp["context_category"] == "REGIONAL_PATTERN").alias("regional"),
        *drift("dt", "_dt", "_it"), *drift("z", "_z", "_iz"),
    )
    mean_w = F.col("_w") / F.col("observations")
    cols = {
        "severity_weighted": F.round(F.coalesce(F.col("_sev"), F.lit(0.0)) / mean_w, 3),
        "anomaly_rate": F.round(F.col("anomalies") / F.col("observations") * 100.0, 2),
        "defect_rate": F.round(F.coalesce(F.col("_defw"), F.lit(0.0)) / mean_w / F.col("observations"), 3),
        "isolation_rate": F.round(F.col("isolated") / F.col("observations"), 3),
        "is_repeated": F.col("anomalies") >= 3,
        "is_persistent": F.col("longest_run") >= 4,
        "is_stuck": (F.col("max_flatline_steps") >= 12) | (F.col("flatline_minutes") >= 60.0),
    }
    for p in ("dt", "z"):
        magnitude, share = F.coalesce(F.col(f"{p}_mean_abs"), F.lit(0.0)), F.coalesce(F.greatest(F.col(f"{p}_high"), F.col(f"{p}_low")), F.lit(0.0))
        cols[f"{p}_drift"] = F.round(magnitude, 3)
        cols[f"{p}_persistence"] = F.round(share, 3)
        cols[f"{p}_trend"] = F.round(F.when(F.col(f"{p}_n") >= 5, F.col(f"{p}_slope")).otherwise(0.0), 4)
        cols[f"{p}_significant"] = (share >= 0.40) & (magnitude >= 2.0)
    return out.withColumns(cols).drop("_sev", "_w", "_defw", *[f"{p}_{s}" for p in ("dt", "z") for s in ("mean_abs", "high", "low", "slope", "n")])


def _score(penalty: Column) -> Column:
    return F.round(100.0 - F.least(F.lit(100.0), penalty), 1)


def component_scores(stats: DataFrame, rules: HealthRules = HealthRules()) -> DataFrame:
    minutes = rules.window_hours * 60.0
    isolation = F.least(F.lit(100.0), F.col("isolation_rate") / 0.15 * 100.0)
    reasons = [
        (F.col("is_persistent"), "PERSISTENT_ANOMALY"),
        (~F.col("is_persistent") & F.col("is_repeated"), "REPEATED_ANOMALIES"),
        (F.col("missing_fields") > 0, "HIGH_MISSING_RATE"),
        (F.col("gap_episodes") > 0, "COMMUNICATION_INSTABILITY"),
        (F.col("is_stuck"), "PERSISTENT_FLATLINE"),
        (F.col("dt_significant"), "INCREASING_DRIFT"),
        (F.col("isolated") >= 3, "REPEATED_LOCAL_SPATIAL_DEVIATION"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in reasons]))
    out = stats.withColumns(
        {
            "anomaly_health": _score(F.col("severity_weighted") / F.greatest(F.lit(1.0), 0.12 * F.col("observations")) * 100.0),
            "quality_health": _score(F.col("defect_rate") / 0.15 * 100.0),
            "communication_health": _score(F.col("gap_minutes") / max(1.0, minutes * 0.15) * 100.0),
            "temporal_health": _score(F.col("flatline_minutes") / max(1.0, minutes * 0.10) * 100.0),
            "spatial_health": _score(isolation + F.when(F.col("dt_significant"), 30.0).otherwise(0.0)),
            "reason_codes": F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("NOMINAL_OPERATION"))),
        }
    )
    raw = (
        rules.w_anomaly * F.col("anomaly_health") + rules.w_quality * F.col("quality_health") + rules.w_comm * F.col("communication_health")
        + rules.w_temporal * F.col("temporal_health") + rules.w_spatial * F.col("spatial_health")
    )
    return out.withColumn("_raw_score", F.round(raw, 6))


def band(score: Column) -> Column:
    return (
        F.when(score >= 90.0, "HEALTHY").when(score >= 75.0, "GOOD").when(score >= 50.0, "ATTENTION")
        .when(score >= 25.0, "DEGRADED").when(score.isNotNull(), "CRITICAL")
    )


PARAMETERS = ("temperature_c", "relative_humidity", "sea_level_pressure_hpa")  # fixed values


def parameter_health(stats: DataFrame) -> DataFrame:
    """Long table station x parameter; temperature uses the neighbour departure as drift."""
    rows = stats.filter(F.col(WINDOW) == "cur").select(
        "*", F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col("dt_drift" if i == 0 else "z_drift").alias("drift"),
                                          F.col("dt_significant" if i == 0 else "z_significant").alias("drifting")) for i, p in enumerate(PARAMETERS)])).alias("p"))
    score = (
        100.0
        - F.when(F.col("p.drifting"), F.least(F.lit(40.0), F.col("p.drift") * 8.0)).otherwise(0.0)
        - F.when(F.col("is_stuck"), F.least(F.lit(50.0), F.col("flatline_minutes") * 0.5)).otherwise(0.0)
        - F.least(F.lit(30.0), F.col("anomalies") * 5.0)
    )
    value = F.greatest(F.lit(0.0), F.round(score, 1))
    return rows.select(KEY, F.col("p.parameter").alias("parameter"), value.alias("health_score"), band(value).alias("status_band"),
                       F.when(F.col("p.drifting"), F.col("p.drift")).alias("drift_indicator"), "flatline_minutes")


def station_health(decided: DataFrame, rules: HealthRules = HealthRules()) -> DataFrame:
    """Overall index, band, trend against the window before, reasons and recommendation."""
    stats = component_scores(window_statistics(windowed(decided, rules), rules), rules)
    return summarise(stats, rules)


def summarise(stats: DataFrame, rules: HealthRules = HealthRules()) -> DataFrame:
    prev = stats.filter(F.col(WINDOW) == "prev").select(KEY, F.col("observations").alias("_prev_n"), F.col("_raw_score").alias("_prev"))
    worst = parameter_health(stats).groupBy(KEY).agg(
        F.max(F.col("status_band").isin("CRITICAL", "DEGRADED")).alias("_bad_channel"))
    cur = stats.filter(F.col(WINDOW) == "cur").join(prev, KEY, "left").join(worst, KEY, "left")
    enough = F.col("observations") >= rules.min_rows
    overall = F.round("_raw_score", 1)
    cur = cur.withColumns(
        {
            "overall_health": F.when(enough, overall),
            "health_delta": F.when(enough & (F.col("_prev_n") >= rules.min_rows), F.round(overall - F.col("_prev"), 1)),
        }
    )
    delta = F.col("health_delta")
    cur = cur.withColumns(
        {
            "status_band": F.coalesce(band(F.col("overall_health")), F.lit("INSUFFICIENT_HISTORY")),
            "trend": F.when(~enough, "INSUFFICIENT_HISTORY").when(delta >= 3.0, "IMPROVING").when(delta <= -3.0, "DEGRADING").otherwise("STABLE"),
        }
    )
    b, t = F.col("status_band"), F.col("trend")
    persistent = F.arrays_overlap("reason_codes", F.array(F.lit("PERSISTENT_FLATLINE"), F.lit("PERSISTENT_ANOMALY")))
    level = (
        F.when(~enough, "MONITOR")
        .when((b == "CRITICAL") | ((b == "DEGRADED") & (t == "DEGRADING")), "PRIORITY_INSPECTION")
        .when((b == "DEGRADED") | ((b == "ATTENTION") & (t == "DEGRADING")) | F.col("_bad_channel") | persistent, "INSPECT")
        .when((b == "ATTENTION") | (t == "DEGRADING"), "MONITOR")
        .otherwise("NO_ACTION")
    )
    reasons = F.when(~enough, F.array(F.lit("INSUFFICIENT_OBSERVATION_HISTORY"))).when(
        t == "IMPROVING", F.array_union("reason_codes", F.array(F.lit("RECENT_RECOVERY_OBSERVED")))).otherwise(F.col("reason_codes"))
    parts = ["anomaly_health", "quality_health", "communication_health", "temporal_health", "spatial_health"]
    return cur.select(
        KEY, "observations", "overall_health", "health_delta", "status_band", "trend", level.alias("recommendation"),
        F.array_distinct(reasons).alias("reason_codes"),
        *[F.when(enough, F.col(c)).otherwise(100.0).alias(c) for c in parts],
        F.when(enough, F.format_string("Health %.1f/100 (%s, %s)", "overall_health", b, F.lower(t)))
        .otherwise(F.format_string("Only %d of %d readings needed", "observations", F.lit(rules.min_rows))).alias("summary"),
    )
