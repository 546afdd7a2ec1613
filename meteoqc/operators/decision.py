"""Evidence of one reading and the ordered rule cascade over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meteoqc.functions.physics import humidity_consistency
from meteoqc.functions.scores import zscore_score
from meteoqc.operators.explain import ACTIONS, AFTER_RECORD_ACTIONS
from meteoqc.operators.features import first_per_key, time_features
from meteoqc.operators.profile import high_water
from meteoqc.operators.quality import outside
from meteoqc.operators.spatial import Network, spatial_context
from meteoqc.schema import DECISION_BOUNDS, DEW, KEY, RH, SLP, STNP, TEMP, TS


@dataclass(frozen=True)
class Rules:
    """Thresholds of the cascade."""

    gap_minutes: float = 15.0
    gap_critical_minutes: float = 180.0
    flatline_steps: int = 6
    flatline_high_steps: int = 12
    score_low: float = 0.40
    score_medium: float = 0.65
    score_high: float = 0.80
    mixed_zscore: float = 3.0
    mixed_departure: float = 6.25
    temp_rate_max_per_minute: float = 0.5
    humidity_tolerance: float = 15.0


# --- fixed values: codes and their order --------------------------------------
BAD_STATUSES = ["REJECTED", "GAP", "DUPLICATE", "CORRUPTED"]
GATES = ["data_quality", "bounds", "flatline", "multivariate", "regional_mixed", "regional", "local", "cluster", "no_context", "nominal"]
GATE_DECISION = {
    "data_quality": "PROBABLE_DATA_QUALITY_ISSUE", "bounds": "PROBABLE_SENSOR_ANOMALY", "flatline": "PROBABLE_SENSOR_ANOMALY",
    "multivariate": "PROBABLE_SENSOR_ANOMALY", "regional_mixed": "PROBABLE_SENSOR_ANOMALY", "regional": "POSSIBLE_GENUINE_EVENT",
    "local": "PROBABLE_SENSOR_ANOMALY", "cluster": "POSSIBLE_GENUINE_EVENT", "no_context": "UNCERTAIN", "nominal": "NORMAL",
}
# --- end of fixed values ------------------------------------------------------
#: what to do, in one text for each gate
ADVICE = {g: " ".join(ACTIONS.get(g, [AFTER_RECORD_ACTIONS])) for g in GATES}


#: what the cascade reads of a reading; others of its columns pass through all exchanges
READ = [KEY, TS, TEMP, RH, SLP, DEW, STNP, "elevation_m", "data_quality_status"]
EVIDENCE = ["data_quality", "ml_anomaly", "temporal", "multivariate", "spatial"]


def evidence(df: DataFrame, rules: Rules = Rules(), score: str = "score", ref: str = "1h") -> DataFrame:
    """Five evidence structs from feature and spatial columns (see ``evidence_inputs``)."""
    have = set(df.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (TEMP, RH, SLP)]))
    bad = outside(TEMP, DECISION_BOUNDS) | outside(RH, DECISION_BOUNDS) | outside(SLP, DECISION_BOUNDS)
    status = F.col("data_quality_status")
    status = F.when(status == "ERROR", "CORRUPTED").when(status == "MISSING", "GAP").otherwise(status)
    rate = F.col(f"{TEMP}_rate_per_minute")
    s = F.coalesce(F.col(score), F.lit(0.0))
    return df.withColumns(
        {
            "data_quality": F.struct(
                status.alias("quality_status"), missing.alias("missing_fields"), F.col("elapsed_minutes").alias("communication_gap_minutes"),
                flag("is_duplicate").alias("is_duplicate"), flag("is_out_of_order").alias("is_out_of_order"), bad.alias("is_physical_out_of_bounds")),
            "ml_anomaly": F.struct(
                F.col(score).alias("raw_model_score"), s.alias("normalized_anomaly_score"), (s >= rules.score_medium).alias("ml_is_anomaly")),
            "temporal": F.struct(
                rate.alias("temp_rate_per_min"), F.col(f"{TEMP}_consecutive_unchanged_count").alias("consecutive_unchanged_count"),
                F.col(f"{TEMP}_duration_unchanged_minutes").alias("flatline_duration_minutes"),
                F.col(f"{TEMP}_zscore_{ref}").alias("baseline_deviation_zscore"),
                F.coalesce(F.abs(rate) > rules.temp_rate_max_per_minute, F.lit(False)).alias("is_rate_abnormal"), F.lit(False).alias("is_flatline")),
            "multivariate": F.struct(
                F.col("dew_point_spread_c").alias("dew_point_spread_c"),
                (~humidity_consistency(tolerance=rules.humidity_tolerance)["ok"]).alias("temp_rh_inconsistent"),
                F.col("joint_standardized_anomaly_magnitude").alias("joint_standardized_divergence"), F.lit(False).alias("is_multivariate_abnormal")),
            "spatial": F.struct(
                F.coalesce("valid_neighbors", F.lit(0)).alias("valid_neighbor_count"),
                F.coalesce("context_category", F.lit("INSUFFICIENT_CONTEXT")).alias("context_category"),
                F.col("temp_similar").alias("temp_consensus_fraction"), F.col("temp_minus_mean").alias("temp_target_minus_mean"),
                F.col("temp_zscore").alias("temp_target_zscore")),
        }
    )


def decide(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Gate id by one ``when`` chain (first match wins), then decision, severity and reasons."""
    dq, ml, tm, mv, sp = (F.col(c) for c in ("data_quality", "ml_anomaly", "temporal", "multivariate", "spatial"))
    gap = F.coalesce(dq["communication_gap_minutes"], F.lit(0.0))
    n_missing = F.size(dq["missing_fields"])
    late_gap = gap > rules.gap_minutes
    defect = F.coalesce(dq["quality_status"].isin(BAD_STATUSES), F.lit(False)) | dq["is_duplicate"] | dq["is_out_of_order"] | (n_missing > 0) | late_gap
    count = F.coalesce(tm["consecutive_unchanged_count"], F.lit(0))
    score = ml["normalized_anomaly_score"]
    strong = ml["ml_is_anomaly"] | (score >= rules.score_medium)
    signal = strong | (score >= rules.score_low) | tm["is_rate_abnormal"]
    z, off = F.abs(F.coalesce(sp["temp_target_zscore"], F.lit(0.0))), F.abs(F.coalesce(sp["temp_target_minus_mean"], F.lit(0.0)))
    category = sp["context_category"]
    df = df.withColumn(
        "gate",
        F.when(defect, "data_quality")
        .when(dq["is_physical_out_of_bounds"], "bounds")
        .when(tm["is_flatline"] | (count >= rules.flatline_steps), "flatline")
        .when(mv["is_multivariate_abnormal"] | mv["temp_rh_inconsistent"], "multivariate")
        .when(~signal, "nominal")
        .when((category == "REGIONAL_PATTERN") & ((z >= rules.mixed_zscore) | (off >= rules.mixed_departure)), "regional_mixed")
        .when(category == "REGIONAL_PATTERN", "regional")
        .when(category == "LOCAL_ONLY", "local")
        .when(category == "LOCAL_CLUSTER", "cluster")
        .otherwise("no_context"),
    )
    g = F.col("gate")
    severity = (
        F.when(g == "data_quality",
               F.when(gap >= rules.gap_critical_minutes, "CRITICAL")
               .when(F.array_contains(dq["missing_fields"], TEMP) | (n_missing >= 2), "HIGH")
               .when(dq["is_duplicate"] | dq["is_out_of_order"], "LOW").otherwise("MEDIUM"))
        .when(g == "bounds", "CRITICAL")
        .when(g == "flatline", F.when(count >= rules.flatline_high_steps, "HIGH").otherwise("MEDIUM"))
        .when(g == "regional_mixed", "HIGH")
        .when(g == "regional", F.when(strong, "LOW").otherwise("INFO"))
        .when(g == "local", F.when(score >= rules.score_high, "HIGH").otherwise("MEDIUM"))
        .when(g == "cluster", "LOW")
        .when(g.isin("multivariate", "no_context"), "MEDIUM")
        .otherwise("INFO")
    )
    by_score = g.isin("regional_mixed", "regional", "local", "cluster", "no_context") & strong
    reasons = [  # in the order the rules report them
        ((g == "data_quality") & dq["is_duplicate"], "DUPLICATE_TIMESTAMP"),
        ((g == "data_quality") & dq["is_out_of_order"], "OUT_OF_ORDER_TIMESTAMP"),
        ((g == "data_quality") & (n_missing > 0), "MISSING_REQUIRED_VARIABLES"),
        ((g == "data_quality") & late_gap, "DATA_GAP"),
        (g == "bounds", "OUT_OF_RANGE_PHYSICAL"),
        (g == "flatline", "PERSISTENT_VALUE"),
        (g == "multivariate", "MULTIVARIATE_DEVIATION"),
        (by_score & (score >= rules.score_high), "ML_HIGH_ANOMALY_SCORE"),
        (by_score & (score < rules.score_high), "ML_MODERATE_ANOMALY_SCORE"),
        (g == "regional_mixed", "MIXED_REGIONAL_EVENT_WITH_LOCAL_EXCESS"),
        (g.isin("regional_mixed", "regional"), "REGIONAL_SPATIAL_AGREEMENT"),
        ((g == "regional") & tm["is_rate_abnormal"], "RAPID_RATE_OF_CHANGE"),
        (g == "local", "LOCAL_SPATIAL_ISOLATION"),
        (g == "cluster", "LOCAL_CLUSTER_AGREEMENT"),
        (g == "no_context", "INSUFFICIENT_SPATIAL_CONTEXT"),
        (g == "no_context", "CONFLICTING_EVIDENCE"),
        (g == "nominal", "NOMINAL_OBSERVATION"),
    ]
    decision = _lookup(GATE_DECISION, g)
    return df.withColumns(
        {
            "decision": decision,
            "severity": severity,
            "reason_codes": F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in reasons])),
            "recommended_action": _lookup(ADVICE, g),
        }
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def evidence_inputs(obs: DataFrame, edges: DataFrame, ref: str = "24h", net: Network = Network()) -> DataFrame:
    """Feature and spatial columns of every reading, joined on (station, time)."""
    feats = time_features(obs, windows=(ref,), cols=[TEMP, RH, SLP], lags=(), ref=ref).withColumn("score", zscore_score(ref))
    timed = obs.filter(F.col(KEY).isNotNull() & F.col(TS).isNotNull())  # no other reading is joined, and none is a neighbour's match
    around = spatial_context(timed, edges, net, timed=True).select(
        KEY, TS, "valid_neighbors", "stale_neighbors", "context_category", "coherence", "temp_similar", "temp_minus_mean", "temp_zscore",
        *[f"{v}_{s}" for v in ("temp", "rh", "slp") for s in ("idw", "n", "std", "km")])
    return feats.join(around, [KEY, TS], "left")


def decisions(obs: DataFrame, edges: DataFrame, rules: Rules = Rules(), ref: str = "24h", net: Network = Network()) -> DataFrame:
    return decide(evidence(evidence_inputs(obs, edges, ref, net), rules, ref=ref), rules)


def anomaly_events(decided: DataFrame) -> DataFrame:
    """Stored events: everything but normal readings and genuine weather, with readable ids.

    Numbers run per station and day, so the id is unique and no day is numbered in one task.
    """
    out = decided.filter(~F.col("decision").isin("NORMAL", "POSSIBLE_GENUINE_EVENT"))
    day = F.date_format(TS, "yyyyMMdd")
    n = F.row_number().over(Window.partitionBy(KEY, day).orderBy(TS))
    return out.withColumn("event_id", F.format_string("ANOM-%s-%s-%04d", day, F.right(F.col(KEY), F.lit(6)), n))


def decision_cube(decided: DataFrame) -> DataFrame:
    """Counts per station and per network: decision x severity x day or night."""
    night = F.when(F.hour(TS).between(6, 17), "day").otherwise("night").alias("period")
    base = decided.select(KEY, "decision", "severity", night)
    cube = base.groupingSets(
        [[KEY, "decision"], [KEY, "severity"], [KEY, "decision", "period"], ["decision"]], KEY, "decision", "severity", "period"
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grouping"))
    return cube


def reason_counts(decided: DataFrame) -> DataFrame:
    return decided.select(KEY, F.explode("reason_codes").alias("reason")).groupBy(KEY, "reason").agg(F.count(F.lit(1)).alias("n"))


def arrival_flags(feed: DataFrame, arrival: str = "ingestion_ts", tie: str = "event_id") -> DataFrame:
    """(tie, station, time, is_duplicate, is_out_of_order) of every row of a feed as it arrived."""
    rows = feed.select(tie, KEY, TS, "source", arrival)
    first = rows.groupBy(KEY, TS, "source").agg(F.min(F.struct(arrival, tie)).alias("_first"))
    late = high_water(rows).select(tie, F.coalesce(F.col(TS) < F.col("high_water_ts"), F.lit(False)).alias("is_out_of_order"))
    marked = rows.join(first, [KEY, TS, "source"]).withColumn("is_duplicate", F.struct(arrival, tie) != F.col("_first"))
    return marked.join(late, tie).select(tie, KEY, TS, "is_duplicate", "is_out_of_order")


def feed_decisions(feed: DataFrame, edges: DataFrame, rules: Rules = Rules(), ref: str = "24h", net: Network = Network(),
                   arrival: str = "ingestion_ts", tie: str = "event_id") -> DataFrame:
    """Decisions on every row of a feed that repeats readings and delivers some late.

    Features come from each reading's first copy, so copies do not shift them; what a row owes to
    its arrival is added as evidence.
    """
    once = first_per_key(feed, [KEY, TS, "source"], [arrival, tie])
    inputs = evidence_inputs(once, edges, ref, net).drop(tie)
    return decide(evidence(arrival_flags(feed, arrival, tie).join(inputs, [KEY, TS]), rules, ref=ref), rules)
