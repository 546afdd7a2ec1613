"""Readable explanations of decisions: summary, actions, evidence tiers, keyword check.

A summary is the headline of the gate that decided and the facts that speak for it; actions follow
from the gate, or from the reason codes where the record itself is in doubt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meteoqc.functions.numeric import steady_round

HEADLINE = {
    "data_quality": "The record itself is in doubt.",
    "bounds": "No ground station can measure this value.",
    "flatline": "The reading has stopped moving.",
    "multivariate": "Temperature and moisture of this reading rule each other out.",
    "regional_mixed": "The whole area is changing, but this station goes further than the others.",
    "regional": "The change is shared across the area.",
    "local": "Only this station shows the change.",
    "cluster": "The closest stations share the change.",
    "no_context": "Too few stations report nearby to tell a fault from weather.",
    "nominal": "Nothing unusual.",
}
#: facts by gate, in the order in which a summary tells them
FACTS = {
    "data_quality": ["repeated", "late", "absent", "silence"],
    "flatline": ["stuck"],
    "regional_mixed": ["departs", "leading"],
    "regional": ["witnesses", "pace", "leading"],
    "local": ["witnesses", "pace", "departs", "leading"],
    "cluster": ["pace", "leading"],
    "no_context": ["score"],
}
ACTIONS = {
    "bounds": ["Take the value out of forecasts until the sensor has been bypassed or replaced."],
    "flatline": ["Read the channel at the logger.", "If it does not move there either, clean or thaw the sensor head."],
    "multivariate": ["Put a reference hygrometer beside the station for a day."],
    "regional_mixed": ["Judge this station again once the weather has passed."],
    "local": ["Look through the service log of the station for the last days.", "Swap in a spare sensor and compare both for a day."],
    "regional": ["Keep the reading; it is weather."],
    "cluster": ["Keep the reading; it is weather."],
    "no_context": ["Wait until more of the surroundings report, then judge again."],
    "nominal": ["Nothing to do."],
}
#: what to do about a doubtful record, by reason code
RECORD_ACTIONS = {
    "DATA_GAP": "Test the link of the station at the next scheduled call.",
    "MISSING_REQUIRED_VARIABLES": "Hold a raw message against the field list of the decoder.",
    "DUPLICATE_TIMESTAMP": "Find the sender that repeats its queue.",
    "OUT_OF_ORDER_TIMESTAMP": "Find where messages wait before they are sent.",
}
AFTER_RECORD_ACTIONS = "Leave the sensors alone until a sound record arrives."
#: a text of the category is expected to hold one of these
TERMS = {
    "FROZEN_SENSOR": ["stopped moving", "same value"],
    "LOCAL_SENSOR_FAULT": ["only this station", "goes further"],
    "SPIKE": ["per minute"],
    "DRIFT": ["mean of the stations"],
    "REGIONAL_EVENT": ["shared across", "share the change"],
    "DATA_GAP": ["record itself", "nothing came", "absent:"],
    "PHYSICAL_LIMIT": ["can measure"],
    "MULTIVARIATE_FAULT": ["moisture", "hygrometer"],
    "OTHER": ["nothing unusual", "too few"],
}
GATE_CATEGORY = {
    "data_quality": "DATA_GAP", "bounds": "PHYSICAL_LIMIT", "flatline": "FROZEN_SENSOR", "multivariate": "MULTIVARIATE_FAULT",
    "regional_mixed": "LOCAL_SENSOR_FAULT", "regional": "REGIONAL_EVENT", "local": "LOCAL_SENSOR_FAULT", "cluster": "REGIONAL_EVENT",
}
# --- fixed values: wording of decisions ---------------------------------------
INTERPRETATION = {
    "NORMAL": "nominal observation", "POSSIBLE_GENUINE_EVENT": "possible regional event", "PROBABLE_SENSOR_ANOMALY": "probable sensor anomaly",
    "PROBABLE_DATA_QUALITY_ISSUE": "probable data quality issue", "UNCERTAIN": "uncertain",
}
# --- end of fixed values ------------------------------------------------------


def _jumped() -> Column:
    return F.col("temporal.is_rate_abnormal") & F.col("temporal.temp_rate_per_min").isNotNull()


def _facts(top: Column | None, gap_minutes: float) -> dict[str, Column]:
    """Each fact as a sentence, null where it does not hold."""
    dq, tm, sp = F.col("data_quality"), F.col("temporal"), F.col("spatial")
    off, pace, silence = sp["temp_target_minus_mean"], tm["temp_rate_per_min"], dq["communication_gap_minutes"]
    return {
        "repeated": F.when(dq["is_duplicate"], "Its time was received before."),
        "late": F.when(dq["is_out_of_order"], "It is older than the newest reading."),
        "absent": F.when(F.size(dq["missing_fields"]) > 0, F.concat(F.lit("Absent: "), F.array_join(dq["missing_fields"], ", "), F.lit("."))),
        "silence": F.when(silence > gap_minutes, F.format_string("Nothing came for %.1f minutes.", steady_round(silence, 1))),
        "stuck": F.format_string("Same value %d times over %.1f minutes.", tm["consecutive_unchanged_count"], steady_round(tm["flatline_duration_minutes"], 1)),
        "witnesses": F.format_string("%d stations nearby report.", sp["valid_neighbor_count"]),
        "pace": F.when(_jumped(), F.format_string("It moved %.2f C per minute.", steady_round(pace, 2))),
        "departs": F.when(off.isNotNull(), F.format_string("It is %.2f C off the mean of the stations nearby.", steady_round(off, 2))),
        "score": F.format_string("Its anomaly score is %.2f.", steady_round(F.col("ml_anomaly.normalized_anomaly_score"), 2)),
        "leading": F.lit(None).cast("string") if top is None else F.when(F.size(top) > 0, F.concat(F.lit("Led by "), F.array_join(top, ", "), F.lit("."))),
    }


def summary(top: Column | None = None, gap_minutes: float = 15.0) -> Column:
    """Headline and facts. ``top``: names of the strongest contributors, told where they matter."""
    facts, out = _facts(top, gap_minutes), F.lit(HEADLINE["nominal"])
    for gate, headline in HEADLINE.items():
        out = F.when(F.col("gate") == gate, F.concat_ws(" ", F.lit(headline), *[facts[f] for f in FACTS.get(gate, [])])).otherwise(out)
    return out


def steps() -> Column:
    record = [F.when(F.array_contains("reason_codes", code), F.lit(text)) for code, text in RECORD_ACTIONS.items()]
    out = F.when(F.col("gate") == "data_quality", F.array_append(F.array_compact(F.array(*record)), F.lit(AFTER_RECORD_ACTIONS)))
    for gate, lines in ACTIONS.items():
        out = out.when(F.col("gate") == gate, F.array(*map(F.lit, lines)))
    return out


def category() -> Column:
    """What kind of text a row should have; a local change is told apart by its pace and its distance."""
    out = F.lit("OTHER")
    for gate, name in GATE_CATEGORY.items():
        out = F.when(F.col("gate") == gate, name).otherwise(out)
    local = F.col("gate") == "local"
    return F.when(local & _jumped(), "SPIKE").when(local & F.col("spatial.temp_target_minus_mean").isNotNull(), "DRIFT").otherwise(out)


def evidence_tiers() -> Column:
    """Direct, model, contextual and operational evidence kept apart."""
    names = [x for kv in INTERPRETATION.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.struct(
        F.struct("temperature_c", "relative_humidity_pct", "sea_level_pressure_hpa").alias("direct"),
        F.struct(F.col("ml_anomaly.raw_model_score").alias("raw_score"), F.col("ml_anomaly.normalized_anomaly_score").alias("score"), F.col("ml_anomaly.ml_is_anomaly").alias("flag")).alias("model"),
        F.struct(F.col("spatial.context_category").alias("category"), F.col("spatial.valid_neighbor_count").alias("neighbours"),
                 F.col("temporal.consecutive_unchanged_count").alias("unchanged"), F.col("temporal.is_rate_abnormal").alias("rate_abnormal"),
                 F.col("multivariate.temp_rh_inconsistent").alias("humidity_inconsistent")).alias("contextual"),
        F.element_at(F.create_map(*names), F.col("decision")).alias("operational"))


def explain(decided: DataFrame, gap_minutes: float = 15.0, contributions: str | None = None) -> DataFrame:
    """Decision rows with summary, steps and evidence tiers."""
    top = None
    if contributions is not None:
        top = F.transform(F.filter(F.slice(F.col(contributions), 1, 2), lambda c: c["direction"] == "increases_anomaly"), lambda c: c["feature"])
    return decided.withColumns({"summary": summary(top, gap_minutes), "investigation_steps": steps(), "evidence": evidence_tiers()})


def keyword_check(explained: DataFrame) -> DataFrame:
    """Per row: expected category, terms of it found in summary and actions, passed."""
    terms = F.create_map(*[x for k, v in TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    text = F.lower(F.concat_ws(" ", "summary", F.array_join("investigation_steps", " ")))
    out = explained.withColumn("expected_category", category())
    out = out.withColumn("matched", F.filter(F.element_at(terms, F.col("expected_category")), lambda w: F.contains(text, w)))
    return out.withColumn("passed", F.size("matched") > 0)


def pass_rates(checked: DataFrame) -> DataFrame:
    return checked.groupBy("expected_category").agg(
        F.count(F.lit(1)).alias("evaluated"), F.count(F.when(F.col("passed"), 1)).alias("passed"),
        F.avg(F.size("matched").cast("double")).alias("mean_matches"))
