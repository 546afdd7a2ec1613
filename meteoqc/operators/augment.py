"""Labelled perturbation of observations: episodes chosen by hash, effects by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meteoqc.functions.numeric import clamp, hash_bucket, steady_round
from meteoqc.operators.chunks import CHUNK, chunk_of, run_positions, with_chunk
from meteoqc.operators.cover import readings_before, with_cover
from meteoqc.schema import KEY, RH, SLP, TEMP, TS

# --- fixed values: type, hours, dT, dRH, dSLP, is_fault, affected -------------
EPISODES = [
    ("SPIKE", 0, 12.0, 0.0, 0.0, True, TEMP),
    ("SMALL_SPIKE", 0, 1.5, 0.0, 0.0, True, TEMP),
    ("NEGATIVE_SPIKE", 0, -15.0, 0.0, 0.0, True, TEMP),
    ("DRIFT", 24, 0.5, 0.0, 0.0, True, TEMP),
    ("OFFSET", 24, 8.0, 0.0, 0.0, True, TEMP),
    ("FROZEN_SENSOR", 18, 0.0, 0.0, 0.0, True, TEMP),
    ("INTERMITTENT_FREEZE", 18, 0.0, 0.0, 0.0, True, TEMP),
    ("MISSING_DATA", 6, 0.0, 0.0, 0.0, True, "all"),
    ("COMMUNICATION_GAP", 12, 0.0, 0.0, 0.0, True, "all"),
    ("DUPLICATE_DATA", 3, 0.0, 0.0, 0.0, True, "all"),
    ("OUT_OF_ORDER_DATA", 3, 0.0, 0.0, 0.0, True, "all"),
    ("RANDOM_NOISE", 12, 4.0, 0.0, 0.0, True, TEMP),
    ("MULTIVARIATE_INCONSISTENCY", 6, 9.0, 20.0, 0.0, True, "all"),
    ("MULTI_SENSOR_FAULT", 6, 8.0, 25.0, 6.0, True, "all"),
    ("COMBINED_FAULT", 12, 6.0, 15.0, 0.0, True, "all"),
    ("POSSIBLE_GENUINE_EVENT", 6, -6.0, 22.0, 3.5, False, "all"),
    ("UNCERTAIN", 3, 1.8, 0.0, 0.0, False, TEMP),
]
REMOVING = ["MISSING_DATA", "COMMUNICATION_GAP"]
# --- end of fixed values ------------------------------------------------------

HOUR_US = 3_600_000_000


def _digits(digest: Column, first: int) -> Column:
    return F.conv(F.substr(digest, F.lit(first), F.lit(8)), 16, 10).cast("long")


def choose_episodes(spark: SparkSession, obs: DataFrame, every: int = 300, seed: int = 42) -> DataFrame:
    """Episodes anchored at one reading in ``every``, chosen by hash; their number grows with the table."""
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("event_id").cast("string")))
    anchors = obs.filter(F.col(TEMP).isNotNull()).select(KEY, TS, F.col(TEMP).alias("start_temp"), digest.alias("h")).filter(_digits(F.col("h"), 1) % every == 0)
    kinds = spark.createDataFrame(
        [(i, *e) for i, e in enumerate(EPISODES)],
        "i int, anomaly_type string, hours int, d_temp double, d_rh double, d_slp double, is_fault boolean, affected string")
    out = anchors.join(F.broadcast(kinds), _digits(F.col("h"), 9) % len(EPISODES) == F.col("i"))  # as many rows as types
    return out.select(
        F.concat(F.lit("ANOM-"), F.substr("h", F.lit(1), F.lit(12))).alias("anomaly_id"), KEY, F.col(TS).alias("start_ts"),
        F.timestamp_micros(F.unix_micros(TS) + F.col("hours").cast("long") * HOUR_US).alias("end_ts"),
        "anomaly_type", "start_temp", "d_temp", "d_rh", "d_slp", "is_fault", "affected")


def affected_rows(obs: DataFrame, episodes: DataFrame, seconds: int = 86_400) -> DataFrame:
    """(reading, episode) pairs; a reading inside two episodes appears twice.

    For results that are pairs by nature: their number grows with the square of a station's density.
    Episodes are spread over the stretches of time they touch, so a reading meets only those of its
    own stretch and not all of its station.
    """
    spread = episodes.withColumn("_c", F.explode(F.sequence(chunk_of("start_ts", seconds), chunk_of("end_ts", seconds))))
    own = [F.col(f"o.{c}") for c in obs.columns if c == KEY or c not in episodes.columns]
    met = (F.col("o.station_id") == F.col("e.station_id")) & (F.col("o._c") == F.col("e._c")) & F.col(f"o.{TS}").between(F.col("e.start_ts"), F.col("e.end_ts"))
    return obs.withColumn("_c", chunk_of(TS, seconds)).alias("o").join(spread.alias("e"), met).select(*own, *[F.col(f"e.{c}") for c in episodes.columns if c != KEY])


def _effects() -> dict[str, Column]:
    kind = F.col("anomaly_type")
    hours = (F.unix_micros(TS) - F.unix_micros("start_ts")) / float(HOUR_US)
    noise = (hash_bucket(2001, F.col("event_id")) - 1000) / 1000.0 * F.col("d_temp")
    held = (kind == "FROZEN_SENSOR") | ((kind == "INTERMITTENT_FREEZE") & (F.floor(hours) % 2 == 0))
    change = F.when(kind == "DRIFT", F.col("d_temp") * hours).when(kind == "RANDOM_NOISE", noise).otherwise(F.col("d_temp"))
    return {
        TEMP: F.when(held & F.col(TEMP).isNotNull(), F.col("start_temp")).otherwise(steady_round(F.col(TEMP) + change, 2)),
        RH: clamp(F.col(RH) + F.col("d_rh"), 0.0, 100.0),
        SLP: steady_round(F.col(SLP) + F.col("d_slp"), 2),
    }


def labels(obs: DataFrame, episodes: DataFrame) -> DataFrame:
    hit = affected_rows(obs, episodes)
    new = F.when(~F.col("anomaly_type").isin(REMOVING), _effects()[TEMP])
    return hit.select(
        "anomaly_id", KEY, TS, "anomaly_type", F.col("affected").alias("affected_variable"), F.col(TEMP).alias("original_value"),
        new.alias("modified_value"), F.col("start_ts").alias("injection_start"), F.col("end_ts").alias("injection_end"), "is_fault")


def labelled_events(episodes: DataFrame) -> DataFrame:
    """The labels of ``labels`` one row per event, with its first and last time instead of every reading in between."""
    real = episodes.filter(F.col(KEY).isNotNull() & F.col("start_ts").isNotNull())
    return real.select("anomaly_id", KEY, "anomaly_type", F.col("affected").alias("affected_variable"), F.col("start_ts").alias("injection_start"),
                       F.col("end_ts").alias("injection_end"), "is_fault")


def with_affected(events: DataFrame, obs: DataFrame) -> DataFrame:
    """``events`` with the number of readings that each of them affects."""
    after = F.timestamp_micros(F.unix_micros("injection_end") + 1)
    counted = readings_before(readings_before(events, obs, F.col("injection_start"), "_a"), obs, after, "_b")
    return counted.withColumn("affected", F.col("_b") - F.col("_a")).drop("_a", "_b")


def apply_episodes(obs: DataFrame, episodes: DataFrame) -> DataFrame:
    """Observations with the effect of the first episode that covers each reading."""
    fields = ["anomaly_type", "start_ts", "start_temp", "d_temp", "d_rh", "d_slp"]
    held = with_cover(obs.select("event_id", KEY, TS), episodes, order="anomaly_id", fields=["anomaly_id", *fields])
    first = held.filter(F.col("cover").isNotNull()).groupBy("event_id").agg(
        F.min_by(F.struct(*[F.col(f"cover.{f}") for f in fields]), F.col("cover.anomaly_id")).alias("_e"))
    marked = obs.join(first, "event_id", "left").select("*", "_e.*").drop("_e")
    kind = F.col("anomaly_type")
    marked = marked.filter(~F.coalesce(kind.isin(REMOVING), F.lit(False)))
    eff = {c: F.when(kind.isNotNull(), e).otherwise(F.col(c)) for c, e in _effects().items()}
    late = F.when(kind == "OUT_OF_ORDER_DATA", 2 * HOUR_US).otherwise(0)
    changed = marked.withColumns({**eff, "ingestion_ts": F.timestamp_micros(F.unix_micros("ingestion_ts") + late)})
    twice = changed.filter(kind == "DUPLICATE_DATA").withColumns(
        {"event_id": F.col("event_id") + 20_000_000, "ingestion_ts": F.timestamp_micros(F.unix_micros("ingestion_ts") + HOUR_US)})
    return changed.unionByName(twice).drop(*fields)


def regional_event(obs: DataFrame, edges: DataFrame, target: str, start: str, hours: int = 6, d_temp: float = -8.0,
                   d_rh: float = 28.0, d_slp: float = 3.5, excess: float = 0.0, outage: bool = False) -> DataFrame:
    """A weather change on ``target`` and its neighbours, each with its own factor 0.85..1.15.

    ``excess`` is added on the target alone (mixed event); ``outage`` removes the neighbours' rows
    instead of changing them.
    """
    area = edges.filter(F.col(KEY) == target).select(F.col("neighbor_id").alias(KEY)).distinct()
    factor = 0.85 + hash_bucket(301, F.col(KEY)) / 1000.0
    t0 = F.lit(start).cast("timestamp")
    inside = F.col(TS).between(t0, F.timestamp_micros(F.unix_micros(t0) + hours * HOUR_US))
    marked = obs.join(area.withColumn("_near", F.lit(True)), KEY, "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
    own = F.col(KEY) == target
    if outage:
        return marked.filter(~(F.col("_near") & inside)).drop("_near")
    hit = inside & (F.col("_near") | own)
    f = F.when(own, 1.0).otherwise(factor)
    extra = F.when(own, excess).otherwise(0.0)
    return marked.withColumns(
        {
            TEMP: F.when(hit, steady_round(F.col(TEMP) + d_temp * f + extra, 2)).otherwise(F.col(TEMP)),
            RH: F.when(hit, clamp(F.col(RH) + d_rh * f, 0.0, 100.0)).otherwise(F.col(RH)),
            SLP: F.when(hit, steady_round(F.col(SLP) + d_slp * f, 2)).otherwise(F.col(SLP)),
            "is_changed": hit,
        }
    ).drop("_near")


# --- fixed values: scenario id, type, first and last step, amount, expected ---
SCENARIOS = [
    ("SV01", "NONE", 0, 287, 0.0, "NORMAL"),
    ("SV02", "SPIKE_POSITIVE", 40, 41, 12.0, "PROBABLE_SENSOR_ANOMALY"),
    ("SV03", "SPIKE_NEGATIVE", 45, 46, -15.0, "PROBABLE_SENSOR_ANOMALY"),
    ("SV04", "STEP_CHANGE", 50, 62, 8.0, "PROBABLE_SENSOR_ANOMALY"),
    ("SV05", "DRIFT", 65, 80, 0.3, "PROBABLE_SENSOR_ANOMALY"),
    ("SV06", "FLATLINE", 85, 102, 24.5, "PROBABLE_SENSOR_ANOMALY"),
    ("SV07", "OSCILLATION", 70, 80, 7.5, "PROBABLE_SENSOR_ANOMALY"),
    ("SV08", "RATE_OF_CHANGE_VIOLATION", 90, 91, 9.5, "PROBABLE_SENSOR_ANOMALY"),
    ("SV09", "IMPOSSIBLE_TEMPERATURE", 95, 96, 59.8, "PROBABLE_DATA_QUALITY_ISSUE"),
    ("SV10", "INVALID_RH", 100, 101, 99.9, "PROBABLE_DATA_QUALITY_ISSUE"),
    ("SV11", "INVALID_PRESSURE", 105, 106, 875.0, "PROBABLE_DATA_QUALITY_ISSUE"),
    ("SV12", "MISSING_TEMPERATURE", 110, 115, 0.0, "PROBABLE_DATA_QUALITY_ISSUE"),
    ("SV13", "MISSING_RH", 110, 115, 0.0, "PROBABLE_DATA_QUALITY_ISSUE"),
    ("SV14", "MISSING_PRESSURE", 110, 115, 0.0, "PROBABLE_DATA_QUALITY_ISSUE"),
    ("SV15", "DUPLICATE", 118, 118, 0.0, "PROBABLE_DATA_QUALITY_ISSUE"),
    ("SV16", "OUT_OF_ORDER", 120, 120, 7.0, "PROBABLE_DATA_QUALITY_ISSUE"),
    ("SV17", "TIMESTAMP_GAP", 125, 133, 45.0, "NORMAL"),
    ("SV18", "CORRUPTED_TIMESTAMP", 135, 135, 0.0, "PROBABLE_DATA_QUALITY_ISSUE"),
    ("SV19", "MULTIVARIATE_INCONSISTENCY", 140, 142, 42.0, "PROBABLE_SENSOR_ANOMALY"),
    ("SV20", "SPATIAL_OUTLIER", 145, 147, 10.5, "PROBABLE_SENSOR_ANOMALY"),
    ("SV21", "REGIONAL_EVENT", 155, 163, -8.0, "POSSIBLE_GENUINE_EVENT"),
    ("SV22", "PARTIAL_OUTAGE", 170, 185, 0.0, "NO_ROWS"),
    ("SV23", "FULL_OUTAGE", 190, 210, 0.0, "NO_ROWS"),
    ("SV24", "RECOVERY", 216, 240, 0.0, "NORMAL"),
]
REMOVED = ["TIMESTAMP_GAP", "PARTIAL_OUTAGE", "FULL_OUTAGE"]
# --- end of fixed values ------------------------------------------------------


def scenario_table(obs: DataFrame) -> DataFrame:
    """A scenario for every station of ``obs``, in turn by the order of their names (one row each)."""
    names = obs.select(KEY).distinct().withColumn("i", (F.row_number().over(Window.orderBy(KEY)) - 1) % len(SCENARIOS))
    kinds = obs.sparkSession.createDataFrame(
        [(i, *s) for i, s in enumerate(SCENARIOS)], "i int, scenario_id string, kind string, first_step int, last_step int, amount double, expected string")
    return names.join(F.broadcast(kinds), "i").drop("i")  # as many rows as scenarios


def with_steps(obs: DataFrame) -> DataFrame:
    """Zero-based step of every reading of a station."""
    return run_positions(with_chunk(obs), {"_x": F.lit(False)}).withColumn("step", F.col("seq") - 1).drop("_x_since", "_x_start", "seq", CHUNK)


def scenario_window(stepped: DataFrame, scenarios: DataFrame, before: int = 24, after: int = 4) -> DataFrame:
    """Rows around each scenario: the warm-up before it and the steps after it."""
    return stepped.join(scenarios, KEY).filter(F.col("step").between(F.col("first_step") - before, F.col("last_step") + after))


def apply_scenarios(stepped: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Transforms of the scenario windows, with the expectation of every row that remains.

    ``ts_text`` is the time as sent, so that a corrupted one can be expressed.
    """
    rows = stepped.join(scenarios, KEY)
    inside = F.col("step").between(F.col("first_step"), F.col("last_step"))
    k, a = F.when(inside, F.col("kind")).otherwise("NONE"), F.col("amount")
    t, up = F.col(TEMP), F.when(F.col("step") % 2 == 0, 1.0).otherwise(-1.0)
    temp = (
        F.when(k.isin("SPIKE_POSITIVE", "SPIKE_NEGATIVE", "STEP_CHANGE", "RATE_OF_CHANGE_VIOLATION", "SPATIAL_OUTLIER", "REGIONAL_EVENT"), steady_round(t + a, 2))
        .when(k == "DRIFT", steady_round(t + a * (F.col("step") - F.col("first_step") + 1), 2))
        .when(k == "OSCILLATION", steady_round(t + up * a, 2))
        .when(k.isin("FLATLINE", "IMPOSSIBLE_TEMPERATURE", "MULTIVARIATE_INCONSISTENCY"), a)
        .when(k == "MISSING_TEMPERATURE", F.lit(None).cast("double")).otherwise(t))
    rh = (
        F.when(k == "FLATLINE", 60.0).when(k == "INVALID_RH", a).when(k == "MULTIVARIATE_INCONSISTENCY", 98.0)
        .when(k == "REGIONAL_EVENT", clamp(F.col(RH) + 28.0, 10.0, 98.0)).when(k == "MISSING_RH", F.lit(None).cast("double")).otherwise(F.col(RH)))
    slp = (
        F.when(k == "FLATLINE", 1013.25).when(k == "INVALID_PRESSURE", a).when(k == "REGIONAL_EVENT", steady_round(F.col(SLP) + 3.5, 2))
        .when(k == "MISSING_PRESSURE", F.lit(None).cast("double")).otherwise(F.col(SLP)))
    status = (
        F.when(k.isin("IMPOSSIBLE_TEMPERATURE", "INVALID_RH", "INVALID_PRESSURE"), "ERROR")
        .when(k.startswith("MISSING"), "MISSING").when(k == "OUT_OF_ORDER", "SUSPECT").otherwise(F.col("data_quality_status")))
    text = F.date_format(TS, "yyyy-MM-dd HH:mm:ss")
    early = F.date_format(F.timestamp_micros(F.unix_micros(TS) - F.col("amount").cast("long") * 60_000_000), "yyyy-MM-dd HH:mm:ss")
    sent = F.when(k == "CORRUPTED_TIMESTAMP", "2026-99-99 00:00:00").when(k == "OUT_OF_ORDER", early).otherwise(text)
    copies = F.when(k.isin(REMOVED), 0).when(k == "DUPLICATE", 2).otherwise(1)
    out = rows.select(
        "event_id", KEY, TS, "step", "scenario_id", k.alias("applied"), temp.alias(TEMP), rh.alias(RH), slp.alias(SLP), status.alias("data_quality_status"),
        sent.alias("ts_text"), F.when(inside, F.col("expected")).otherwise("NORMAL").alias("expected"), copies.alias("_copies"))
    return out.filter(F.col("_copies") > 0).select("*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")).drop("_copies")
