"""Imputation of missing readings and correction proposals; raw values are never changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meteoqc.functions.numeric import array_mean, array_median, array_std, clamp, steady_round, tail
from meteoqc.functions.physics import joint_violations
from meteoqc.functions.text import hash16
from meteoqc.operators.chunks import (CHUNK, FOUR_DAYS, OWN, as_of, chunk_window, drop_halo, run_positions, with_chunk,
                                      with_halo)
from meteoqc.operators.features import missing_runs
from meteoqc.operators.staging import staged
from meteoqc.schema import KEY, RH, SLP, TEMP, TS

# --- fixed values: estimate bounds and error floors ---------------------------
ESTIMATE_BOUNDS = {"temp": (-50.0, 60.0), "rh": (0.0, 100.0), "slp": (870.0, 1085.0)}
ERROR_FLOOR = {"temp": 0.25, "rh": 1.50, "slp": 0.30}
ERROR_LIMIT = {"temp": 5.0, "rh": 25.0, "slp": 6.0}
DEPARTURE_LIMIT = {"temp": 15.0, "rh": 50.0, "slp": 20.0}
QUALITY_CONFIDENCE = {"HIGH": 0.90, "MEDIUM": 0.75, "LOW": 0.50, "POOR": 0.25}
CANONICAL = {"temp": TEMP, "rh": RH, "slp": SLP}
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class RepairRules:
    """Safety limits of imputation and correction."""

    max_gap_minutes: float = 60.0
    max_steps: int = 12
    history: int = 12
    min_history: int = 3
    recent: int = 6
    min_neighbours: int = 2
    degraded_health: float = 60.0


def by_variable(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col("variable") == k, v).otherwise(out)
    return out


def long_series(obs: DataFrame, variables: tuple[str, ...] = ("temp", "rh", "slp")) -> DataFrame:
    """(series, station, variable, time, x): every variable of a station is its own series."""
    rows = obs.select(KEY, TS, *[F.col(CANONICAL[v]).alias(v) for v in variables]).unpivot([KEY, TS], list(variables), "variable", "x")
    return rows.withColumn("series", F.concat_ws("/", KEY, "variable"))


def with_history(probes: DataFrame, series: DataFrame, size: int = 12, seconds: int = FOUR_DAYS) -> DataFrame:
    """Array ``history`` of the last ``size`` valid values strictly before each probe (empty if none).

    Values and probes are exchanged once, as single values; the arrays are put together where the
    probes are. A chunk gets what it needs from before its start from the last values of each chunk.
    """
    set_key = F.coalesce(F.concat(F.lit("="), "series"), F.lit("")).alias("_s")  # never null, so that the chunks of an unnamed series are joined as well
    values = with_chunk(series.filter(F.col("x").isNotNull()).select(set_key, TS, "x"), seconds=seconds)
    asked = with_chunk(probes.select(set_key, TS, F.struct("*").alias("_probe")), seconds=seconds)
    both = values.unionByName(asked, allowMissingColumns=True).withColumn("_side", F.when(F.col("_probe").isNull(), 0).otherwise(-1))
    mine = Window.partitionBy("_s", CHUNK, "_side").orderBy(TS)
    upto = Window.partitionBy("_s", CHUNK).orderBy(TS, "_side", "_n").rowsBetween(Window.unboundedPreceding, 0)
    near = F.when(F.col("_side") == 0, F.collect_list("x").over(mine.rowsBetween(-(size - 1), 0)))
    # one exchange for both windows
    found = both.repartition("_s", CHUNK).withColumns({"_near": near, "_n": F.row_number().over(mine)}).withColumn("_near", F.last("_near", True).over(upto)).filter(F.col("_side") != 0)

    newest = values.withColumn("_r", F.row_number().over(Window.partitionBy("_s", CHUNK).orderBy(F.col(TS).desc()))).filter(F.col("_r") <= size)
    ends = newest.groupBy("_s", CHUNK).agg(F.array_compact(F.array(*[F.max(F.when(F.col("_r") == i, F.col("x"))) for i in range(size, 0, -1)])).alias("_end"))
    chunks = asked.select("_s", CHUNK).unionByName(values.select("_s", CHUNK)).distinct().join(ends, ["_s", CHUNK], "left")
    timed = F.col("_end").isNotNull() & F.col(CHUNK).isNotNull()
    kept = Window.partitionBy("_s", timed).orderBy(CHUNK).rowsBetween(-(size - 1), 0)
    before = Window.partitionBy("_s").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.join(ends.filter(F.col(CHUNK).isNull()).select("_s", F.col("_end").alias("_untimed")), "_s", "left")  # values without a time come before all others
    chunks = chunks.withColumn("_upto", F.when(timed, tail(F.flatten(F.collect_list("_end").over(kept)), size)))
    carried = chunks.select("_s", CHUNK, F.last("_upto", True).over(before).alias("_before"), "_untimed")
    none = F.array().cast("array<double>")
    out = found.join(carried, ["_s", CHUNK], "left")
    history = (F.when(F.col("_near").isNotNull(), tail(F.concat(F.coalesce("_before", none), F.col("_near")), size))
               .when(F.col("_s") != "", F.coalesce("_before", "_untimed", none)).otherwise(none))
    return out.select("_probe.*", history.alias("history"))


def with_next_value(probes: DataFrame, series: DataFrame, seconds: int = FOUR_DAYS) -> DataFrame:
    build = series.filter(F.col("x").isNotNull()).select("series", TS, F.col("x").alias("next_x"))
    out = as_of(probes, build, key="series", ts=TS, payload=["next_x"], name="_n", forward=True, strict=True, seconds=seconds)
    return out.withColumn("next_x", F.col("_n.next_x")).drop("_n")


def spatial_estimates(context: DataFrame) -> DataFrame:
    """Neighbour estimate, count, spread and mean distance per (station, time, variable)."""
    rows = [F.struct(F.lit(v).alias("variable"), F.col(f"{v}_idw").alias("idw"), F.coalesce(f"{v}_n", F.lit(0)).alias("n"),
                     F.col(f"{v}_std").alias("n_std"), F.col(f"{v}_km").alias("km")) for v in CANONICAL]
    return context.select(KEY, TS, F.explode(F.array(*rows)).alias("s")).select(KEY, TS, "s.*")


def standard_error(method: Column, gap: Column) -> dict[str, Column]:
    """Standard error, method quality, confidence and 95 % range of ``estimate``.

    Needs columns variable, estimate, n, n_std, km and history.
    """
    floor = by_variable(ERROR_FLOOR)
    low = by_variable({k: b[0] for k, b in ESTIMATE_BOUNDS.items()})
    high = by_variable({k: b[1] for k, b in ESTIMATE_BOUNDS.items()})
    n, t = F.coalesce(F.col("n"), F.lit(0)), F.size("history")
    s_std = F.when(n >= 2, F.coalesce("n_std", F.lit(0.0))).when(n == 1, floor * 1.5).otherwise(0.0)
    t_std = F.when(t >= 2, array_std(F.col("history"))).when(t == 1, floor * 1.5).otherwise(0.0)
    far = F.when((n >= 2) & F.col("km").isNotNull(), F.greatest(F.lit(1.0), 1.0 + (F.col("km") - 100.0) / 400.0)).otherwise(1.0)
    one = F.lit(1)
    spatial = (F.when(n >= 2, F.greatest(floor, s_std * far / F.sqrt(n.cast("double"))))
               .when(n == 1, F.greatest(floor * 1.5, s_std * far)).otherwise(floor * 3.0))
    temporal = F.when(t >= 2, F.greatest(floor, t_std / F.sqrt(t.cast("double")))).otherwise(floor * 2.5)
    s_se = F.greatest(floor, s_std / F.sqrt(F.greatest(one, n).cast("double")))
    t_se = F.greatest(floor, t_std / F.sqrt(F.greatest(one, t).cast("double")))
    combined = F.sqrt(0.6 * s_se * s_se + 0.4 * t_se * t_se) * far
    two_sided = F.when(t >= 2, F.greatest(floor * 0.8, t_std / F.sqrt(t.cast("double")) * 0.8)).otherwise(floor * 2.0)
    se = (F.when(method == "SPATIAL_IDW_CONSENSUS", spatial)
          .when(method.isin("CAUSAL_TEMPORAL_INTERPOLATION", "ROLLING_BASELINE"), temporal)
          .when(method == "COMBINED_TEMPORAL_SPATIAL", combined)
          .when(method == "RETROSPECTIVE_INTERPOLATION", two_sided))
    se = se * F.when(gap > 5.0, F.sqrt(1.0 + (gap - 5.0) / 30.0)).otherwise(1.0)
    quality = (
        F.when((method == "COMBINED_TEMPORAL_SPATIAL") & (n >= 3) & (t >= 3), "HIGH")
        .when((method == "SPATIAL_IDW_CONSENSUS") & (n >= 3), "HIGH")
        .when((method == "RETROSPECTIVE_INTERPOLATION") & (t >= 4) & (gap <= 15.0), "HIGH")
        .when(((n >= 2) | (t >= 3)) & (gap <= 30.0), "MEDIUM")
        .when((n == 1) | (t == 2) | (gap <= 60.0), "LOW").otherwise("POOR"))
    base = F.lit(None).cast("double")
    for k, v in QUALITY_CONFIDENCE.items():
        base = F.when(quality == k, v).otherwise(base)
    relative = F.least(F.lit(1.0), se * 2.0 / ((high - low) * 0.1))
    has = F.col("estimate").isNotNull()
    return {
        "standard_error": F.when(has, steady_round(se, 3)),
        "method_quality": F.when(has, quality),
        "confidence": F.when(has, steady_round(clamp(base * (1.0 - 0.5 * relative), 0.1, 0.98), 3)),
        "range_low": F.when(has, steady_round(F.greatest(low, F.col("estimate") - 1.96 * se), 3)),
        "range_high": F.when(has, steady_round(F.least(high, F.col("estimate") + 1.96 * se), 3)),
    }


def _bounded(x: Column, digits: int) -> Column:
    low = by_variable({k: b[0] for k, b in ESTIMATE_BOUNDS.items()})
    high = by_variable({k: b[1] for k, b in ESTIMATE_BOUNDS.items()})
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, steady_round(x, digits))))


def impute(missing: DataFrame, rules: RepairRules = RepairRules(), retrospective: bool = False) -> DataFrame:
    """Estimate for rows with columns variable, gap_minutes, missing_steps, history, idw, n, n_std, km (next_x)."""
    h, t = F.col("history"), F.size("history")
    last3 = tail(h, 3)
    slope = (F.get(last3, F.lit(2)) - F.get(last3, F.lit(0))) / 2.0
    damped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), slope * 0.5))
    gap = F.coalesce("gap_minutes", F.lit(0.0))
    unsafe = (gap > rules.max_gap_minutes) | (F.col("missing_steps") > rules.max_steps)
    two_sided = F.lit(retrospective) & (t > 0) & (F.col("next_x").isNotNull() if retrospective else F.lit(False))
    method = (
        F.when(unsafe, "NO_ESTIMATE").when(two_sided, "RETROSPECTIVE_INTERPOLATION")
        .when(F.col("idw").isNotNull() & (t >= rules.min_history), "COMBINED_TEMPORAL_SPATIAL")
        .when(F.col("idw").isNotNull(), "SPATIAL_IDW_CONSENSUS")
        .when(t >= rules.min_history, "CAUSAL_TEMPORAL_INTERPOLATION")
        .when(t >= 1, "ROLLING_BASELINE").otherwise("NO_ESTIMATE"))
    df = missing.withColumn("method", method)
    m = F.col("method")
    value = (
        F.when(m == "RETROSPECTIVE_INTERPOLATION", 0.5 * (F.element_at(h, -1) + (F.col("next_x") if retrospective else F.lit(None))) if retrospective else F.lit(None).cast("double"))
        .when(m == "COMBINED_TEMPORAL_SPATIAL", 0.6 * F.col("idw") + 0.4 * array_median(tail(h, rules.history)))
        .when(m == "SPATIAL_IDW_CONSENSUS", F.col("idw"))
        .when(m == "CAUSAL_TEMPORAL_INTERPOLATION", F.get(h, t - 1) + damped * F.col("missing_steps"))
        .when(m == "ROLLING_BASELINE", array_mean(h)))
    df = df.withColumns({"estimate": _bounded(value, 3), "status": F.when(m == "NO_ESTIMATE", "NOT_IMPUTABLE").otherwise("IMPUTED")})
    return df.withColumns(standard_error(m, gap))


def missing_readings(obs: DataFrame, context: DataFrame, var: str = "temp", *, rules: RepairRules = RepairRules(),
                     retrospective: bool = False) -> DataFrame:
    """All missing readings of one variable with their history and neighbour estimate."""
    runs = missing_runs(obs.select(KEY, TS, CANONICAL[var]), CANONICAL[var])
    series = runs.select(KEY, TS, F.col(CANONICAL[var]).alias("x"), F.lit(var).alias("variable"), F.col(KEY).alias("series"), "missing_steps", "gap_minutes")
    probes = with_history(series.filter(F.col("x").isNull()), series, rules.history)
    if retrospective:
        probes = with_next_value(probes, series)
    return probes.join(spatial_estimates(context), [KEY, TS, "variable"], "left")


FOUND = "array<struct<obs_ts:timestamp,missing_steps:bigint,estimate:double,method:string>>"
STATE = f"struct<past:array<double>,steps:bigint,found:{FOUND}>"


def _next_state(s: Column, r: Column, rules: RepairRules, cadence_minutes: float) -> Column:
    """State after one reading: the last values or estimates, the missing steps so far, the estimates made."""
    missing, past = r["x"].isNull(), s["past"]
    steps = F.when(missing, s["steps"] + 1).otherwise(0)
    n = F.size(past)
    method = (
        F.when((steps * cadence_minutes > rules.max_gap_minutes) | (steps > rules.max_steps), "NO_ESTIMATE")
        .when(r["idw"].isNotNull() & (n >= rules.min_history), "COMBINED_TEMPORAL_SPATIAL").when(r["idw"].isNotNull(), "SPATIAL_IDW_CONSENSUS")
        .when(n >= rules.min_history, "CAUSAL_TEMPORAL_INTERPOLATION").when(n > 0, "ROLLING_BASELINE").otherwise("NO_ESTIMATE"))
    slope = (F.get(past, n - 1) - F.get(past, n - 3)) / 2.0
    value = (
        F.when(method == "COMBINED_TEMPORAL_SPATIAL", 0.6 * r["idw"] + 0.4 * array_median(past)).when(method == "SPATIAL_IDW_CONSENSUS", r["idw"])
        .when(method == "CAUSAL_TEMPORAL_INTERPOLATION", F.get(past, n - 1) + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), slope * 0.5)) * steps)
        .when(method == "ROLLING_BASELINE", array_mean(past)))
    made = F.struct(r[TS].alias(TS), steps.alias("missing_steps"), _bounded(value, 3).alias("estimate"), method.alias("method"))
    found = F.when(missing, F.concat(s["found"], F.array(made))).otherwise(s["found"])
    # a reading joins the values; so does an estimate, if there is one
    joins = F.when(missing, F.get(found, F.size(found) - 1)["estimate"]).otherwise(r["x"])
    return F.struct(F.when(joins.isNotNull(), tail(F.concat(past, F.array(joins)), rules.history)).otherwise(past).alias("past"), steps.alias("steps"), found.alias("found"))


def impute_series(obs: DataFrame, context: DataFrame, variables: tuple[str, ...] = ("temp", "rh", "slp"), *, rules: RepairRules = RepairRules(),
                  cadence_minutes: float = 5.0, segment: int = 256, seconds: int = FOUR_DAYS) -> DataFrame:
    """Series imputation in which every estimate becomes history for the next missing reading.

    Two gaps are independent once ``history`` valid readings lie between them, so a series is cut there
    and the pieces run in parallel. A piece is folded inside the JVM over an array of its readings, at
    most ``segment`` of them at a time; a longer piece goes on from the state in which its last segment
    ended, so there are as many rounds as the longest piece has segments.
    """
    series = long_series(obs, variables)
    base = run_positions(with_chunk(series.select("series", TS, "x"), seconds=seconds), {"_v": F.col("x").isNull()}, key=("series",))
    # _v_since: valid readings since the last missing one; null start = none missing before
    base = base.drop(CHUNK, "seq").withColumnRenamed("_v_since", "valid_since")
    halo = with_halo(base, rows=1, key=("series",), seconds=seconds)
    w = chunk_window(("series",))
    before = F.lag("valid_since").over(w)
    opens = F.col("x").isNull() & (before.isNull() | (before >= rules.history) | F.lag("_v_start").over(w).isNull())
    marked = halo.withColumn("_opens", opens).filter(OWN).drop(OWN)
    pieces = run_positions(marked, {"_p": F.col("_opens")}, key=("series",)).filter(F.col("_p_start").isNotNull() & (F.col("valid_since") <= rules.history))
    openings = with_history(pieces.filter("_opens").select("series", TS), series, rules.history).select("series", F.col(TS).alias("piece"), "history")
    est = spatial_estimates(context).select(F.concat_ws("/", KEY, "variable").alias("series"), TS, "idw")
    rows = pieces.select("series", TS, "x", F.col("_p_start").alias("piece"), F.floor(F.col("_p_since") / segment).alias("part")).join(est, ["series", TS], "left")
    parts = staged(rows.groupBy("series", "piece", "part").agg(F.array_sort(F.collect_list(F.struct(TS, "x", "idw"))).alias("readings")).join(
        openings, ["series", "piece"]).withColumn("round", F.row_number().over(Window.partitionBy("series", "piece").orderBy("part"))))
    rounds = parts.agg(F.max("round")).first()[0] or 1  # of the longest piece
    ends, out = None, None
    for k in range(1, rounds + 1):
        own = parts.filter(F.col("round") == k).select("series", F.substring_index("series", "/", -1).alias("variable"), "piece", "readings", "history")
        own = own.withColumn("steps", F.lit(0).cast("long")) if ends is None else own.drop("history").join(ends, ["series", "piece"])
        start = F.struct(F.col("history").alias("past"), F.col("steps").alias("steps"), F.array().cast(FOUND).alias("found")).cast(STATE)
        folded = staged(own.withColumn("s", F.aggregate("readings", start, lambda s, r: _next_state(s, r, rules, cadence_minutes).cast(STATE))).select(
            "series", "variable", "piece", "s"))
        ends = folded.select("series", "piece", F.col("s.past").alias("history"), F.col("s.steps").alias("steps"))
        found = folded.select(F.expr("left(series, length(series) - length(variable) - 1)").alias(KEY), "variable", F.explode("s.found").alias("f")).select(KEY, "variable", "f.*")
        out = found if out is None else out.unionByName(found)
    return out


def correction_inputs(decided: DataFrame, variables: tuple[str, ...] = ("temp", "rh", "slp"), rules: RepairRules = RepairRules()) -> DataFrame:
    """One row per (reading, variable) with history, neighbour estimate and decision.

    Estimate and decision travel with their reading. Joined back on (station, time), each of the
    readings that share both would meet all the others.
    """
    rows = [F.struct(F.lit(v).alias("variable"), F.col(CANONICAL[v]).alias("x"), F.col(f"{v}_idw").alias("idw"), F.coalesce(f"{v}_n", F.lit(0)).alias("n"),
                     F.col(f"{v}_std").alias("n_std"), F.col(f"{v}_km").alias("km")) for v in variables]
    known = decided.filter(F.col(KEY).isNotNull() & F.col(TS).isNotNull())
    probes = known.select(KEY, TS, "decision", "severity", F.explode(F.array(*rows)).alias("s")).select(KEY, TS, "s.*", "decision", "severity")
    probes = probes.filter(F.col("x").isNotNull()).withColumn("series", F.concat_ws("/", KEY, "variable"))
    return with_history(probes, long_series(decided, variables), rules.history)


def recommend(inputs: DataFrame, health: DataFrame | None = None, rules: RepairRules = RepairRules()) -> DataFrame:
    """Correction proposals; normal readings and genuine weather are shielded."""
    df = inputs
    if health is not None:
        df = df.join(health.select(KEY, F.col("overall_health").alias("health_score")), KEY, "left")
    else:
        df = df.withColumn("health_score", F.lit(None).cast("double"))
    t, n = F.size("history"), F.coalesce(F.col("n"), F.lit(0))
    shielded = F.col("decision").isin("POSSIBLE_GENUINE_EVENT", "NORMAL")
    has_s, has_t = F.col("idw").isNotNull() & (n >= rules.min_neighbours), t >= 2
    recent = array_median(tail(F.col("history"), rules.recent))
    method = (
        F.when(shielded, "NO_ESTIMATE").when(has_s & has_t, "COMBINED_TEMPORAL_SPATIAL")
        .when(has_s, "SPATIAL_IDW_CONSENSUS").when(has_t, "ROLLING_BASELINE").otherwise("NO_ESTIMATE"))
    df = df.withColumns({"method": method, "_shielded": shielded, "_spatial": has_s})
    m = F.col("method")
    value = (F.when(m == "COMBINED_TEMPORAL_SPATIAL", 0.65 * F.col("idw") + 0.35 * recent)
             .when(m == "SPATIAL_IDW_CONSENSUS", F.col("idw")).when(m == "ROLLING_BASELINE", recent))
    df = df.withColumn("estimate", _bounded(value, 2))
    df = df.withColumns(standard_error(m, F.lit(0.0)))
    too_wide = F.col("standard_error") > by_variable(ERROR_LIMIT)
    too_far = F.abs(F.col("x") - F.col("estimate")) > by_variable(DEPARTURE_LIMIT)
    degraded = F.coalesce(F.col("health_score") < rules.degraded_health, F.lit(False))
    worth = degraded | F.col("decision").isin("PROBABLE_SENSOR_ANOMALY", "PROBABLE_DATA_QUALITY_ISSUE")
    status = (
        F.when(F.col("_shielded"), "NO_CORRECTION_RECOMMENDED").when(m == "NO_ESTIMATE", "INSUFFICIENT_EVIDENCE")
        .when(too_wide | too_far, "REVIEW_RECOMMENDED")
        .when(F.col("_spatial") & F.col("method_quality").isin("HIGH", "MEDIUM") & worth, "CORRECTION_CANDIDATE")
        .otherwise("REVIEW_RECOMMENDED"))
    return df.withColumns(
        {"status": status, "recommendation_id": hash16(KEY, F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "variable"), "departure": F.abs(F.col("x") - F.col("estimate"))}
    ).drop("_shielded", "_spatial")


def bundles(recommended: DataFrame, obs: DataFrame) -> DataFrame:
    """Per reading: the state after all proposals, its violations, and the downgraded statuses."""
    proposed = recommended.filter(F.col("estimate").isNotNull())
    wide = proposed.groupBy(KEY, TS).agg(
        *[F.max(F.when(F.col("variable") == v, F.col("estimate"))).alias(f"new_{v}") for v in CANONICAL],
        F.count(F.lit(1)).alias("proposals"), F.count(F.when(F.col("status") == "CORRECTION_CANDIDATE", 1)).alias("candidates"))
    out = wide.join(obs, [KEY, TS])
    state = {v: F.coalesce(F.col(f"new_{v}"), F.col(CANONICAL[v])) for v in CANONICAL}
    broken = joint_violations(state["temp"], "dew_point_c", state["rh"], state["slp"])
    out = out.withColumn("violations", broken)
    consistent = F.size("violations") == 0
    return out.select(
        KEY, TS, "new_temp", "new_rh", "new_slp", "proposals", "candidates", "violations", consistent.alias("is_consistent"),
        F.when(consistent, F.col("candidates")).otherwise(0).alias("candidates_kept"),
        F.when(F.col("candidates") == 0, "REVIEW_RECOMMENDED").when(consistent, "CORRECTION_CANDIDATE").otherwise("REVIEW_RECOMMENDED").alias("bundle_status"))


def resample(obs: DataFrame, var: str = "temp", step_seconds: int = 900, seconds: int = FOUR_DAYS) -> DataFrame:
    """Regular grid per station with linear interpolation in time between the valid neighbours.

    The grid is generated per station and chunk, so a long series is not built in one row.
    """
    x = F.col(CANONICAL[var])
    step = step_seconds * 1_000_000
    ends = obs.groupBy(KEY).agg(F.min(F.unix_micros(TS)).alias("lo"), F.max(F.unix_micros(TS)).alias("hi"), F.min_by("elevation_m", TS).alias("elevation_m"))
    span = seconds * 1_000_000
    parts = ends.select("*", F.explode(F.sequence(F.floor(F.col("lo") / span), F.floor(F.col("hi") / span))).alias("c"))
    first = F.ceil(F.greatest(F.col("lo"), F.col("c") * span) / step)
    last = F.floor(F.least(F.col("hi"), (F.col("c") + 1) * span - 1) / step)
    grid = parts.filter(first <= last).select(KEY, "elevation_m", F.explode(F.sequence(first, last)).alias("g")).select(
        KEY, "elevation_m", F.timestamp_micros((F.col("g") * step).cast("long")).alias(TS))
    build = obs.filter(x.isNotNull()).select(KEY, TS, x.alias("x"))
    found = as_of(grid, build, key=KEY, ts=TS, payload=[TS, "x"], name="a", seconds=seconds)
    found = as_of(found, build, key=KEY, ts=TS, payload=[TS, "x"], name="b", forward=True, seconds=seconds)
    t0, t1, t = F.unix_micros("a.obs_ts"), F.unix_micros("b.obs_ts"), F.unix_micros(TS)
    share = F.when(t1 > t0, (t - t0) / (t1 - t0)).otherwise(0.0)
    value = F.when(F.col("a").isNull(), F.col("b.x")).when(F.col("b").isNull(), F.col("a.x")).otherwise(
        F.col("a.x") + (F.col("b.x") - F.col("a.x")) * share)
    return found.select(KEY, TS, "elevation_m", value.alias("value"))


def reconstruction_metrics(rows: DataFrame) -> DataFrame:
    """Error of estimates against the truth; rows: truth, observed (null = missing), estimate, is_anomalous."""
    err = F.abs(F.col("truth") - F.col("estimate"))
    judged = F.when(F.col("is_anomalous"), err)
    grew = F.col("is_anomalous") & F.col("observed").isNotNull() & (err > F.abs(F.col("truth") - F.col("observed")) + 0.5)
    n_bad, n_clean = F.count(F.when(F.col("is_anomalous"), 1)), F.count(F.when(~F.col("is_anomalous"), 1))
    return rows.agg(
        F.count(F.lit(1)).alias("points"), n_bad.alias("anomalous"), F.count(judged).alias("estimated"),
        steady_round(F.avg(judged), 3).alias("mae"), steady_round(F.sqrt(F.avg(judged * judged)), 3).alias("rmse"),
        steady_round(F.avg(F.when(F.abs("truth") > 1e-3, judged / F.abs("truth") * 100.0)), 2).alias("relative_error_pct"),
        steady_round(F.count(judged) / F.greatest(F.lit(1), n_bad), 3).alias("coverage"),
        steady_round(F.count(F.when(grew, 1)) / F.greatest(F.lit(1), F.count(judged)), 4).alias("unsafe_rate"),
        steady_round(F.count(F.when(~F.col("is_anomalous") & F.col("estimate").isNotNull(), 1)) / F.greatest(F.lit(1), n_clean), 4).alias("unnecessary_rate"))
