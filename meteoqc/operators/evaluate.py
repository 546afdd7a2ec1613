"""Detector evaluation: labels, confusion metrics, curves, events, calibration, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meteoqc.functions.numeric import steady_round
from meteoqc.operators.chunks import CHUNK, FOUR_DAYS, as_of, chunk_window, drop_halo, scan, with_chunk, with_halo
from meteoqc.operators.cover import readings_before, with_cover
from meteoqc.schema import KEY, TS

SCORE_DIGITS = 6


def with_truth(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``y_true`` = 1 iff (station, time) carries a fault label."""
    faults = labels.filter("is_fault").select(KEY, TS).distinct().withColumn("_y", F.lit(1))
    return rows.join(faults, [KEY, TS], "left").withColumn("y_true", F.coalesce("_y", F.lit(0))).drop("_y")


def with_truth_of_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """``with_truth`` from events with a first and a last time: 1 iff a fault on the row's station holds its time."""
    out = with_cover(rows, events.filter("is_fault"), order="anomaly_id", start="injection_start", end="injection_end", name="_y")
    return out.withColumn("y_true", F.col("_y").isNotNull().cast("int")).drop("_y")


def first_hits(hits: DataFrame, events: DataFrame, key: Sequence[str] = (KEY,), more: Sequence[str] = ()) -> DataFrame:
    """Events with a struct ``hit`` of the first row of ``hits`` (time and ``more``) inside them, null if none is."""
    site = F.concat_ws("|", *key).alias("_site")
    asked = events.select("*", site, F.col("injection_start").alias(TS))
    found = as_of(asked, hits.select(site, TS, *more), key="_site", ts=TS, payload=[TS, *more], name="hit", forward=True)
    return found.withColumn("hit", F.when(F.col(f"hit.{TS}") <= F.col("injection_end"), F.col("hit"))).drop("_site", TS)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    def n(p, t):
        return F.count(F.when((F.col("pred") == p) & (F.col("y_true") == t), 1))

    c = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 0).alias("tn"), n(0, 1).alias("fn"))
    return with_rates(c)


def with_rates(c: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return c.withColumns(
        {
            "precision": steady_round(p, 4), "recall": steady_round(r, 4), "f1": steady_round(_ratio(2.0 * p * r, p + r), 4),
            "fpr": steady_round(_ratio(fp, fp + tn), 4), "fnr": steady_round(_ratio(fn, fn + tp), 4),
        }
    )


def score_groups(rows: DataFrame, buckets: int = 1000) -> DataFrame:
    """Counts per distinct score and the counts at or above it, highest score first.

    Scores are in [0, 1]; equal ones are counted first, so at most 10^6 rows remain, and the running
    counts are formed per bucket of scores.
    """
    s = steady_round(F.col("score"), SCORE_DIGITS)
    g = rows.groupBy(s.alias("score")).agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    g = g.withColumns({CHUNK: -F.floor(F.col("score") * buckets), "_rank": -F.col("score")})
    return scan(g, {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, key=(), order=["_rank"]).drop(CHUNK, "_rank")


def curve_areas(rows: DataFrame) -> DataFrame:
    """Average precision (step integral) and ROC area (trapezoids), null for a single class."""
    g = score_groups(rows)
    total = rows.agg(F.sum("y_true").alias("P"), F.sum(1 - F.col("y_true")).alias("N"))
    g = g.join(F.broadcast(total), F.lit(True))  # one row
    step = F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp"))
    trapezoid = F.col("neg") / F.col("N") * (F.col("tp") - F.col("pos") / 2.0) / F.col("P")
    both = F.max((F.col("P") > 0) & (F.col("N") > 0))
    return g.agg(F.when(both, steady_round(F.sum(step), 4)).alias("pr_auc"), F.when(both, steady_round(F.sum(trapezoid), 4)).alias("roc_auc"))


def calibrate(rows: DataFrame, target: str = "f1") -> DataFrame:
    """Threshold among the distinct percentiles 1..99 of the scores with the best metric.

    Each score is placed among the (at most 99) candidates by counting those below it, so scores
    are not paired with candidates. The lowest threshold wins a tie; 0.5 for a single class.
    """
    g = rows.groupBy(steady_round(F.col("score"), SCORE_DIGITS).alias("score")).agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    cuts = g.agg(F.array_sort(F.array_distinct(F.transform(
        F.percentile("score", F.array(*[F.lit(i / 100.0) for i in range(1, 100)]), F.col("pos") + F.col("neg")), lambda c: F.round(c, 9)))).alias("cuts"))
    placed = g.join(F.broadcast(cuts), F.lit(True)).select("cuts", F.size(F.filter("cuts", lambda c: c <= F.col("score"))).alias("k"), "pos", "neg")  # one row of cuts
    per = placed.groupBy("k", "cuts").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # at most 100 rows from here on: k = number of candidates at or below the score
    cand = cuts.select(F.posexplode("cuts").alias("i", "threshold"))
    hit = cand.join(per, F.col("k") > F.col("i")).groupBy("i", "threshold").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    total = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    m = hit.join(F.broadcast(total), F.lit(True))  # one row
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("P"))
    metric = {"f1": _ratio(2.0 * p * r, p + r), "precision": p, "balanced": (p + r) / 2.0}[target]
    m = m.withColumn("metric", F.round(metric, 9))
    best = m.agg(F.max_by(F.struct("threshold", "metric", "P", "N"), F.struct("metric", (-F.col("threshold")).alias("low"))).alias("b"))
    single = (F.col("b.P") == 0) | (F.col("b.N") == 0)
    return best.select(F.when(single, 0.5).otherwise(F.col("b.threshold")).alias("threshold"), F.when(~single, F.col("b.metric")).alias("metric"))


def calibrate_by(rows: DataFrame, by: Sequence[str], target: str = "f1") -> DataFrame:
    """``calibrate`` for every group of ``by``: one row each with ``threshold`` and ``metric``."""
    by = list(by)
    g = rows.groupBy(*by, steady_round(F.col("score"), SCORE_DIGITS).alias("score")).agg(F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    cuts = g.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.transform(F.percentile("score", F.array(*[F.lit(i / 100.0) for i in range(1, 100)]), F.col("pos") + F.col("neg")),
                                                  lambda c: F.round(c, 9)))).alias("cuts"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # each score counts for the candidates at or below it: at most 100 sums per group
    per = g.join(F.broadcast(cuts), by).groupBy(*by, F.size(F.filter("cuts", lambda c: c <= F.col("score"))).alias("k")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cand = cuts.select(*by, "P", "N", F.posexplode("cuts").alias("i", "threshold"))
    m = cand.join(per, by).filter(F.col("k") > F.col("i")).groupBy(*by, "P", "N", "threshold").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("P"))
    metric = {"f1": _ratio(2.0 * p * r, p + r), "precision": p, "balanced": (p + r) / 2.0}[target]
    best = m.withColumn("metric", F.round(metric, 9)).groupBy(*by, "P", "N").agg(
        F.max_by(F.struct("threshold", "metric"), F.struct("metric", (-F.col("threshold")).alias("low"))).alias("b"))
    single = (F.col("P") == 0) | (F.col("N") == 0)
    return best.select(*by, F.when(single, 0.5).otherwise(F.col("b.threshold")).alias("threshold"), F.when(~single, F.col("b.metric")).alias("metric"))


def event_hits(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per labelled event: detected or not, steps and minutes to the first detection."""
    pred = rows.select(KEY, TS, "pred")
    j = labels.join(pred, [KEY, TS], "left").withColumn("pred", F.coalesce("pred", F.lit(0)))
    first = F.min(F.when(F.col("pred") == 1, F.col(TS)))
    ev = j.groupBy("anomaly_id").agg(first.alias("first_hit"), F.min("injection_start").alias("start"), F.first("anomaly_type").alias("anomaly_type"),
                                     F.first(KEY).alias(KEY), F.first("is_fault").alias("is_fault"))
    steps = labels.join(ev.select("anomaly_id", "first_hit"), "anomaly_id").filter(F.col(TS) < F.col("first_hit")).groupBy("anomaly_id").agg(F.count(F.lit(1)).alias("steps"))
    out = ev.join(steps, "anomaly_id", "left")
    return out.select(
        "anomaly_id", KEY, "anomaly_type", "is_fault", F.col("first_hit").isNotNull().alias("detected"),
        F.when(F.col("first_hit").isNotNull(), F.coalesce("steps", F.lit(0))).alias("latency_steps"),
        F.greatest(F.lit(0.0), (F.unix_micros("first_hit") - F.unix_micros("start")) / 60_000_000.0).alias("_lat")
    ).withColumn("latency_minutes", F.when(F.col("detected"), F.col("_lat"))).drop("_lat")


def hits_of_events(rows: DataFrame, events: DataFrame, obs: DataFrame) -> DataFrame:
    """``event_hits`` from events with a first and a last time; steps count the readings of ``obs``."""
    own = first_hits(rows.filter("pred = 1"), events).select(*events.columns, F.col(f"hit.{TS}").alias("hit"))
    per = own.groupBy("anomaly_id").agg(F.min("hit").alias("first_hit"), F.min("injection_start").alias("start"), F.first("anomaly_type").alias("anomaly_type"),
                                        F.first(KEY).alias(KEY), F.first("is_fault").alias("is_fault"))
    # readings of the event before the hit; events may share an id, where readings do
    found = events.select("anomaly_id", KEY, "injection_start", "injection_end").join(per.filter("first_hit IS NOT NULL").select("anomaly_id", "first_hit"), "anomaly_id")
    until = F.least(F.col("first_hit"), F.timestamp_micros(F.unix_micros("injection_end") + 1))
    counted = readings_before(readings_before(found, obs, F.col("injection_start"), "_a"), obs, until, "_b")
    steps = counted.groupBy("anomaly_id").agg(F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("steps"))
    hit = F.col("first_hit").isNotNull()
    minutes = F.greatest(F.lit(0.0), (F.unix_micros("first_hit") - F.unix_micros("start")) / 60_000_000.0)
    return per.join(steps, "anomaly_id", "left").select(
        "anomaly_id", KEY, "anomaly_type", "is_fault", hit.alias("detected"), F.when(hit, F.coalesce("steps", F.lit(0))).alias("latency_steps"), F.when(hit, minutes).alias("latency_minutes"))


def false_alarm_starts(rows: DataFrame, labels: DataFrame, seconds: int = FOUR_DAYS) -> DataFrame:
    """Rising edges of the prediction among rows whose time carries no fault, per station."""
    clean = rows.join(labels.filter("is_fault").select(TS).distinct(), TS, "left_anti").select(KEY, TS, "pred")
    halo = with_halo(clean, rows=1, seconds=seconds)
    rising = (F.col("pred") == 1) & (F.coalesce(F.lag("pred").over(chunk_window()), F.lit(0)) == 0)
    return drop_halo(halo.withColumn("rising", rising), CHUNK)


def event_metrics(rows: DataFrame, labels: DataFrame) -> DataFrame:
    faults = labels.filter("is_fault")
    ev = event_hits(rows, faults).agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("detected"), 1)).alias("detected"),
        steady_round(F.coalesce(F.avg("latency_steps"), F.lit(0.0)), 2).alias("mean_latency_steps"),
        steady_round(F.coalesce(F.avg("latency_minutes"), F.lit(0.0)), 2).alias("mean_latency_minutes"))
    alarms = false_alarm_starts(rows, labels).agg(F.count(F.when(F.col("rising"), 1)).alias("false_alarms"))
    span = rows.agg(F.min(TS).alias("lo"), F.max(TS).alias("hi"))
    stations = rows.select(KEY).distinct().agg(F.count(F.lit(1)).alias("stations"))
    out = ev
    for one in (alarms, span, stations):  # one row each
        out = out.join(F.broadcast(one), F.lit(True))
    days = F.greatest(F.lit(1.0), (F.unix_micros("hi") - F.unix_micros("lo")) / 86_400_000_000.0)
    return out.select(
        "events", "detected", (F.col("events") - F.col("detected")).alias("missed"), steady_round(_ratio(F.col("detected"), F.col("events")), 4).alias("event_recall"),
        "mean_latency_steps", "mean_latency_minutes", "false_alarms",
        steady_round(F.col("false_alarms") / (F.greatest(F.lit(1), "stations") * days), 4).alias("false_alarms_per_station_day"))


def recall_by(hits: DataFrame, col: str) -> DataFrame:
    out = hits.groupBy(col).agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("detected"), 1)).alias("detected"))
    return out.withColumn("recall", steady_round(F.col("detected") / F.col("events"), 4))


def severity_tier() -> Column:
    """Size of the injected change; an unknown one counts as 3."""
    delta = F.coalesce(F.abs(F.col("modified_value") - F.col("original_value")), F.lit(3.0))
    return F.when((delta <= 2.0) | (F.col("anomaly_type") == "SMALL_SPIKE"), "subtle").when(delta <= 5.0, "moderate").otherwise("obvious")


def recall_by_tier(rows: DataFrame, labels: DataFrame) -> DataFrame:
    pred = rows.select(KEY, TS, "pred")
    j = labels.filter("is_fault").withColumn("tier", severity_tier()).join(pred, [KEY, TS], "left")
    per = j.groupBy("tier", "anomaly_id").agg(F.max(F.coalesce("pred", F.lit(0))).alias("hit"))
    return recall_by(per.withColumn("detected", F.col("hit") == 1), "tier")


def genuine_event_alarms(rows: DataFrame, labels: DataFrame) -> DataFrame:
    times = labels.filter(F.col("anomaly_type") == "POSSIBLE_GENUINE_EVENT").select(TS).distinct()
    hit = rows.join(times, TS, "left_semi")
    return hit.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count(F.when(F.col("pred") == 1, 1)).alias("flagged"),
        steady_round(F.avg(F.col("pred").cast("double")), 4).alias("false_alarm_rate"), steady_round(F.avg("score"), 4).alias("mean_score"))


def label_accounting(labels: DataFrame) -> DataFrame:
    per_time = labels.groupBy(KEY, TS).agg(F.count(F.lit(1)).alias("events_here"), F.count(F.lit(1)).alias("n"))
    overlap = per_time.agg(F.count(F.when(F.col("events_here") > 1, 1)).alias("overlapping"))
    total = labels.groupBy("anomaly_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("n").alias("affected_rows"), steady_round(F.avg("n"), 2).alias("mean_rows_per_event"))
    return total.join(F.broadcast(overlap), F.lit(True))  # one row


def rows_at(rows: DataFrame, places: DataFrame, tie: str, seconds: int) -> DataFrame:
    """(name, at, tie) of the rows at the 1-based ``places`` (name, place) in (time, ``tie``) order.

    Rows are counted per stretch of time, then per instant of the few stretches that hold a place;
    only rows of those instants are ever put in order, and no row of the table is shuffled as a whole.
    """
    def narrowed(counts: DataFrame, wanted: DataFrame, by: str, key: list[str]) -> DataFrame:
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("before", before)
        join = placed.join(F.broadcast(wanted), key) if key else placed.join(F.broadcast(wanted), F.lit(True))  # one row for each place
        inside = (F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("n"))
        return join.filter(inside).select("name", by, (F.col("place") - F.col("before")).alias("place"))

    times = with_chunk(rows.select(TS, F.col(tie).alias("tie")), TS, seconds)
    stretches = narrowed(times.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("n")), places, CHUNK, [])
    instants = times.join(F.broadcast(stretches.select("name", CHUNK)), CHUNK).groupBy("name", TS).agg(F.count(F.lit(1)).alias("n"))
    at = narrowed(instants, stretches.select("name", "place"), TS, ["name"])
    last = times.join(F.broadcast(at), TS).withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("tie")))
    return last.filter(F.col("k") == F.col("place")).select("name", F.col(TS).alias("at"), "tie")


def chronological_split(rows: DataFrame, tie: str = "event_id", train: float = 0.6, val: float = 0.2, seconds: int = 3600) -> DataFrame:
    """Exact split by position in time order, from the two rows at the borders.

    Rows with the time and ``tie`` of a border row belong to the part before it.
    """
    n = F.col("_n")
    t_end = F.greatest(F.lit(1), F.floor(n * train + 1e-9))
    v_end = F.least(F.greatest(t_end + 1, F.floor(n * (train + val) + 1e-9)), F.when(n > 2, n - 1).otherwise(n))
    ends = rows.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(
        F.struct(F.lit("t").alias("name"), t_end.alias("place")), F.struct(F.lit("v").alias("name"), v_end.alias("place")))).alias("e")).select("e.*")
    cuts = rows_at(rows, ends, tie, seconds).groupBy().pivot("name", ["t", "v"]).agg(F.first(F.struct("at", "tie")))
    place = F.struct(F.col(TS).alias("at"), F.col(tie).alias("tie"))
    part = F.when(place <= F.col("_cut.t"), "train").when(place <= F.col("_cut.v"), "validation").otherwise("test")
    return rows.join(F.broadcast(cuts.select(F.struct("t", "v").alias("_cut"))), F.lit(True)).withColumn("split", part).drop("_cut")  # one row


def split_by_dates(rows: DataFrame, train_end: str, val_end: str) -> DataFrame:
    a, b = F.lit(train_end).cast("timestamp"), F.lit(val_end).cast("timestamp")
    return rows.withColumn("split", F.when(F.col(TS) < a, "train").when(F.col(TS) < b, "validation").otherwise("test"))


def compare_sets(metrics: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Mean and population spread of each metric over the rows of ``metrics`` tagged with ``by``."""
    long = metrics.unpivot([by], list(cols), "metric", "value")
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("sets"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.max_by(by, F.struct("value", by)).alias("best_set"))


def sweep_thresholds(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Confusion metrics per threshold; the parameter list is short and exploded after counting scores."""
    g = rows.groupBy(steady_round(F.col("score"), SCORE_DIGITS).alias("score"), "y_true").agg(F.count(F.lit(1)).alias("n"))
    x = g.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    above = F.col("score") >= F.col("threshold")

    def n(cond, y):
        return F.sum(F.when(cond & (F.col("y_true") == y), F.col("n")).otherwise(0))

    c = x.groupBy("threshold").agg(n(above, 1).alias("tp"), n(above, 0).alias("fp"), n(~above, 0).alias("tn"), n(~above, 1).alias("fn"))
    return with_rates(c)


def first_missing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that differ between two runs of an operator (empty = identical)."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
