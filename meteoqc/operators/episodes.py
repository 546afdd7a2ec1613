"""Life cycle of anomalous runs: onset, peak, recovery, surrounding rows, neighbours meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meteoqc.functions.numeric import steady_round
from meteoqc.operators.chunks import CHUNK, FOUR_DAYS, run_positions, with_chunk
from meteoqc.schema import KEY, TEMP, TS

#: readings of an average station in one stretch of the neighbours' join
READINGS = 32


def runs_of(decided: DataFrame, seconds: int = FOUR_DAYS) -> DataFrame:
    """Rows with ``is_anom`` and the time of the last row of the other kind (``run_key``)."""
    anom = (F.col("decision") != "NORMAL") | F.coalesce(F.col("score") >= 0.5, F.lit(False))
    rows = with_chunk(decided.withColumn("is_anom", anom), seconds=seconds)
    # normal rows are breaks; an anomalous row's run is named by the normal row before it
    return run_positions(rows, {"_n": ~F.col("is_anom")}).withColumns({"run_key": F.col("_n_start"), "run_pos": F.col("_n_since")}).drop("_n_since", "_n_start", CHUNK)


def reconstruct(decided: DataFrame, seconds: int = FOUR_DAYS) -> DataFrame:
    """One row per anomalous run. Recovery is the first normal row after it, null while it lasts."""
    rows = runs_of(decided, seconds)
    score = F.col("score")
    peak = F.max_by(F.struct(TS, TEMP, "score"), F.struct(score, (-F.unix_micros(TS)).alias("early")))
    runs = rows.filter("is_anom").groupBy(KEY, "run_key").agg(
        F.min(TS).alias("onset"), F.max(TS).alias("last_ts"), F.count(F.lit(1)).alias("length"), peak.alias("p"), F.max("seq").alias("_last_seq"))
    # the row right after a run is normal, so it can be found by its row number
    after = rows.filter(~F.col("is_anom")).select(KEY, (F.col("seq") - 1).alias("_last_seq"), F.col(TS).alias("recovery"))
    out = runs.join(after, [KEY, "_last_seq"], "left")
    end = F.coalesce("recovery", "last_ts")
    return out.select(
        KEY, "onset", "last_ts", "recovery", "length", F.col("p.obs_ts").alias("peak_ts"), F.col(f"p.{TEMP}").alias("peak_value"),
        steady_round(F.col("p.score"), 3).alias("peak_score"),
        steady_round((F.unix_micros(end) - F.unix_micros("onset")) / 60_000_000.0, 1).alias("duration_minutes"), F.col("recovery").isNull().alias("is_ongoing"))


def surroundings(decided: DataFrame, steps: int = 5, seconds: int = FOUR_DAYS) -> DataFrame:
    """The last rows before each run and the first rows after it, as (episode onset, side, row)."""
    rows = runs_of(decided, seconds)
    runs = rows.filter("is_anom").groupBy(KEY, "run_key").agg(F.min(TS).alias("onset"), F.min("seq").alias("a"), F.max("seq").alias("b"))
    offsets = F.array(*[F.lit(i) for i in range(1, steps + 1)])
    wanted = runs.select(KEY, "onset", F.explode(F.concat(
        F.transform(offsets, lambda i: F.struct(F.lit("before").alias("side"), (F.col("a") - i).alias("seq"))),
        F.transform(offsets, lambda i: F.struct(F.lit("after").alias("side"), (F.col("b") + i).alias("seq"))))).alias("w")).select(KEY, "onset", "w.*")
    return wanted.join(rows.select(KEY, "seq", TS, TEMP, "decision"), [KEY, "seq"])


def neighbours_during(episodes: DataFrame, obs: DataFrame, edges: DataFrame, col: str = TEMP, seconds: int = 86_400) -> DataFrame:
    """Readings of neighbouring stations between onset and end of each episode.

    An equi-join on (neighbour, stretch of time) with the time range as residual predicate. A stretch
    is ``seconds`` long at most and holds about ``READINGS`` of an average station, so an episode of a
    dense station meets few readings besides its own, and few stretches are made per reading.
    """
    span = F.unix_micros(F.max(TS)) - F.unix_micros(F.min(TS))
    total = obs.groupBy(KEY).agg(span.alias("span"), F.count(TS).alias("n")).agg(F.sum("span").alias("span"), F.sum("n").alias("n")).first()
    us = max(1_000_000, min(seconds * 1_000_000, READINGS * int(total["span"] or 0) // max(1, total["n"] or 0)))
    end = F.coalesce("recovery", "last_ts")
    days = F.sequence(F.floor(F.unix_micros("onset") / us), F.floor(F.unix_micros(end) / us))
    e = episodes.select(KEY, "onset", end.alias("end"), F.explode(days).alias("day")).join(edges.select(KEY, "neighbor_id"), KEY)
    n = obs.select(F.col(KEY).alias("neighbor_id"), F.col(TS).alias("n_ts"), F.col(col).alias("x"), F.floor(F.unix_micros(TS) / us).alias("day"))
    hit = e.join(n, ["neighbor_id", "day"]).filter(F.col("n_ts").between(F.col("onset"), F.col("end")))
    per = hit.groupBy(KEY, "onset", "neighbor_id").agg(F.sum("x").alias("s"), F.count("x").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return per.groupBy(KEY, "onset").agg(
        F.count(F.lit(1)).alias("neighbor_stations"), steady_round(F.sum("s") / F.sum("c"), 3).alias("neighbor_mean"),
        steady_round(F.min("lo"), 3).alias("neighbor_min"), steady_round(F.max("hi"), 3).alias("neighbor_max"))
