"""Station network, neighbour joins and agreement with neighbouring stations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meteoqc.functions.geo import bearing_deg, coarser, cube_cell, haversine_km
from meteoqc.functions.physics import filled_slp
from meteoqc.functions.timefn import round_to_minutes
from meteoqc.operators.chunks import CHUNK, FOUR_DAYS, as_of, chunk_window, drop_halo, with_halo
from meteoqc.operators.staging import staged
from meteoqc.schema import KEY, RH, SLP, TEMP, TS, VARS


@dataclass(frozen=True)
class Network:
    """Neighbour search and tolerance parameters."""

    max_km: float = 600.0
    k: int = 5
    tolerance_minutes: int = 30
    min_valid: int = 2
    idw_power: float = 1.0
    max_elevation_diff_m: float | None = None


TOLERANCE = {"temp": 1.0, "rh": 5.0, "slp": 1.5}  # fixed values
TREND_TOLERANCE = {"temp": 0.3, "rh": 1.5, "slp": 0.4}  # fixed values


def stations(obs: DataFrame) -> DataFrame:
    """One row per station, coordinates from its first reading, missing elevation = 0."""
    place = F.struct("station_name", "latitude", "longitude", F.coalesce("elevation_m", F.lit(0.0)).alias("elevation_m"))
    return obs.groupBy(KEY).agg(F.min_by(place, TS).alias("p")).select(KEY, "p.*")


def station_pairs(st: DataFrame, max_km: float = 600.0) -> DataFrame:
    """Ordered pairs within ``max_km`` by an equi-join on grid cells (no cross join)."""
    cell = cube_cell(F.col("latitude"), F.col("longitude"), max_km)
    placed = st.select(KEY, "latitude", "longitude", "elevation_m", cell.alias("c"))
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = placed
    for axis in ("cx", "cy", "cz"):
        left = left.withColumn(f"d_{axis}", F.explode(near))
    left = left.select(
        F.col(KEY), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("elevation_m").alias("elev"),
        *[(F.col(f"c.{a}") + F.col(f"d_{a}")).alias(a) for a in ("cx", "cy", "cz")],
    )
    right = placed.select(
        F.col(KEY).alias("neighbor_id"), F.col("latitude").alias("n_lat"), F.col("longitude").alias("n_lon"),
        F.col("elevation_m").alias("n_elev"), "c.*",
    )
    a, b = (F.col("lat"), F.col("lon")), (F.col("n_lat"), F.col("n_lon"))
    return (
        left.join(right, ["cx", "cy", "cz"])
        .filter(F.col(KEY) != F.col("neighbor_id"))
        .select(
            KEY, "neighbor_id",
            haversine_km(*a, *b).alias("distance_km"),
            bearing_deg(*a, *b).alias("bearing_deg"),
            (F.col("n_elev") - F.col("elev")).alias("elevation_diff_m"),
        )
        .filter(F.col("distance_km") <= max_km)
    )


AXES = ["cx", "cy", "cz"]
LEVELS = 12  # the finest cells are max_km / 2^LEVELS wide


def _around(df: DataFrame, cell: str = "c") -> DataFrame:
    """Each row once for its cell and each of the 26 cells around it."""
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(AXES, (x, y, z))]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]))
    return df.withColumn("_d", step).withColumn(cell, F.struct(*[(F.col(f"{cell}.{a}") + F.col(f"_d.d{a}")).alias(a) for a in AXES])).drop("_d")


def _nearest(asked: DataFrame, placed: DataFrame, net: Network) -> DataFrame:
    """The k nearest of every row of ``asked`` (with ``level`` and ``c``) among the cells around its own."""
    right = placed.select("level", "c", F.col(KEY).alias("neighbor_id"), F.col("latitude").alias("n_lat"), F.col("longitude").alias("n_lon"), F.col("elevation_m").alias("n_elev"))
    a, b = (F.col("latitude"), F.col("longitude")), (F.col("n_lat"), F.col("n_lon"))
    pairs = _around(asked).join(right, ["level", "c"]).filter(F.col(KEY) != F.col("neighbor_id")).select(
        KEY, "neighbor_id", "level", haversine_km(*a, *b).alias("distance_km"), bearing_deg(*a, *b).alias("bearing_deg"), (F.col("n_elev") - F.col("elevation_m")).alias("elevation_diff_m"))
    pairs = pairs.filter(F.col("distance_km") <= net.max_km)
    if net.max_elevation_diff_m is not None:
        pairs = pairs.filter(F.abs("elevation_diff_m") <= net.max_elevation_diff_m)
    w = Window.partitionBy(KEY).orderBy(F.round("distance_km", 6), "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= net.k)


def nearest_edges(st: DataFrame, net: Network = Network()) -> DataFrame:
    """k nearest per station by a ring search over nested grids; the same rows as all pairs would give.

    Every station starts at the finest level where the cells around its own hold some times k
    stations, so a dense cell is cut as often as needed. If its k-th neighbour lies within one cell
    width, no other cell can hold a nearer one. Else the distance found (or ``max_km`` where fewer than
    k were found) bounds the second and last search, at the finest level whose cells are that wide.
    """
    fine = cube_cell(F.col("latitude"), F.col("longitude"), net.max_km / 2**LEVELS)
    st = st.withColumns({"_f": fine, "elevation_m": F.coalesce("elevation_m", F.lit(0.0))})
    placed = st.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("c", coarser(F.col("_f"), LEVELS - F.col("level"))).select(
        KEY, "latitude", "longitude", "elevation_m", "level", "c")
    held = placed.groupBy("level", "c").agg(F.count(F.lit(1)).alias("n"))
    near = _around(held).groupBy("level", "c").agg(F.sum("n").alias("near"))
    start = placed.join(near, ["level", "c"]).groupBy(KEY).agg(F.coalesce(F.max(F.when(F.col("near") > 4 * net.k, F.col("level"))), F.lit(0)).alias("level"))
    first = _nearest(placed.join(start, [KEY, "level"]), placed, net)
    reach = first.groupBy(KEY).agg(F.count(F.lit(1)).alias("found"), F.max("distance_km").alias("reach"))
    state = start.join(reach, KEY, "left").withColumn("width", net.max_km / F.pow(F.lit(2.0), F.col("level")))
    done = (F.col("level") == 0) | ((F.coalesce("found", F.lit(0)) == net.k) & (F.col("reach") + 1e-6 <= F.col("width")))
    wide = F.when(F.col("found") == net.k, F.least(F.col("reach") + 1e-6, F.lit(net.max_km))).otherwise(net.max_km)
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.floor(F.log2(net.max_km / F.greatest(wide, F.lit(1e-6)))).cast("int")))
    again = state.filter(~done).select(KEY, level.alias("level"))
    second = _nearest(placed.join(again, [KEY, "level"]), placed, net)
    return first.join(state.filter(done).select(KEY), KEY, "left_semi").unionByName(second).drop("level")


def all_pairs_edges(st: DataFrame, net: Network = Network()) -> DataFrame:
    """k nearest per station out of all pairs within ``max_km``."""
    pairs = station_pairs(st, net.max_km)
    if net.max_elevation_diff_m is not None:
        pairs = pairs.filter(F.abs("elevation_diff_m") <= net.max_elevation_diff_m)
    w = Window.partitionBy(KEY).orderBy(F.round("distance_km", 6), "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= net.k)


def neighbour_edges(st: DataFrame, net: Network = Network(), dense: int = 512) -> DataFrame:
    """k nearest per station; the rank uses rounded distance, then id, so ties are stable.

    Pairs are made directly where no cell of ``max_km`` holds more than ``dense`` stations, which one
    count tells, and found by a ring search otherwise. Both give the same rows.
    """
    cells = st.groupBy(cube_cell(F.col("latitude"), F.col("longitude"), net.max_km).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    most = cells.agg(F.max("n")).first()[0] or 0
    return all_pairs_edges(st, net) if most <= dense else nearest_edges(staged(st), net)


def bucketed_neighbours(obs: DataFrame, edges: DataFrame, minutes: int = 30, readings: DataFrame | None = None) -> DataFrame:
    """Neighbour aggregates per reading with both sides rounded to the same time bucket.

    They depend on (station, bucket) only, so they are computed once per bucket and joined back,
    not once per reading. ``readings``: the same rows before their features were added, so that the
    features are not computed a second time for the values of the buckets.
    """
    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_bucket": round_to_minutes(TS, minutes), "_slp": filled_slp()})

    seen, obs = placed(obs if readings is None else readings), placed(obs)
    latest = seen.groupBy(KEY, "_bucket").agg(
        F.max_by(F.struct(F.col(TEMP).alias("temp"), F.col(RH).alias("rh"), F.col("_slp").alias("slp")), TS).alias("v")
    )
    links = edges.select(F.col(KEY).alias("_target"), F.col("neighbor_id").alias(KEY), "distance_km")
    aggs = [F.count(F.lit(1)).alias("spatial_neighbor_count"), F.min("distance_km").alias("spatial_nearest_neighbor_dist_km")]
    for v in VARS:
        x = F.col(f"v.{v}")
        aggs += [
            F.avg(x).alias(f"spatial_neighbor_{v}_mean"),
            F.percentile(x, F.lit(0.5)).alias(f"spatial_neighbor_{v}_median"),
            F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias(f"spatial_neighbor_{v}_std"),
        ]
    around = latest.join(links, KEY).groupBy(F.col("_target").alias(KEY), "_bucket").agg(*aggs)
    out = obs.join(around, [KEY, "_bucket"], "left").withColumn(
        "spatial_neighbor_count", F.coalesce("spatial_neighbor_count", F.lit(0))
    )
    own = {"temp": F.col(TEMP), "rh": F.col(RH), "slp": F.col("_slp")}
    return out.withColumns(
        {f"spatial_{v}_delta_from_neighbor_mean": own[v] - F.col(f"spatial_neighbor_{v}_mean") for v in VARS}
    ).drop("_bucket", "_slp")


def with_deltas(obs: DataFrame, seconds: int = FOUR_DAYS) -> DataFrame:
    """Columns temp/rh/slp (SLP filled) and their change since the station's previous reading."""
    base = obs.withColumns({"temp": F.col(TEMP), "rh": F.col(RH), "slp": filled_slp()})
    halo = with_halo(base, rows=1, seconds=seconds)
    w = chunk_window()
    return drop_halo(halo.withColumns({f"d_{v}": F.col(v) - F.lag(v).over(w) for v in VARS}), CHUNK)


READING = [TS, "temp", "rh", "slp", "d_temp", "d_rh", "d_slp"]


def neighbour_matches(obs: DataFrame, edges: DataFrame, net: Network = Network(), *, causal: bool = True,
                      seconds: int = FOUR_DAYS, timed: bool = False) -> DataFrame:
    """One row per (reading, neighbour) with the neighbour's reading nearest in time.

    ``causal``: latest at or before the reading; otherwise the nearest on either side, the earlier
    one on a tie. Readings beyond the tolerance stay, marked ``is_stale``. The narrow series is
    written once, because probes, candidates and their chunk totals all read it. ``timed``: every
    reading has a station and a time. Then only these two are looked up, once for all readings that
    share them, and the values join the matches by (station, time), which places them for ``consensus``.
    """
    series = staged(with_deltas(obs, seconds).select(KEY, *READING))
    links = edges.select(KEY, "neighbor_id", "distance_km", "rank")
    probes = (series.select(KEY, TS).distinct() if timed else series).join(links, KEY)
    build = series.select(F.col(KEY).alias("neighbor_id"), *READING)
    found = as_of(probes, build, key="neighbor_id", ts=TS, payload=READING, name="n", seconds=seconds)
    if not causal:
        found = as_of(found, build, key="neighbor_id", ts=TS, payload=READING, name="f", forward=True, seconds=seconds)
        back, ahead = F.unix_micros(TS) - F.unix_micros("n.obs_ts"), F.unix_micros("f.obs_ts") - F.unix_micros(TS)
        found = found.withColumn("n", F.when(F.col("n").isNull() | (ahead < back), F.coalesce("f", "n")).otherwise(F.col("n"))).drop("f")
    if timed:
        found = series.hint("merge").join(found, [KEY, TS])  # a broadcast would leave them by neighbour
    seconds_off = (F.unix_micros("n.obs_ts") - F.unix_micros(TS)) / 1_000_000.0
    found = found.withColumn("time_delta_seconds", seconds_off)
    stale = F.abs("time_delta_seconds") > net.tolerance_minutes * 60.0
    any_value = F.coalesce("n.temp", "n.rh", "n.slp").isNotNull()
    return found.withColumns({"is_stale": stale, "is_valid": F.coalesce(~stale & any_value, F.lit(False))})


def _consensus(v: str, net: Network) -> list[Column]:
    """Aggregates over one reading's neighbours for one variable; what shares a count or a sum shares its buffer."""
    ok = F.col("is_valid")
    x = F.when(ok, F.col(f"n.{v}"))
    d = F.when(ok & F.col(f"n.{v}").isNotNull(), F.col(f"n.d_{v}"))
    t, tol, trend = F.col(v), TOLERANCE[v], TREND_TOLERANCE[v]
    w = F.when(x.isNotNull(), 1.0 / F.pow(F.greatest(F.col("distance_km"), F.lit(1.0)), F.lit(net.idw_power)))

    def share(cond, value):
        return F.coalesce(F.count(F.when(value.isNotNull() & cond, 1)) / F.nullif(F.count(value), F.lit(0)), F.lit(0.0))

    def mean(value):
        return F.sum(value) / F.nullif(F.count(x), F.lit(0))

    return [
        F.count(x).alias(f"{v}_n"), mean(x).alias(f"{v}_mean"),
        # one column per neighbour rank: plain hash aggregation, where a percentile would buffer objects
        *[F.max(F.when(F.col("rank") == i + 1, x)).alias(f"_{v}_{i}") for i in range(net.k)],
        F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias(f"{v}_std"),
        F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max"),
        share(x > t + tol, x).alias(f"{v}_higher"),
        share(x < t - tol, x).alias(f"{v}_lower"),
        share(F.abs(x - t) <= tol, x).alias(f"{v}_similar"),
        share(d > trend, d).alias(f"{v}_rising"),
        share(d < -trend, d).alias(f"{v}_falling"),
        share(F.abs(d) <= trend, d).alias(f"{v}_stable"),
        F.count(d).alias(f"{v}_trend_n"),
        (F.sum(w * x) / F.sum(w)).alias(f"{v}_idw"), mean(F.when(x.isNotNull(), F.col("distance_km"))).alias(f"{v}_km"),
    ]


def _median(values: list[Column], n: Column) -> Column:
    """Median of ``n`` non-null values among a fixed number of columns (nulls sort first)."""
    s, first = F.sort_array(F.array(*values)), F.lit(len(values)) - n
    low, high = first + F.floor((n - 1) / 2), first + F.floor(n / 2)
    return F.when(n > 0, (F.get(s, low.cast("int")) + F.get(s, high.cast("int"))) / 2.0)


def consensus(matches: DataFrame, net: Network = Network(), placed: bool = False) -> DataFrame:
    """Agreement of each reading with its neighbours, all three variables in one aggregate.

    The narrow matches are exchanged, not the wide partial aggregates, of which there would be one
    for each match; ``placed`` ones lie by (station, time) already. Below 100 buffers the aggregate is also compiled (``spark.sql.codegen.maxFields``).
    """
    any_of = F.last if placed else F.first  # readings that share station and time: one of them speaks for all
    aggs = [
        F.count(F.when(F.col("n").isNotNull(), 1)).alias("matched_neighbors"),
        F.count(F.when(F.col("is_valid"), 1)).alias("valid_neighbors"),
        F.count(F.when(F.col("is_stale"), 1)).alias("stale_neighbors"),
        F.avg(F.when(F.col("is_valid"), F.col("distance_km"))).alias("valid_mean_km"),
        *[any_of(v).alias(v) for v in VARS], *[any_of(f"d_{v}").alias(f"d_{v}") for v in VARS],
    ]
    for v in VARS:
        aggs += _consensus(v, net)
    out = (matches if placed else matches.repartition(KEY, TS)).groupBy(KEY, TS).agg(*aggs)
    ranked = {v: [F.col(f"_{v}_{i}") for i in range(net.k)] for v in VARS}
    out = out.withColumns({"nearest_temp": F.coalesce(*ranked["temp"]), **{f"{v}_median": _median(ranked[v], F.col(f"{v}_n")) for v in VARS}})
    out = out.drop(*[f"_{v}_{i}" for v in VARS for i in range(net.k)])
    cols = {}
    for v in VARS:
        t, tol, trend = F.col(v), TOLERANCE[v], TREND_TOLERANCE[v]
        off = t - F.col(f"{v}_mean")
        std = F.col(f"{v}_std")
        cols[f"{v}_minus_mean"] = off
        cols[f"{v}_minus_median"] = t - F.col(f"{v}_median")
        cols[f"{v}_minus_idw"] = t - F.col(f"{v}_idw")
        cols[f"{v}_zscore"] = (
            F.when(off.isNull(), F.lit(None).cast("double"))
            .when(std > 1e-4, off / std)
            .when(F.abs(off) <= tol, 0.0)
            .otherwise(off / max(tol, 0.1))
        )
        up, down, flat = F.col(f"{v}_rising"), F.col(f"{v}_falling"), F.col(f"{v}_stable")
        d = F.col(f"d_{v}")
        agree = F.when(d > trend, up - down).when(d < -trend, down - up).otherwise(flat - (up + down))
        cols[f"{v}_agreement"] = F.when(
            d.isNotNull() & (F.col(f"{v}_trend_n") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), agree))
        )
    return out.withColumns(cols)


def mean_of(*cols: Column) -> Column:
    """Mean of the non-null values, null if none."""
    values = F.array_compact(F.array(*cols))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def context(cons: DataFrame, net: Network = Network()) -> DataFrame:
    """Coherence index and the spatial category of each reading."""
    levels = []
    depart, corroborated = {}, {}
    for v in VARS:
        similar, agree = F.col(f"{v}_similar"), F.col(f"{v}_agreement")
        score = 0.6 * similar + 0.4 * F.coalesce((agree + 1.0) / 2.0, F.lit(0.5))
        levels.append(F.when((F.col(f"{v}_n") > 0) & F.col(v).isNotNull(), score))
        z = F.abs(F.coalesce(F.col(f"{v}_zscore"), F.lit(0.0)))
        off = F.abs(F.coalesce(F.col(f"{v}_minus_median"), F.lit(0.0)))
        depart[v] = (similar < 0.5) & ((z >= 2.2) | (off > 2.0 * TOLERANCE[v]))
        big = F.coalesce(F.abs(F.col(f"d_{v}")) >= 2.5 * TREND_TOLERANCE[v], F.lit(False))
        corroborated[v] = (similar >= 0.5) | (big & F.coalesce(agree >= 0.5, F.lit(False)))
    any_departure = depart["temp"] | depart["rh"] | depart["slp"]
    unexplained = [depart[v] & ~corroborated[v] for v in VARS]
    near_alike = F.coalesce(F.abs(F.col("temp") - F.col("nearest_temp")) <= TOLERANCE["temp"] * 1.5, F.lit(False))
    category = (
        F.when(F.col("valid_neighbors") < net.min_valid, "INSUFFICIENT_CONTEXT")
        .when(~any_departure, "REGIONAL_PATTERN")
        .when(~(unexplained[0] | unexplained[1] | unexplained[2]), "REGIONAL_PATTERN")
        .when(near_alike, "LOCAL_CLUSTER")
        .otherwise("LOCAL_ONLY")
    )
    return cons.withColumns(
        {"coherence": F.coalesce(mean_of(*levels), F.lit(0.0)), "context_category": category}
    )


def spatial_context(obs: DataFrame, edges: DataFrame, net: Network = Network(), seconds: int = FOUR_DAYS, timed: bool = False) -> DataFrame:
    return context(consensus(neighbour_matches(obs, edges, net, seconds=seconds, timed=timed), net, placed=timed), net)


def trailing_neighbours(obs: DataFrame, edges: DataFrame, col: str = TEMP, minutes: int = 15,
                        seconds: int = FOUR_DAYS) -> DataFrame:
    """Each neighbour's latest valid value within ``minutes`` before the reading (one row each)."""
    series = obs.select(KEY, TS, F.col(col).alias("own"))
    probes = series.join(edges.select(KEY, "neighbor_id", "distance_km", "rank"), KEY)
    build = series.filter(F.col("own").isNotNull()).select(
        F.col(KEY).alias("neighbor_id"), TS, F.col("own").alias("value"))
    found = as_of(probes, build, key="neighbor_id", ts=TS, payload=[TS, "value"], name="n", seconds=seconds)
    fresh = F.unix_micros(TS) - F.unix_micros("n.obs_ts") <= minutes * 60_000_000
    return found.withColumn("neighbor_value", F.when(fresh, F.col("n.value"))).drop("n")


# --- fixed values: agreement tolerances of the neighbour comparison -----------
AGREE = {TEMP: 2.0, RH: 10.0, SLP: 2.5}
# --- end of fixed values ------------------------------------------------------


def compare_neighbours(obs: DataFrame, edges: DataFrame, col: str = TEMP, minutes: int = 15,
                       seconds: int = FOUR_DAYS) -> DataFrame:
    found = trailing_neighbours(obs, edges, col, minutes, seconds)
    x = F.col("neighbor_value")
    out = found.groupBy(KEY, TS).agg(
        F.first("own").alias("own"), F.count(F.lit(1)).alias("configured"), F.count(x).alias("active"),
        F.percentile(x, F.lit(0.5)).alias("neighbor_median"),
        F.count(F.when(F.abs(x - F.col("own")) <= AGREE[col], 1)).alias("agreeing"),
    )
    return out.withColumns(
        {
            "deviation": F.col("own") - F.col("neighbor_median"),
            "alignment": F.when(F.col("configured") == 0, "NO_NEIGHBORS")
            .when(F.col("active") == 0, "STALE_OR_MISSING")
            .when(F.col("active") >= 3, "ALIGNED")
            .otherwise("SPARSE"),
        }
    )


def topology_report(st: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbour list per station (bounded by k) and whether it is connected."""
    lists = edges.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("neighbors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))), lambda e: e["neighbor_id"]), ",").alias("neighbor_ids"),
        F.min("distance_km").alias("nearest_km"),
    )
    return st.select(KEY).join(lists, KEY, "left").select(
        KEY, F.coalesce("neighbors", F.lit(0)).alias("neighbors"), F.coalesce("neighbor_ids", F.lit("")).alias("neighbor_ids"),
        "nearest_km", (F.coalesce("neighbors", F.lit(0)) > 0).alias("is_connected"),
    )
