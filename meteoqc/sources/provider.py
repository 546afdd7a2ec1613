"""Provider JSON payloads: one reading, parallel arrays, or a flat object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meteoqc.functions.text import clean_number
from meteoqc.functions.timefn import parse_timestamp
from meteoqc.operators.quality import completeness_status, with_reject_reasons
from meteoqc.schema import DEW, KEY, RH, SLP, STNP, TEMP, TS

# --- fixed values: field names of the payloads --------------------------------
FIELDS = {"time": "time", TEMP: "temperature_2m", RH: "relative_humidity_2m", SLP: "pressure_msl",
          STNP: "surface_pressure", DEW: "dew_point_2m"}
FLAT_FALLBACKS = {TEMP: ["temperature", "temp"], RH: ["humidity", "rh"], SLP: ["pressure", "slp"],
                  STNP: ["station_pressure"], DEW: ["dew_point"]}
# --- end of fixed values ------------------------------------------------------


def _text(names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_flat_names = [*FIELDS.values(), *[x for v in FLAT_FALLBACKS.values() for x in v]]
PAYLOAD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ["station_id", "station_name", "latitude", "longitude", "elevation", "error", "reason", *_flat_names]]
    + [
        T.StructField("current", _text([*FIELDS.values(), "interval"])),
        T.StructField("hourly", T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in FIELDS.values()])),
        T.StructField("_provenance", _text(["provider", "station_id", "retrieved_at_utc", "scenario", "http_status"])),
    ]
)


def scan(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One payload per file, or per line (JSON lines, which large archives can be split at)."""
    return spark.read.option("wholetext", not lines).text(path).select(
        F.col("value").alias("payload"), F.input_file_name().alias("payload_file"))


def normalise(raw: DataFrame, payload: str = "payload", default_station: str = "UNKNOWN_STATION") -> DataFrame:
    """Rows of all three shapes in one pass, each with ``reject_reasons`` and its ``payload_shape``.

    Every payload becomes an array of readings which is then exploded, so the three shapes need
    neither three scans nor a union.
    """
    p = raw.withColumn("_p", F.from_json(payload, PAYLOAD))

    def reading(get) -> Column:
        return F.struct(*[get(k, f).cast("string").alias(k) for k, f in FIELDS.items()])

    def flat(k, f):
        return F.coalesce(F.col(f"_p.{f}"), *[F.col(f"_p.{x}") for x in FLAT_FALLBACKS.get(k, [])])

    def at(i):
        return reading(lambda k, f: F.get(F.col(f"_p.hourly.{f}"), i))

    no_reading = reading(lambda k, f: F.lit(None))
    one = F.array(reading(lambda k, f: F.col(f"_p.current.{f}")))
    many = F.transform(F.sequence(F.lit(0), F.size("_p.hourly.time") - 1), at)
    shape = (
        F.when(F.col("_p.current").isNotNull(), "LIVE_API_CURRENT")
        .when(F.size("_p.hourly.time") > 0, "LIVE_API_HOURLY")
        .when(F.col("_p.time").isNotNull(), "LIVE_API_FLAT")
    )
    readings = (
        F.when(shape == "LIVE_API_CURRENT", one)
        .when(shape == "LIVE_API_HOURLY", many)
        .when(shape == "LIVE_API_FLAT", F.array(reading(flat)))
        .otherwise(F.array(no_reading))
    )
    kept = [c for c in raw.columns if c != payload]
    rows = p.select(*kept, "_p", shape.alias("report_type"), F.explode(readings).alias("_r"))
    out = rows.select(
        *kept,
        F.coalesce("_p.station_id", "_p._provenance.station_id", F.lit(default_station)).alias(KEY),
        F.col("_p.station_name").alias("station_name"),
        parse_timestamp("_r.time").alias(TS),
        clean_number("_p.latitude").alias("latitude"), clean_number("_p.longitude").alias("longitude"),
        clean_number("_p.elevation").alias("elevation_m"),
        *[clean_number(f"_r.{c}").alias(c) for c in (TEMP, DEW, RH, SLP, STNP)],
        F.lit("OPEN_METEO").alias("source"), "report_type",
        parse_timestamp("_p._provenance.retrieved_at_utc").alias("ingestion_ts"),
    ).withColumn("data_quality_status", completeness_status())
    return with_reject_reasons(
        out,
        [
            (F.col("report_type").isNull(), "PAYLOAD_NOT_RECOGNISED"),
            (F.col("latitude").isNull() | F.col("longitude").isNull(), "COORDINATES_MISSING"),
            (F.col("report_type").isNotNull() & F.col(TS).isNull(), "TIMESTAMP_MISSING_OR_MALFORMED"),
        ],
    )


def as_payload(obs: DataFrame) -> DataFrame:
    """Canonical rows written as payloads, the shape chosen by ``event_id`` (current, arrays, flat)."""
    def js(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    when = F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    later = F.date_format(F.timestamp_micros(F.unix_micros(TS) + 1_800_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    head = F.format_string('"station_id": "%s", "latitude": %s, "longitude": %s, "elevation": %s', KEY, "latitude", "longitude", "elevation_m")
    one = F.concat(
        F.lit('"time": "'), when, F.lit('Z", "temperature_2m": '), js(TEMP), F.lit(', "relative_humidity_2m": '), js(RH),
        F.lit(', "pressure_msl": '), js(SLP), F.lit(', "surface_pressure": '), js(STNP))
    two = F.concat(
        F.lit('"time": ["'), when, F.lit('", "'), later, F.lit('"], "temperature_2m": ['), js(TEMP), F.lit(', -9999], "relative_humidity_2m": ['),
        js(RH), F.lit(', 50], "pressure_msl": ['), js(SLP), F.lit(', 1010.5], "surface_pressure": ['), js(STNP), F.lit("]"))
    kind = F.col("event_id") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit("{"), head, F.lit(', "current": {'), one, F.lit("}}")))
        .when(kind == 1, F.concat(F.lit("{"), head, F.lit(', "hourly": {'), two, F.lit("}}")))
        .when(kind == 2, F.concat(F.lit("{"), head, F.lit(", "), one, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), head, F.lit(', "reason": "no data"}')))
    )
    return obs.select("event_id", body.alias("payload"))
