"""Generic CSV with header aliases, format sniffing and station files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.functions.text import clean_number
from meteoqc.functions.timefn import parse_timestamp
from meteoqc.operators.quality import completeness_status, with_reject_reasons
from meteoqc.schema import DEW, KEY, RH, SLP, STNP, TEMP, TS
from meteoqc.sources import isd

# --- fixed values: accepted header names and defaults -------------------------
ALIASES = {
    KEY: ["station_id", "station", "stn", "aws_id"],
    "station_name": ["station_name", "name", "station_desc"],
    TS: ["timestamp", "time", "date", "date_time", "datetime", "obs_time", "obs_ts"],
    TEMP: ["temperature", "temperature_c", "temp", "temp_c", "air_temp", "tmp", "temp_degree_c", "temperature_celsius"],
    DEW: ["dew_point_c", "dew_point", "dewpoint", "dew_pt", "dew"],
    RH: ["humidity", "relative_humidity", "relative_humidity_pct", "rh", "rhum", "rel_hum", "hum"],
    SLP: ["pressure", "sea_level_pressure", "sea_level_pressure_hpa", "mslp", "slp", "barometer", "baro_pressure"],
    STNP: ["station_pressure_hpa", "station_pressure", "stp"],
    "latitude": ["latitude", "lat", "y"],
    "longitude": ["longitude", "lon", "lng", "x"],
    "elevation_m": ["elevation", "elevation_m", "elev", "z", "alt", "altitude"],
}
REQUIRED = [KEY, TS, TEMP, RH, SLP]
OPTIONAL = ["station_name", DEW, STNP, "latitude", "longitude", "elevation_m"]
LABEL_COLUMNS = ["ground_truth_anomaly", "is_anomaly", "anomaly_label"]
DEFAULT_PLACE = {"latitude": 28.6139, "longitude": 77.2090, "elevation_m": 216.0}
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class HeaderMapping:
    mapping: dict[str, str]
    unmapped: list[str]
    missing: list[str]
    warnings: list[str] = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return not self.missing


def infer_mapping(columns: list[str]) -> HeaderMapping:
    """Header name -> canonical column; the first header that fits a column keeps it."""
    canonical = {alias: name for name, names in ALIASES.items() for alias in names}
    mapping: dict[str, str] = {}
    for c in columns:
        target = canonical.get(c.strip().lower())
        if target and target not in mapping.values():
            mapping[c] = target
    missing = [c for c in REQUIRED if c not in mapping.values()]
    warnings = [f"missing required columns: {', '.join(missing)}"] if missing else []
    if not {"latitude", "longitude"} <= set(mapping.values()):
        warnings.append("no coordinates in the header, defaults apply")
    return HeaderMapping(mapping, [c for c in columns if c not in mapping], missing, warnings)


def rename(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(mapping or infer_mapping(df.columns).mapping)


def with_canonical_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Adds canonical columns from old names where the canonical one is absent."""
    return df.withColumns({new: F.col(old) for old, new in aliases.items() if old in df.columns and new not in df.columns})


def normalise(raw: DataFrame, mapping: dict[str, str] | None = None, default_station: str = "UNKNOWN_STATION") -> DataFrame:
    df = rename(raw, mapping)
    numbers = [TEMP, DEW, RH, SLP, STNP, "latitude", "longitude", "elevation_m"]
    cols = {c: clean_number(c) if c in df.columns else F.lit(None).cast("double") for c in numbers}
    cols |= {c: F.coalesce(cols[c], F.lit(v)) for c, v in DEFAULT_PLACE.items()}
    station = F.trim(F.col(KEY)) if KEY in df.columns else F.lit(None).cast("string")
    name = F.col("station_name") if "station_name" in df.columns else F.lit(None).cast("string")
    cols[KEY] = F.coalesce(station, F.lit(default_station))
    cols[TS] = parse_timestamp(F.col(TS).cast("string")) if TS in df.columns else F.lit(None).cast("timestamp")
    df = df.withColumns(cols)
    label = next((c for c in LABEL_COLUMNS if c in df.columns), None)
    out = df.withColumns(
        {
            "station_name": F.coalesce(name, F.concat(F.lit("Station "), F.col(KEY))),
            "source": F.lit("HISTORICAL_CSV"),
            "data_quality_status": completeness_status(),
            "is_fault": F.col(label).cast("boolean") if label else F.lit(None).cast("boolean"),
        }
    ).select(*REQUIRED, *OPTIONAL, "source", "data_quality_status", "is_fault")
    return with_reject_reasons(out, [(F.col(TS).isNull(), "TIMESTAMP_MISSING_OR_MALFORMED")])


def is_archive_layout(columns: list[str]) -> bool:
    return {"TMP", "DATE"} <= set(columns)


def files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line -> files that start with it. One pass over the text gives one row for each file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"), "_metadata.file_path", "_metadata.file_block_start")
    first = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "n").alias("header"))
    out: dict[str, list[str]] = {}
    for r in first.select(F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B"))).alias("file"), "header").orderBy("file").toLocalIterator():
        out.setdefault(r["header"], []).append(r["file"])
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sniffs the headers and dispatches to the archive or the generic normaliser.

    Files with different headers are read apart: a CSV scan takes columns by place, so one header
    for all of them would swap columns of the others.
    """
    out = None
    for files in files_by_header(spark, path).values():
        raw = spark.read.option("header", True).csv(files)
        rows = isd.normalise(raw) if is_archive_layout(raw.columns) else normalise(raw)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return normalise(spark.read.option("header", True).csv(path)) if out is None else out


def read_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark files -> (synthetic observations, scenario labels in their own frame)."""
    rows = labels = None
    for files in files_by_header(spark, path).values():
        raw = spark.read.option("header", True).csv(files)
        scenario = [c for c in ("scenario_id", "scenario_name", "anomaly_type", "step_index", *LABEL_COLUMNS) if c in raw.columns]
        part = normalise(raw).withColumn("is_synthetic", F.lit(True)), rename(raw).select(KEY, parse_timestamp(F.col(TS)).alias(TS), *scenario)
        rows, labels = part if rows is None else (rows.unionByName(part[0]), labels.unionByName(part[1], allowMissingColumns=True))
    return rows, labels


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station list from a YAML file with a top-level ``stations`` list (PyYAML needed)."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise RuntimeError("reading YAML station lists needs PyYAML") from e
    with open(path) as f:
        rows = yaml.safe_load(f)["stations"]
    data = [(str(r["station_id"]), r.get("name"), float(r["latitude"]), float(r["longitude"]), float(r.get("elevation") or 0.0)) for r in rows]
    return spark.createDataFrame(data, f"{KEY} string, station_name string, latitude double, longitude double, elevation_m double")
