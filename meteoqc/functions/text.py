"""Cleaning of text fields, identifiers, redaction and error categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
MISSING_TEXT = ["", "null", "None", "NaN", "nan", "-9999", "-999", "999.9"]
MISSING_NUMBERS = [-9999.0, -999.0, 999.9, 9999.0]
ISD_MISSING_TEXT = ["9999", "+9999", "-9999", "99999", "+99999", "999.9", "9999.9"]
ISD_MISSING_NUMBERS = [9999.0, -9999.0, 99999.0, 999.9, 9999.9]
QC_STATUS = {"0": "VALID", "1": "VALID", "2": "SUSPECT", "3": "ERROR", "4": "VALID", "5": "VALID",
             "6": "SUSPECT", "7": "ERROR", "9": "UNKNOWN"}
# --- end of fixed values ------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def unquoted(x: Column | str) -> Column:
    return F.regexp_replace(F.trim(_c(x)), r'^"+|"+$', "")


def clean_number(x: Column | str) -> Column:
    """Number, or null for missing markers, non-numbers, NaN and infinities."""
    t = F.trim(_c(x).cast("string"))
    n = t.try_cast("double")
    bad = t.isin(MISSING_TEXT) | n.isin(MISSING_NUMBERS) | F.isnan(n) | (F.abs(n) == float("inf"))
    return F.when(~bad, n)


def add_scaled_fields(df: DataFrame, fields: dict[str, str], scale: float = 10.0) -> DataFrame:
    """``"+0108,1"`` -> ``<name>_value`` 10.8 and ``<name>_qc`` "1", for each name: text column.

    Sentinels are null; bad numbers have QC 3. The steps are separate projections and end in a
    generator, so a filter on a parsed value does not repeat the parsing once per reference.
    """
    kept = df.columns
    df = df.withColumns({f"_{n}_raw": unquoted(c) for n, c in fields.items()})
    df = df.withColumns(
        {k: v for n in fields for k, v in {
            f"_{n}_head": F.trim(F.split_part(F.col(f"_{n}_raw"), F.lit(","), F.lit(1))),
            f"_{n}_flag": F.trim(F.split_part(F.col(f"_{n}_raw"), F.lit(","), F.lit(2))),
        }.items()})
    df = df.withColumns({f"_{n}_number": F.col(f"_{n}_head").try_cast("double") for n in fields})
    out = []
    for n in fields:
        head, flag, number = (F.col(f"_{n}_{x}") for x in ("head", "flag", "number"))
        blank = F.coalesce(F.col(f"_{n}_raw"), F.lit("")) == ""
        missing = (head == "") | head.isin(ISD_MISSING_TEXT)
        unreadable = ~blank & ~missing & number.isNull()
        value = F.when(~blank & ~missing & ~number.isin(ISD_MISSING_NUMBERS), F.round(number / scale, 2))
        qc = F.when(unreadable, "3").when(blank | (flag == ""), "9").otherwise(flag)
        out += [value.alias(f"{n}_value"), qc.alias(f"{n}_qc")]
    return pin(df, out).select(*kept, *[f"{n}_{x}" for n in fields for x in ("value", "qc")])


def pin(df: DataFrame, computed: list[Column]) -> DataFrame:
    """Adds columns through a generator, which later filters and projections are not merged into."""
    return df.select("*", F.inline(F.array(F.struct(*computed))))


def qc_status(code: Column | str) -> Column:
    return F.coalesce(F.element_at(literal_map(QC_STATUS), _c(code)), F.lit("UNKNOWN"))


def hash16(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", *[_c(p) for p in parts]), 256), 1, 16)


def observation_id(source: Column | str, station: Column | str, ts: Column | str) -> Column:
    return F.concat(
        F.lit("obs_"), F.lower(_c(source)), F.lit("_"), F.right(_c(station), F.lit(6)), F.lit("_"),
        hash16(source, station, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")),
    )


def redact_keys(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(apikey|api_key)=[^&]+", "$1=[REDACTED]")


def error_category(x: Column | str) -> Column:
    """Fixed rule order: the first marker found decides."""
    t = _c(x)
    low = F.lower(t)
    return (
        F.when(t.contains("429"), "HTTP_429")
        .when(t.contains("401") | t.contains("403"), "HTTP_401")
        .when(low.contains("timeout"), "TIMEOUT")
        .when(t.contains("500") | t.contains("502") | t.contains("503"), "HTTP_5XX")
        .when(low.contains("malformed"), "PARSE_ERROR")
        .when(low.contains("quality gate"), "SCHEMA_VIOLATION")
        .otherwise("NETWORK_ERROR")
    )
