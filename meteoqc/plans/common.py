"""Helpers shared by the query catalogue and its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meteoqc.sources.tables import OBS_SQL

DIGITS = 6
#: moves values off exact rounding ties, where two engines may legitimately disagree
NUDGE = 1e-9


def publish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Stable output: doubles rounded, times without zone."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c + NUDGE, digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def oracle(select: str, *ctes: str, doubles: list[str] | tuple[str, ...] = (), ints=(), digits: int = DIGITS,
           base: str = OBS_SQL) -> str:
    """Oracle text: shared CTEs, the query, and the same output rounding as ``publish``."""
    parts = ",\n".join([base, *ctes, f"result AS (\n{select}\n)"])
    swaps = [f"round({c} + 1e-9::DOUBLE, {digits}) + 0.0 AS {c}" for c in doubles] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    star = f"* REPLACE ({', '.join(swaps)})" if swaps else "*"
    return f"WITH {parts}\nSELECT {star} FROM result"


def replaced_observations(*ctes: str) -> str:
    """Base CTEs in which ``observations`` is redefined by ``ctes`` from ``raw_observations``."""
    return ",\n".join([OBS_SQL.replace("observations AS (", "raw_observations AS (").rstrip(), *ctes])
