"""Threshold and z-score detectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meteoqc.schema import RH, SLP, TEMP

# --- fixed values: (low, high, scale) per variable ----------------------------
THRESHOLDS = {TEMP: (-50.0, 60.0, 10.0), RH: (0.0, 100.0, 20.0), SLP: (500.0, 1080.0, 50.0)}
MAX_RATE_PER_5MIN = 5.0
RATE_SCALE = 5.0
# --- end of fixed values ------------------------------------------------------


def _clip(x: Column) -> Column:
    """Into 0..1, missing as 0 (``least`` and ``greatest`` skip nulls, so it must be explicit)."""
    return F.when(x.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def threshold_score(rate_5min: Column | None = None) -> Column:
    """Degree of the worst violation, 0..1; missing values violate nothing."""
    parts = []
    for c, (low, high, scale) in THRESHOLDS.items():
        beyond = F.greatest(F.lit(0.0), low - F.col(c)) + F.greatest(F.lit(0.0), F.col(c) - high)
        parts.append(F.when(F.col(c).isNotNull(), _clip(beyond / scale)).otherwise(0.0))
    if rate_5min is not None:
        parts.append(_clip((F.abs(rate_5min) - MAX_RATE_PER_5MIN) / RATE_SCALE))
    return F.greatest(*parts)


def max_abs_z(ref: str = "1h") -> Column:
    return F.greatest(*[F.coalesce(F.abs(F.col(f"{c}_zscore_{ref}")), F.lit(0.0)) for c in (TEMP, RH, SLP)])


def zscore_score(ref: str = "1h") -> Column:
    return F.tanh(max_abs_z(ref) / 3.0)
