"""Small numeric helpers over columns and short arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steady_round(x: Column | str, digits: int) -> Column:
    """Rounding that does not depend on the last bit of a value lying exactly between two steps."""
    assert digits <= 6, "the nudge must stay below the last digit kept"
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + 1e-9, digits)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a))


def array_std(a: Column) -> Column:
    """Sample standard deviation, null below two values."""
    mean = array_mean(a)
    return F.when(F.size(a) > 1, F.sqrt(array_sum(F.transform(a, lambda x: (x - mean) * (x - mean))) / (F.size(a) - 1)))


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low) + F.get(s, high)) / 2.0)


def tail(a: Column, n: int) -> Column:
    """Last ``n`` elements."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def hash_bucket(buckets: int, *parts: Column) -> Column:
    """Reproducible bucket 0..buckets-1 from the MD5 of the parts, the same on any engine."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets
