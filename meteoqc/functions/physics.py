"""Thermodynamic and barometric relations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meteoqc.schema import BOUNDS, DEW, RH, SLP, STNP, TEMP

# --- fixed values -------------------------------------------------------------
MAGNUS_A = 17.625
MAGNUS_B = 243.04
MAGNUS_C = 6.1078
GRAVITY = 9.80665
MOLAR_MASS_AIR = 0.0289644
GAS_CONSTANT = 8.31447
LAPSE_RATE = 0.0065
KELVIN = 273.15
STANDARD_TEMP_C = 15.0
STANDARD_TEMP_K = 288.15
# --- end of fixed values ------------------------------------------------------

BAROMETRIC_EXPONENT = (GRAVITY * MOLAR_MASS_AIR) / (GAS_CONSTANT * LAPSE_RATE)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NaN and infinities are missing values; everything downstream relies on NULL."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def saturation_vapour_pressure(temp: Column | str) -> Column:
    t = _c(temp)
    return MAGNUS_C * F.exp(MAGNUS_A * t / (MAGNUS_B + t))


def relative_humidity(temp: Column | str, dew: Column | str, clamp: bool = True) -> Column:
    """RH from temperature and dew point, null outside the range of the Magnus formula."""
    t, d = finite(temp), finite(dew)
    raw = 100.0 * F.exp(MAGNUS_A * d / (MAGNUS_B + d) - MAGNUS_A * t / (MAGNUS_B + t))
    low, high = BOUNDS[RH]
    value = F.round(raw, 2)
    if clamp:
        value = F.when(raw < low, low).when(raw > high, high).otherwise(value)
    return F.when(t.between(-80.0, 80.0) & d.between(-90.0, 60.0), value)


def _barometric_factor(elevation: Column, temp: Column) -> Column:
    kelvin = F.coalesce(temp, F.lit(STANDARD_TEMP_C)) + KELVIN
    kelvin = F.when(kelvin <= 0, STANDARD_TEMP_K).otherwise(kelvin)
    base = 1.0 - LAPSE_RATE * elevation / kelvin
    return F.when(base > 0, F.pow(base, F.lit(BAROMETRIC_EXPONENT)))


def station_pressure(slp: Column | str, elevation: Column | str, temp: Column | str) -> Column:
    return F.round(_c(slp) * _barometric_factor(_c(elevation), _c(temp)), 2)


def sea_level_pressure(stnp: Column | str, elevation: Column | str, temp: Column | str) -> Column:
    return F.round(_c(stnp) / _barometric_factor(_c(elevation), _c(temp)), 2)


def filled_slp(slp=SLP, stnp=STNP, elevation="elevation_m", temp=TEMP) -> Column:
    """Sea-level pressure, derived from station pressure when missing and T is known."""
    return F.coalesce(_c(slp), F.when(_c(temp).isNotNull(), sea_level_pressure(stnp, elevation, temp)))


def humidity_consistency(temp=TEMP, dew=DEW, rh=RH, tolerance: float = 5.0) -> Column:
    """struct(ok, reason): dew point above air temperature, or RH that T and Td do not support."""
    t, d, h = _c(temp), _c(dew), _c(rh)
    derived = relative_humidity(t, d)
    above = F.coalesce(d > t + 0.2, F.lit(False))
    diverges = F.coalesce(F.abs(derived - h) > tolerance, F.lit(False))
    reason = F.when(above, F.lit("DEW_POINT_ABOVE_TEMPERATURE")).when(diverges, F.lit("RH_DIVERGES_FROM_DEW_POINT"))
    return F.struct((~(above | diverges)).alias("ok"), reason.alias("reason"))


def joint_violations(temp=TEMP, dew=DEW, rh=RH, slp=SLP, stnp=STNP, elevation="elevation_m",
                     humidity_tolerance: float = 15.0, pressure_tolerance: float = 6.0) -> Column:
    """Array of violation codes of one joint state (bounds, humidity trio, two pressures)."""
    def outside(value, name):
        low, high = BOUNDS[name]
        return (_c(value) < low) | (_c(value) > high)

    expected = station_pressure(slp, elevation, temp)
    trio = humidity_consistency(temp, dew, rh, humidity_tolerance)
    checks = [
        (outside(temp, TEMP), "TEMPERATURE_OUT_OF_BOUNDS"),
        (outside(rh, RH), "HUMIDITY_OUT_OF_BOUNDS"),
        (outside(slp, SLP), "PRESSURE_OUT_OF_BOUNDS"),
        (~trio["ok"], "HUMIDITY_TRIO_INCONSISTENT"),
        (F.abs(expected - _c(stnp)) > pressure_tolerance, "PRESSURE_PAIR_INCONSISTENT"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in checks]))
