"""Unit conversions and meteorological formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of kg m-2 s-1. Fixed values.
FLUX_UNITS = ("kg m-2 s-1", "kg m^-2 s^-1", "kg/m2/s")


def pr_to_mm_day(value: Column, units: Column, staging: bool = False) -> Column:
    """Precipitation flux to mm/day; other units are taken as they are. In staging, metres become mm."""
    u = F.lower(F.trim(units))
    out = F.when(u.isin(*FLUX_UNITS), value * 86400)
    return (out.when(u.isin("m", "metre", "meter", "metres", "meters"), value * 1000) if staging else out).otherwise(value)


def saturation_vapour_pressure(celsius: Column) -> Column:
    """Magnus, in hPa."""
    return 6.112 * F.exp(17.67 * celsius / (celsius + 243.5))


def clip(value: Column, low: float, high: float) -> Column:
    """value within bounds; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def relative_humidity(temperature: Column, dew_point: Column) -> Column:
    """Per cent, from temperatures in °C."""
    return clip(100 * saturation_vapour_pressure(dew_point) / saturation_vapour_pressure(temperature), 0.0, 100.0)


def wet_bulb_stull(celsius: Column, humidity: Column) -> Column:
    """Wet-bulb temperature in °C from °C and per cent (Stull 2011)."""
    rh = clip(humidity, 0.0, 100.0)
    return (
        celsius * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(celsius + rh) - F.atan(rh - 1.676331)
        + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035
    )


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def doy_noleap(date: Column) -> Column:
    """Day of the year on a calendar without Feb 29; Feb 29 itself has none."""
    leap = is_leap(F.year(date))
    feb29 = (F.month(date) == 2) & (F.dayofmonth(date) == 29)
    return F.when(~feb29, F.dayofyear(date) - F.when(leap & (F.month(date) > 2), 1).otherwise(0))


def not_feb29(date: Column) -> Column:
    return ~((F.month(date) == 2) & (F.dayofmonth(date) == 29))
