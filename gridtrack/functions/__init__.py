"""Scalar formulas as Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6378.137


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in km of two points in degrees."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    root = F.sqrt(h)
    return 2 * EARTH_KM * F.asin(F.when(root > 1, 1.0).otherwise(root))  # null of a null


def cell_area(lat: Column, dlon: float, dlat: float) -> Column:
    """Area in km2 of a regular grid cell at a latitude."""
    return F.abs(F.lit(dlon * math.pi / 180 * 6378.1) * F.cos(F.radians(lat)) * F.lit(dlat * 111.32))


def theta(t: Column, p: Column) -> Column:
    """Potential temperature (K) from temperature (deg C below 100, else K) and pressure (hPa)."""
    return (t + F.when(t < 100, 273.15).otherwise(0.0)) * F.pow(F.lit(1000.0) / p, F.lit(0.286))


def theta_e(t: Column, q: Column, p: Column) -> Column:
    """Equivalent potential temperature (K) from deg C, specific humidity (kg/kg) and hPa."""
    k, moist = t + 273.15, F.greatest(F.lit(1e-10), q)
    vapour = 100.0 * p * moist / (0.622 + 0.378 * q)
    lcl = 2840.0 / (3.5 * F.log(k) - F.log(vapour) - 0.1998) + 55.0
    return k * F.pow(1000.0 / p, 0.2854 * (1.0 - 0.28 * q)) * F.exp((3.376 / lcl - 0.00254) * 1000.0 * moist * (1.0 + 0.81 * q))


def wind_direction(u: Column, v: Column) -> Column:
    """Direction the wind blows from, degrees clockwise from north; null without wind."""
    return F.when((u == 0) & (v == 0), None).otherwise(F.pmod(F.degrees(F.atan2(u, v)) + 180.0, F.lit(360.0)))


def mid_month_threshold(values: list[float], ts: Column) -> Column:
    """Twelve mid-month values interpolated linearly in time at a timestamp."""
    sec = ts.cast("double")
    month0 = F.date_trunc("month", ts)

    def middle(shift: int) -> Column:
        begin, end = F.add_months(month0, shift).cast("timestamp").cast("double"), F.add_months(month0, shift + 1).cast("timestamp").cast("double")
        return (begin + end) / 2

    arr = F.array(*[F.lit(float(v)) for v in values])
    m = F.month(ts)
    at = lambda shift: F.element_at(arr, (F.pmod(m + (shift - 1), F.lit(12)) + 1).cast("int"))
    before = sec < middle(0)
    t0, t1 = F.when(before, middle(-1)).otherwise(middle(0)), F.when(before, middle(0)).otherwise(middle(1))
    v0, v1 = F.when(before, at(-1)).otherwise(at(0)), F.when(before, at(0)).otherwise(at(1))
    return v0 + (v1 - v0) * (sec - t0) / (t1 - t0)
