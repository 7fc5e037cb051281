"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def sigmoidal(x: Column, centre, slope) -> Column:
    return 1 / (1 + F.exp(-slope * (x - centre)))


def sigmoidal_inverse(y: Column, centre, slope) -> Column:
    return centre - F.log(1 / y - 1) / slope


def heaviside(x: Column, at_zero: float = 0.0) -> Column:
    if at_zero not in (0, 0.5, 1):
        raise ValueError("at zero the step is 0, 0.5 or 1")
    return F.when(x < 0, 0.0).when(x > 0, 1.0).when(x == 0, float(at_zero))


def signed_log(x: Column) -> Column:
    """sign(x) * ln(1 + |x|)."""
    return F.signum(x) * F.log1p(F.abs(x))


def signed_exp(y: Column) -> Column:
    """The inverse of signed_log."""
    return F.signum(y) * F.expm1(F.abs(y))


#: A rational Chebyshev fit of erfc, within 1.2e-7 (Numerical Recipes).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erf(x: Column) -> Column:
    """The error function, within 1.2e-7."""
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, 1 - tail).otherwise(tail - 1)


def erf_of(x: float) -> float:
    """erf of a number."""
    t, poly = 1 / (1 + 0.5 * abs(x)), ERFC[-1]
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    tail = t * math.exp(-x * x + poly)
    return 1 - tail if x >= 0 else tail - 1


def wrap(angle: Column, period: float = TWO_PI) -> Column:
    """Into [0, period)."""
    return F.pmod(angle, F.lit(float(period)))


def angle_difference(a: Column, b: Column) -> Column:
    """The signed smallest turn from b to a, in [-pi, pi)."""
    return wrap(a - b + math.pi) - math.pi


def circular_sum(a: Column, b: Column, period: float = TWO_PI) -> Column:
    return wrap(a + b, period)


def zero_if_tiny(angle: Column, tolerance: float = 1e-8) -> Column:
    """Angles within tolerance of 0 or of a full turn are 0."""
    return F.when((F.abs(angle) < tolerance) | (F.abs(angle - TWO_PI) < tolerance), 0.0).otherwise(angle)


def from_unit(x: Column, low, high) -> Column:
    return x * (high - low) + low


def to_unit(y: Column, low, high) -> Column:
    return (y - low) / (high - low)


def rotate(x: Column, y: Column, angle: Column, x0=0.0, y0=0.0) -> tuple[Column, Column]:
    """Counter-clockwise around (x0, y0)."""
    dx, dy = x - x0, y - y0
    return x0 + dx * F.cos(angle) - dy * F.sin(angle), y0 + dx * F.sin(angle) + dy * F.cos(angle)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius_m: float = 6378137.0) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius_m * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing from north, -180 to 180."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))


def padded_flag(i: Column, n: int) -> Column:
    """A task's number with leading zeros, as wide as the largest."""
    return F.lpad(i.cast("string"), len(str(n)), "0")


def hours_between(begin: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", begin, end) / 3.6e9


def time_label(at: Column) -> Column:
    """A time as text that sorts like it and may stand in a file's name: 20240131-235959."""
    return F.date_format(at, "yyyyMMdd-HHmmss")
