"""Aggregate functions as Column expressions, and the majority class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scalars import wrap


def circular_mean(angle: Column, period: float = 2 * math.pi, legacy_shift: bool = False) -> Column:
    """The direction of the mean vector, in [0, period); legacy_shift gives it in [1, period + 1) instead."""
    k = 2 * math.pi / period
    mean = wrap(F.atan2(F.sum(F.sin(angle * k)), F.sum(F.cos(angle * k))) / k, period)
    return wrap(mean - 1, period) + 1 if legacy_shift else mean


def resultant(angle: Column, period: float = 2 * math.pi) -> Column:
    k = 2 * math.pi / period
    return F.least(F.lit(1.0), F.sqrt(F.pow(F.sum(F.cos(angle * k)), 2) + F.pow(F.sum(F.sin(angle * k)), 2)) / F.count(angle))


def circular_sd(angle: Column, period: float = 2 * math.pi) -> Column:
    """sqrt(-2 ln R) in units of the period: 0 where all are equal, null for fewer than two."""
    k = 2 * math.pi / period
    return F.when(F.count(angle) < 2, None).when(F.stddev_samp(angle) == 0, 0.0).otherwise(F.sqrt(-2 * F.log(resultant(angle, period))) / k)


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def q95_abs(x: Column) -> Column:
    return F.percentile(F.abs(x), 0.95)


def max_abs(x: Column) -> Column:
    return F.max(F.abs(x))


def is_binary(x: Column) -> Column:
    return F.countDistinct(x) == 2


def mean_difference(a: Column, b: Column) -> Column:
    return F.avg(a - b)


def circular_range(rows: DataFrame, keys, angle: str, period: float = 2 * math.pi) -> DataFrame:
    """keys, circ_range: the shortest arc that holds all angles."""
    w = Window.partitionBy(*keys).orderBy("a")
    ordered = rows.where(F.col(angle).isNotNull()).select(*keys, wrap(F.col(angle), period).alias("a")).withColumn("gap", F.col("a") - F.lag("a").over(w))
    around = period - (F.max("a") - F.min("a"))
    return ordered.groupBy(*keys).agg((period - F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), around)).alias("circ_range"))


def majority(rows: DataFrame, keys, value: str, skip_null: bool = False, all_ties: bool = False) -> DataFrame:
    """keys, value, n: the most frequent value of each group.

    Nulls count as a value unless skipped.  Of ties the smallest value is taken, a null last, or all of them.
    """
    counted = rows.where(F.col(value).isNotNull()) if skip_null else rows
    counted = counted.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), *(() if all_ties else (F.asc_nulls_last(value),)))
    place = (F.rank() if all_ties else F.row_number()).over(w)
    return counted.withColumn("place", place).where("place = 1").select(*keys, value, "n")
