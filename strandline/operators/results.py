"""Result tables: long rows, wide rows, and the work that is still to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("danz1d", "danz2d", "eppinga", "gastner")


def to_wide(rows: DataFrame, keys, metrics: list[str]) -> DataFrame:
    """One row per key with a column for each metric of (keys, metric, value); the list of metrics is explicit."""
    return rows.groupBy(*keys).pivot("metric", metrics).agg(F.max("value"))


def to_long(rows: DataFrame, keys, prefix: str = "") -> DataFrame:
    """keys, metric, value of every other column, its name behind the prefix."""
    values = [c for c in rows.columns if c not in keys]
    renamed = rows.select(*keys, *(F.col(c).cast("double").alias(f"{prefix}{c}") for c in values))
    return renamed.unpivot(list(keys), [f"{prefix}{c}" for c in values], "metric", "value")


def merged(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Long rows of both; where both have a metric of a key, the new value."""
    by = [*keys, "metric"]
    return old.join(new, by, "left_anti").unionByName(new)


def pending(work: DataFrame, log: DataFrame, current: int, keys=("tid", "nb", "migtype", "method")) -> DataFrame:
    """Work items that the log lacks, or has of an older version only."""
    return work.join(log.where(F.col("version") >= current), list(keys), "left_anti")


def work_items(transects: DataFrame, windows=(64, 32), migtypes=("AllMigration", "OnlyGoodMigration"), methods=METHODS) -> DataFrame:
    """Every method for every transect, window and variant."""
    every = lambda values: F.explode(F.array(*map(F.lit, values)))
    return transects.select("tid", every(windows).alias("nb")).withColumn("migtype", every(migtypes)).withColumn("method", every(methods))


def prevalence(cells: DataFrame, keys=("tid",), n_cells: int = 3200) -> DataFrame:
    """Shares of both types, of their common border, and how densely its cells are packed."""
    from .grid import QUEEN, abutting, shifted

    k = list(keys)
    share = cells.groupBy(*k).agg((F.count("veg1") / float(n_cells)).alias("p1"), (F.count("veg2") / float(n_cells)).alias("p2"))
    border = abutting(cells, keys=keys)
    buffered = shifted(border, QUEEN, keys).select(*k, "r", "c").union(border.select(*k, "r", "c")).distinct().join(cells.select(*k, "r", "c"), [*k, "r", "c"], "left_semi")
    n, m = border.groupBy(*k).agg(F.count("*").alias("n_border")), buffered.groupBy(*k).agg(F.count("*").alias("n_buffer"))
    return share.join(n, k, "left").join(m, k, "left").withColumn("packing", F.col("n_buffer") / F.col("n_border"))
