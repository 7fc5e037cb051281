"""Measures below, within and above an interaction zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Zones by the columns of an interval [start, end]; border columns belong to both zones that they part, for locations.
ZONES = {"below": "c <= start", "within": "c between start and end", "above": "c >= end"}


def zone_location(profile: DataFrame, zone: DataFrame, keys=("tid",), res_m: float = 30.0) -> DataFrame:
    """profile: keys, c, elev, d1, d2, abut; zone: keys, start, end. Width, elevations, slope, roughness, and mean and sd below, within, above."""
    k = list(keys)
    w = Window.partitionBy(*k).orderBy("c")
    rows = profile.join(zone, k).withColumn("gain", F.abs(F.col("elev") - F.lag("elev").over(w)))
    inside = F.expr(ZONES["within"])
    step = F.when(F.expr("c > start and c <= end"), F.col("gain"))
    stats = [f(F.when(F.expr(cond), F.col(x))).alias(f"{name}_{z}_{x}") for z, cond in ZONES.items() for x in ("d1", "d2", "abut") for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    out = rows.groupBy(*k, "start", "end").agg(
        F.min(F.when(inside, F.col("elev"))).alias("elev_min"), F.max(F.when(inside, F.col("elev"))).alias("elev_max"), F.max(F.when(F.expr("c = start"), F.col("elev"))).alias("elev_start"),
        F.max(F.when(F.expr("c = end"), F.col("elev"))).alias("elev_end"), F.coalesce(F.sum(step), F.lit(0.0)).alias("gain_total"), F.count(F.when(F.expr("c < start"), 1)).alias("n_below"), F.count(F.when(F.expr("c > end"), 1)).alias("n_above"), F.count("*").alias("n"), *stats,
    )
    width = (F.col("end") - F.col("start")) * res_m
    rise = F.abs(F.col("elev_end") - F.col("elev_start"))
    return out.withColumns({
        "width_m": width, "slope_mpm": rise / F.nullif(width, F.lit(0.0)), "slope_deg": F.degrees(F.atan(rise / F.nullif(width, F.lit(0.0)))), "roughness_mpm": (F.col("gain_total") - rise) / F.nullif(width, F.lit(0.0)),
        "fraction_below": F.col("n_below") / F.col("n"), "fraction_above": F.col("n_above") / F.col("n"),
    }).drop("n_below", "n_above", "n")


def zone_patches(labelled: DataFrame, zone: DataFrame, keys=("tid",), res_m: float = 30.0, classes_m2: tuple[float, float] = (1e4, 1e6)) -> DataFrame:
    """Per zone (without overlap): number of patches, median of their whole sizes, and numbers in three area classes."""
    k = list(keys)
    size = labelled.groupBy(*k, "patch_id").agg((F.count("*") * (res_m * res_m)).alias("area_m2"))
    place = F.when(F.expr("c < start"), "below").when(F.expr("c > end"), "above").otherwise("within")
    touched = labelled.join(zone, k).select(*k, "patch_id", place.alias("zone")).distinct().join(size, [*k, "patch_id"])
    a, b = classes_m2
    return touched.groupBy(*k, "zone").agg(
        F.count("*").alias("n_patches"), F.percentile("area_m2", 0.5).alias("median_area_m2"), F.count(F.when(F.col("area_m2") <= a, 1)).alias("n_small"), F.count(F.when((F.col("area_m2") > a) & (F.col("area_m2") <= b), 1)).alias("n_middle"), F.count(F.when(F.col("area_m2") > b, 1)).alias("n_large"),
    )


def homogeneity(aspects: DataFrame, azimuth: float, keys=("tid",)) -> DataFrame:
    """How far aspects turn from the azimuth: RMSE and 95 percent of the absolute turn, of cells and of column means, and the mean turn."""
    from ..functions.aggregates import circular_mean, q95_abs, rms
    from ..functions.scalars import angle_difference

    k = list(keys)
    turn = angle_difference(F.col("aspect"), F.lit(azimuth))
    cells = aspects.where("aspect is not null").withColumn("turn", turn)
    by_cell = cells.groupBy(*k).agg(rms(F.col("turn")).alias("cell_rmse"), q95_abs(F.col("turn")).alias("cell_q95"), F.avg("turn").alias("mean_turn"))
    columns = cells.groupBy(*k, "c").agg(circular_mean(F.col("aspect")).alias("m")).withColumn("t", angle_difference(F.col("m"), F.lit(azimuth)))
    return by_cell.join(columns.groupBy(*k).agg(rms(F.col("t")).alias("column_rmse"), q95_abs(F.col("t")).alias("column_q95")), k)


def deviating_patches(aspects: DataFrame, azimuth: float, n_cells: int, keys=("tid",)) -> DataFrame:
    """keys, dir, n_cells, n_patches, largest, fraction: of each cardinal direction (1 north to 4 west) other than the azimuth's.

    Cells of one direction form rook patches; largest and fraction are the shares of the band's n_cells that the largest
    patch and all of them have.  Cells without an aspect are in none; directions without cells have no row.
    """
    import math

    from ..functions.scalars import wrap
    from .grid import ROOK
    from .patches import patch_sizes, patches

    cardinal = lambda a: (1 + F.floor(wrap(a + math.pi / 4) / (math.pi / 2))).cast("int")
    held = aspects.where("aspect is not null").withColumn("dir", cardinal(F.col("aspect"))).where(F.col("dir") != cardinal(F.lit(azimuth)))
    sizes = patch_sizes(patches(held, "dir", ROOK, (*keys, "dir")), (*keys, "dir")).withColumnRenamed("n_cells", "n")
    return sizes.groupBy(*keys, "dir").agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_patches"), (F.max("n") / float(n_cells)).alias("largest"), (F.sum("n") / float(n_cells)).alias("fraction"))


def elevation_ratio(cells: DataFrame, keys=("tid",), res_m: float = 30.0, n_rows: int = 50) -> DataFrame:
    """The spread of elevation across each inner column, as a share of the rise that the band's mean slope makes over its width."""
    from ..functions.aggregates import max_abs, q95_abs, rms

    k = list(keys)
    columns = cells.groupBy(*k, "c").agg((F.max("elev") - F.min("elev")).alias("spread"), F.avg("elev").alias("m"))
    fit = columns.groupBy(*k).agg(F.abs(F.regr_slope("m", F.col("c") * res_m)).alias("slope"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    ratio = columns.join(fit, k).where("c > lo and c < hi and slope > 0").withColumn("ratio", F.col("spread") / (F.col("slope") * n_rows * res_m))
    return ratio.groupBy(*k).agg(rms(F.col("ratio")).alias("ratio_rms"), q95_abs(F.col("ratio")).alias("ratio_q95"), max_abs(F.col("ratio")).alias("ratio_max"))
