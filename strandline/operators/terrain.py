"""Moving windows: slope, aspect, flow directions, curvature, kernels, circular statistics by prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Direction codes of the eight neighbours as (row step, column step), rows counted downwards, clockwise from the right.
FLOW_CODES = {(0, 1): 1, (1, 1): 2, (1, 0): 4, (1, -1): 8, (0, -1): 16, (-1, -1): 32, (-1, 0): 64, (-1, 1): 128}


def neighbourhood(cells: DataFrame, value: str = "elev", keys=("tid",)) -> DataFrame:
    """keys, r, c and z11 .. z33: the 3 by 3 cells around each cell of a complete grid; null beyond its border.

    Two passes of lag and lead, along rows and along columns, so that there is no join.
    """
    across, down = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    row = cells.select(*keys, "r", "c", F.lag(value).over(across).alias("a1"), F.col(value).alias("a2"), F.lead(value).over(across).alias("a3"))
    return row.select(*keys, "r", "c", *(f(f"a{j}").over(down).alias(f"z{i}{j}") for i, f in ((1, F.lag), (3, F.lead)) for j in (1, 2, 3)), *(F.col(f"a{j}").alias(f"z2{j}") for j in (1, 2, 3)))


def slope_aspect(cells: DataFrame, value: str = "elev", keys=("tid",), res_m: float = 30.0, min_slope: float = 0.0) -> DataFrame:
    """keys, r, c, slope, aspect: eight-neighbour slope and down-slope direction clockwise from north, in radians.

    Border cells have neither; aspect is null where the slope is less than min_slope.
    """
    z = neighbourhood(cells, value, keys)
    dx = (F.expr("z13 + 2 * z23 + z33") - F.expr("z11 + 2 * z21 + z31")) / (8.0 * res_m)
    dy = (F.expr("z31 + 2 * z32 + z33") - F.expr("z11 + 2 * z12 + z13")) / (8.0 * res_m)
    z = z.withColumns({"dx": dx, "dy": dy}).withColumn("slope", F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))
    aspect = F.pmod(F.atan2(-F.col("dx"), F.col("dy")), F.lit(2 * math.pi))
    return z.select(*keys, "r", "c", "slope", F.when(F.col("slope") >= min_slope, aspect).alias("aspect"))


def band_aspect(cells: DataFrame, azimuth: float, min_slope: float, value: str = "elev", keys=("tid",), res_m: float = 30.0) -> DataFrame:
    """keys, r, c, slope, aspect of a band: cells that are flatter than min_slope face the band's azimuth; border cells have none."""
    found = slope_aspect(cells, value, keys, res_m)
    return found.withColumn("aspect", F.when(F.col("slope") > min_slope, F.col("aspect")).when(F.col("slope").isNotNull(), azimuth))


def tangential_curvature(cells: DataFrame, value: str = "elev", keys=("tid",), res_m: float = 30.0) -> DataFrame:
    """keys, r, c, curvature: Zevenbergen and Thorne's quadratic surface, across the slope; 0 on level ground."""
    z = neighbourhood(cells, value, keys)
    d = F.expr("(z21 + z23) / 2 - z22") / (res_m * res_m)
    e = F.expr("(z12 + z32) / 2 - z22") / (res_m * res_m)
    f = F.expr("-z11 + z13 + z31 - z33") / (4 * res_m * res_m)
    g, h = F.expr("-z21 + z23") / (2 * res_m), F.expr("z12 - z32") / (2 * res_m)
    z = z.withColumns({"p_xx": d, "p_yy": e, "p_xy": f, "p_x": g, "p_y": h}).withColumn("s2", F.expr("p_x * p_x + p_y * p_y"))
    return z.where("z11 is not null and z13 is not null and z31 is not null and z33 is not null").select(*keys, "r", "c", F.expr("case when s2 = 0 then 0.0D else -2 * (p_xx * p_y * p_y + p_yy * p_x * p_x - p_xy * p_x * p_y) / s2 end").alias("curvature"))


def flow_direction(cells: DataFrame, value: str = "elev", keys=("tid",), uphill: bool = False) -> DataFrame:
    """keys, r, c, code: the neighbour of the steepest drop, or uphill of the smallest rise; ties go to the smaller code.

    The grid is complete, as for neighbourhood().  Cells that nothing lies below (above) have no row.
    """
    z = neighbourhood(cells, value, keys)
    own = F.col("z22")
    ways = []
    for (dr, dc), code in FLOW_CODES.items():
        theirs = F.col(f"z{dr + 2}{dc + 2}")
        score = own - theirs if uphill else (own - theirs) / F.sqrt(F.lit(float(dr * dr + dc * dc)))
        ways.append(F.when(theirs > own if uphill else theirs < own, F.struct(score.alias("score"), F.lit(-code).alias("k"))))
    return z.select(*keys, "r", "c", F.greatest(*ways).alias("best")).where("best is not null").select(*keys, "r", "c", (-F.col("best.k")).alias("code"))


def inverse_distance_kernel(radius: float) -> list[tuple[int, int, float]]:
    """(dr, dc, weight) of the cells within radius: weights fall with distance and add up to 1; the centre has none."""
    n = int(radius)
    raw = [(a, b, 1 / math.hypot(a, b)) for a in range(-n, n + 1) for b in range(-n, n + 1) if 0 < math.hypot(a, b) <= radius]
    total = sum(w for *_, w in raw)
    return [(a, b, w / total) for a, b, w in raw]


def kernel_focal(cells: DataFrame, kernel: list[tuple[int, int, float]], value: str = "v", keys=("tid",)) -> DataFrame:
    """keys, r, c, focal: the weighted sum of the neighbours that there are."""
    weights = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(w).alias("w")) for a, b, w in kernel))).alias("k")
    given = cells.where(F.col(value).isNotNull()).select(*keys, F.col("r").alias("r0"), F.col("c").alias("c0"), F.col(value).alias("x"), weights)
    spread = given.select(*keys, (F.col("r0") - F.col("k.dr")).alias("r"), (F.col("c0") - F.col("k.dc")).alias("c"), (F.col("x") * F.col("k.w")).alias("part"))
    return cells.select(*keys, "r", "c").join(spread.groupBy(*keys, "r", "c").agg(F.sum("part").alias("focal")), [*keys, "r", "c"])


def focal_circular(cells: DataFrame, angle: Column, window: int, keys=("tid",)) -> DataFrame:
    """keys, r, c, n, focal_mean, focal_sd of the angles in the window of odd size (even ones are raised) around each cell.

    The grid is complete: a cell without an angle has a null one.  Running sums of sine, cosine and count along rows, then
    along columns; a window's sum is the running sum at its end less that before its begin, two look-ups by place.  The
    cost of a cell doesn't depend on the window's size.  Sums are of 64-bit integers, units of 2^-32: they are exact
    differences, where sums of doubles would lose the small ones.  Windows without any angle have no mean.
    """
    half = (window + 1 - window % 2) // 2
    fixed = lambda x: F.round(F.coalesce(x, F.lit(0.0)) * float(1 << 32), 0).cast("long")
    out = cells.select(*keys, "r", "c", fixed(F.sin(angle)).alias("s"), fixed(F.cos(angle)).alias("k"), F.when(angle.isNotNull(), 1).otherwise(0).cast("long").alias("n"))
    for line, along in (("r", "c"), ("c", "r")):
        w = Window.partitionBy(*keys, line).orderBy(along)
        out = out.select(*keys, "r", "c", *(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(x) for x in ("s", "k", "n")))
        upto = lambda x: F.coalesce(F.lead(x, half).over(w), F.last(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        out = out.select(*keys, "r", "c", *((upto(x) - F.coalesce(F.lag(x, half + 1).over(w), F.lit(0))).alias(x) for x in ("s", "k", "n")))  # noqa: B023
    s, k = F.col("s") / float(1 << 32), F.col("k") / float(1 << 32)
    length = F.least(F.lit(1.0), F.sqrt(s * s + k * k) / F.nullif("n", F.lit(0)))
    mean = F.when(F.col("n") > 0, F.pmod(F.atan2(s, k), F.lit(2 * math.pi)))
    return out.select(*keys, "r", "c", "n", mean.alias("focal_mean"), F.sqrt(-2 * F.log(length)).alias("focal_sd"))
