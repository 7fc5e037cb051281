"""Candidate transect lines from search points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import angle_difference
from .grid import crop
from .profile import islands


def highest_in_window(cells: DataFrame, points: DataFrame, n: int, value: str = "elev", keys=("tid",)) -> DataFrame:
    """keys, r0, c0, r1, c1, top: the highest cell of the window around each point; ties to the smaller row, then column."""
    near = crop(cells, points, n, keys)
    best = F.max(F.struct(value, (-F.col("r")).alias("r"), (-F.col("c")).alias("c")))
    return near.groupBy(*keys, "r0", "c0").agg(best.alias("b")).select(*keys, "r0", "c0", (-F.col("b.r")).alias("r1"), (-F.col("b.c")).alias("c1"), F.col(f"b.{value}").alias("top"))


def steepest_slope(cells: DataFrame, points: DataFrame, nearest: float, farthest: float, value: str = "elev", keys=("tid",), res_m: float = 30.0) -> DataFrame:
    """The cell of the greatest absolute rise per metre between nearest and farthest cells away; ties to the nearer one."""
    k = list(keys)
    own = points.join(cells.select(*k, F.col("r").alias("r0"), F.col("c").alias("c0"), F.col(value).alias("z0")), [*k, "r0", "c0"])
    near = crop(cells, own, 2 * math.ceil(farthest) + 1, keys).withColumn("d", F.hypot(F.col("r") - F.col("r0"), F.col("c") - F.col("c0"))).where(F.col("d").between(nearest, farthest))
    near = near.withColumn("slope", F.round(F.abs(F.col(value) - F.col("z0")) / (F.col("d") * res_m), 9))
    w = Window.partitionBy(*k, "r0", "c0").orderBy(F.desc("slope"), "d", "r", "c")
    return near.withColumn("place", F.row_number().over(w)).where("place = 1").select(*k, "r0", "c0", F.col("r").alias("r1"), F.col("c").alias("c1"), "slope", F.round(F.col("d") * res_m, 6).alias("dist_m"))


def line_cells(lines: DataFrame, keys=("tid", "line_id")) -> DataFrame:
    """Cells along lines from (r0, c0) to (r1, c1), one per step of the longer side: keys, i, r, c."""
    n = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")))
    along = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))))
    part = F.col("i") / F.greatest(F.col("n"), F.lit(1)).cast("double")
    place = lambda a, b: F.floor(F.col(a) + part * (F.col(b) - F.col(a)) + 0.5).cast("int")
    return along.select(*keys, "i", place("r0", "r1").alias("r"), place("c0", "c1").alias("c"))


def homogeneous_lines(cells: DataFrame, starts: DataFrame, half_length: int, max_turn: float, min_cells: int, keys=("tid",)) -> DataFrame:
    """keys, line_id, i_from, i_to, n: of the line through each start along its aspect, the longest run of cells whose
    aspect turns from the start's by less than max_turn, if it has at least min_cells."""
    k = list(keys)
    from_up = starts.join(cells.select(*k, "r", "c", "aspect"), [*k, "r", "c"]).where("aspect is not null")
    dr, dc = -F.cos("aspect") * half_length, F.sin("aspect") * half_length
    lines = from_up.select(*k, "line_id", F.col("aspect").alias("a0"), (F.col("r") - dr).alias("r0"), (F.col("c") - dc).alias("c0"), (F.col("r") + dr).alias("r1"), (F.col("c") + dc).alias("c1"))
    n = F.lit(2 * half_length)
    along = lines.withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    place = lambda a, b: F.floor(F.round(F.col(a) + F.col("i") / n * (F.col(b) - F.col(a)), 6) + 0.5).cast("int")
    on = along.select(*k, "line_id", "i", "a0", place("r0", "r1").alias("r"), place("c0", "c1").alias("c")).join(cells.select(*k, "r", "c", "aspect"), [*k, "r", "c"])
    alike = on.where(F.abs(angle_difference(F.col("aspect"), F.col("a0"))) < max_turn)
    runs = islands(alike, (*keys, "line_id"), "i")
    w = Window.partitionBy(*k, "line_id").orderBy(F.desc("n"), "a")
    return runs.withColumn("place", F.row_number().over(w)).where(f"place = 1 and n >= {min_cells}").select(*k, "line_id", F.col("a").alias("i_from"), F.col("b").alias("i_to"), "n")
