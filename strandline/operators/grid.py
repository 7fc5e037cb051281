"""Cell-wise operators: reclassify, crop, mask, overlay, neighbours, rasterise, rotate."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.aggregates import majority

ROOK = ((0, 1), (0, -1), (1, 0), (-1, 0))
QUEEN = (*ROOK, (1, 1), (1, -1), (-1, 1), (-1, -1))


def to_na1(value: Column, ids) -> Column:
    return F.when(value.isin(*ids), 1)


def na1_to_01(value: Column, tolerance: float = 1e-8) -> Column:
    return F.when(F.abs(value - 1) < tolerance, 1).otherwise(0)


def rows_of(cells: DataFrame, value: str, exclude=(None,)) -> DataFrame:
    """Cells as rows without those whose value is excluded: None is a null, a pair a closed range, else the value itself."""
    x = F.col(value)
    for e in exclude:
        out = x.isNull() if e is None else x.between(*e) if isinstance(e, tuple) else x == F.lit(e)
        cells = cells.where(~F.coalesce(out, F.lit(False)))
    return cells


def crop(cells: DataFrame, points: DataFrame, n: int, keys=("tid",)) -> DataFrame:
    """Cells of the window of n by n cells around each point (keys, r0, c0), clamped by the grid itself."""
    half = round((n - 1) / 2)
    inside = F.col("r").between(F.col("r0") - half, F.col("r0") + half) & F.col("c").between(F.col("c0") - half, F.col("c0") + half)
    return cells.join(points, list(keys)).where(inside)


def mask(cells: DataFrame, by: DataFrame, keys=("tid", "r", "c")) -> DataFrame:
    return cells.join(by.select(*keys), list(keys), "left_semi")


def shifted(cells: DataFrame, offsets, keys=("tid",), columns=()) -> DataFrame:
    """A row for each cell and neighbour place (dr, dc): keys, r, c of the place, from_r, from_c, dr, dc and columns."""
    columns = [F.col(x) if isinstance(x, str) else x for x in columns]
    names = cells.select(*columns).columns if columns else []
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets))).alias("step")
    return cells.select(*keys, F.col("r").alias("from_r"), F.col("c").alias("from_c"), *columns, steps).select(
        *keys, (F.col("from_r") + F.col("step.dr")).alias("r"), (F.col("from_c") + F.col("step.dc")).alias("c"), "from_r", "from_c", F.col("step.dr").alias("dr"), F.col("step.dc").alias("dc"), *names
    )


def abutting(cells: DataFrame, a: str = "veg1", b: str = "veg2", keys=("tid",)) -> DataFrame:
    """Cells of one type that have a rook neighbour of the other: keys, r, c; two window passes and no join.

    Places are distinct; those that the grid lacks are nobody's neighbour.
    """
    across, down = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    flags = cells.select(*keys, "r", "c", F.coalesce(F.col(a) == 1, F.lit(False)).alias("a"), F.coalesce(F.col(b) == 1, F.lit(False)).alias("b"))
    near = lambda x: reduce(or_, (F.coalesce(f(x).over(w), F.lit(False)) & (f(along).over(w) == F.col(along) + step) for w, along in ((across, "c"), (down, "r")) for f, step in ((F.lag, -1), (F.lead, 1))))
    seen = flags.select("*", near("a").alias("near_a"), near("b").alias("near_b"))
    return seen.where("(a and near_b) or (b and near_a)").select(*keys, "r", "c")


def rasterise(points: DataFrame, keys=("r", "c"), value: str = "value", cls: str = "class") -> DataFrame:
    """Points to cells: mean value and majority class."""
    means = points.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n_points"))
    return means.join(majority(points, keys, cls, skip_null=True).drop("n"), list(keys), "left")


def rotate_band(cells: DataFrame, angle: float, subcells: int = 2, keys=("tid",), value: str = "v", cls: str = "veg_class") -> DataFrame:
    """Cells on a lattice rotated about the corner by -angle: each is cut into subcells^2 points, which are rotated and
    gathered again; the new cell has the mean value and the majority class of its points."""
    import math

    half = [(i + 0.5) / subcells for i in range(subcells)]
    points = F.explode(F.array(*(F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a in half for b in half)))
    cos, sin = math.cos(-angle), math.sin(-angle)
    cut = cells.withColumn("p", points).withColumns({"y": F.col("r") - 1 + F.col("p.y"), "x": F.col("c") - 1 + F.col("p.x")})
    new = cut.withColumns({"r": (F.floor(F.col("x") * sin + F.col("y") * cos) + 1).cast("int"), "c": (F.floor(F.col("x") * cos - F.col("y") * sin) + 1).cast("int")})
    by = [*keys, "r", "c"]
    means = new.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n_points"))
    return means.join(majority(new, by, cls).drop("n"), by)


def long_table(cells: DataFrame, x: str, y: str, keys=("tid",), drop_null: bool = True) -> DataFrame:
    """x, y, cols, rows of every cell; without those where either is null."""
    out = cells.select(*keys, F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col("c").alias("cols"), F.col("r").alias("rows"))
    return out.dropna(subset=["x", "y"]) if drop_null else out
