"""Candidate bands: the rectangle around a line, its place in the window, its cells turned and gathered again; extents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import to_na1

EXTENT = ("xmin", "ymin", "xmax", "ymax")


def extents(points: DataFrame, keys=("tid",), x: str = "x", y: str = "y") -> DataFrame:
    """keys, xmin, ymin, xmax, ymax of the points of each group."""
    return points.groupBy(*keys).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def grid_extents(cells: DataFrame, keys=("tid",)) -> DataFrame:
    """keys, xmin, ymin, xmax, ymax of the cells: cell (r, c) reaches from (c - 1, r - 1) to (c, r), rows counted downwards."""
    return cells.groupBy(*keys).agg((F.min("c") - 1.0).alias("xmin"), (F.min("r") - 1.0).alias("ymin"), F.max("c").cast("double").alias("xmax"), F.max("r").cast("double").alias("ymax"))


def extent_relations(a: DataFrame, b: DataFrame, keys=("tid",)) -> DataFrame:
    """keys, the union u_* and the intersection i_* of both extents (null where they are apart), whether a contains b.

    Extents that touch intersect in a line or a point.  Groups that only one side has are left out.
    """
    both = a.select(*keys, *(F.col(e).alias(f"a_{e}") for e in EXTENT)).join(b.select(*keys, *(F.col(e).alias(f"b_{e}") for e in EXTENT)), list(keys))
    pick = lambda f, e: f(f"a_{e}", f"b_{e}")
    low, high = ("xmin", "ymin"), ("xmax", "ymax")
    meet = (pick(F.greatest, "xmin") <= pick(F.least, "xmax")) & (pick(F.greatest, "ymin") <= pick(F.least, "ymax"))
    union = [pick(F.least if e in low else F.greatest, e).alias(f"u_{e}") for e in EXTENT]
    inner = [F.when(meet, pick(F.least if e in high else F.greatest, e)).alias(f"i_{e}") for e in EXTENT]
    inside = (F.col("a_xmin") <= F.col("b_xmin")) & (F.col("a_ymin") <= F.col("b_ymin")) & (F.col("a_xmax") >= F.col("b_xmax")) & (F.col("a_ymax") >= F.col("b_ymax"))
    return both.select(*keys, *union, *inner, inside.alias("contains"))


def band_rectangles(lines: DataFrame, width: float) -> DataFrame:
    """lines with their length, direction (ux, uy) and the extent of the rectangle of the width around each.

    Lines are (x0, y0) to (x1, y1) in cells.  The sides follow from one direction, so that they are parallel and at right
    angles for any line; lines without a length have no rectangle.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = lines.withColumn("length", F.sqrt(dx * dx + dy * dy)).where("length > 0").withColumns({"ux": dx / F.col("length"), "uy": dy / F.col("length")})
    half = width / 2
    aside = {"x": half * F.abs("uy"), "y": half * F.abs("ux")}
    low = {f"{e}min": F.least(f"{e}0", f"{e}1") - aside[e] for e in "xy"}
    return out.withColumns(low | {f"{e}max": F.greatest(f"{e}0", f"{e}1") + aside[e] for e in "xy"})


def candidate_band(cells: DataFrame, lines: DataFrame, width: int, subcells: int = 8, veg1=(1,), veg2=(2,), keys=("tid",), value: str = "elev", cls: str = "veg_class", res_m: float = 30.0) -> DataFrame:
    """keys, line_id, r, c, dist_m, mean_value, veg_class, veg1, veg2, n_points: the band of each line, turned so that the line runs along c.

    Cells are cut into subcells^2 points each; those in the rectangle are gathered into cells of the band, whose first
    column begins at (x0, y0) and whose rows are counted from the left of the line's direction on a map of rows downwards.
    Values are averaged, without nulls; classes go by majority, ties to the smallest, null last; veg1 and veg2 are 1 where
    the class is one of theirs.  Bands that aren't inside their grid have no rows, as are lines without length or grid.
    The last column is as wide as the line's length leaves it.

    Only cells within a cell's diagonal of the rectangle are cut; points are counted by cell and class before the shuffle.
    """
    k = list(keys)
    window = grid_extents(cells, keys).select(*k, *(F.col(e).alias(f"w_{e}") for e in EXTENT))
    inside = band_rectangles(lines, width).join(window, k).where("w_xmin <= xmin and w_ymin <= ymin and w_xmax >= xmax and w_ymax >= ymax")
    inside = inside.select(*k, "line_id", "x0", "y0", "length", "ux", "uy")
    half, reach = width / 2, 0.75

    def place(x, y):
        px, py = x - F.col("x0"), y - F.col("y0")
        return {"along": px * F.col("ux") + py * F.col("uy"), "across": py * F.col("ux") - px * F.col("uy") + half}

    near = cells.select(*k, "r", "c", F.col(value).cast("double").alias("value"), F.col(cls).alias("class")).join(inside, k).withColumns(place(F.col("c") - 0.5, F.col("r") - 0.5))
    near = near.where((F.col("along") >= -reach) & (F.col("along") <= F.col("length") + reach) & (F.col("across") >= -reach) & (F.col("across") <= width + reach))
    steps = [(i + 0.5) / subcells for i in range(subcells)]
    points = F.explode(F.array(*(F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a in steps for b in steps)))
    cut = near.withColumn("p", points).withColumns(place(F.col("c") - 1 + F.col("p.x"), F.col("r") - 1 + F.col("p.y")))
    held = cut.where("along >= 0 and along < length and across >= 0").where(F.col("across") < width)
    by = [*k, "line_id", "r", "c"]
    turned = held.select(*k, "line_id", (F.floor("across") + 1).cast("int").alias("r"), (F.floor("along") + 1).cast("int").alias("c"), "value", "class")
    counted = turned.groupBy(*by, "class").agg(F.sum("value").alias("s"), F.count("value").alias("m"), F.count("*").alias("n"))
    # the greatest of (count, has a class, smallest class)
    ranked = F.struct("n", F.col("class").isNotNull().alias("known"), (-F.col("class")).alias("least"))
    out = counted.groupBy(*by).agg((F.sum("s") / F.nullif(F.sum("m"), F.lit(0))).alias("mean_value"), (-F.max(ranked)["least"]).alias("veg_class"), F.sum("n").alias("n_points"))
    found = F.col("veg_class")
    return out.select(*by, ((F.col("c") - 0.5) * res_m).alias("dist_m"), "mean_value", "veg_class", to_na1(found, veg1).alias("veg1"), to_na1(found, veg2).alias("veg2"), "n_points")
