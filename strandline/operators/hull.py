"""Hull edges: a biased walk around the percolating patch of a type, and its statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patches import grouped


def _crosses(a, b, c, d) -> bool:
    """Do the open segments ab and cd cross other than at cell centres?"""
    def side(p, q, x):
        return (q[0] - p[0]) * (x[1] - p[1]) - (q[1] - p[1]) * (x[0] - p[0])

    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def walk(cells: set[tuple[int, int]], step: int, end_to_left: bool) -> list[tuple[int, int]]:
    """(r, c) in order along the edge of a patch.

    A type that ends to the left is walked from its lowest to its uppermost row along its least columns, another one
    downwards along its largest.  Of the cells within `step` the one of the smallest turn, clockwise from straight
    back, is next, the nearest of ties.  Moves that cross the walk, or repeat a move in the same direction, are refused;
    a refused cell is not tried again from there.  Visits are listed as often as they occur.
    """
    if not cells:
        return []
    top, low = min(r for r, _ in cells), max(r for r, _ in cells)
    pick = min if end_to_left else max
    front = lambda row: (row, pick(c for r, c in cells if r == row))
    at, end = (front(low), front(top)) if end_to_left else (front(top), front(low))
    # azimuths clockwise from the direction of the walk: up for the left edge, down for the right one
    sign = 1 if end_to_left else -1
    azimuth = lambda a, b: math.atan2(sign * (b[1] - a[1]), sign * (a[0] - b[0])) % (2 * math.pi)
    back, path, moves = math.pi, [at], set()
    near = [(a, b) for a in range(-step, step + 1) for b in range(-step, step + 1) if 0 < math.hypot(a, b) <= step]
    if step == 1:
        near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    while at != end or len(path) == 1 and len(cells) > 1 and at != end:
        choices = []
        for a, b in near:
            to = (at[0] + a, at[1] + b)
            if to in cells and (at, to) not in moves:
                turn = (azimuth(at, to) - back) % (2 * math.pi)
                choices.append((turn if turn > 1e-12 else 2 * math.pi, math.hypot(a, b), to))
        recent = path[-(8 * step + 8) :]
        for _, _, to in sorted(choices):
            if step > 1 and any(_crosses(at, to, p, q) for p, q in zip(recent, recent[1:], strict=False)):
                continue
            break
        else:
            break
        moves.add((at, to))
        back = (azimuth(at, to) + math.pi) % (2 * math.pi)
        path.append(to)
        at = to
    return path


def hull_edge(patch: DataFrame, step: int, end_to_left: bool, keys=("tid",)) -> DataFrame:
    """keys, seq (from 1), r, c: the walk around the patch of each group."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        path = walk(set(pdf[["r", "c"]].itertuples(index=False, name=None)), step, end_to_left)
        return pd.DataFrame({"seq": range(1, len(path) + 1), "r": [r for r, _ in path], "c": [c for _, c in path]})

    return grouped(patch.select(*keys, "r", "c"), list(keys), kernel, "seq int, r int, c int")


def hull_stats(edge: DataFrame, keys=("tid",), res_m: float = 30.0, n_rows: int = 50) -> DataFrame:
    """Position (mean column), width (its sd), length of the walk, and whether it spans the band."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy("seq")
    moved = edge.withColumn("d", F.hypot(F.col("r") - F.lag("r").over(w), F.col("c") - F.lag("c").over(w)))
    return moved.groupBy(*keys).agg(
        (F.avg("c") * res_m).alias("location_m"), (F.stddev_samp("c") * res_m).alias("width_m"), (F.coalesce(F.sum("d"), F.lit(0.0)) * res_m).alias("length_m"), F.count("*").alias("n_visits"), (F.max("r") - F.min("r") + 1 == n_rows).alias("spans"),
    )


def hull_gradient(edge: DataFrame, terrain: DataFrame, keys=("tid",)) -> DataFrame:
    """Mean and sd of elevation and slope on the cells of the walk."""
    on = edge.select(*keys, "r", "c").distinct().join(terrain, [*keys, "r", "c"])
    return on.groupBy(*keys).agg(*(f(x).alias(f"{n}_{x}") for x in ("elev", "slope") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))


def struggle_zone(edge: DataFrame, fronts: DataFrame, other: str, end_to_left: bool, keys=("tid",), res_m: float = 30.0) -> DataFrame:
    """Per row the distance from the walk's mean column to the other type's front runner, positive ahead of the walk."""
    mean = edge.groupBy(*keys, "r").agg(F.avg("c").alias("hull_c"))
    sign = -1 if end_to_left else 1
    rows = mean.join(fronts.select(*keys, "r", F.col(other).alias("front")), [*keys, "r"]).where("front is not null")
    return rows.groupBy(*keys).agg(F.avg((F.col("front") - F.col("hull_c")) * sign * res_m).alias("mean_distance_m"), F.stddev_samp((F.col("front") - F.col("hull_c")) * res_m).alias("sd_distance_m"), F.count("*").alias("n_rows"))
