"""Patches: connected components of cells, percolation growth, patch statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import QUEEN, ROOK


def label(r: np.ndarray, c: np.ndarray, offsets=QUEEN) -> np.ndarray:
    """The least index of the component of each cell, neighbours being at the offsets."""
    n = len(r)
    if not n:
        return np.zeros(0, np.int64)
    width = int(c.max() - c.min()) + 2 * max(abs(b) for _, b in offsets) + 1
    at = r.astype(np.int64) * width + c
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    parent = np.arange(n)
    left, right = [], []
    for a, b in offsets:
        if (a, b) > (0, 0):  # each pair of neighbours once
            place = np.minimum(np.searchsorted(ranked, at + a * width + b), n - 1)
            there = ranked[place] == at + a * width + b
            left.append(np.nonzero(there)[0])
            right.append(order[place[there]])
    x, y = np.concatenate(left), np.concatenate(right)
    while len(x):  # hook roots to smaller ones, then halve the paths
        a, b = parent[x], parent[y]
        open_ = a != b
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def disc(radius: float) -> list[tuple[int, int]]:
    n = int(radius)
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if 0 < a * a + b * b <= radius * radius]


def patches(cells: DataFrame, layer: str, offsets=QUEEN, keys=("tid",), n_cols: int = 64) -> DataFrame:
    """keys, r, c, patch_id of the cells that hold the layer: components, named by their least (r - 1) * n_cols + c.

    One group is one band, whose size settings bound; grids that don't fit a group need tiles whose labels are merged.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r, c = rows["r"].to_numpy(), rows["c"].to_numpy()
        root = label(r, c, offsets)
        name = pd.Series((r - 1) * n_cols + c).groupby(root).transform("min")
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "r": r, "c": c, "patch_id": name.to_numpy()})

    held = cells.where(F.col(layer).isNotNull()).select(*keys, "r", "c")
    schema = ", ".join([*(f"{k} {dict(held.dtypes)[k]}" for k in keys), "r int, c int, patch_id int"])
    return held.groupBy(*keys).applyInPandas(run, schema)


def patch_sizes(labelled: DataFrame, keys=("tid",)) -> DataFrame:
    return labelled.groupBy(*keys, "patch_id").agg(F.count("*").alias("n_cells"))


def median_radius(labelled: DataFrame, keys=("tid",), res_m: float = 30.0) -> DataFrame:
    return patch_sizes(labelled, keys).groupBy(*keys).agg(F.sqrt(F.percentile("n_cells", 0.5) * (res_m * res_m) / F.pi()).alias("median_radius_m"))


def largest_patch(labelled: DataFrame, keys=("tid",)) -> DataFrame:
    """Cells of the largest patch of each group; of ties the one of the smallest name."""
    best = patch_sizes(labelled, keys).groupBy(*keys).agg(F.max(F.struct("n_cells", (-F.col("patch_id")).alias("k"))).alias("best"))
    return labelled.join(best.select(*keys, (-F.col("best.k")).alias("patch_id")), [*keys, "patch_id"], "left_semi")


def percolation_patch(cells: DataFrame, layer: str, step: float, keys=("tid",)) -> DataFrame:
    """Cells reached from the largest rook patch by jumps of at most `step` cells: keys, r, c."""
    core = largest_patch(patches(cells, layer, ROOK, keys), keys).select(*keys, F.col("patch_id").alias("core_id"), "r", "c")
    if step <= 1:
        return core.select(*keys, "r", "c")
    wide = patches(cells, layer, disc(step), keys)
    holds = wide.join(core, [*keys, "r", "c"]).select(*keys, "patch_id").distinct()
    return wide.join(holds, [*keys, "patch_id"], "left_semi").select(*keys, "r", "c")


def percolated(r: np.ndarray, c: np.ndarray, step: float, n_cols: int = 64) -> np.ndarray:
    """percolation_patch of one group's cells: which of them it holds."""
    root = label(r, c, ROOK)
    size, name = np.bincount(root, minlength=len(r)), np.full(len(r), np.iinfo(np.int64).max)
    np.minimum.at(name, root, (r.astype(np.int64) - 1) * n_cols + c)
    core = root == min(np.nonzero(size == size.max())[0], key=lambda i: name[i])
    if step <= 1:
        return core
    wide = label(r, c, disc(step))
    return np.isin(wide, wide[core])


def human_footprint(cells: DataFrame, layer: str = "excl", keys=("tid",), n_rows: int = 50, n_cols: int = 64, res_m: float = 30.0) -> DataFrame:
    """Share of the area, place of the densest column, and the extent of the largest queen patch as shares of the band."""
    area = cells.groupBy(*keys).agg((F.count(layer) / float(n_rows * n_cols)).alias("area_fraction"))
    by_col = cells.groupBy(*keys, "c").agg(F.count(layer).alias("n"))
    mode = by_col.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("c")).alias("k"))).alias("m")).where("m.n > 0").select(*keys, (-F.col("m.k") * res_m).alias("mode_x_m"))
    big = largest_patch(patches(cells, layer, QUEEN, keys), keys).groupBy(*keys).agg(((F.max("c") - F.min("c") + 1) / float(n_cols)).alias("x_extent"), ((F.max("r") - F.min("r") + 1) / float(n_rows)).alias("y_extent"))
    return area.join(mode, list(keys), "left").join(big, list(keys), "left")


def grouped(rows: DataFrame, keys, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel on each group; its rows get the keys in front."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf)
        for i, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, k, v)
        return out

    types = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), schema]))
