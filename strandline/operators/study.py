"""Whole studies: candidate lines by type, band rectangles, the methods by name and version, task states."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TransectType
from . import fits, flow, fronts, hull, lines, patches, profile, results, terrain


def utm_zone(longitude: Column) -> Column:
    return (F.floor((longitude + 180) / 6) + 1).cast("int")


def in_band(points: DataFrame, bands: DataFrame, width: float, keys=("tid",)) -> DataFrame:
    """Points (x, y) in the rectangle of a width around the line (x0, y0) to (x1, y1): keys, x, y, along, across.

    Turned into the line's own directions the rectangle is two ranges; nothing is rasterised.
    """
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    joined = points.join(bands, list(keys)).withColumn("length", length).where("length > 0")
    ux, uy = (F.col("x1") - F.col("x0")) / F.col("length"), (F.col("y1") - F.col("y0")) / F.col("length")
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    turned = joined.withColumns({"along": dx * ux + dy * uy, "across": dy * ux - dx * uy})
    return turned.where((F.col("along") >= 0) & (F.col("along") <= F.col("length")) & (F.abs("across") <= width / 2)).select(*keys, "x", "y", "along", "across")


def distance_from_points(cells: DataFrame, points: DataFrame, keys=("tid",), res_m: float = 30.0) -> DataFrame:
    """keys, r, c, dist_m: the distance of each cell to the nearest point (r0, c0) of its grid."""
    d = F.hypot(F.col("r") - F.col("r0"), F.col("c") - F.col("c0")) * res_m
    return cells.select(*keys, "r", "c").join(points, list(keys)).groupBy(*keys, "r", "c").agg(F.min(d).alias("dist_m"))


def elongated(candidates: DataFrame, factor: float, n_rows: int, n_cols: int) -> DataFrame:
    """Lines whose far end lies `factor` times their length further on, kept within the grid."""
    far = lambda a, b, n: F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.col(b) + factor * (F.col(b) - F.col(a)) + 0.5).cast("int")))
    return candidates.withColumns({"r1": far("r0", "r1", n_rows), "c1": far("c0", "c1", n_cols)})


def candidate_lines(kind: TransectType, cells: DataFrame, starts: DataFrame, window: int, aspects: DataFrame | None = None, max_turn: float = 1.0, min_cells: int = 2) -> DataFrame:
    """tid, line_id, i, r, c: cells of the candidate lines from the starts (tid, r0, c0) of one transect type."""
    if kind is TransectType.MAX_ELEVATION_LINE:
        ends = lines.highest_in_window(cells, starts, window)
    elif kind is TransectType.STEEPEST_LINE:
        ends = lines.steepest_slope(cells, starts, 1, (window - 1) // 2)
    elif kind is TransectType.FLOW_PATH:
        downhill = flow.flow_reach(cells.join(terrain.flow_direction(cells), ["tid", "r", "c"], "left"))
        ends = starts.join(downhill.withColumnsRenamed({"r": "r0", "c": "c0", "end_r": "r1", "end_c": "c1"}), ["tid", "r0", "c0"])
    else:
        if aspects is None:
            raise ValueError("lines of like aspect need aspects")
        named = starts.select("tid", F.col("r0").alias("r"), F.col("c0").alias("c"), F.lit(0).alias("line_id"))
        runs = lines.homogeneous_lines(aspects, named, (window - 1) // 2, max_turn, min_cells)
        return runs.select("tid", "line_id", F.explode(F.sequence("i_from", "i_to")).alias("i"))
    return lines.line_cells(ends.select("tid", F.lit(0).alias("line_id"), "r0", "c0", "r1", "c1"))


class Band(NamedTuple):
    """The cells of one band by row and column; what is missing is NaN."""

    r: np.ndarray
    c: np.ndarray
    elev: np.ndarray
    veg1: np.ndarray
    veg2: np.ndarray

    def grid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elevations by the rows and columns that there are, and the place of each cell among these."""
        i, j = (np.unique(x, return_inverse=True)[1] for x in (self.r, self.c))
        z = np.full((i.max() + 1, j.max() + 1), np.nan)
        z[i, j] = self.elev
        return z, i, j

    def fronts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """fronts.front_runners: rows, and the farthest column of each type there."""
        rows, i = np.unique(self.r, return_inverse=True)
        ahead, behind = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        np.maximum.at(ahead, i[self.veg1 == 1], self.c[self.veg1 == 1])
        np.minimum.at(behind, i[self.veg2 == 1], self.c[self.veg2 == 1])
        return rows, np.where(np.isinf(ahead), np.nan, ahead), np.where(np.isinf(behind), np.nan, behind)


@dataclass(frozen=True)
class Method:
    """A measure by name: its version, and how it turns a band into values by metric.

    A method measures as the operators named in its description do, but with the whole band at hand: the cells of all
    bands are read and dealt out once for all methods, instead of once or more for each measure.
    """

    version: int
    measure: Callable[[Band], dict[str, float]]


def _mean_sd(x: np.ndarray) -> tuple[float, float]:
    x = x[~np.isnan(x)]
    return float(x.mean()) if len(x) else math.nan, float(x.std(ddof=1)) if len(x) > 1 and np.ptp(x) > 0 else 0.0 if len(x) > 1 else math.nan


def _named(prefix: str, found: dict) -> dict[str, float]:
    return {f"{prefix}{name}": math.nan if value is None else float(value) for name, value in found.items()}


def profile_pairs(band: Band, res_m: float = 30.0, n_rows: int = 50) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """x and y by fit: elevation and both densities over the distance, both densities over the elevation, by columns."""
    cols, j = np.unique(band.c, return_inverse=True)
    known = ~np.isnan(band.elev)
    with np.errstate(invalid="ignore"):
        elev = np.bincount(j[known], band.elev[known], len(cols)) / np.bincount(j[known], minlength=len(cols))
    out = {"elev_dist": (cols * res_m, elev)}
    for veg in ("veg1", "veg2"):
        d = np.bincount(j[~np.isnan(getattr(band, veg))], minlength=len(cols)) / float(n_rows)
        out |= {f"{veg}_dist": (cols * res_m, d), f"{veg}_elev": (elev, d)}
    return out


def _abruptness(band: Band) -> dict[str, float]:
    """Five fits, each by a line and a sigmoid, and whether AIC prefers the sigmoid."""
    out = {}
    for fit, pair in profile_pairs(band).items():
        if (scaled := fits.unit_arrays(*pair)) is not None:
            curved = fits.sigmoid_measures(*scaled)
            curved["best"] = None if curved["best"] is None else curved["best"] == "sigmoid"
            out |= _named(f"{fit}_linear_", fits.line_measures(*scaled)) | _named(f"{fit}_sigmoid_", curved)
    return out


def _cellwise(band: Band) -> dict[str, float]:
    """Models of each type's cells on elevation: line, sigmoid, logit, both complementary log-logs, rows as random effects.

    The elevation is centred and scaled by band.
    """
    known = ~np.isnan(band.elev)
    mean, sd = _mean_sd(band.elev)
    if not sd > 0:
        return {}
    x, r, out = (band.elev[known] - mean) / sd, band.r[known], {}
    for veg in ("veg1", "veg2"):
        y = np.nan_to_num(getattr(band, veg)[known])
        order = np.lexsort((y, x, r))
        found = {
            "logit": fits.glm_measures(x, y, "logit"), "cloglog": fits.glm_measures(x, y, "cloglog"), "cloglog_absence": fits.glm_measures(x, 1 - y, "cloglog"),
            "pql": fits.pql_measures(r[order], x[order], y[order]),
        }
        found["pql"].pop("b_auto")
        if (scaled := fits.unit_arrays(x, y)) is not None:
            found |= {"line": fits.line_measures(*scaled), "sigmoid": fits.sigmoid_measures(*scaled)}
            found["sigmoid"].pop("best")
        for name, values in found.items():
            out |= _named(f"{veg}_{name}_", values)
    return out


def _advancement(band: Band, n_cols: int = 64, n_rows: int = 50, res_m: float = 30.0) -> dict[str, float]:
    """The optimum, the advancement of both types, and its tests."""
    n1, n2, n = int((~np.isnan(band.veg1)).sum()), int((~np.isnan(band.veg2)).sum()), float(n_rows * n_cols)
    if not n1 + n2:
        return {}
    pos = round(n1 * float(n_cols) / (n1 + n2))
    out = _named("", {"pos_cell": pos, "pos_m": pos * res_m, "density1": n1 / n, "density2": n2 / n, "density_all": (n1 + n2) / n})
    moved, t = {}, {}
    for i, front in enumerate(band.fronts()[1:], 1):
        d = (front - pos) * res_m
        t[i] = np.sign(d) * np.log1p(np.abs(d))
        (moved[f"mean_d{i}"], moved[f"sd_d{i}"]), (moved[f"mean_t{i}"], moved[f"sd_t{i}"]) = _mean_sd(d), _mean_sd(t[i])
    out |= _named("advancement_", moved | {"beyond": moved["mean_t1"] > 0 and moved["mean_t2"] < 0})
    delta = (t[1] + t[2])[~np.isnan(t[1] + t[2])]
    if len(delta):
        rounded = np.round(delta, 9)
        out |= _named("ranks_", fronts.rank_measures(rounded)) | _named("ranks_exact_", {"p_exact": fronts.exact_p(rounded)})
        out |= _named("power_", fronts.power_measures(delta)) | _named("bootstrap_", fronts.bootstrap_measures(delta))
    return out


#: The hull edges of a study: type, the other type's front, whether the type ends to the left.
EDGES = (("veg1", "front2", False), ("veg2", "front1", True))
HULL_STEPS = (1, 3)


def _slopes(z: np.ndarray, res_m: float = 30.0) -> np.ndarray:
    """The slopes of terrain.slope_aspect; NaN at the border and beside missing cells."""
    z = np.pad(z, 1, constant_values=np.nan)
    n, m = z.shape
    at = {(i, j): z[i : n - 2 + i, j : m - 2 + j] for i in range(3) for j in range(3)}
    dx = ((at[0, 2] + 2 * at[1, 2] + at[2, 2]) - (at[0, 0] + 2 * at[1, 0] + at[2, 0])) / (8.0 * res_m)
    dy = ((at[2, 0] + 2 * at[2, 1] + at[2, 2]) - (at[0, 0] + 2 * at[0, 1] + at[0, 2])) / (8.0 * res_m)
    return np.arctan(np.sqrt(dx * dx + dy * dy))


def _hull(band: Band, res_m: float = 30.0, n_rows: int = 50) -> dict[str, float]:
    """The hull edge of each type and step: its place, the ground it lies on, its distance to the other type's front."""
    z, i, j = band.grid()
    ground = dict(zip(zip(band.r.tolist(), band.c.tolist(), strict=True), zip(z[i, j], _slopes(z)[i, j], strict=True), strict=True))
    rows, front1, front2 = band.fronts()
    ahead = {"front1": dict(zip(rows.tolist(), front1, strict=True)), "front2": dict(zip(rows.tolist(), front2, strict=True))}
    out = {}
    for veg, other, left in EDGES:
        held = ~np.isnan(getattr(band, veg))
        if not held.any():
            continue
        r, c = band.r[held], band.c[held]
        for step in HULL_STEPS:
            patch = patches.percolated(r, c, step)
            path = hull.walk(set(zip(r[patch].tolist(), c[patch].tolist(), strict=True)), step, left)
            y, x = np.array(path).T
            location, width = _mean_sd(x.astype(float))
            found = {"location_m": location * res_m, "width_m": width * res_m, "length_m": float(np.hypot(np.diff(y), np.diff(x)).sum()) * res_m, "n_visits": len(path), "spans": y.max() - y.min() + 1 == n_rows}
            on = np.array([ground[p] for p in sorted(set(path))])
            for k, name in enumerate(("elev", "slope")):
                found[f"mean_{name}"], found[f"sd_{name}"] = _mean_sd(on[:, k])
            gap = np.array([ahead[other][row] - x[y == row].mean() for row in np.unique(y).tolist()])
            gap = gap[~np.isnan(gap)]
            if len(gap):
                mean, sd = _mean_sd(gap)
                found |= {"mean_distance_m": mean * (-1 if left else 1) * res_m, "sd_distance_m": sd * res_m, "n_rows": len(gap)}
            out |= _named(f"step{step}_{veg}_", found)
    return out


METHODS = {"danz1d": Method(4, _abruptness), "danz2d": Method(3, _cellwise), "eppinga": Method(3, _advancement), "gastner": Method(3, _hull)}


def measured(cells: DataFrame, due: DataFrame | None = None) -> DataFrame:
    """tid, method, metric, value of all methods, or of those due (tid, methods: bits in the order of METHODS).

    The cells are dealt out by band once; a band is measured in one place, all its methods one after another.  Bands are
    small but take long, so that Spark's choice of tasks by size would leave cores idle: there are as many tasks as
    shuffles have partitions, and some for each core.  Cells without band or place are left out, elevations that are
    not finite are missing.
    """
    rows = cells.where("tid is not null and r is not null and c is not null")
    rows = rows.select("tid", F.col("r").cast("int"), F.col("c").cast("int"), *(F.col(x).cast("double") for x in ("elev", "veg1", "veg2")))
    every = due is None
    if not every:
        rows = rows.join(due.select("tid", F.col("methods").cast("int")), "tid")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["c"], pdf["r"]))]
        elev = pdf["elev"].to_numpy(float)
        band = Band(pdf["r"].to_numpy(), pdf["c"].to_numpy(), np.where(np.isfinite(elev), elev, np.nan), pdf["veg1"].to_numpy(float), pdf["veg2"].to_numpy(float))
        bits = -1 if every else int(pdf["methods"].iloc[0])
        found = [(name, metric, value) for i, (name, m) in enumerate(METHODS.items()) if bits >> i & 1 for metric, value in m.measure(band).items()]
        out = pd.DataFrame(found, columns=["method", "metric", "value"])
        out.insert(0, "tid", key[0])
        return out

    spark = cells.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "tid").groupBy("tid").applyInPandas(run, f"tid {dict(cells.dtypes)['tid']}, method string, metric string, value double")


def measure_all(cells: DataFrame) -> DataFrame:
    """tid, metric, value of every method, its name in front of the metric."""
    return measured(cells).select("tid", F.concat_ws("_", "method", "metric").alias("metric"), "value")


def measure_pending(cells: DataFrame, work: DataFrame, log: DataFrame) -> DataFrame:
    """tid, method, version, metric, value of all work (tid, method) that the log (tid, method, version) lacks or has of an older version."""
    todo = [results.pending(work.where(F.col("method") == name), log, m.version, ("tid", "method")).select("tid", F.lit(1 << i).alias("bit")) for i, (name, m) in enumerate(METHODS.items())]
    due = reduce(DataFrame.unionByName, todo).groupBy("tid").agg(F.bit_or("bit").alias("methods"))
    version = F.create_map(*(F.lit(x) for name, m in METHODS.items() for x in (name, m.version)))
    return measured(cells, due).select("tid", "method", version[F.col("method")].alias("version"), "metric", "value")


def task_states(located: DataFrame, windows: int, failed: DataFrame | None = None) -> DataFrame:
    """tid, state of the tasks that have rows (tid, nb, found): located if all windows are, error if any failed, else notransect."""
    states = located.groupBy("tid").agg((F.count(F.when(F.col("found"), 1)) == windows).alias("all"))
    if failed is not None:
        states = states.join(failed.select("tid", F.lit(True).alias("failed")).distinct(), "tid", "left")
    else:
        states = states.withColumn("failed", F.lit(None).cast("boolean"))
    return states.select("tid", F.when(F.col("failed"), "error").when(F.col("all"), "located").otherwise("notransect").alias("state"))


def zone_ends(cells: DataFrame, res_m: float = 30.0) -> DataFrame:
    """tid, method, start_m, center_m, end_m: between the places that each method gives to the two types.

    Abruptness: the centres of the sigmoids of their densities; advancement: the optimum and their mean advancement, the
    optimum being the centre; hull edges of each step: the mean columns of their walks.  Start and end are null where the
    place of one type is missing; where both are, there is no row.
    """
    dens = profile.densities(cells).withColumn("x", F.col("c") * res_m)
    half = fits.sigmoid_abruptness(dens, "x", "d", ("tid", "veg")).select("tid", F.lit("abruptness").alias("method"), F.nanvl("x50", F.lit(None)).alias("m"))
    optimum = fronts.optimal_boundary(cells)
    moved = fronts.advancement_summary(fronts.advancement(fronts.front_runners(cells), optimum)).join(optimum, "tid")
    ahead = moved.select("tid", F.lit("advancement").alias("method"), F.explode(F.array(F.col("pos_m") + F.col("mean_d1"), F.col("pos_m") + F.col("mean_d2"))).alias("m"), F.col("pos_m").alias("center"))
    every = half.unionByName(ahead, allowMissingColumns=True)
    for step in HULL_STEPS:
        for veg, _, left in EDGES:
            edge = hull.hull_stats(hull.hull_edge(patches.percolation_patch(cells, veg, step), step, left))
            every = every.unionByName(edge.select("tid", F.lit(f"hull_edge_{step}").alias("method"), F.col("location_m").alias("m")), allowMissingColumns=True)
    known = every.where("m is not null").groupBy("tid", "method").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.first("center").alias("center_m"), F.count("*").alias("n"))
    return known.select("tid", "method", F.when(F.col("n") == 2, F.col("low")).alias("start_m"), "center_m", F.when(F.col("n") == 2, F.col("high")).alias("end_m"))
