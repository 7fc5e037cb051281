"""Profiles along a band: densities, rolling means, runs, boundary zones, interval look-ups, trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def densities(cells: DataFrame, layers=("veg1", "veg2"), keys=("tid",), n_rows: int = 50) -> DataFrame:
    """keys, veg, c, d: the share of each column's cells that hold the layer."""
    wide = cells.groupBy(*keys, "c").agg(*((F.count(v) / float(n_rows)).alias(v) for v in layers))
    return wide.unpivot([*keys, "c"], list(layers), "veg", "d").select(*keys, "veg", "c", "d")


def column_stats(cells: DataFrame, value: str = "elev", keys=("tid",)) -> DataFrame:
    return cells.groupBy(*keys, "c").agg(F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("sd_value"))


def rolling_mean(profile: DataFrame, value: str = "d", by=("tid", "veg"), out: str = "s") -> DataFrame:
    """Centred mean of three columns; the first and the last column take their neighbour's."""
    w = Window.partitionBy(*by).orderBy("c")
    three = profile.withColumn("mean3", F.avg(value).over(w.rowsBetween(-1, 1)))
    first, last = F.lag("c").over(w).isNull(), F.lead("c").over(w).isNull()
    ends = F.when(first & last, F.col(value)).when(first, F.lead("mean3").over(w)).when(last, F.lag("mean3").over(w))
    return three.withColumn(out, F.coalesce(ends, F.col("mean3"))).drop("mean3")


def islands(flags: DataFrame, by=("tid", "veg"), order: str = "c") -> DataFrame:
    """by, a, b, n: runs of consecutive places of the rows that flags has, by gaps and islands."""
    w = Window.partitionBy(*by).orderBy(order)
    return flags.withColumn("island", F.col(order) - F.row_number().over(w)).groupBy(*by, "island").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n")).drop("island")


def run_lengths(rows: DataFrame, value: Column, by=("tid",), order: str = "c") -> DataFrame:
    """by, run_id (from 1), value, first, last, n: run-length encoding."""
    w = Window.partitionBy(*by).orderBy(order)
    x = rows.withColumn("value", value)
    starts = (~F.col("value").eqNullSafe(F.lag("value").over(w)) | F.lag(order).over(w).isNull()).cast("int")
    return x.withColumn("starts", starts).withColumn("run_id", F.sum("starts").over(w)).groupBy(*by, "run_id").agg(F.first("value").alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def zone_extent(profile: DataFrame, keys=("tid",), low: int = 5, high: int = 75, extended: int = 50, residual: DataFrame | None = None) -> DataFrame:
    """keys, start, end: the columns between which the boundary zone lies.

    profile has densities (keys, veg in veg1 and veg2, c, d); thresholds are in percent.  veg1 falls: from its last run
    of high density to the last run of low density behind that.  veg2 rises: from its first low run to the first high
    run behind that.  The zone starts where veg2 is low within the extended run of veg1 that holds the end of veg1's
    high run, and ends where veg1 is low within the extended run of veg2 that holds the begin of veg2's high run.
    Groups without any of these pieces have no row.  A residual profile must have no run of extended density.
    """
    k = list(keys)
    smooth = rolling_mean(profile, by=(*keys, "veg")).withColumn("k", F.bround(F.col("s") * 100, 0))
    runs = {name: islands(smooth.where(cond), (*keys, "veg")) for name, cond in (("hi", F.col("k") >= high), ("mn", F.col("k") >= extended), ("lo", F.col("k") <= low))}
    of = lambda name, veg, p: runs[name].where(F.col("veg") == veg).select(*k, F.col("a").alias(f"{p}a"), F.col("b").alias(f"{p}b"))

    def one(rows: DataFrame, p: str, last: bool = False) -> DataFrame:
        pick = F.max_by if last else F.min_by
        return rows.groupBy(*k).agg(pick(F.struct(f"{p}a", f"{p}b"), f"{p}a").alias("run")).select(*k, "run.*")

    v1s = one(of("hi", "veg1", "v1s"), "v1s", last=True)
    v1e = one(of("lo", "veg1", "v1e").join(v1s, k).where("v1ea > v1sb"), "v1e", last=True)
    v2s = one(of("lo", "veg2", "v2s"), "v2s")
    v2e = one(of("hi", "veg2", "v2e").join(v2s, k).where("v2ea > v2sb"), "v2e")
    held = v1s.join(of("mn", "veg1", "m"), k).where("v1sb between ma and mb").select(*k, "v1sb", F.col("ma").alias("m1a"))
    begin = held.join(v2s, k).withColumn("start", F.greatest("v2sa", "m1a")).where("start <= least(v2sb, v1sb)").select(*k, "start")
    far = begin.join(v2e, k).where("v2eb > start").withColumn("f", F.expr("greatest(v2ea, start + 1)"))
    tail = far.join(of("mn", "veg2", "m"), k).where("f between ma and mb").join(v1e, k)
    out = tail.where("greatest(v1ea, f) <= least(v1eb, mb)").select(*k, "start", F.least("v1eb", "mb").alias("end"))
    if residual is not None:
        rest = rolling_mean(residual, by=(*keys, "veg")).where(F.bround(F.col("s") * 100, 0) >= extended)
        out = out.join(rest.select(*k).distinct(), k, "left_anti")
    return out


def majority_profiles(cells: DataFrame, main: Column, keys=("tid",), n_rows: int = 50) -> tuple[DataFrame, DataFrame]:
    """Densities of the members of each type for which main holds, and those of the others."""
    kept = cells.withColumns({v: F.when(main, F.col(v)) for v in ("veg1", "veg2")})
    rest = cells.withColumns({v: F.when(~main, F.col(v)) for v in ("veg1", "veg2")})
    return densities(kept, keys=keys, n_rows=n_rows), densities(rest, keys=keys, n_rows=n_rows)


def trim_band(cells: DataFrame, zone: DataFrame, keys=("tid",)) -> DataFrame:
    """Cells of the zone's columns, which are counted from its start; the shift is kept as x0."""
    inside = cells.join(zone, list(keys)).where(F.col("c").between(F.col("start"), F.col("end")))
    return inside.withColumns({"x0": F.col("start") - 1, "c": (F.col("c") - F.col("start") + 1)}).drop("start", "end")


def interval_index(points: DataFrame, breaks: DataFrame, keys=("tid",), x: str = "x", at: str = "at", index: str = "j") -> DataFrame:
    """points with index: the last break at or before x, kept within the first and the last but one (all-inside).

    breaks has keys, at and its number j from 1.  An as-of look-up by union and running maximum: one sort of both
    sides, no pairs.
    """
    k = list(keys)
    sides = points.withColumns({"_x": F.col(x).cast("double"), "_j": F.lit(None).cast("int"), "_own": F.lit(1)})
    marks = breaks.select(*k, F.col(at).cast("double").alias("_x"), F.col("j").cast("int").alias("_j"), F.lit(0).alias("_own"))
    w = Window.partitionBy(*k).orderBy("_x", "_own").rowsBetween(Window.unboundedPreceding, 0)
    found = sides.unionByName(marks, allowMissingColumns=True).withColumn("_at", F.max("_j").over(w)).where("_own = 1")
    size = breaks.groupBy(*k).agg(F.max("j").alias("_n"))
    inside = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.coalesce("_at", F.lit(1))))
    return found.join(size, k).withColumn(index, inside.cast("int")).drop("_x", "_j", "_own", "_at", "_n")


def trim_line(points: DataFrame, spans: DataFrame, keys=("tid",)) -> DataFrame:
    """Points of a line between the distances start_m and end_m."""
    return points.join(spans, list(keys)).where(F.col("dist_m").between(F.col("start_m"), F.col("end_m"))).drop("start_m", "end_m")


def orient(points: DataFrame, keys=("tid",)) -> DataFrame:
    """Lines from their lower to their higher end: seq and dist_m anew; those of fewer than two points or of level ends go."""
    k = list(keys)
    ends = points.groupBy(*k).agg(F.min_by("elev", "seq").alias("e0"), F.max_by("elev", "seq").alias("e1"), F.max("seq").alias("n"), F.max("dist_m").alias("d1"), F.min("dist_m").alias("d0"))
    flip = F.col("e0") > F.col("e1")
    joined = points.join(ends.where("n > 1 and e0 <> e1"), k)
    return joined.withColumns({
        "seq": F.when(flip, F.col("n") - F.col("seq") + 1).otherwise(F.col("seq")),
        "dist_m": F.when(flip, F.col("d1") + F.col("d0") - F.col("dist_m")).otherwise(F.col("dist_m")),
    }).drop("e0", "e1", "n", "d1", "d0")


def low_to_high_section(points: DataFrame, keys=("tid",)) -> DataFrame:
    """The part of a line from its first lowest to its last highest point; nothing where that runs backwards."""
    k = list(keys)
    low = points.groupBy(*k).agg(F.min(F.struct("elev", "seq")).alias("lo"), F.max(F.struct("elev", "seq")).alias("hi")).select(*k, F.col("lo.seq").alias("from_seq"), F.col("hi.seq").alias("to_seq"))
    return points.join(low, k).where("seq between from_seq and to_seq").drop("from_seq", "to_seq")


def line_summary(points: DataFrame, keys=("tid",)) -> DataFrame:
    """Length, extremes, summed differences, mean slope and roughness of lines."""
    k = list(keys)
    w = Window.partitionBy(*k).orderBy("seq")
    steps = points.withColumn("step", F.abs(F.col("elev") - F.lag("elev").over(w)))
    out = steps.groupBy(*k).agg(
        (F.max("dist_m") - F.min("dist_m")).alias("length_m"), F.max("elev").alias("elev_max_m"), F.min("elev").alias("elev_min_m"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("elev_diffsum_m"), F.min_by("elev", "seq").alias("elev_start_m"), F.max_by("elev", "seq").alias("elev_end_m"),
    )
    total = F.abs(F.col("elev_end_m") - F.col("elev_start_m"))
    slope = total / F.nullif("length_m", F.lit(0.0))
    return out.withColumns({"elev_diff_m": F.col("elev_max_m") - F.col("elev_min_m"), "slope_mpm": slope, "slope_deg": F.degrees(F.atan(slope)), "roughness_mpm": (F.col("elev_diffsum_m") - total) / F.nullif("length_m", F.lit(0.0))})


def band_summary(cells: DataFrame, keys=("tid",), res_m: float = 30.0, n_rows: int = 50) -> DataFrame:
    """The line summary of a band's column means, with its length, width and area."""
    line = cells.groupBy(*keys, "c").agg(F.avg("elev").alias("elev")).withColumns({"seq": F.col("c"), "dist_m": F.col("c") * res_m})
    length = F.col("length_m") + res_m
    return line_summary(line, keys).withColumns({"band_length_m": length, "width_m": F.lit(n_rows * res_m), "area_m2": length * n_rows * res_m})
