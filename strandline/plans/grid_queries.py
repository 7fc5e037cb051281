"""Queries of cells, joins, profiles and terrain."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalars as S
from ..operators import grid, profile, results, terrain
from ..sources import tables as T
from .base import CELL, DENSITY, PATH, POINT, R, query, smooth, zone

PI2 = repr(2 * math.pi) + "e0"
KEYS = ["tid", "r", "c"]


@query("cell_scan", f"WITH {CELL} SELECT tid, r, c, {R('v')} AS v, veg_class FROM cell WHERE v IS NOT NULL AND NOT (v BETWEEN -0.1e0 AND 0.1e0) AND veg_class <> 3")
def cell_scan(spark, sf):
    cells = grid.rows_of(T.band_cells(spark, sf), "v", (None, (-0.1, 0.1)))
    return grid.rows_of(cells, "veg_class", (3,)).select(*KEYS, "v", "veg_class")


@query("reclassify_na1", f"WITH {CELL} SELECT tid, r, c, CASE WHEN veg_class IN (1, 2, 5) THEN 1 END AS na1 FROM cell")
def reclassify_na1(spark, sf):
    return T.band_cells(spark, sf).select(*KEYS, grid.to_na1(F.col("veg_class"), (1, 2, 5)).alias("na1"))


@query("reclassify_01", f"WITH {CELL} SELECT tid, r, c, CASE WHEN veg1 = 1 THEN 1 ELSE 0 END AS v01 FROM cell")
def reclassify_01(spark, sf):
    return T.band_cells(spark, sf).select(*KEYS, grid.na1_to_01(F.col("veg1")).alias("v01"))


def _points(cells):
    return cells.select("tid").distinct().select("tid", (F.col("tid") % 30 + 10).alias("r0"), (F.col("tid") * 7 % 55 + 5).alias("c0"))


POINTS = "pts AS (SELECT DISTINCT tid, tid % 30 + 10 AS r0, tid * 7 % 55 + 5 AS c0 FROM cell)"


@query("crop_window", f"WITH {CELL}, {POINTS} SELECT tid, r, c, {R('elev')} AS elev FROM cell JOIN pts USING (tid) WHERE r BETWEEN r0 - 7 AND r0 + 7 AND c BETWEEN c0 - 7 AND c0 + 7")
def crop_window(spark, sf):
    cells = T.band_cells(spark, sf)
    return grid.crop(cells, _points(cells), 15).select(*KEYS, "elev")


@query("mask_overlay", f"WITH {CELL} SELECT tid, r, c, {R('elev + 100e0 * coalesce(veg2, 0)')} AS combined FROM cell WHERE veg1 = 1 AND excl IS NULL")
def mask_overlay(spark, sf):
    cells = T.band_cells(spark, sf)
    kept = grid.mask(cells.where("excl is null"), cells.where("veg1 = 1"))
    return kept.select(*KEYS, (F.col("elev") + 100.0 * F.coalesce("veg2", F.lit(0))).alias("combined"))


@query("rat_lookup_majority", """
WITH code AS (
  SELECT l_suppkey % 10 AS tid, p_partkey AS value, p_size AS level3, p_brand AS macro FROM lineitem JOIN part ON l_partkey = p_partkey
), n1 AS (SELECT tid, value, count(*) AS n FROM code WHERE level3 BETWEEN 1 AND 10 GROUP BY ALL),
one AS (SELECT tid, value AS veg1_class FROM n1 QUALIFY row_number() OVER (PARTITION BY tid ORDER BY n DESC, value) = 1),
n2 AS (SELECT tid, macro, count(*) AS n, count(DISTINCT value) AS n_classes FROM code WHERE level3 > 10 GROUP BY ALL),
grp AS (SELECT tid, macro AS veg2_group, n AS veg2_cells, n_classes AS veg2_classes FROM n2 QUALIFY row_number() OVER (PARTITION BY tid ORDER BY n DESC, macro) = 1)
SELECT tid, veg1_class, veg2_group, veg2_cells, veg2_classes FROM one JOIN grp USING (tid)""")
def rat_lookup_majority(spark, sf):
    rat = T.attribute_table(spark, sf)
    coded = T.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("tid"), F.col("l_partkey").alias("value")).join(rat, "value")
    veg1 = A.majority(coded.where("level3 between 1 and 10"), ["tid"], "value").select("tid", F.col("value").alias("veg1_class"))
    veg2 = A.majority(coded.where("level3 > 10"), ["tid"], "macro").select("tid", F.col("macro").alias("veg2_group"), F.col("n").alias("veg2_cells"))
    members = coded.where("level3 > 10").groupBy("tid", F.col("macro").alias("veg2_group")).agg(F.countDistinct("value").alias("veg2_classes"))
    return veg1.join(veg2, "tid").join(members, ["tid", "veg2_group"])


@query("column_density", f"WITH {DENSITY} SELECT tid, veg, c, {R('d')} AS d FROM dens")
def column_density(spark, sf):
    return profile.densities(T.band_cells(spark, sf))


@query("column_mean_sd", f"WITH {CELL} SELECT tid, c, {R('avg(elev)')} AS mean_value, {R('stddev_samp(elev)')} AS sd_value FROM cell GROUP BY tid, c")
def column_mean_sd(spark, sf):
    return profile.column_stats(T.band_cells(spark, sf))


def _mod(x: str) -> str:
    return f"(({x}) - {PI2} * floor(({x}) / {PI2}))"


@query("circular_stats", f"""
WITH {CELL}, a AS (SELECT tid, c, {_mod('12e0 * v')} AS a FROM cell),
s AS (SELECT tid, sum(sin(a)) AS s, sum(cos(a)) AS k, count(*) AS n, stddev_samp(a) AS sd FROM a GROUP BY tid),
g AS (SELECT tid, max(gap) AS gap, max(a) - min(a) AS span FROM (SELECT tid, a, a - lag(a) OVER (PARTITION BY tid ORDER BY a) AS gap FROM a) GROUP BY tid)
SELECT tid, {R(_mod('atan2(s, k)'))} AS circ_mean, {R('sqrt(-2 * ln(least(1e0, sqrt(k * k + s * s) / n)))')} AS circ_sd,
  {R(f'{PI2} - greatest(gap, {PI2} - span)')} AS circ_range, {R(_mod('atan2(s, k) + 5e0'))} AS circ_sum
FROM s JOIN g USING (tid)""")
def circular_stats(spark, sf):
    rows = T.band_cells(spark, sf).select("tid", S.wrap(12.0 * F.col("v")).alias("a"))
    out = rows.groupBy("tid").agg(A.circular_mean(F.col("a")).alias("circ_mean"), A.circular_sd(F.col("a")).alias("circ_sd"))
    return out.join(A.circular_range(rows, ["tid"], "a"), "tid").withColumn("circ_sum", S.circular_sum(F.col("circ_mean"), F.lit(5.0)))


@query("majority_null_ties", f"""
WITH {POINT}, n AS (SELECT c, r, class, count(*) AS n FROM raw_point GROUP BY ALL)
SELECT c, r, class, n FROM n QUALIFY row_number() OVER (PARTITION BY c, r ORDER BY n DESC, class ASC NULLS LAST) = 1""")
def majority_null_ties(spark, sf):
    return A.majority(T.raw_points(spark, sf), ["c", "r"], "class")


@query("majority_all_ties", f"""
WITH {POINT}, n AS (SELECT c, r, class, count(*) AS n FROM raw_point WHERE class IS NOT NULL GROUP BY ALL)
SELECT c, r, class, n FROM n QUALIFY rank() OVER (PARTITION BY c, r ORDER BY n DESC) = 1""")
def majority_all_ties(spark, sf):
    return A.majority(T.raw_points(spark, sf), ["c", "r"], "class", skip_null=True, all_ties=True)


RESIDUAL = "res AS (SELECT tid, r, c, elev - avg(elev) OVER (PARTITION BY tid, c) AS e FROM cell)"


def residuals(cells):
    return cells.join(profile.column_stats(cells), ["tid", "c"]).withColumn("e", F.col("elev") - F.col("mean_value"))


@query("residual_error_stats", f"WITH {CELL}, {RESIDUAL} SELECT tid, {R('sqrt(avg(e * e))')} AS rmse, {R('quantile_cont(abs(e), 0.95)')} AS q95, {R('max(abs(e))')} AS max_error FROM res GROUP BY tid")
def residual_error_stats(spark, sf):
    e = F.col("e")
    return residuals(T.band_cells(spark, sf)).groupBy("tid").agg(A.rms(e).alias("rmse"), A.q95_abs(e).alias("q95"), A.max_abs(e).alias("max_error"))


@query("rolling_mean_extend", f"WITH {DENSITY}, {smooth()} SELECT tid, veg, c, {R('d')} AS d, {R('s')} AS s FROM sm")
def rolling_mean_extend(spark, sf):
    return profile.rolling_mean(profile.densities(T.band_cells(spark, sf)))


@query("run_length", f"""
WITH {DENSITY}, {smooth()}, f AS (SELECT tid, veg, c, round_even(s * 100, 0) >= 50 AS value FROM sm),
b AS (SELECT *, (lag(value) OVER w IS NULL OR lag(value) OVER w <> value)::INT AS st FROM f WINDOW w AS (PARTITION BY tid, veg ORDER BY c)),
i AS (SELECT *, sum(st) OVER (PARTITION BY tid, veg ORDER BY c) AS run_id FROM b)
SELECT tid, veg, run_id::BIGINT AS run_id, first(value) AS value, min(c) AS first, max(c) AS last, count(*) AS n FROM i GROUP BY tid, veg, run_id""")
def run_length(spark, sf):
    smoothed = profile.rolling_mean(profile.densities(T.band_cells(spark, sf)))
    return profile.run_lengths(smoothed, F.bround(F.col("s") * 100, 0) >= 50, ("tid", "veg"))


def zones(spark, sf):
    return profile.zone_extent(profile.densities(T.band_cells(spark, sf)))


@query("zone_extent", f"WITH {DENSITY}, {smooth()}, {zone()} SELECT tid, start_c AS start, end_c AS \"end\" FROM z_out")
def zone_extent(spark, sf):
    return zones(spark, sf)


MAIN = CELL.replace("veg1,", "veg1x,").replace("veg2,", "veg2x,") + """, main AS (
  SELECT tid, r, c, CASE WHEN m THEN veg1x END AS veg1, CASE WHEN m THEN veg2x END AS veg2, CASE WHEN NOT m THEN veg1x END AS rest1, CASE WHEN NOT m THEN veg2x END AS rest2
  FROM (SELECT *, veg_class <> 0 AS m FROM cell)
), dens AS (
  SELECT tid, veg, c, d FROM (SELECT tid, c, count(veg1) / 50e0 AS d1, count(veg2) / 50e0 AS d2 FROM main GROUP BY tid, c) CROSS JOIN LATERAL (VALUES ('veg1', d1), ('veg2', d2)) x(veg, d)
), rest AS (
  SELECT tid, veg, c, d FROM (SELECT tid, c, count(rest1) / 50e0 AS d1, count(rest2) / 50e0 AS d2 FROM main GROUP BY tid, c) CROSS JOIN LATERAL (VALUES ('veg1', d1), ('veg2', d2)) x(veg, d)
)"""


@query("zone_extent_majority", f"WITH {MAIN}, {smooth()}, {zone()}, {smooth('rest', 'rs')} SELECT tid, start_c AS start, end_c AS \"end\" FROM z_out WHERE tid NOT IN (SELECT tid FROM rs WHERE round_even(s * 100, 0) >= 50)")
def zone_extent_majority(spark, sf):
    main, rest = profile.majority_profiles(T.band_cells(spark, sf), F.col("veg_class") != 0)
    return profile.zone_extent(main, residual=rest)


@query("trim_band", f"WITH {DENSITY}, {smooth()}, {zone()} SELECT tid, r, (c - start_c + 1)::INT AS c, (start_c - 1)::INT AS x0, {R('elev')} AS elev, veg1, veg2 FROM cell JOIN z_out USING (tid) WHERE c BETWEEN start_c AND end_c")
def trim_band(spark, sf):
    cells = T.band_cells(spark, sf)
    return profile.trim_band(cells, zones(spark, sf)).select("tid", "r", F.col("c").cast("int"), F.col("x0").cast("int"), "elev", "veg1", "veg2")


@query("trim_line", f"WITH {PATH} SELECT tid, seq, {R('dist_m')} AS dist_m, {R('elev')} AS elev FROM line_point WHERE dist_m BETWEEN 300 + tid % 10 * 30 AND 900 + tid % 7 * 30")
def trim_line(spark, sf):
    points = T.path_points(spark, sf)
    spans = points.select("tid").distinct().select("tid", (300 + F.col("tid") % 10 * 30).alias("start_m"), (900 + F.col("tid") % 7 * 30).alias("end_m"))
    return profile.trim_line(points, spans).select("tid", "seq", "dist_m", "elev")


@query("asof_interval", f"""
WITH {PATH}, brk AS (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY dist_m) AS j, dist_m AS at FROM line_point WHERE seq % 5 = 0),
n AS (SELECT tid, max(j) AS n FROM brk GROUP BY tid),
p AS (SELECT tid, seq, dist_m + 10e0 AS x FROM line_point)
SELECT p.tid, p.seq, {R('p.x')} AS x, greatest(1, least(n.n - 1, coalesce(b.j, 1)))::INT AS j
FROM p JOIN n USING (tid) ASOF LEFT JOIN brk b ON b.tid = p.tid AND b.at <= p.x""")
def asof_interval(spark, sf):
    points = T.path_points(spark, sf)
    breaks = points.where("seq % 5 = 0").select("tid", (F.col("seq") / 5).cast("int").alias("j"), F.col("dist_m").alias("at"))
    return profile.interval_index(points.select("tid", "seq", (F.col("dist_m") + 10.0).alias("x")), breaks).select("tid", "seq", "x", "j")


ORIENT = PATH + """, e AS (SELECT tid, arg_min(elev, seq) AS e0, arg_max(elev, seq) AS e1, max(seq) AS n, max(dist_m) AS d1, min(dist_m) AS d0 FROM line_point GROUP BY tid),
o AS (SELECT p.tid, CASE WHEN e0 > e1 THEN n - seq + 1 ELSE seq END AS seq, CASE WHEN e0 > e1 THEN d1 + d0 - dist_m ELSE dist_m END AS dist_m, elev FROM line_point p JOIN e USING (tid) WHERE n > 1 AND e0 <> e1)"""


@query("path_orient_sort", f"WITH {ORIENT} SELECT tid, seq, {R('dist_m')} AS dist_m, {R('elev')} AS elev FROM o")
def path_orient_sort(spark, sf):
    return profile.orient(T.path_points(spark, sf)).select("tid", "seq", "dist_m", "elev")


@query("path_minmax_section", f"""
WITH {ORIENT}, x AS (SELECT tid, min(elev) AS lo, max(elev) AS hi FROM o GROUP BY tid),
s AS (SELECT tid, min(seq) FILTER (elev = lo) AS a, max(seq) FILTER (elev = hi) AS b FROM o JOIN x USING (tid) GROUP BY tid)
SELECT tid, seq, {R('elev')} AS elev FROM o JOIN s USING (tid) WHERE seq BETWEEN a AND b""")
def path_minmax_section(spark, sf):
    return profile.low_to_high_section(profile.orient(T.path_points(spark, sf))).select("tid", "seq", "elev")


def _summary(source: str, extra: str = "") -> str:
    return f"""
, st AS (SELECT *, abs(elev - lag(elev) OVER (PARTITION BY tid ORDER BY seq)) AS step FROM {source}),
su AS (SELECT tid, max(dist_m) - min(dist_m) AS length_m, max(elev) AS hi, min(elev) AS lo, coalesce(sum(step), 0) AS ds, arg_min(elev, seq) AS e0, arg_max(elev, seq) AS e1 FROM st GROUP BY tid)
SELECT tid, {R('length_m')} AS length_m, {R('hi')} AS elev_max_m, {R('lo')} AS elev_min_m, {R('ds')} AS elev_diffsum_m, {R('e0')} AS elev_start_m, {R('e1')} AS elev_end_m, {R('hi - lo')} AS elev_diff_m,
  {R('abs(e1 - e0) / nullif(length_m, 0)')} AS slope_mpm, {R('degrees(atan(abs(e1 - e0) / nullif(length_m, 0)))')} AS slope_deg, {R('(ds - abs(e1 - e0)) / nullif(length_m, 0)')} AS roughness_mpm{extra} FROM su"""


@query("linear_transect_summary", f"WITH {PATH} {_summary('line_point')}")
def linear_transect_summary(spark, sf):
    return profile.line_summary(T.path_points(spark, sf))


@query("band_env_summary", f"WITH {CELL}, ln AS (SELECT tid, c AS seq, c * 30e0 AS dist_m, avg(elev) AS elev FROM cell GROUP BY tid, c)" + _summary("ln", ", length_m + 30e0 AS band_length_m, 1500e0 AS width_m, (length_m + 30e0) * 1500e0 AS area_m2"))
def band_env_summary(spark, sf):
    return profile.band_summary(T.band_cells(spark, sf))


ABUT = """, stp AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dr, dc)),
abut AS (
  SELECT DISTINCT a.tid, a.r, a.c FROM cell a CROSS JOIN stp JOIN cell b ON b.tid = a.tid AND b.r = a.r + dr AND b.c = a.c + dc
  WHERE (a.veg1 = 1 AND b.veg2 = 1) OR (a.veg2 = 1 AND b.veg1 = 1)
)"""


@query("abutting_cells", f"WITH {CELL} {ABUT} SELECT tid, r, c FROM abut")
def abutting_cells(spark, sf):
    return grid.abutting(T.band_cells(spark, sf))


ZS = CELL + ", nb AS (SELECT a.tid, a.r, a.c, " + ", ".join(f"max(b.elev) FILTER (b.r - a.r = {i - 2} AND b.c - a.c = {j - 2}) AS z{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + """
  FROM cell a JOIN cell b ON a.tid = b.tid AND b.r IN (a.r - 1, a.r, a.r + 1) AND b.c IN (a.c - 1, a.c, a.c + 1) GROUP BY ALL)"""
SLOPE = ZS + f""", dxy AS (SELECT tid, r, c, ((z13 + 2 * z23 + z33) - (z11 + 2 * z21 + z31)) / 240e0 AS dx, ((z31 + 2 * z32 + z33) - (z11 + 2 * z12 + z13)) / 240e0 AS dy FROM nb),
sa AS (SELECT tid, r, c, atan(sqrt(dx * dx + dy * dy)) AS slope, {_mod('atan2(-dx, dy)')} AS a0 FROM dxy),
asp AS (SELECT tid, r, c, slope, CASE WHEN slope >= 0.3e0 THEN a0 END AS aspect FROM sa)"""


@query("slope_aspect", f"WITH {SLOPE} SELECT tid, r, c, {R('slope')} AS slope, {R('aspect')} AS aspect FROM asp")
def slope_aspect(spark, sf):
    return terrain.slope_aspect(T.band_cells(spark, sf), min_slope=0.3)


@query("focal_circular", f"""
WITH {CELL}, f AS (
  SELECT a.tid, a.r, a.c, count(*) AS n, sum(sin(12e0 * b.v)) AS s, sum(cos(12e0 * b.v)) AS k
  FROM cell a JOIN cell b ON a.tid = b.tid AND b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY ALL)
SELECT tid, r, c, n, {R(_mod('atan2(s, k)'), 5)} AS focal_mean, {R('sqrt(-2 * ln(least(1e0, sqrt(s * s + k * k) / n)))', 5)} AS focal_sd FROM f""")
def focal_circular(spark, sf):
    out = terrain.focal_circular(T.band_cells(spark, sf), 12.0 * F.col("v"), 5)
    return out.withColumns({x: F.round(x, 5) for x in ("focal_mean", "focal_sd")})


CODES = "codes AS (SELECT * FROM (VALUES (0, 1, 1), (1, 1, 2), (1, 0, 4), (1, -1, 8), (0, -1, 16), (-1, -1, 32), (-1, 0, 64), (-1, 1, 128)) s(dr, dc, code))"
DOWN = f"""{CODES}, down AS (
  SELECT a.tid, a.r, a.c, code FROM cell a CROSS JOIN codes JOIN cell b ON b.tid = a.tid AND b.r = a.r + dr AND b.c = a.c + dc WHERE a.elev > b.elev
  QUALIFY row_number() OVER (PARTITION BY a.tid, a.r, a.c ORDER BY (a.elev - b.elev) / sqrt((dr * dr + dc * dc)::DOUBLE) DESC, code) = 1)"""


@query("flow_direction", f"WITH {CELL}, {DOWN} SELECT tid, r, c, code FROM down")
def flow_direction(spark, sf):
    return terrain.flow_direction(T.band_cells(spark, sf))


@query("flow_direction_uphill", f"""WITH {CELL}, {CODES} SELECT a.tid, a.r, a.c, code FROM cell a CROSS JOIN codes JOIN cell b ON b.tid = a.tid AND b.r = a.r + dr AND b.c = a.c + dc WHERE b.elev > a.elev
  QUALIFY row_number() OVER (PARTITION BY a.tid, a.r, a.c ORDER BY b.elev - a.elev, code) = 1""")
def flow_direction_uphill(spark, sf):
    return terrain.flow_direction(T.band_cells(spark, sf), uphill=True)


@query("tangential_curvature", f"""
WITH {ZS}, q AS (SELECT tid, r, c, ((z21 + z23) / 2 - z22) / 900e0 AS d, ((z12 + z32) / 2 - z22) / 900e0 AS e, (-z11 + z13 + z31 - z33) / 3600e0 AS f, (-z21 + z23) / 60e0 AS g, (z12 - z32) / 60e0 AS h
  FROM nb WHERE z11 IS NOT NULL AND z13 IS NOT NULL AND z31 IS NOT NULL AND z33 IS NOT NULL)
SELECT tid, r, c, {R('CASE WHEN g * g + h * h = 0 THEN 0e0 ELSE -2 * (d * h * h + e * g * g - f * g * h) / (g * g + h * h) END')} AS curvature FROM q""")
def tangential_curvature(spark, sf):
    return terrain.tangential_curvature(T.band_cells(spark, sf))


_KERNEL = terrain.inverse_distance_kernel(2)


@query("inverse_distance_focal", f"""
WITH {CELL}, kern AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b}, {w!r}e0)' for a, b, w in _KERNEL)}) s(dr, dc, w))
SELECT a.tid, a.r, a.c, {R('sum(b.v * w)')} AS focal FROM cell a CROSS JOIN kern JOIN cell b ON b.tid = a.tid AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.tid, a.r, a.c""")
def inverse_distance_focal(spark, sf):
    return terrain.kernel_focal(T.band_cells(spark, sf), _KERNEL)


@query("rasterize_aggregate", f"""
WITH {POINT}, m AS (SELECT r, c, avg(value) AS mean_value, count(*) AS n_points FROM raw_point GROUP BY r, c),
n AS (SELECT r, c, class, count(*) AS n FROM raw_point WHERE class IS NOT NULL GROUP BY ALL),
k AS (SELECT r, c, class FROM n QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY n DESC, class) = 1)
SELECT r, c, {R('mean_value')} AS mean_value, n_points, class FROM m LEFT JOIN k USING (r, c)""")
def rasterize_aggregate(spark, sf):
    return grid.rasterise(T.raw_points(spark, sf))


_COS, _SIN = math.cos(-0.3), math.sin(-0.3)


@query("rotate_band", f"""
WITH {CELL}, sub AS (SELECT tid, v, veg_class, r - 1 + y AS y, c - 1 + x AS x FROM cell, (VALUES (0.25e0), (0.75e0)) a(y), (VALUES (0.25e0), (0.75e0)) b(x)),
rot AS (SELECT tid, v, veg_class, (floor(x * ({_SIN!r}e0) + y * {_COS!r}e0) + 1)::INT AS r, (floor(x * {_COS!r}e0 - y * ({_SIN!r}e0)) + 1)::INT AS c FROM sub),
m AS (SELECT tid, r, c, avg(v) AS mean_value, count(*) AS n_points FROM rot GROUP BY tid, r, c),
n AS (SELECT tid, r, c, veg_class, count(*) AS n FROM rot GROUP BY ALL),
k AS (SELECT tid, r, c, veg_class FROM n QUALIFY row_number() OVER (PARTITION BY tid, r, c ORDER BY n DESC, veg_class) = 1)
SELECT tid, r, c, {R('mean_value')} AS mean_value, n_points, veg_class FROM m JOIN k USING (tid, r, c)""")
def rotate_band(spark, sf):
    return grid.rotate_band(T.band_cells(spark, sf), 0.3)


@query("mosaic_overlap_mean", f"WITH {POINT}, t AS (SELECT r, c, tile, avg(value) AS value FROM raw_point GROUP BY ALL) SELECT r, c, {R('avg(value)')} AS value, count(*) AS n_tiles FROM t GROUP BY r, c")
def mosaic_overlap_mean(spark, sf):
    return T.mosaic(T.raw_points(spark, sf))


@query("reproject_bilinear", f"""
WITH {CELL}, t AS (SELECT tid, r * 0.7e0 + 1.3e0 AS y, c * 0.9e0 + 0.45e0 AS x FROM cell),
j AS (SELECT t.tid, y, x, (1 - abs(y - k.r)) * (1 - abs(x - k.c)) AS w, k.v FROM t JOIN cell k ON k.tid = t.tid AND k.r IN (floor(y), floor(y) + 1) AND k.c IN (floor(x), floor(x) + 1))
SELECT tid, {R('y')} AS y, {R('x')} AS x, {R('sum(w * v) / sum(w)')} AS v FROM j WHERE w > 0 GROUP BY tid, y, x""")
def reproject_bilinear(spark, sf):
    cells = T.band_cells(spark, sf)
    return T.reproject_bilinear(cells, cells.select("tid", (F.col("r") * 0.7 + 1.3).alias("y"), (F.col("c") * 0.9 + 0.45).alias("x")))


@query("transect_long", f"WITH {CELL} SELECT tid, {R('elev')} AS x, veg1::DOUBLE AS y, c AS cols, r AS rows FROM cell WHERE veg1 IS NOT NULL")
def transect_long(spark, sf):
    return grid.long_table(T.band_cells(spark, sf), "elev", "veg1")


@query("transect_grids_wide", f"""WITH {CELL} SELECT tid, c AS cols, r AS rows, {R('elev')} AS env, coalesce(veg1, 0) AS veg1, coalesce(veg2, 0) AS veg2, s.n_cells
FROM cell JOIN (SELECT tid, count(veg1) AS n_cells FROM cell GROUP BY tid) s USING (tid)""")
def transect_grids_wide(spark, sf):
    cells = T.band_cells(spark, sf)
    descriptors = cells.groupBy("tid").agg(F.count("veg1").alias("n_cells"))
    layers = cells.select("tid", F.col("c").alias("cols"), F.col("r").alias("rows"), F.col("elev").alias("env"), *(F.coalesce(v, F.lit(0)).alias(v) for v in ("veg1", "veg2")))
    return layers.join(descriptors, "tid", "left")


@query("set_ops", """
WITH a AS (SELECT DISTINCT p_size AS code FROM part WHERE p_partkey % 3 = 0), b AS (SELECT DISTINCT p_size AS code FROM part WHERE p_partkey % 7 = 1)
SELECT 'both' AS part, code FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', code FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', code FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def set_ops(spark, sf):
    rat = T.attribute_table(spark, sf)
    a, b = (rat.where(cond).select(F.col("level3").alias("code")).distinct() for cond in ("value % 3 = 0", "value % 7 = 1"))
    named = lambda name, df: df.select(F.lit(name).alias("part"), "code")
    return named("both", a.intersect(b)).union(named("only_a", a.subtract(b))).union(named("either", a.union(b).distinct()))


@query("top_k", f"WITH {CELL} SELECT tid, r, c, {R('elev')} AS elev FROM cell QUALIFY row_number() OVER (PARTITION BY tid ORDER BY elev DESC, r, c) <= 3")
def top_k(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("tid").orderBy(F.desc("elev"), "r", "c")
    return T.band_cells(spark, sf).withColumn("place", F.row_number().over(w)).where("place <= 3").select(*KEYS, "elev")


@query("scalar_functions", f"""
WITH {CELL}, x AS (SELECT tid, r, c, v FROM cell)
SELECT tid, r, c, {R('1 / (1 + exp(-3e0 * (v - 0.1e0)))')} AS sigmoid, {R('0.1e0 - ln(1 / (1 / (1 + exp(-3e0 * (v - 0.1e0)))) - 1) / 3e0')} AS back, CASE WHEN v < 0 THEN 0e0 WHEN v > 0 THEN 1e0 ELSE 0.5e0 END AS step,
  {R('sign(v) * ln(1 + abs(v * 100))')} AS t17, {R('v * 100')} AS t17_back, {R(_mod('7e0 * v'))} AS wrapped, {R(_mod(f'v * 9 - 1e0 + {math.pi!r}e0') + f' - {math.pi!r}e0')} AS turn, {R('v * (5e0 - -3e0) + -3e0')} AS from_unit, {R('(v - -1e0) / 3e0')} AS to_unit,
  {R('c * cos(0.5e0) - r * sin(0.5e0)')} AS x_rot, {R('c * sin(0.5e0) + r * cos(0.5e0)')} AS y_rot, lpad(tid::VARCHAR, 3, '0') AS flag
FROM x""")
def scalar_functions(spark, sf):
    cells = T.band_cells(spark, sf)
    v = F.col("v")
    x, y = S.rotate(F.col("c").cast("double"), F.col("r").cast("double"), F.lit(0.5))
    return cells.select(
        *KEYS, S.sigmoidal(v, 0.1, 3.0).alias("sigmoid"), S.sigmoidal_inverse(S.sigmoidal(v, 0.1, 3.0), 0.1, 3.0).alias("back"), S.heaviside(v, 0.5).alias("step"), S.signed_log(v * 100).alias("t17"), S.signed_exp(S.signed_log(v * 100)).alias("t17_back"),
        S.wrap(7.0 * v).alias("wrapped"), S.angle_difference(v * 9, F.lit(1.0)).alias("turn"), S.from_unit(v, -3.0, 5.0).alias("from_unit"), S.to_unit(v, -1.0, 2.0).alias("to_unit"), x.alias("x_rot"), y.alias("y_rot"), S.padded_flag(F.col("tid"), 100).alias("flag"),
    )


@query("bearing_distance", f"""
WITH {CELL}, p AS (SELECT DISTINCT tid, -110e0 + tid * 0.1e0 AS lon1, 40e0 + tid * 0.05e0 AS lat1, -109.7e0 + tid * 0.02e0 AS lon2, 40.4e0 - tid * 0.03e0 AS lat2 FROM cell),
h AS (SELECT *, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS h FROM p)
SELECT tid, {R('2 * 6378137e0 * asin(sqrt(least(1e0, h)))', 3)} AS length_m, {R('degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))))')} AS bearing FROM h""")
def bearing_distance(spark, sf):
    t = F.col("tid")
    ends = (-110.0 + t * 0.1, 40.0 + t * 0.05, -109.7 + t * 0.02, 40.4 - t * 0.03)
    return T.band_cells(spark, sf).select("tid").distinct().select("tid", F.round(S.haversine_m(*ends), 3).alias("length_m"), S.bearing_deg(*ends).alias("bearing"))


@query("result_wide", f"WITH {CELL} SELECT tid, max(veg1)::DOUBLE AS has_veg1, {R('avg(elev)')} AS mean_elev, {R('max(elev)')} AS max_elev FROM cell GROUP BY tid")
def result_wide(spark, sf):
    wide = T.band_cells(spark, sf).groupBy("tid").agg(F.max("veg1").alias("has_veg1"), F.avg("elev").alias("mean_elev"), F.max("elev").alias("max_elev"))
    return results.to_wide(results.to_long(wide, ["tid"]), ["tid"], ["has_veg1", "mean_elev", "max_elev"])


@query("result_merge", f"""WITH {CELL}, o AS (SELECT tid, 'mean' AS metric, avg(elev) AS value FROM cell GROUP BY tid), n AS (SELECT tid, 'mean' AS metric, max(elev) AS value FROM cell WHERE tid % 2 = 0 GROUP BY tid)
SELECT tid, metric, {R('value')} AS value FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE tid NOT IN (SELECT tid FROM n))""")
def result_merge(spark, sf):
    cells = T.band_cells(spark, sf)
    old = results.to_long(cells.groupBy("tid").agg(F.avg("elev").alias("mean")), ["tid"])
    return results.merged(old, results.to_long(cells.where("tid % 2 = 0").groupBy("tid").agg(F.max("elev").alias("mean")), ["tid"]), ["tid"])


WORK = """tids AS (SELECT DISTINCT (vec_id // 50)::INT AS tid FROM embeddings),
work AS (SELECT * FROM tids, (VALUES (64), (32)) a(nb), (VALUES ('AllMigration'), ('OnlyGoodMigration')) b(migtype), (VALUES ('danz1d'), ('danz2d'), ('eppinga'), ('gastner')) m(method))"""


@query("pending_work", f"WITH {WORK} SELECT tid, nb, migtype, method FROM work WHERE NOT (tid % 2 = 0 AND tid % 3 >= 2)")
def pending_work(spark, sf):
    work = results.work_items(T.band_cells(spark, sf).select("tid").distinct())
    log = work.where("tid % 2 = 0").withColumn("version", F.col("tid") % 3)
    return results.pending(work, log, 2)


@query("max_timing", "SELECT round(max(value) + 2, 6) + 0e0 AS max_time_h FROM events")
def max_timing(spark, sf):
    return T.max_timing(T.read(spark, sf, "events"), "value")


@query("veg_prevalence_packing", f"""
WITH {CELL} {ABUT}, sh AS (SELECT tid, count(veg1) / 3200e0 AS p1, count(veg2) / 3200e0 AS p2 FROM cell GROUP BY tid),
buf AS (SELECT DISTINCT b.tid, b.r, b.c FROM abut a JOIN cell b ON a.tid = b.tid AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
n AS (SELECT tid, count(*) AS n_border FROM abut GROUP BY tid), m AS (SELECT tid, count(*) AS n_buffer FROM buf GROUP BY tid)
SELECT tid, {R('p1')} AS p1, {R('p2')} AS p2, n_border, n_buffer, {R('n_buffer / n_border')} AS packing FROM sh LEFT JOIN n USING (tid) LEFT JOIN m USING (tid)""")
def veg_prevalence_packing(spark, sf):
    return results.prevalence(T.band_cells(spark, sf))


def aspects(cells, min_slope: float = 0.3):
    return terrain.slope_aspect(cells, min_slope=min_slope)
