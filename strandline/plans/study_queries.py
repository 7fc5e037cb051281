"""Queries of whole studies: candidate lines, band rectangles, methods and versions, task states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import TransectType
from ..functions import scalars as S
from ..operators import band, profile, study
from ..sources import tables as T
from .base import CELL, POINT, R, query
from .grid_queries import KEYS, aspects
from .measure_queries import LPTS, WORK_SQL, _starts


@query("point_in_band", f"""
WITH {CELL}, b AS (SELECT DISTINCT tid, 5e0 + tid AS x0, 4e0 AS y0, 50e0 - tid AS x1, 40e0 AS y1 FROM cell),
l AS (SELECT cell.tid, c::DOUBLE AS x, r::DOUBLE AS y, x0, y0, (x1 - x0) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS ux, (y1 - y0) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS uy, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS n FROM cell JOIN b USING (tid)),
a AS (SELECT tid, x, y, n, (x - x0) * ux + (y - y0) * uy AS along, (y - y0) * ux - (x - x0) * uy AS across FROM l)
SELECT tid, x, y, {R('along')} AS along, {R('across')} AS across FROM a WHERE along BETWEEN 0 AND n AND abs(across) <= 4.7e0""")
def point_in_band(spark, sf):
    cells, t = T.band_cells(spark, sf), F.col("tid")
    bands = cells.select("tid").distinct().select("tid", (5.0 + t).alias("x0"), F.lit(4.0).alias("y0"), (50.0 - t).alias("x1"), F.lit(40.0).alias("y1"))
    return study.in_band(cells.select("tid", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y")), bands, 9.4)


@query("distance_from_points", f"WITH {CELL}, {LPTS}, p AS (SELECT * FROM pts UNION ALL SELECT tid, 1, 1 FROM pts) SELECT tid, r, c, {R('min(sqrt(((r - r0) * (r - r0) + (c - c0) * (c - c0))::DOUBLE)) * 30')} AS dist_m FROM cell JOIN p USING (tid) GROUP BY tid, r, c")
def distance_from_points(spark, sf):
    cells = T.band_cells(spark, sf)
    starts = _starts(cells)
    return study.distance_from_points(cells, starts.select("tid", F.col("r0").cast("int"), F.col("c0").cast("int")).union(starts.select("tid", F.lit(1), F.lit(1))))


@query("elongated_line", f"""WITH {CELL}, {LPTS}, e AS (SELECT tid, r0, c0, r AS r1, c AS c1 FROM cell JOIN pts USING (tid) WHERE abs(r - r0) <= 7 AND abs(c - c0) <= 7 QUALIFY row_number() OVER (PARTITION BY tid ORDER BY elev DESC, r, c) = 1)
SELECT tid, r0, c0, greatest(1, least(50, floor(r1 + 1.5e0 * (r1 - r0) + 0.5e0)))::INT AS r1, greatest(1, least(64, floor(c1 + 1.5e0 * (c1 - c0) + 0.5e0)))::INT AS c1 FROM e""")
def elongated_line(spark, sf):
    from ..operators.lines import highest_in_window

    cells = T.band_cells(spark, sf)
    return study.elongated(highest_in_window(cells, _starts(cells), 15).drop("top"), 1.5, 50, 64)


@query("utm_zone", "SELECT DISTINCT (vec_id % 360 - 180)::INT AS lon, (floor((vec_id % 360 - 180 + 180) / 6) + 1)::INT AS zone FROM embeddings")
def utm_zone(spark, sf):
    lon = T.read(spark, sf, "embeddings").select((F.col("vec_id") % 360 - 180).cast("int").alias("lon")).distinct()
    return lon.select("lon", study.utm_zone(F.col("lon")).alias("zone"))


def _candidates(kind):
    def run(spark, sf):
        cells = T.band_cells(spark, sf)
        return study.candidate_lines(kind, cells, _starts(cells), 21, aspects(cells) if kind is TransectType.HOMOGENEOUS_ASPECT else None)

    return run


for _kind in TransectType:
    query(f"candidate_lines_{_kind.name.lower()}")(_candidates(_kind))


@query("task_states", f"""WITH {WORK_SQL}, f AS (SELECT tid, count(*) FILTER (nb = 64 OR tid % 3 <> 0) = 2 AS ok FROM (SELECT DISTINCT tid, nb FROM work) GROUP BY tid)
SELECT tid, CASE WHEN tid % 5 = 4 THEN 'error' WHEN ok THEN 'located' ELSE 'notransect' END AS state FROM f""")
def task_states(spark, sf):
    tids = T.band_cells(spark, sf).select("tid").distinct()
    windows = tids.withColumn("nb", F.explode(F.array(F.lit(64), F.lit(32)))).withColumn("found", F.expr("nb = 64 or tid % 3 <> 0"))
    return study.task_states(windows, 2, tids.where("tid % 5 = 4"))


@query("measure_pending")
def measure_pending(spark, sf):
    cells = T.band_cells(spark, sf)
    work = cells.select("tid").distinct().withColumn("method", F.explode(F.array(*map(F.lit, study.METHODS))))
    return study.measure_pending(cells, work, work.where("tid % 2 = 0").withColumn("version", F.lit(3)))


@query("zone_ends")
def zone_ends(spark, sf):
    return study.zone_ends(T.band_cells(spark, sf))


@query("cell_of_point", f"WITH {CELL} SELECT p.tid, p.x, p.y, k.r, k.c, {R('k.elev')} AS elev FROM (SELECT tid, c * 29.7e0 AS x, r * 29.9e0 AS y FROM cell) p JOIN cell k ON k.tid = p.tid AND k.r = floor(p.y / 30) + 1 AND k.c = floor(p.x / 30) + 1")
def cell_of_point(spark, sf):
    """Of a point in every cell."""
    cells = T.band_cells(spark, sf)
    points = cells.select("tid", (F.col("c") * 29.7).alias("x"), (F.col("r") * 29.9).alias("y"))
    place = points.withColumns({"r": (F.floor(F.col("y") / 30) + 1).cast("int"), "c": (F.floor(F.col("x") / 30) + 1).cast("int")})
    return place.join(cells.select(*KEYS, "elev"), KEYS).select("tid", "x", "y", "r", "c", "elev")


# every third band leaves the window
BAND_LINES = """
bline AS (SELECT tid, line_id, 8e0 + tid % 20 + line_id AS x0, CASE WHEN tid % 3 = 2 THEN 3e0 ELSE 10e0 END AS y0, 57e0 - tid % 7 AS x1, 38e0 - 5 * line_id AS y1 FROM (SELECT DISTINCT tid FROM cell), (VALUES (0), (1)) l(line_id)),
bdir AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM bline),
brect AS (SELECT *, (x1 - x0) / len AS ux, (y1 - y0) / len AS uy FROM bdir)"""
#: The stated definition over all cells: corners of the rectangle against the window, then each point of each cell by itself.
CANDIDATE_BAND = BAND_LINES + """,
bwin AS (SELECT tid, min(c) - 1e0 AS wx0, max(c) AS wx1, min(r) - 1e0 AS wy0, max(r) AS wy1 FROM cell GROUP BY tid),
bcorner AS (SELECT tid, line_id, x + a * 6 * uy AS x, y - a * 6 * ux AS y FROM (SELECT tid, line_id, ux, uy, x0 AS x, y0 AS y FROM brect UNION ALL SELECT tid, line_id, ux, uy, x1, y1 FROM brect), (VALUES (-1), (1)) s(a)),
bin AS (SELECT tid, line_id FROM bcorner JOIN bwin USING (tid) GROUP BY tid, line_id HAVING bool_and(x >= wx0 AND x <= wx1 AND y >= wy0 AND y <= wy1)),
bpt AS (SELECT b.tid, b.line_id, elev, veg_class, len, c - 1 + (i + 0.5e0) / 8 - x0 AS px, r - 1 + (j + 0.5e0) / 8 - y0 AS py, ux, uy FROM cell JOIN brect b ON b.tid = cell.tid JOIN bin ON bin.tid = b.tid AND bin.line_id = b.line_id, range(8) s(i), range(8) t(j)),
bturn AS (SELECT tid, line_id, elev, veg_class, px * ux + py * uy AS along, py * ux - px * uy + 6e0 AS across, len FROM bpt),
bcell AS (SELECT tid, line_id, (floor(across) + 1)::INT AS r, (floor(along) + 1)::INT AS c, elev, veg_class FROM bturn WHERE along >= 0 AND along < len AND across >= 0 AND across < 12),
bmean AS (SELECT tid, line_id, r, c, avg(elev) AS mean_value, count(*) AS n_points FROM bcell GROUP BY ALL),
bmode AS (SELECT tid, line_id, r, c, veg_class FROM (SELECT tid, line_id, r, c, veg_class, count(*) AS n FROM bcell GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tid, line_id, r, c ORDER BY n DESC, veg_class) = 1),
band AS (SELECT tid, line_id, r, c, (c - 0.5e0) * 30 AS dist_m, mean_value, veg_class, CASE WHEN veg_class IN (0, 1, 2) THEN 1 END AS veg1, CASE WHEN veg_class IN (5, 6) THEN 1 END AS veg2, n_points FROM bmean JOIN bmode USING (tid, line_id, r, c))"""


def _band_lines(cells):
    t, i = F.col("tid"), F.col("line_id")
    tids = cells.select("tid").distinct().withColumn("line_id", F.explode(F.array(F.lit(0), F.lit(1))))
    return tids.select("tid", "line_id", (8.0 + t % 20 + i).alias("x0"), F.when(t % 3 == 2, 3.0).otherwise(10.0).alias("y0"), (57.0 - t % 7).alias("x1"), (38.0 - 5 * i).alias("y1"))


def _band(spark, sf):
    cells = T.band_cells(spark, sf)
    return band.candidate_band(cells, _band_lines(cells), 12, 8, (0, 1, 2), (5, 6))


@query("candidate_band", f"WITH {CELL}, {CANDIDATE_BAND} SELECT tid, line_id, r, c, {R('dist_m')} AS dist_m, {R('mean_value')} AS mean_value, veg_class, veg1, veg2, n_points FROM band")
def candidate_band(spark, sf):
    return _band(spark, sf)


@query("candidate_band_density", f"""WITH {CELL}, {CANDIDATE_BAND}, n AS (SELECT tid, line_id, c, count(veg1) / 12e0 AS d1, count(veg2) / 12e0 AS d2 FROM band GROUP BY ALL)
SELECT tid, line_id, veg, c, {R('d')} AS d FROM n CROSS JOIN LATERAL (VALUES ('veg1', d1), ('veg2', d2)) x(veg, d)""")
def candidate_band_density(spark, sf):
    return profile.densities(_band(spark, sf), keys=("tid", "line_id"), n_rows=12)


@query("band_extents", f"""WITH {CELL}, {BAND_LINES}, b AS (SELECT tid, line_id, least(x0, x1) - 6 * abs(uy) AS x_a, least(y0, y1) - 6 * abs(ux) AS y_a, greatest(x0, x1) + 6 * abs(uy) AS x_b, greatest(y0, y1) + 6 * abs(ux) AS y_b FROM brect),
e AS (SELECT tid, min(c) - 1e0 AS x_a, min(r) - 1e0 AS y_a, max(c)::DOUBLE AS x_b, max(r)::DOUBLE AS y_b FROM cell WHERE veg1 = 1 GROUP BY tid),
j AS (SELECT b.tid, line_id, least(e.x_a, b.x_a) AS u1, least(e.y_a, b.y_a) AS u2, greatest(e.x_b, b.x_b) AS u3, greatest(e.y_b, b.y_b) AS u4, greatest(e.x_a, b.x_a) AS i1, greatest(e.y_a, b.y_a) AS i2, least(e.x_b, b.x_b) AS i3, least(e.y_b, b.y_b) AS i4,
  e.x_a = least(e.x_a, b.x_a) AND e.y_a = least(e.y_a, b.y_a) AND e.x_b = greatest(e.x_b, b.x_b) AND e.y_b = greatest(e.y_b, b.y_b) AS contains FROM b JOIN e USING (tid))
SELECT tid, line_id, {R('u1')} AS u_xmin, {R('u2')} AS u_ymin, {R('u3')} AS u_xmax, {R('u4')} AS u_ymax,
  CASE WHEN i1 <= i3 AND i2 <= i4 THEN {R('i1')} END AS i_xmin, CASE WHEN i1 <= i3 AND i2 <= i4 THEN {R('i2')} END AS i_ymin, CASE WHEN i1 <= i3 AND i2 <= i4 THEN {R('i3')} END AS i_xmax, CASE WHEN i1 <= i3 AND i2 <= i4 THEN {R('i4')} END AS i_ymax, contains FROM j""")
def band_extents(spark, sf):
    """The rectangles of lines against the extent of a vegetation type."""
    cells = T.band_cells(spark, sf)
    rectangles = band.band_rectangles(_band_lines(cells), 12).select("tid", "line_id", *band.EXTENT)
    held = band.grid_extents(cells.where("veg1 = 1")).join(rectangles.select("tid", "line_id"), "tid")
    return band.extent_relations(held, rectangles, ("tid", "line_id"))


@query("mosaic_like_first", f"""WITH {POINT}, g AS (SELECT r, c, value, flag AS tile, CASE flag WHEN 'N' THEN 10e0 ELSE 30e0 END AS res_m FROM raw_point),
k AS (SELECT * FROM g WHERE res_m = (SELECT res_m FROM g ORDER BY tile LIMIT 1)), t AS (SELECT r, c, tile, avg(value) AS value FROM k GROUP BY ALL)
SELECT r, c, {R('avg(value)')} AS value, count(*) AS n_tiles FROM t GROUP BY r, c""")
def mosaic_like_first(spark, sf):
    """Tiles of another cell size than the first are left out of the mosaic."""
    points = T.raw_points(spark, sf).select("r", "c", "value", F.col("flag").alias("tile"), F.when(F.col("flag") == "N", 10.0).otherwise(30.0).alias("res_m"))
    return T.mosaic(T.like_first(points, fields=("res_m",)))


@query("elapsed_times", f"SELECT user_id AS tid, strftime(min(ts), '%Y%m%d-%H%M%S') AS began, {R('(epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9')} AS hours FROM events GROUP BY user_id")
def elapsed_times(spark, sf):
    ends = T.read(spark, sf, "events").groupBy(F.col("user_id").alias("tid")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("tid", S.time_label(F.col("a")).alias("began"), S.hours_between(F.col("a"), F.col("b")).alias("hours"))
