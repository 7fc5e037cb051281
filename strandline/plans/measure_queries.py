"""Queries of patches, fronts, models, flow, zones, sampling and lines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..operators import fits, flow, fronts, grid, hull, lines, patches, profile, results, sampling, study, terrain, zones
from ..sources import tables as T
from .base import CELL, DENSITY, R, query, smooth, zone
from .grid_queries import ABUT, DOWN, KEYS, RESIDUAL, SLOPE, _mod, aspects, residuals
from .grid_queries import WORK as WORK_SQL
from .grid_queries import zones as zone_rows


def patch_sql(layer: str, queen: bool, name: str, extra: str = "") -> str:
    """name(tid, r, c, patch_id): labels fall to the least cell number that neighbours reach."""
    near = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1" if queen else "abs(a.r - b.r) + abs(a.c - b.c) <= 1"
    near = extra or near
    return f"""
{name}_n AS (SELECT tid, r, c, (r - 1) * 64 + c AS id FROM cell WHERE {layer} IS NOT NULL),
{name}_e AS (SELECT a.tid, a.id AS x, b.id AS y FROM {name}_n a JOIN {name}_n b ON a.tid = b.tid AND {near} AND a.id <> b.id),
{name}_w(tid, id, label) USING KEY (tid, id) AS (
  SELECT tid, id, id FROM {name}_n
  UNION
  SELECT tid, id, min(label) FROM (
    SELECT e.tid AS tid, e.y AS id, w.label AS label FROM {name}_w w JOIN {name}_e e ON e.tid = w.tid AND e.x = w.id JOIN recurring.{name}_w o ON o.tid = e.tid AND o.id = e.y WHERE w.label < o.label
  ) GROUP BY tid, id
), {name} AS (SELECT n.tid, n.r, n.c, w.label AS patch_id FROM {name}_n n JOIN {name}_w w ON w.tid = n.tid AND w.id = n.id)"""


P4, P8, PX = patch_sql("veg1", False, "p4"), patch_sql("veg1", True, "p8"), patch_sql("excl", True, "px")


@query("patches4", f"WITH RECURSIVE {CELL}, {P4} SELECT tid, r, c, patch_id::INT AS patch_id FROM p4")
def patches4(spark, sf):
    return patches.patches(T.band_cells(spark, sf), "veg1", grid.ROOK)


@query("patches8", f"WITH RECURSIVE {CELL}, {P8} SELECT tid, r, c, patch_id::INT AS patch_id FROM p8")
def patches8(spark, sf):
    return patches.patches(T.band_cells(spark, sf), "veg1", grid.QUEEN)


@query("patch_frequency", f"WITH RECURSIVE {CELL}, {P8}, s AS (SELECT tid, patch_id, count(*) AS n_cells FROM p8 GROUP BY ALL) SELECT tid, n_cells, count(*) AS n_patches FROM s GROUP BY ALL")
def patch_frequency(spark, sf):
    return patches.patch_sizes(patches8(spark, sf)).groupBy("tid", "n_cells").agg(F.count("*").alias("n_patches"))


@query("median_patch_radius", f"WITH RECURSIVE {CELL}, {P8}, s AS (SELECT tid, patch_id, count(*) AS n FROM p8 GROUP BY ALL) SELECT tid, {R('sqrt(quantile_cont(n, 0.5) * 900 / pi())')} AS median_radius_m FROM s GROUP BY tid")
def median_patch_radius(spark, sf):
    return patches.median_radius(patches8(spark, sf))


@query("human_footprint", f"""
WITH RECURSIVE {CELL}, {PX}, a AS (SELECT tid, count(excl) / 3200e0 AS area_fraction FROM cell GROUP BY tid),
m AS (SELECT tid, c FROM (SELECT tid, c, count(excl) AS n FROM cell GROUP BY tid, c) WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY tid ORDER BY n DESC, c) = 1),
s AS (SELECT tid, patch_id, count(*) AS n, max(c) - min(c) + 1 AS x, max(r) - min(r) + 1 AS y FROM px GROUP BY ALL),
b AS (SELECT tid, x, y FROM s QUALIFY row_number() OVER (PARTITION BY tid ORDER BY n DESC, patch_id) = 1)
SELECT a.tid, {R('area_fraction')} AS area_fraction, m.c * 30e0 AS mode_x_m, {R('b.x / 64e0')} AS x_extent, {R('b.y / 50e0')} AS y_extent FROM a LEFT JOIN m USING (tid) LEFT JOIN b USING (tid)""")
def human_footprint(spark, sf):
    return patches.human_footprint(T.band_cells(spark, sf))


BIG4 = "b4 AS (SELECT tid, patch_id FROM (SELECT tid, patch_id, count(*) AS n FROM p4 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tid ORDER BY n DESC, patch_id) = 1)"
PS = patch_sql("veg1", False, "ps", "(a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9")


@query("percolation_patch", f"""
WITH RECURSIVE {CELL}, {P4}, {BIG4}, {PS}
SELECT tid, r, c FROM ps WHERE (tid, patch_id) IN (SELECT ps.tid, ps.patch_id FROM ps JOIN p4 USING (tid, r, c) JOIN b4 ON b4.tid = p4.tid AND b4.patch_id = p4.patch_id)""")
def percolation_patch(spark, sf):
    return patches.percolation_patch(T.band_cells(spark, sf), "veg1", 3)


FRONT = "fr AS (SELECT tid, r, max(c) FILTER (veg1 = 1) AS front1, min(c) FILTER (veg2 = 1) AS front2 FROM cell GROUP BY tid, r)"
OPT = "opt AS (SELECT tid, round_even(n1 * 64e0 / (n1 + n2), 0) AS pos, n1, n2 FROM (SELECT tid, count(veg1) AS n1, count(veg2) AS n2 FROM cell GROUP BY tid))"
ADV = f"{FRONT}, {OPT}, adv AS (SELECT tid, r, (front1 - pos) * 30 AS d1, (front2 - pos) * 30 AS d2, sign(front1 - pos) * ln(1 + abs(front1 - pos) * 30) AS t1, sign(front2 - pos) * ln(1 + abs(front2 - pos) * 30) AS t2 FROM fr JOIN opt USING (tid))"


def advanced(spark, sf):
    cells = T.band_cells(spark, sf)
    return fronts.advancement(fronts.front_runners(cells), fronts.optimal_boundary(cells))


@query("front_runners", f"WITH {CELL}, {FRONT} SELECT tid, r, front1, front2 FROM fr")
def front_runners(spark, sf):
    return fronts.front_runners(T.band_cells(spark, sf))


@query("optimal_boundary", f"WITH {CELL}, {OPT} SELECT tid, pos::INT AS pos_cell, pos * 30e0 AS pos_m, {R('n1 / 3200e0')} AS density1, {R('n2 / 3200e0')} AS density2, {R('(n1 + n2) / 3200e0')} AS density_all FROM opt")
def optimal_boundary(spark, sf):
    return fronts.optimal_boundary(T.band_cells(spark, sf))


@query("advancement_t17", f"WITH {CELL}, {ADV} SELECT tid, " + ", ".join(f"{R(f'{f}({x}{i})')} AS {n}_{x}{i}" for x in "dt" for i in (1, 2) for n, f in (("mean", "avg"), ("sd", "stddev_samp"))) + ", coalesce(avg(t1) > 0 AND avg(t2) < 0, false) AS beyond FROM adv GROUP BY tid")
def advancement_t17(spark, sf):
    return fronts.advancement_summary(advanced(spark, sf))


def _lcg(x: str) -> str:
    return f"((({x})::BIGINT * 1103515245 + 12345) % 2147483648)"


def _boot(block: int) -> str:
    return f"""
WITH {CELL}, {ADV}, dl AS (SELECT tid, t1 + t2 AS delta, row_number() OVER (PARTITION BY tid ORDER BY r) - 1 AS i FROM adv WHERE t1 IS NOT NULL AND t2 IS NOT NULL),
sz AS (SELECT tid, count(*) AS n FROM dl GROUP BY tid),
dr AS (SELECT tid, rep, (({_lcg(_lcg(f'rep * 65536 + place // {block}'))} // 1024) + place % {block}) % n AS i FROM sz, range(1, 21) a(rep), LATERAL range(0, n) b(place))
SELECT dr.tid, rep::INT AS rep, {R('avg(delta)')} AS mean_delta FROM dr JOIN dl ON dl.tid = dr.tid AND dl.i = dr.i GROUP BY dr.tid, rep"""


@query("advancement_bootstrap_iid", _boot(1))
def advancement_bootstrap_iid(spark, sf):
    return fronts.bootstrap(advanced(spark, sf), 20)


@query("advancement_bootstrap_block", _boot(5))
def advancement_bootstrap_block(spark, sf):
    return fronts.bootstrap(advanced(spark, sf), 20, block=5)


@query("advancement_interval")
def advancement_interval(spark, sf):
    rows = advanced(spark, sf)
    return fronts.bootstrap_interval(fronts.bootstrap(rows, 500), rows)


@query("wilcoxon_signed_rank", f"""
WITH {CELL}, {ADV}, d AS (SELECT tid, round(t1 + t2, 9) AS d FROM adv WHERE t1 IS NOT NULL AND t2 IS NOT NULL),
k AS (SELECT tid, d, rank() OVER (PARTITION BY tid ORDER BY abs(d)) + (count(*) OVER (PARTITION BY tid, abs(d)) - 1) / 2e0 AS k FROM d),
s AS (SELECT tid, count(*) FILTER (d <> 0) AS n, coalesce(sum(k) FILTER (d > 0), 0) AS p, coalesce(sum(k) FILTER (d < 0), 0) AS m, coalesce(sum(k * k) FILTER (d <> 0), 0) AS s2 FROM k GROUP BY tid)
SELECT tid, n, {R('p')} AS w_plus, {R('m')} AS w_minus, {R('(p - m) / sqrt(nullif(s2, 0))')} AS z FROM s""")
def wilcoxon_signed_rank(spark, sf):
    return fronts.signed_ranks(advanced(spark, sf))


@query("wilcoxon_exact")
def wilcoxon_exact(spark, sf):
    return fronts.exact_signed_rank_p(advanced(spark, sf))


@query("retro_power")
def retro_power(spark, sf):
    return fronts.retro_power(advanced(spark, sf))


@query("advancement_tests")
def advancement_tests(spark, sf):
    return fronts.advancement_tests(advanced(spark, sf))


@query("linear_abruptness", f"""
WITH {DENSITY}, q AS (SELECT tid, veg, c::DOUBLE AS x, d AS y, min(c) OVER w AS xmin, max(c) OVER w - min(c) OVER w AS xr, min(d) OVER w AS ymin, max(d) OVER w - min(d) OVER w AS yr FROM dens WINDOW w AS (PARTITION BY tid, veg)),
u AS (SELECT tid, veg, xmin, xr, (x - xmin) / xr AS x1, (y - ymin) / yr AS y1 FROM q WHERE xr > 0 AND yr > 0),
f AS (SELECT tid, veg, regr_intercept(y1, x1) AS a, regr_slope(y1, x1) AS b, regr_r2(y1, x1) AS r2, count(*)::DOUBLE AS n, first(xmin) AS xmin, first(xr) AS xr, regr_syy(y1, x1) - regr_sxy(y1, x1) * regr_sxy(y1, x1) / regr_sxx(y1, x1) AS rss FROM u GROUP BY tid, veg)
SELECT tid, veg, """ + ", ".join(f"{R(f'xmin + ({p}e0 - a) / b * xr')} AS x{n}" for p, n in (("0.05", "05"), ("0.5", "50"), ("0.95", "95"))) + f""", {R('abs(0.9e0 / b * xr)')} AS width, {R('b')} AS slope, {R('b / xr')} AS slope_x, {R('r2')} AS r2, {R(f'n * ln({2 * math.pi!r}e0 * rss / n) + n + 6')} AS aic FROM f WHERE b <> 0 AND rss > 0""")
def linear_abruptness(spark, sf):
    return fits.linear_abruptness(profile.densities(T.band_cells(spark, sf)), "c", "d", ("tid", "veg"))


@query("sigmoid_abruptness")
def sigmoid_abruptness(spark, sf):
    return fits.sigmoid_abruptness(profile.densities(T.band_cells(spark, sf)), "c", "d", ("tid", "veg"))


def binary(spark, sf):
    return T.band_cells(spark, sf).select(*KEYS, (F.col("c") / 64.0).alias("x"), F.coalesce("veg2", F.lit(0)).alias("y"))


def _irls(rounds: int) -> str:
    out = f"WITH {CELL}, bin AS (SELECT tid, c / 64e0 AS x, coalesce(veg2, 0)::DOUBLE AS y FROM cell), b0 AS (SELECT tid, ln(avg(y) / (1 - avg(y))) AS b0, 0e0 AS b1 FROM bin GROUP BY tid HAVING avg(y) > 0 AND avg(y) < 1)"
    for i in range(rounds):
        out += f""", e{i} AS (SELECT tid, x, y, greatest(-30e0, least(30e0, b0 + b1 * x)) AS eta FROM bin JOIN b{i} USING (tid)), m{i} AS (SELECT tid, x, y, eta, 1 / (1 + exp(-eta)) AS mu FROM e{i}),
w{i} AS (SELECT tid, x, mu * (1 - mu) AS w, eta + (y - mu) / (mu * (1 - mu)) AS z FROM m{i}), s{i} AS (SELECT tid, sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * z) AS sz, sum(w * x * z) AS sxz FROM w{i} GROUP BY tid),
b{i + 1} AS (SELECT tid, (sxx * sz - sx * sxz) / (sw * sxx - sx * sx) AS b0, (sw * sxz - sx * sz) / (sw * sxx - sx * sx) AS b1 FROM s{i})"""
    return out + f" SELECT tid, {R('b0', 5)} AS b0, {R('b1', 5)} AS b1 FROM b{rounds}"


@query("logistic_glm", _irls(7))
def logistic_glm(spark, sf):
    out = fits.binomial_glm(binary(spark, sf), "x", "y")
    return out.select("tid", F.round("b0", 5).alias("b0"), F.round("b1", 5).alias("b1"))


@query("cloglog_glm")
def cloglog_glm(spark, sf):
    return fits.grouped_glm(binary(spark, sf), "x", "y", "cloglog")


@query("grouped_logistic_glm")
def grouped_logistic_glm(spark, sf):
    return fits.grouped_glm(binary(spark, sf), "x", "y")


@query("bernoulli_performance", f"""
WITH {CELL}, sc AS (SELECT tid, round(1 / (1 + exp(-0.2e0 * (c - 40))), 9) AS p, coalesce(veg2, 0) AS y FROM cell),
a AS (SELECT tid, p AS cut, sum(y) AS pos, count(*) AS n, sum((p - y) * (p - y)) AS sq FROM sc GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER d AS tp, sum(n - pos) OVER d AS fp, sum(pos) OVER g AS pp, sum(n) OVER g AS mm, sum(sq) OVER g AS ss FROM a WINDOW d AS (PARTITION BY tid ORDER BY cut DESC), g AS (PARTITION BY tid)),
x AS (SELECT *, mm - pp AS nn, tp / pp AS sens, 1 - fp / (mm - pp) AS spec, pp / mm AS prev FROM w WHERE pp > 0 AND mm > pp),
y AS (SELECT *, sens + spec - 1 AS tss, prev * sens + (1 - prev) * spec AS po FROM x),
z AS (SELECT *, (po - pe) / (1 - pe) AS kappa, pos * (nn - fp + (n - pos) / 2e0) AS wins FROM (SELECT *, -2 * tss * prev * (1 - prev) + po AS pe FROM y)),
q AS (SELECT *, round(max(tss) OVER (PARTITION BY tid), 9) AS tm, round(max(kappa) OVER (PARTITION BY tid), 9) AS km FROM z)
SELECT tid, {R('first(ss) / first(mm)')} AS brier, {R('sum(wins) / (first(pp) * first(nn))')} AS auc, {R('first(tm)')} AS tss, {R('avg(cut) FILTER (round(tss, 9) = tm)')} AS tss_cut, {R('avg(sens) FILTER (round(tss, 9) = tm)')} AS tss_sens, {R('avg(spec) FILTER (round(tss, 9) = tm)')} AS tss_spec, {R('first(km)')} AS kappa, {R('avg(cut) FILTER (round(kappa, 9) = km)')} AS kappa_cut FROM q GROUP BY tid""")
def bernoulli_performance(spark, sf):
    scored = T.band_cells(spark, sf).select("tid", F.round(1 / (1 + F.exp(-0.2 * (F.col("c") - 40))), 9).alias("p"), F.coalesce("veg2", F.lit(0)).alias("y"))
    return fits.bernoulli_performance(scored)


@query("global_glm")
def global_glm(spark, sf):
    cells = T.band_cells(spark, sf)
    rows = cells.select(F.coalesce("veg2", F.lit(0)).cast("double").alias("y"), (F.col("c") / 64.0).alias("x"), (F.col("r") / 50.0).alias("rows"), F.col("tid").cast("string").alias("transect"))
    return fits.global_glm(rows, "y ~ x + rows + transect")


@query("glmm_pql")
def glmm_pql(spark, sf):
    return fits.mixed_pql(binary(spark, sf), "x", "y").drop("b_auto")


@query("glmm_rac")
def glmm_rac(spark, sf):
    rows = binary(spark, sf)
    beta = fits.binomial_glm(rows, "x", "y").select("tid", "b0", "b1")
    res = rows.join(beta, "tid").withColumn("res", F.col("y") - 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * F.col("x")))))
    auto = terrain.kernel_focal(res, terrain.inverse_distance_kernel(5), "res")
    return fits.mixed_pql(rows.join(auto, KEYS), "x", "y", autocovariate="focal")


def _edge(spark, sf, step: int = 1):
    return hull.hull_edge(patches.percolation_patch(T.band_cells(spark, sf), "veg1", step), step, False)


@query("hull_edge_walk")
def hull_edge_walk(spark, sf):
    return _edge(spark, sf)


@query("hull_edge_walk_step3")
def hull_edge_walk_step3(spark, sf):
    return _edge(spark, sf, 3)


@query("hull_edge_stats")
def hull_edge_stats(spark, sf):
    return hull.hull_stats(_edge(spark, sf))


@query("hull_gradient")
def hull_gradient(spark, sf):
    cells = T.band_cells(spark, sf)
    return hull.hull_gradient(_edge(spark, sf), cells.select(*KEYS, "elev").join(aspects(cells).select(*KEYS, "slope"), KEYS))


@query("struggle_zone_distance")
def struggle_zone_distance(spark, sf):
    return hull.struggle_zone(_edge(spark, sf), fronts.front_runners(T.band_cells(spark, sf)), "front2", False)


REACH = f"{DOWN}, nxt AS (SELECT tid, r, c, r + dr AS r2, c + dc AS c2 FROM down JOIN codes USING (code))"


def _doubling(rounds: int) -> str:
    """Pointer doubling: after k rounds every cell points 2^k steps on, or to the end of its path."""
    out = f"WITH {CELL}, {REACH}, j0 AS (SELECT tid, r, c, coalesce(r2, r) AS er, coalesce(c2, c) AS ec, (r2 IS NOT NULL)::BIGINT AS n FROM cell LEFT JOIN nxt USING (tid, r, c))"
    for i in range(rounds):
        out += f", j{i + 1} AS (SELECT a.tid, a.r, a.c, b.er, b.ec, a.n + b.n AS n FROM j{i} a JOIN j{i} b ON b.tid = a.tid AND b.r = a.er AND b.c = a.ec)"
    return out + f" SELECT tid, r, c, er::INT AS end_r, ec::INT AS end_c, n AS n_steps FROM j{rounds}"


@query("flow_path_reach", _doubling(9))
def flow_path_reach(spark, sf):
    cells = T.band_cells(spark, sf)
    return flow.flow_reach(cells.join(terrain.flow_direction(cells), KEYS, "left"))


def judged(spark, sf, layer: str = "veg1"):
    cells = T.band_cells(spark, sf)
    labelled = patches.patches(cells, layer, grid.ROOK)
    rows = cells.select(*KEYS).join(labelled, KEYS, "left").join(terrain.flow_direction(cells), KEYS, "left")
    return labelled, flow.migration(rows, layer == "veg2")


@query("good_bad_migration")
def good_bad_migration(spark, sf):
    return judged(spark, sf)[1]


@query("good_bad_migration_veg2")
def good_bad_migration_veg2(spark, sf):
    return judged(spark, sf, "veg2")[1]


@query("migration_tally")
def migration_tally(spark, sf):
    return flow.migration_tally(judged(spark, sf)[1])


@query("good_migration_cells")
def good_migration_cells(spark, sf):
    return flow.without_bad_migration(*judged(spark, sf))


ZONE = f"WITH {DENSITY}, {smooth()}, {zone()}, zn AS (SELECT tid, start_c AS s, end_c AS e FROM z_out)"
_ZCOND = {"below": "c <= s", "within": "c BETWEEN s AND e", "above": "c >= e"}


@query("interzone_location", f"""
{ZONE} {ABUT}, pr AS (
  SELECT k.tid, k.c, avg(elev) AS elev, count(veg1) / 50e0 AS d1, count(veg2) / 50e0 AS d2, count(a.r) / 50e0 AS abut FROM cell k LEFT JOIN abut a ON a.tid = k.tid AND a.r = k.r AND a.c = k.c GROUP BY k.tid, k.c
), g AS (SELECT *, abs(elev - lag(elev) OVER (PARTITION BY tid ORDER BY c)) AS gain FROM pr JOIN zn USING (tid)),
f AS (SELECT tid, s, e, min(elev) FILTER (c BETWEEN s AND e) AS elev_min, max(elev) FILTER (c BETWEEN s AND e) AS elev_max, max(elev) FILTER (c = s) AS elev_start, max(elev) FILTER (c = e) AS elev_end,
  coalesce(sum(gain) FILTER (c > s AND c <= e), 0) AS gain, count(*) FILTER (c < s) AS nb, count(*) FILTER (c > e) AS na, count(*) AS n, {', '.join(f"{f}({x}) FILTER ({cond}) AS {n}_{z}_{x}" for z, cond in _ZCOND.items() for x in ("d1", "d2", "abut") for n, f in (("mean", "avg"), ("sd", "stddev_samp")))} FROM g GROUP BY tid, s, e)
SELECT tid, s AS start, e AS "end", {R('elev_min')} AS elev_min, {R('elev_max')} AS elev_max, {R('elev_start')} AS elev_start, {R('elev_end')} AS elev_end, {R('gain')} AS gain_total, {', '.join(f"{R(f'{n}_{z}_{x}')} AS {n}_{z}_{x}" for z in _ZCOND for x in ("d1", "d2", "abut") for n in ("mean", "sd"))},
  (e - s) * 30e0 AS width_m, {R('abs(elev_end - elev_start) / ((e - s) * 30e0)')} AS slope_mpm, {R('degrees(atan(abs(elev_end - elev_start) / ((e - s) * 30e0)))')} AS slope_deg, {R('(gain - abs(elev_end - elev_start)) / ((e - s) * 30e0)')} AS roughness_mpm, {R('nb / n')} AS fraction_below, {R('na / n')} AS fraction_above FROM f""")
def interzone_location(spark, sf):
    cells = T.band_cells(spark, sf)
    border = grid.abutting(cells).withColumn("abut", F.lit(1))
    rows = cells.join(border, KEYS, "left").groupBy("tid", "c").agg(F.avg("elev").alias("elev"), *((F.count(v) / 50.0).alias(n) for v, n in (("veg1", "d1"), ("veg2", "d2"), ("abut", "abut"))))
    return zones.zone_location(rows, zone_rows(spark, sf))


@query("interzone_patch_distribution", f"""
{ZONE.replace('WITH', 'WITH RECURSIVE', 1)}, {P8}, sz AS (SELECT tid, patch_id, count(*) * 900e0 AS a FROM p8 GROUP BY ALL),
t AS (SELECT DISTINCT p8.tid, p8.patch_id, CASE WHEN c < s THEN 'below' WHEN c > e THEN 'above' ELSE 'within' END AS zone FROM p8 JOIN zn ON zn.tid = p8.tid)
SELECT t.tid, zone, count(*) AS n_patches, {R('quantile_cont(a, 0.5)')} AS median_area_m2, count(*) FILTER (a <= 1e4) AS n_small, count(*) FILTER (a > 1e4 AND a <= 1e6) AS n_middle, count(*) FILTER (a > 1e6) AS n_large FROM t JOIN sz ON sz.tid = t.tid AND sz.patch_id = t.patch_id GROUP BY t.tid, zone""")
def interzone_patch_distribution(spark, sf):
    return zones.zone_patches(patches8(spark, sf), zone_rows(spark, sf))


@query("morans_i", f"""
WITH {CELL}, {RESIDUAL}, d AS (SELECT tid, r, c, e - avg(e) OVER (PARTITION BY tid) AS d FROM res),
stp AS (SELECT x - 3 AS dr, y - 3 AS dc FROM range(7) a(x), range(7) b(y) WHERE (x, y) <> (3, 3)),
q AS (SELECT a.tid, a.r, a.c, a.d, b.d AS e FROM d a CROSS JOIN stp JOIN d b ON b.tid = a.tid AND b.r = a.r + dr AND b.c = a.c + dc QUALIFY row_number() OVER (PARTITION BY a.tid, a.r, a.c ORDER BY dr * dr + dc * dc, dr, dc) <= 8),
l AS (SELECT tid, r, c, first(d) * avg(e) AS k, first(d) * first(d) AS s FROM q GROUP BY tid, r, c)
SELECT tid, {R('sum(k) / sum(s)')} AS morans_i FROM l GROUP BY tid""")
def morans_i(spark, sf):
    return fits.morans_i(residuals(T.band_cells(spark, sf)), "e")


@query("morans_i_permuted")
def morans_i_permuted(spark, sf):
    return fits.morans_p(residuals(T.band_cells(spark, sf)), "e", permutations=199)


@query("semivariogram", f"""
WITH {CELL}, m AS (SELECT tid, c, avg(elev) - 1500 - 12 * c AS x FROM cell GROUP BY tid, c)
SELECT a.tid, (b.c - a.c)::INT AS lag, {R('avg((a.x - b.x) * (a.x - b.x)) / 2')} AS gamma, count(*) AS n_pairs FROM m a JOIN m b ON a.tid = b.tid AND b.c - a.c BETWEEN 1 AND 20 GROUP BY ALL""")
def semivariogram(spark, sf):
    return fits.semivariogram(_means(spark, sf), "x")


def _means(spark, sf):
    return T.band_cells(spark, sf).groupBy("tid", "c").agg((F.avg("elev") - 1500 - 12 * F.col("c")).alias("x"))


@query("variogram_range")
def variogram_range(spark, sf):
    return fits.variogram_range(fits.semivariogram(_means(spark, sf), "x"))


def _turn(x: str, az: float = 1.5 * math.pi) -> str:
    return f"({_mod(f'{x} - {az!r}e0 + {math.pi!r}e0')} - {math.pi!r}e0)"


@query("aspect_homogeneity", f"""
WITH {SLOPE}, t AS (SELECT tid, c, {_turn('aspect')} AS t FROM asp WHERE aspect IS NOT NULL),
m AS (SELECT tid, c, {_mod('atan2(sum(sin(aspect)), sum(cos(aspect)))')} AS m FROM asp WHERE aspect IS NOT NULL GROUP BY tid, c),
u AS (SELECT tid, {_turn('m')} AS t FROM m)
SELECT tid, {R('cell_rmse')} AS cell_rmse, {R('cell_q95')} AS cell_q95, {R('mean_turn')} AS mean_turn, {R('column_rmse')} AS column_rmse, {R('column_q95')} AS column_q95
FROM (SELECT tid, sqrt(avg(t * t)) AS cell_rmse, quantile_cont(abs(t), 0.95) AS cell_q95, avg(t) AS mean_turn FROM t GROUP BY tid) JOIN (SELECT tid, sqrt(avg(t * t)) AS column_rmse, quantile_cont(abs(t), 0.95) AS column_q95 FROM u GROUP BY tid) USING (tid)""")
def aspect_homogeneity(spark, sf):
    return zones.homogeneity(aspects(T.band_cells(spark, sf)), 1.5 * math.pi)


@query("elevation_ratio", f"""
WITH {CELL}, k AS (SELECT tid, c, max(elev) - min(elev) AS spread, avg(elev) AS m FROM cell GROUP BY tid, c), f AS (SELECT tid, abs(regr_slope(m, c * 30e0)) AS slope FROM k GROUP BY tid),
q AS (SELECT tid, spread / (slope * 1500e0) AS q FROM k JOIN f USING (tid) WHERE c > 1 AND c < 64)
SELECT tid, {R('sqrt(avg(q * q))')} AS ratio_rms, {R('quantile_cont(q, 0.95)')} AS ratio_q95, {R('max(q)')} AS ratio_max FROM q GROUP BY tid""")
def elevation_ratio(spark, sf):
    return zones.elevation_ratio(T.band_cells(spark, sf))


PRIORITY = "((tid::BIGINT * 4096 + r * 64 + c) * 1103515245 + 12345) % 2147483648"


def _vegetated(spark, sf):
    return T.band_cells(spark, sf).where("veg1 = 1 or veg2 = 1").select(*KEYS)


@query("search_points", f"WITH {CELL} SELECT tid, r, c, {PRIORITY} AS priority FROM cell WHERE veg1 = 1 OR veg2 = 1 ORDER BY priority, tid, r, c LIMIT 100")
def search_points(spark, sf):
    return sampling.search_points(_vegetated(spark, sf), 100)


@query("search_points_top_up", f"""
WITH {CELL}, a AS (SELECT tid, r, c, {PRIORITY} AS priority, r * c % 97 = 0 AS old FROM cell WHERE veg1 = 1 OR veg2 = 1) SELECT tid, r, c, priority FROM a ORDER BY old DESC, priority, tid, r, c LIMIT 700""")
def search_points_top_up(spark, sf):
    cells = _vegetated(spark, sf)
    return sampling.top_up(cells.where("r * c % 97 = 0"), cells, 700)


@query("search_points_inhibited")
def search_points_inhibited(spark, sf):
    return sampling.inhibited_points(_vegetated(spark, sf), 6.0)


LPTS = "pts AS (SELECT DISTINCT tid, tid % 30 + 10 AS r0, tid * 7 % 55 + 5 AS c0 FROM cell)"


def _starts(cells):
    return cells.select("tid").distinct().select("tid", (F.col("tid") % 30 + 10).alias("r0"), (F.col("tid") * 7 % 55 + 5).alias("c0"))


@query("max_in_window", f"WITH {CELL}, {LPTS} SELECT tid, r0, c0, r AS r1, c AS c1, {R('elev')} AS top FROM cell JOIN pts USING (tid) WHERE abs(r - r0) <= 7 AND abs(c - c0) <= 7 QUALIFY row_number() OVER (PARTITION BY tid ORDER BY elev DESC, r, c) = 1")
def max_in_window(spark, sf):
    cells = T.band_cells(spark, sf)
    return lines.highest_in_window(cells, _starts(cells), 15)


@query("steepest_slope", f"""
WITH {CELL}, {LPTS}, o AS (SELECT pts.*, elev AS z0 FROM pts JOIN cell ON cell.tid = pts.tid AND r = r0 AND c = c0),
n AS (SELECT o.tid, r0, c0, r, c, sqrt(((r - r0) * (r - r0) + (c - c0) * (c - c0))::DOUBLE) AS d, elev, z0 FROM cell JOIN o USING (tid)),
s AS (SELECT *, round(abs(elev - z0) / (d * 30), 9) AS slope FROM n WHERE d BETWEEN 3 AND 10)
SELECT tid, r0, c0, r AS r1, c AS c1, {R('slope')} AS slope, {R('d * 30')} AS dist_m FROM s QUALIFY row_number() OVER (PARTITION BY tid ORDER BY slope DESC, d, r, c) = 1""")
def steepest_slope(spark, sf):
    cells = T.band_cells(spark, sf)
    return lines.steepest_slope(cells, _starts(cells), 3, 10)


@query("line_cells", f"""
WITH {CELL}, {LPTS}, l AS (SELECT tid, 0 AS line_id, r0, c0, 50 - r0 // 2 AS r1, 64 - c0 // 3 AS c1 FROM pts), n AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n FROM l)
SELECT tid, line_id, i::INT AS i, floor(r0 + i / greatest(n, 1) * (r1 - r0) + 0.5e0)::INT AS r, floor(c0 + i / greatest(n, 1) * (c1 - c0) + 0.5e0)::INT AS c FROM n, LATERAL range(0, n + 1) t(i)""")
def line_cells(spark, sf):
    starts = _starts(T.band_cells(spark, sf))
    return lines.line_cells(starts.select("tid", F.lit(0).alias("line_id"), "r0", "c0", (50 - F.floor(F.col("r0") / 2)).alias("r1"), (64 - F.floor(F.col("c0") / 3)).alias("c1")))


@query("homogeneous_aspect_line", f"""
WITH {SLOPE}, st AS (SELECT tid, r, c, aspect AS a0, r * 64 + c AS line_id FROM asp WHERE aspect IS NOT NULL),
l AS (SELECT tid, line_id, a0, r + cos(a0) * 8 AS r0, c - sin(a0) * 8 AS c0, r - cos(a0) * 8 AS r1, c + sin(a0) * 8 AS c1 FROM st),
o AS (SELECT tid, line_id, i, a0, floor(round(r0 + i / 16e0 * (r1 - r0), 6) + 0.5e0)::INT AS r, floor(round(c0 + i / 16e0 * (c1 - c0), 6) + 0.5e0)::INT AS c FROM l, range(0, 17) t(i)),
k AS (SELECT o.tid, line_id, i FROM o JOIN asp ON asp.tid = o.tid AND asp.r = o.r AND asp.c = o.c WHERE abs({_mod(f'aspect - a0 + {math.pi!r}e0')} - {math.pi!r}e0) < 1e0),
g AS (SELECT tid, line_id, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY tid, line_id ORDER BY i) AS g FROM k) GROUP BY tid, line_id, g)
SELECT tid, line_id, a::INT AS i_from, b::INT AS i_to, n FROM g WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY tid, line_id ORDER BY n DESC, a) = 1""")
def homogeneous_aspect_line(spark, sf):
    """A line from every cell."""
    cells = aspects(T.band_cells(spark, sf))
    starts = cells.select(*KEYS, (F.col("r") * 64 + F.col("c")).alias("line_id"))
    return lines.homogeneous_lines(cells, starts, 8, 1.0, 2)


#: A surface without the bands' rise, so that its cells face all directions.
ROUGH = SLOPE.replace("1500e0 + 12e0 * c + 40e0 * v AS elev", "200e0 * v AS elev")


def _rough(spark, sf):
    return T.band_cells(spark, sf).withColumn("elev", 200.0 * F.col("v"))


@query("band_aspect", f"WITH {ROUGH} SELECT tid, r, c, {R('slope')} AS slope, {R(f'CASE WHEN slope > 0.3e0 THEN a0 WHEN slope IS NOT NULL THEN {1.5 * math.pi!r}e0 END')} AS aspect FROM sa")
def band_aspect(spark, sf):
    return terrain.band_aspect(_rough(spark, sf), 1.5 * math.pi, 0.3)


@query("deviating_aspect_patches", f"""
WITH RECURSIVE {ROUGH}, dir AS (SELECT tid, r, c, (1 + floor({_mod(f'a0 + {math.pi / 4!r}e0')} / {math.pi / 2!r}e0))::INT AS dir FROM sa WHERE slope > 0.3e0),
dev AS (SELECT tid * 10 + dir AS tid, r, c, dir FROM dir WHERE dir <> 4), {patch_sql('dir', False, 'pd').replace('FROM cell WHERE', 'FROM dev WHERE')}
SELECT (tid // 10)::INT AS tid, (tid % 10)::INT AS dir, sum(n)::BIGINT AS n_cells, count(*) AS n_patches, {R('max(n) / 3200e0')} AS largest, {R('sum(n) / 3200e0')} AS fraction
FROM (SELECT tid, patch_id, count(*) AS n FROM pd GROUP BY ALL) GROUP BY tid""")
def deviating_aspect_patches(spark, sf):
    return zones.deviating_patches(terrain.band_aspect(_rough(spark, sf), 1.5 * math.pi, 0.3), 1.5 * math.pi, 3200)


@query("terrain_classes")
def terrain_classes(spark, sf):
    cells = T.band_cells(spark, sf)
    return fits.terrain_classes(cells.select(*KEYS, "elev").join(terrain.slope_aspect(cells), KEYS))


@query("stream_locate", f"SELECT user_id AS tid, count(*) AS n_points, {R('max(value)')} AS elev_max_m, {R('min(value)')} AS elev_min_m FROM events GROUP BY user_id")
def stream_locate(spark, sf):
    from ..streaming.locate import stream_paths

    root = sampling.may_checkpoint(spark)
    import uuid

    def summarise(rows):
        return rows.groupBy("tid").agg(F.count("*").alias("n_points"), F.max("elev").alias("elev_max_m"), F.min("elev").alias("elev_min_m"))

    return stream_paths(spark, sf, f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}", summarise)


@query("events_windowed", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) + 0e0 AS total FROM events GROUP BY ALL")
def events_windowed(spark, sf):
    from ..streaming.locate import windowed_counts

    out = windowed_counts(T.read(spark, sf, "events"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("measure_all_methods")
def measure_all_methods(spark, sf):
    """All methods' results of every transect as one long table."""
    return study.measure_all(T.band_cells(spark, sf))
