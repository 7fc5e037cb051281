"""Analytic fixtures and invariants."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import aggregates as A
from strandline.functions import scalars as S
from strandline.model import Settings
from strandline.operators import fits, flow, fronts, grid, hull, patches, profile, results, sampling, terrain
from strandline.sources import tables as T


def cells(spark, values, name="elev"):
    """A grid of one band from a matrix; None is a null cell."""
    rows = [(0, i + 1, j + 1, None if x is None else float(x)) for i, row in enumerate(values) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, f"tid int, r int, c int, {name} double")


def test_plane_has_constant_slope_and_aspect(spark):
    out = terrain.slope_aspect(cells(spark, [[3 * j + 4 * i for j in range(6)] for i in range(5)]), res_m=1.0).where("slope is not null").collect()
    assert len(out) == 12 and all(abs(r.slope - math.atan(5)) < 1e-9 for r in out)
    assert len({round(r.aspect, 9) for r in out}) == 1


def test_aspect_points_downhill(spark):
    east = terrain.slope_aspect(cells(spark, [[-j for j in range(3)]] * 3), res_m=1.0).where("slope is not null").first()
    north = terrain.slope_aspect(cells(spark, [[i] * 3 for i in range(3)]), res_m=1.0).where("slope is not null").first()
    assert abs(east.aspect - math.pi / 2) < 1e-9 and abs(north.aspect) < 1e-9


def test_diagonal_squares_are_one_patch_by_queen_and_two_by_rook(spark):
    grid_ = cells(spark, [[1, 1, None, None], [1, 1, None, None], [None, None, 1, 1], [None, None, 1, 1]], "veg1")
    count = lambda offsets: patches.patches(grid_, "veg1", offsets, n_cols=4).select("patch_id").distinct().count()
    assert (count(grid.ROOK), count(grid.QUEEN)) == (2, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=6, max_size=6), st.booleans())
def test_labels_are_components(held, queen):
    offsets = grid.QUEEN if queen else grid.ROOK
    at = [(i, j) for i in range(6) for j in range(7) if held[i][j]]
    found = dict(zip(at, patches.label(np.array([a for a, _ in at], int), np.array([b for _, b in at], int), offsets).tolist(), strict=True))
    seen: dict = {}
    for x in at:
        if x not in seen:
            todo = [x]
            seen[x] = x
            while todo:
                a, b = todo.pop()
                for i, j in offsets:
                    y = (a + i, b + j)
                    if y in found and y not in seen:
                        seen[y] = x
                        todo.append(y)
    assert all((found[x] == found[y]) == (seen[x] == seen[y]) for x in at for y in at)


def test_inhibited_points_keep_their_distance(spark):
    area = cells(spark, [[1] * 30] * 30)
    points = sorted((r.r, r.c) for r in sampling.inhibited_points(area, 5.0).collect())
    assert len(points) > 10
    assert all(math.dist(p, q) > 5 for p in points for q in points if p < q)
    # none could be added
    assert all(any(math.dist((i, j), p) <= 5 for p in points) for i in range(1, 31) for j in range(1, 31))


def test_inhibited_points_go_on_until_no_cell_is_left(spark, monkeypatch):
    # each round keeps one cell of the line and drops the next
    monkeypatch.setattr(sampling, "with_priority", lambda frame, seed=0: frame.withColumn("priority", F.col("c").cast("long")))
    line = cells(spark, [[1] * 131])
    assert sorted(r.c for r in sampling.inhibited_points(line, 1.0).collect()) == list(range(1, 132, 2))


def test_inhibited_query_samples_all_vegetated_cells(spark):
    from strandline.plans import catalogue

    data = "/root/testdata/sf0.001"
    area = [(r.tid, r.r, r.c) for r in T.band_cells(spark, data).where("veg1 = 1 or veg2 = 1").collect()]
    points = [(r.tid, r.r, r.c) for r in catalogue.QUERIES["search_points_inhibited"](spark, data).collect()]
    assert any(c % 2 for _, _, c in points) and set(points) <= set(area)
    assert all(any(t == u and math.dist((r, c), (a, b)) <= 6 for u, a, b in points) for t, r, c in area)


def test_power_takes_the_quantile_of_each_group(spark):
    known = {1: 6.313752, 2: 2.919986, 4: 2.131847, 5: 2.015048, 10: 1.812461, 11: 1.795885, 49: 1.676551, 50: 1.675905}
    assert all(abs(fronts.t_quantile(0.95, n) - t) < 1e-6 for n, t in known.items())
    rows = spark.createDataFrame([(n, 0.1 * (i % 3), 0.2 * (i % 2)) for n in (5, 11, 50) for i in range(n)], "tid int, t1 double, t2 double")
    for r in fronts.retro_power(rows).collect():
        d = [0.1 * (i % 3) + 0.2 * (i % 2) for i in range(r.tid)]
        s = np.std(d, ddof=1)
        x = (known[r.tid] - 0.2 * math.sqrt(r.tid) / s) / (math.sqrt(2) * s)  # as the survey has it: n degrees of freedom, and s
        assert abs(r.power - (1 - math.erf(x)) / 2) < 1e-6


def test_registered_permutations(spark):
    from strandline.plans import catalogue

    ps = [r.p * 200 for r in catalogue.QUERIES["morans_i_permuted"](spark, "/root/testdata/sf0.001").collect()]
    assert all(abs(p - round(p)) < 1e-3 for p in ps) and any(round(p) % 2 for p in ps)


def test_circular_mean_ignores_full_turns(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (6.0,)], "a double")
    one = rows.agg(A.circular_mean(F.col("a")).alias("m"), A.circular_sd(F.col("a")).alias("s")).first()
    two = rows.agg(A.circular_mean(F.col("a") + 2 * math.pi).alias("m"), A.circular_sd(F.col("a") + 2 * math.pi).alias("s")).first()
    assert abs(one.m - two.m) < 1e-9 and abs(one.s - two.s) < 1e-9
    shifted = rows.agg(A.circular_mean(F.col("a"), legacy_shift=True)).first()[0]
    assert 1 <= shifted < 1 + 2 * math.pi


def test_scalars(spark):
    row = spark.range(1).select(
        S.signed_exp(S.signed_log(F.lit(-7.5))).alias("back"), S.erf(F.lit(0.7)).alias("erf"), S.erf(F.lit(-0.7)).alias("neg"), S.heaviside(F.lit(0.0), 0.5).alias("h"), S.wrap(F.lit(-0.5)).alias("w"),
        S.sigmoidal_inverse(S.sigmoidal(F.lit(0.3), 0.1, 2.0), 0.1, 2.0).alias("s"), S.zero_if_tiny(F.lit(2 * math.pi - 1e-12)).alias("z"),
    ).first()
    assert abs(row.back + 7.5) < 1e-9 and abs(row.erf - math.erf(0.7)) < 2e-7 and abs(row.neg + math.erf(0.7)) < 2e-7 and row.h == 0.5
    assert abs(row.w - 5.7831853) < 1e-6 and abs(row.s - 0.3) < 1e-9 and row.z == 0
    with pytest.raises(ValueError):
        S.heaviside(F.lit(0.0), 0.3)


def test_rotation_keeps_distances(spark):
    x, y = S.rotate(F.lit(3.0), F.lit(4.0), F.lit(1.1))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(math.hypot(row.x, row.y) - 5) < 1e-9


def test_majority_cases(spark):
    x1, x2 = [None, None, None, 1, 2, 3, 4], [1 / 3] * 3 + [1, 2, 3, 4] + [None] * 3
    frame = lambda xs: spark.createDataFrame([(0, None if x is None else float(x)) for x in xs], "k int, v double")
    values = lambda xs, **how: sorted((r.v for r in A.majority(frame(xs), ["k"], "v", **how).collect()), key=repr)
    assert values(x1) == [None]
    assert values(x1, skip_null=True, all_ties=True) == [1, 2, 3, 4]
    assert values(x1, all_ties=True) == [None]
    assert values(x2, all_ties=True) == [1 / 3, None]
    assert values(x2, skip_null=True) == [1 / 3]
    assert values(x2)[0] in (None, 1 / 3)


def test_profile_without_zone(spark):
    flat = spark.createDataFrame([(0, v, c, 0.5) for v in ("veg1", "veg2") for c in range(1, 21)], "tid int, veg string, c int, d double")
    assert profile.zone_extent(flat).count() == 0


def test_zone_starts_before_it_ends(spark):
    ramp = [(0, "veg1", c, max(0.0, min(1.0, (25 - c) / 20))) for c in range(1, 41)] + [(0, "veg2", c, max(0.0, min(1.0, (c - 15) / 20))) for c in range(1, 41)]
    zone = profile.zone_extent(spark.createDataFrame(ramp, "tid int, veg string, c int, d double")).collect()
    assert all(z.start < z.end for z in zone)


def test_kernel_adds_up():
    kernel = terrain.inverse_distance_kernel(3.5)
    assert abs(sum(w for *_, w in kernel) - 1) < 1e-12 and (0, 0) not in {(a, b) for a, b, _ in kernel}


def test_flow_path_stops():
    step = {(1, 1): (1, 2), (1, 2): (1, 3), (2, 1): (2, 2), (2, 2): (2, 1)}
    assert flow.flow_path(step, (1, 1)) == [(1, 1), (1, 2), (1, 3)]
    assert flow.flow_path(step, (2, 1)) == [(2, 1), (2, 2)]
    assert flow.flow_path(step, (1, 1), {(1, 2)}) == [(1, 1), (1, 2)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=5, max_size=15), st.booleans())
def test_hull_walk_of_a_block_follows_its_front(widths, left):
    block = {(r, (13 - c if left else c)) for r, w in enumerate(widths, 1) for c in range(1, w + 1)}
    path = hull.walk(block, 1, left)
    assert set(path) <= block and path[0][0] == (len(widths) if left else 1)
    assert len({(p, q) for p, q in zip(path, path[1:], strict=False)}) == len(path) - 1
    assert path[-1][0] == (1 if left else len(widths))


def test_hull_walk_of_a_straight_edge_is_straight():
    block = {(r, c) for r in range(1, 9) for c in range(1, 5)}
    assert hull.walk(block, 1, False) == [(r, 4) for r in range(1, 9)]
    assert hull.walk(block, 1, True) == [(r, 1) for r in range(8, 0, -1)]


def test_front_runners_of_a_step(spark):
    rows = [(0, r, c, 1 if c <= 4 else None, 1 if c > 6 else None) for r in range(1, 6) for c in range(1, 11)]
    frame = spark.createDataFrame(rows, "tid int, r int, c int, veg1 int, veg2 int")
    assert {(r.front1, r.front2) for r in fronts.front_runners(frame).collect()} == {(4, 7)}
    assert fronts.optimal_boundary(frame, n_cols=10, n_rows=5).first().pos_cell == 5


def test_sigmoid_is_recovered():
    x = np.linspace(0, 1, 60)
    centre, slope, rss = fits.fit_sigmoid(x, 1 / (1 + np.exp(-12 * (x - 0.4))))
    assert abs(centre - 0.4) < 1e-6 and abs(slope - 12) < 1e-4 and rss < 1e-12


def test_distributed_and_grouped_fits_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.4 + 1.3 * x)))).astype(float)
    frame = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y, strict=True)], "tid int, x double, y double")
    for link in ("logit", "cloglog"):
        a, b = fits.binomial_glm(frame, "x", "y", link, iterations=12).first(), fits.grouped_glm(frame, "x", "y", link).first()
        assert abs(a.b0 - b.b0) < 1e-4 and abs(a.b1 - b.b1) < 1e-4 and b.converged


def test_exact_rank_test(spark):
    # all of five differences positive: 2 / 2^5
    frame = spark.createDataFrame([(0, i, float(i), 0.0) for i in range(1, 6)], "tid int, r int, t1 double, t2 double")
    assert abs(fronts.exact_signed_rank_p(frame).first().p_exact - 2 / 32) < 1e-12


def test_pending_work(spark):
    work = results.work_items(spark.createDataFrame([(1,), (2,)], "tid int"))
    log = work.where("tid = 1").withColumn("version", F.lit(1))
    assert work.count() == 32 and results.pending(work, log, 1).count() == 16 and results.pending(work, log, 2).count() == 32


def test_settings_are_checked():
    assert Settings().location_calls == 12 and Settings().measure_calls == 24 and Settings().inhibit_distance_m is None
    assert Settings(inhibit=True).inhibit_distance_m == 16670
    assert Settings(hull_steps=(3, 1, 3)).hull_steps == (1, 3) and abs(Settings(transect_azimuth=2 * math.pi + 1).transect_azimuth - 1) < 1e-9
    for bad in ({"density_low": 0.6}, {"band_width_cells": 100}, {"transects": 9}, {"neighborhoods": (10,)}, {"patch_area_classes_m2": (2.0, 1.0)}, {"seed": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_settings_survive_as_text():
    from strandline.model import TransectType, VegType, from_json, to_json

    one = Settings(inhibit=True, transect_type=TransectType.FLOW_PATH, veg1=VegType((489, 490), "class", True))
    assert from_json(to_json(one)) == one


def test_band_points(spark):
    from strandline.operators import study

    points = spark.createDataFrame([(0, 5.0, 0.9), (0, 5.0, 1.1), (0, -0.1, 0.0), (0, 10.0, 0.0)], "tid int, x double, y double")
    band = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0)], "tid int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.x, r.y) for r in study.in_band(points, band, 2.0).collect()) == [(5.0, 0.9), (10.0, 0.0)]


def test_append_rows_refuses_nested_columns(spark, tmp_path):
    T.append_rows(spark.createDataFrame([(1, 2.0)], "a int, b double"), f"{tmp_path}/out")
    T.append_rows(spark.createDataFrame([(3, 4.0)], "a int, b double"), f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2
    with pytest.raises(ValueError):
        T.append_rows(spark.createDataFrame([([1],)], "a array<int>"), f"{tmp_path}/out")


def test_geometry_and_timing(spark):
    layers = spark.createDataFrame([("a", "x", 30.0, False, False, 9), ("b", "x", 30.0, False, False, 4), ("c", "y", 10.0, False, False, 0)], "layer string, crs string, res_m double, longlat boolean, rotation boolean, ncell long")
    assert T.same_geometry(layers).first().valid
    assert T.max_timing(spark.createDataFrame([], "time_h double")).first()[0] == 2.0


def test_stream_counts_all_points_of_a_transect(spark, tmp_path):
    """A transect whose points come in two batches is summarised from all of them; others are not touched again."""
    from strandline.streaming.locate import latest, locate_stream

    source, schema = f"{tmp_path}/in", "tid int, elev double"
    summarise = lambda rows: rows.groupBy("tid").agg(F.max("elev").alias("top"), F.count("*").alias("n"))
    for rows in ([(1, 1.0), (2, 5.0)], [(2, 2.0), (3, 3.0)], [(2, 7.0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        locate_stream(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/out", f"{tmp_path}/state", summarise).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.tid, r.top, r.n) for r in latest(out).collect()) == [(1, 1.0, 1), (2, 7.0, 3), (3, 3.0, 1)]
    assert sorted((r.tid, r.batch_id) for r in out.collect()) == [(1, 0), (2, 0), (2, 1), (2, 2), (3, 1)]


def test_band_along_the_grid_is_the_grid(spark):
    from strandline.operators import band

    cells = spark.createDataFrame([(0, r, c, float(r * 100 + c) if (r, c) != (3, 3) else None, (r + c) % 3 if c != 2 else None) for r in range(1, 7) for c in range(1, 9)], "tid int, r int, c int, elev double, veg_class int")
    lines = spark.createDataFrame([(0, 0, 0.0, 3.0, 8.0, 3.0), (0, 1, 0.0, 1.0, 8.0, 1.0), (0, 2, 4.0, 3.0, 4.0, 3.0), (0, 3, 4.0, 5.0, 4.0, 1.5), (5, 0, 0.0, 3.0, 8.0, 3.0), (0, None, 8.0, 3.0, 0.0, 3.0)], "tid int, line_id int, x0 double, y0 double, x1 double, y1 double")
    found = {(r.line_id, r.r, r.c): r for r in band.candidate_band(cells, lines, 4, 4, (0,), (1, 2)).collect()}
    # out of the window, without length and without a grid: no rows
    assert {k[0] for k in found} == {0, 3, None}
    for r in range(1, 5):
        for c in range(1, 9):
            # cells as they are, and turned about where the line runs the other way
            for got, (y, x) in ((found[0, r, c], (r + 1, c)), (found[None, r, c], (6 - r, 9 - c))):
                assert got.mean_value == (float(y * 100 + x) if (y, x) != (3, 3) else None) and got.n_points == 16 and got.dist_m == (c - 0.5) * 30
                cls = (y + x) % 3 if x != 2 else None
                assert (got.veg_class, got.veg1, got.veg2) == (cls, 1 if cls == 0 else None, 1 if cls in (1, 2) else None)
    # a line up the columns, its last column half as wide
    assert max(c for i, _, c in found if i == 3) == 4 and {found[3, r, 4].n_points for r in range(1, 5)} == {8}
    assert [found[3, r, 1].mean_value for r in range(1, 5)] == [503.0, 504.0, 505.0, 506.0]
    empty = band.candidate_band(cells.limit(0), lines, 4).collect() + band.candidate_band(cells, lines.limit(0), 4).collect()
    assert empty == []


def test_tiles_like_the_first(spark):
    from strandline.sources import tables as T

    tiles = spark.createDataFrame([("b", 1, 1, 2.0, "x", 30.0), ("a", 1, 1, 4.0, "x", 30.0), ("c", 1, 1, 9.0, "y", 30.0), ("d", 1, 2, 9.0, None, 30.0), (None, 1, 1, 9.0, "x", 30.0)], "tile string, r int, c int, value double, crs string, res_m double")
    assert {r.tile for r in T.like_first(tiles).collect()} == {"a", "b"}
    assert {r.tile for r in T.like_first(tiles.where("tile = 'd'")).collect()} == {"d"} and T.like_first(tiles.limit(0)).count() == 0
