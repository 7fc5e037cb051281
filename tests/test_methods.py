"""Methods of a band at once against the operators that measure all bands one step at a time."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import fits, fronts, hull, patches, profile, results, study, terrain
from strandline.plans import catalogue
from strandline.sources import tables as T

DATA = "/root/testdata/sf0.001"


def named(found, by, prefix):
    return results.to_long(found, ["tid", by], prefix).select("tid", F.concat_ws("_", by, "metric").alias("metric"), "value")


def danz1d(cells):
    at, dens, x = cells.groupBy("tid", "c").agg(F.avg("elev").alias("elev")), profile.densities(cells), (F.col("c") * 30.0).alias("x")
    pairs = at.select("tid", F.lit("elev_dist").alias("fit"), x, F.col("elev").alias("y"))
    pairs = pairs.unionByName(dens.select("tid", F.concat("veg", F.lit("_dist")).alias("fit"), x, F.col("d").alias("y")))
    pairs = pairs.unionByName(dens.join(at, ["tid", "c"]).select("tid", F.concat("veg", F.lit("_elev")).alias("fit"), F.col("elev").alias("x"), F.col("d").alias("y")))
    curved = fits.sigmoid_abruptness(pairs, keys=("tid", "fit")).withColumn("best", F.col("best") == "sigmoid")
    return [named(fits.linear_abruptness(pairs, keys=("tid", "fit")), "fit", "linear_"), named(curved, "fit", "sigmoid_")]


def danz2d(cells):
    scale = cells.groupBy("tid").agg(F.avg("elev").alias("m"), F.stddev_samp("elev").alias("s")).where("s > 0")
    held = F.expr("stack(2, 'veg1', coalesce(veg1, 0), 'veg2', coalesce(veg2, 0)) as (veg, y)")
    rows, keys = cells.join(scale, "tid").withColumn("x", (F.col("elev") - F.col("m")) / F.col("s")).select("tid", "r", "x", held), ("tid", "veg")
    found = {
        "line": fits.linear_abruptness(rows, keys=keys), "sigmoid": fits.sigmoid_abruptness(rows, keys=keys).drop("best"), "logit": fits.grouped_glm(rows, "x", "y", "logit", keys),
        "cloglog": fits.grouped_glm(rows, "x", "y", "cloglog", keys), "cloglog_absence": fits.grouped_glm(rows.withColumn("y", 1 - F.col("y")), "x", "y", "cloglog", keys),
        "pql": fits.mixed_pql(rows, "x", "y", keys=keys).drop("b_auto"),
    }
    return [named(values, "veg", f"{name}_") for name, values in found.items()]


def eppinga(cells):
    optimum = fronts.optimal_boundary(cells)
    moved = fronts.advancement(fronts.front_runners(cells), optimum)
    found = {
        "": optimum, "advancement_": fronts.advancement_summary(moved), "ranks_": fronts.signed_ranks(moved), "ranks_exact_": fronts.exact_signed_rank_p(moved),
        "power_": fronts.retro_power(moved), "bootstrap_": fronts.advancement_tests(moved),
    }
    return [results.to_long(rows, ["tid"], prefix) for prefix, rows in found.items()]


def gastner(cells):
    ground = cells.select("tid", "r", "c", "elev").join(terrain.slope_aspect(cells).select("tid", "r", "c", "slope"), ["tid", "r", "c"])
    ahead, parts = fronts.front_runners(cells), []
    for step in study.HULL_STEPS:
        for veg, other, left in study.EDGES:
            edge = hull.hull_edge(patches.percolation_patch(cells, veg, step), step, left)
            found = (hull.hull_stats(edge), hull.hull_gradient(edge, ground), hull.struggle_zone(edge, ahead, other, left))
            parts += [results.to_long(rows, ["tid"], f"step{step}_{veg}_") for rows in found]
    return parts


OPERATORS = {"danz1d": danz1d, "danz2d": danz2d, "eppinga": eppinga, "gastner": gastner}


@pytest.fixture(scope="module")
def cells(spark):
    """Two whole bands, and odd ones: without either type, without a second one, of three rows, of one cell of a type, level, with a missing row and missing values."""
    rows = T.band_cells(spark, DATA).where("tid < 2").select("tid", "r", "c", "elev", "veg1", "veg2")
    none, one = F.lit(None).cast("int"), rows.where("tid = 0")
    odd = [
        one.withColumns({"veg1": none, "veg2": none}), one.withColumn("veg2", none), one.where("r <= 3"), one.withColumn("veg2", F.when((F.col("r") == 7) & (F.col("c") == 50), 1)),
        one.withColumn("elev", F.lit(1500.0)), one.where("r <> 9"), one.withColumn("elev", F.when(F.expr("(r * 7 + c) % 11 > 0"), F.col("elev"))), one.where("r = 1 and c <= 2"),
    ]
    return reduce(DataFrame.unionByName, [rows, *(x.withColumn("tid", F.lit(10 + i)) for i, x in enumerate(odd))]).cache()


@pytest.mark.parametrize("method", study.METHODS)
def test_bands_at_once_as_by_operators(spark, cells, method):
    found = {(r.tid, r.metric): r.value for r in study.measured(cells).where(F.col("method") == method).collect()}
    want = {(r.tid, r.metric): r.value for r in reduce(DataFrame.unionByName, OPERATORS[method](cells)).collect()}
    assert set(found) == set(want)
    for k, x in want.items():
        assert (found[k] is None) == (x is None) and (x is None or math.isclose(found[k], x, rel_tol=1e-6, abs_tol=1e-7)), (k, found[k], x)


def test_cells_are_read_and_dealt_out_once(spark):
    plan = catalogue.QUERIES["measure_all_methods"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(x) for x in ("FileScan", "Exchange", "FlatMapGroupsInPandas")] == [1, 1, 1]


def test_pending_methods_only(spark, cells):
    work = cells.select("tid").distinct().withColumn("method", F.explode(F.array(F.lit("danz1d"), F.lit("eppinga"))))
    log = spark.createDataFrame([(0, "eppinga", study.METHODS["eppinga"].version), (0, "danz1d", study.METHODS["danz1d"].version - 1)], "tid int, method string, version int")
    some = cells.where("tid < 2")
    found = {tuple(r) for r in study.measure_pending(some, work.where("tid < 2"), log).collect()}
    want = {(r.tid, r.method, study.METHODS[r.method].version, r.metric, r.value) for r in study.measured(some).collect() if r.method == "danz1d" or r.method == "eppinga" and r.tid == 1}
    assert found == want


@pytest.mark.parametrize("link", ["logit", "cloglog"])
@pytest.mark.parametrize("more", [False, True])
def test_random_effects_as_by_the_dense_matrix(link, more):
    rng = np.random.default_rng(3)
    by, a, z = np.sort(rng.integers(0, 9, 500)), rng.normal(size=500), rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(0.3 - 1.2 * a - rng.normal(size=9)[by]))).astype(float)
    fixed, Z = np.column_stack([np.ones(500), a] + [z] * more), np.zeros((500, 18))
    Z[np.arange(500), by], Z[np.arange(500), 9 + by] = 1, a
    starts, f = np.nonzero(np.append(True, by[1:] != by[:-1]))[0], fixed.shape[1]
    for var in (np.array([0.5, 0.5]), np.array([30.0, 1e-3])):
        beta, cov, dev, _ = fits.irls(np.hstack([fixed, Z]), y, link, 25, np.diag(np.concatenate([np.zeros(f), np.repeat(1 / var, 9)])))
        b, u, s, d = fits.random_irls(fixed, y, starts, var, link)
        for x, w in ((b, beta[:f]), (u.T.ravel(), beta[f:]), (s.T.ravel(), np.diag(cov)[f:]), (d, dev)):
            np.testing.assert_allclose(x, w, rtol=1e-9, atol=1e-10)


def test_kept_draws_are_those_of_the_generator():
    x = np.random.default_rng(8).normal(0.2, 1, 30)
    kept = fronts.bootstrap_measures(x, 3000)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fronts, "KEEP_ROWS", 0)
        assert fronts.bootstrap_measures(x, 3000) == kept
