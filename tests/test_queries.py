"""Every query against its SQL; those without SQL run, and are held against properties elsewhere."""

from __future__ import annotations

import math

import pytest

from strandline.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or not isinstance(x, (int, float)) and not hasattr(x, "as_integer_ratio"):
        return str(x)
    return round(float(x), 6)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    a = sorted((tuple(map(plain, r)) for r in found.select(*want.columns).collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    # the answer stated with the fixture
    want = [(9, 58), (8, 58), (9, 57), (9, 58), (8, 58), (9, 58), (9, 57), (8, 57), (8, 57), (8, 58)]
    found = {r.tid: (r.start, r.end) for r in catalogue.QUERIES["zone_extent"](spark, DATA).collect()}
    assert found == dict(enumerate(want))


def test_flagship_at_the_next_scale(spark):
    # the answer stated with the fixture; the one above is of other vectors
    want = [(9, 58), (10, 58), (9, 57), (8, 58), (9, 58), (9, 57), (8, 57), (10, 58), (8, 58), (8, 57)]
    found = {r.tid: (r.start, r.end) for r in catalogue.QUERIES["zone_extent"](spark, "/root/testdata/sf0.01").collect()}
    assert found == dict(enumerate(want))


@pytest.mark.parametrize("name", ["scalar_functions", "reproject_bilinear", "homogeneous_aspect_line", "cell_of_point"])
def test_queries_start_from_every_cell(name):
    # no lattice of cells, in the SQL neither
    sql = catalogue.ORACLE_SQL[name]
    assert "r %" not in sql and "c %" not in sql


def test_power_by_its_formula(spark):
    from strandline.operators import fronts
    from strandline.plans import measure_queries

    # quantiles of Student's t at 0.95, from a printed table
    for n, t in ((1, 6.3138), (2, 2.9200), (5, 2.0150), (10, 1.8125), (30, 1.6973), (50, 1.6759), (120, 1.6577)):
        assert abs(fronts.t_quantile(0.95, n) - t) < 6e-5
    rows = measure_queries.advanced(spark, DATA).where("t1 is not null and t2 is not null").collect()
    found = {r.tid: (r.n, r.power) for r in catalogue.QUERIES["retro_power"](spark, DATA).collect()}
    for tid, (n, power) in found.items():
        d = [r.t1 + r.t2 for r in rows if r.tid == tid]
        s = (sum((x - sum(d) / len(d)) ** 2 for x in d) / (len(d) - 1)) ** 0.5
        x = (fronts.t_quantile(0.95, len(d)) - 0.2 * len(d) ** 0.5 / s) / (2**0.5 * s)
        assert n == len(d) and abs(power - 0.5 * (1 - math.erf(x))) < 2e-6
    assert found


def test_bootstraps_agree_with_theory(spark):
    import numpy as np

    from strandline.operators import fronts

    rng = np.random.default_rng(5)
    rows = [(t, i, float(x), float(y)) for t, shift in ((0, 0.0), (1, 3.0)) for i, (x, y) in enumerate(rng.normal(shift / 2, 1, (50, 2)))]
    frame = spark.createDataFrame([*rows, (0, 50, None, 1.0), (2, 1, 1.0, 1.0)], "tid int, r int, t1 double, t2 double")
    found = {r.tid: r for r in fronts.advancement_tests(frame, 20_000).collect()}
    for t in (0, 1):
        d = np.array([x + y for k, _, x, y in rows if k == t])
        r = found[t]
        assert r.n == 50 and abs(r.t0 - d.mean()) < 1e-12 and abs(r.iid_se - d.std() / 50**0.5) < 0.01 and abs(r.iid_bias) < 0.01
        # of a nearly normal mean the limits are those of the normal distribution
        assert abs(r.iid_low_950 - (d.mean() - 1.96 * d.std() / 50**0.5)) < 0.05 and r.iid_low_999 < r.iid_low_990 < r.iid_low_950 < r.dep_mean < r.dep_high_950 < r.dep_high_990
    assert found[1].iid_ci0_p < 0.0011 and found[1].iid_freq_p == 0 and found[0].iid_ci0_p > 0.04 and found[2].iid_mean is None
    # white noise needs no blocks, a slow wave long ones
    assert fronts.optimal_block(rng.normal(size=400)) < 4 < fronts.optimal_block(np.sin(np.arange(400) / 15) + 0.1 * rng.normal(size=400))


def test_glm_runs_until_it_settles(spark):
    from strandline.operators import fits

    rows = [(0, i / 100, int((i * 37) % 100 < i)) for i in range(100)] + [(1, i / 100, int(i >= 50)) for i in range(100)] + [(2, 0.5, 1)]
    frame = spark.createDataFrame(rows, "tid int, x double, y int")
    found = {r.tid: r for r in fits.binomial_glm(frame, "x", "y", iterations=12).collect()}
    one = {r.tid: r for r in fits.grouped_glm(frame, "x", "y").collect()}
    assert found[0].converged and abs(found[0].b1 - one[0].b1) < 1e-4 and not found[1].converged and 2 not in found


def test_nearest_eight():
    import numpy as np

    from strandline.operators.fits import nearest_eight

    r, c = (x.ravel() for x in np.mgrid[0:6, 0:7])
    near, there = nearest_eight(r, c)
    for i in range(len(r)):
        want = sorted(((r[j] - r[i]) ** 2 + (c[j] - c[i]) ** 2, r[j] - r[i], c[j] - c[i], j) for j in range(len(r)) if j != i)[:8]
        assert there[i].all() and near[i].tolist() == [w[-1] for w in want]


def test_methods_give_what_their_operators_do(spark):
    from strandline.operators import study

    found = {(r.tid, r.metric): r.value for r in catalogue.QUERIES["measure_all_methods"](spark, DATA).collect()}
    assert {t for t, _ in found} == set(range(10))
    one = {m for t, m in found if t == 0}
    for fit in ("elev_dist", "veg1_dist", "veg2_dist", "veg1_elev", "veg2_elev"):
        assert {f"danz1d_{fit}_linear_x50", f"danz1d_{fit}_sigmoid_x50", f"danz1d_{fit}_sigmoid_best"} <= one
    for model in ("line_x50", "sigmoid_x50", "logit_b1", "cloglog_b1", "cloglog_absence_b1", "pql_var0"):
        assert {f"danz2d_veg1_{model}", f"danz2d_veg2_{model}"} <= one
    # the type that ends to the right falls with the elevation, the other one rises
    assert all(found[t, "danz2d_veg1_logit_b1"] < 0 < found[t, "danz2d_veg2_logit_b1"] for t in range(10))
    for r in catalogue.QUERIES["linear_abruptness"](spark, DATA).collect():
        assert close(found[r.tid, f"danz1d_{r.veg}_dist_linear_r2"], plain(r.r2))
    for name, prefix, drop in (("advancement_t17", "eppinga_advancement_", ()), ("retro_power", "eppinga_power_", ()), ("hull_edge_stats", "gastner_step1_veg1_", ("spans",))):
        for r in catalogue.QUERIES[name](spark, DATA).collect():
            for metric, value in r.asDict().items():
                if metric not in ("tid", *drop):
                    assert close(plain(found[r.tid, prefix + metric]), plain(float(value) if value is not None else None)), (name, metric)
    ends = catalogue.QUERIES["zone_ends"](spark, DATA).collect()
    assert {r.method for r in ends} == {"abruptness", "advancement", *(f"hull_edge_{s}" for s in study.HULL_STEPS)}
    assert all(r.start_m <= r.end_m for r in ends if r.start_m is not None) and all((r.center_m is None) == (r.method != "advancement") for r in ends)
    centres = {(r.tid, r.method): (r.start_m, r.end_m) for r in ends}
    for t in range(10):
        assert centres[t, "abruptness"] == pytest.approx(sorted(found[t, f"danz1d_{v}_dist_sigmoid_x50"] for v in ("veg1", "veg2")))
