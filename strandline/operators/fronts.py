"""Front runners and their advancement beyond the optimal boundary, with resampling and rank tests."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import erf, erf_of, signed_log
from ..sources.tables import lcg


def front_runners(cells: DataFrame, keys=("tid",)) -> DataFrame:
    """keys, r, front1, front2: the farthest cell of each type in every row; null where the row has none."""
    return cells.groupBy(*keys, "r").agg(F.max(F.when(F.col("veg1") == 1, F.col("c"))).alias("front1"), F.min(F.when(F.col("veg2") == 1, F.col("c"))).alias("front2"))


def optimal_boundary(cells: DataFrame, keys=("tid",), n_cols: int = 64, n_rows: int = 50, res_m: float = 30.0) -> DataFrame:
    """Where the boundary would lie if the types kept their covers but didn't mix; densities of both and of all."""
    n = float(n_rows * n_cols)
    counted = cells.groupBy(*keys).agg(F.count("veg1").alias("n1"), F.count("veg2").alias("n2"))
    x = F.col("n1") * float(n_cols) / (F.col("n1") + F.col("n2"))
    return counted.where("n1 + n2 > 0").select(*keys, F.bround(x, 0).cast("int").alias("pos_cell"), (F.bround(x, 0) * res_m).alias("pos_m"), (F.col("n1") / n).alias("density1"), (F.col("n2") / n).alias("density2"), ((F.col("n1") + F.col("n2")) / n).alias("density_all"))


def advancement(fronts: DataFrame, optimum: DataFrame, keys=("tid",), res_m: float = 30.0) -> DataFrame:
    """keys, r, d1, d2 (metres beyond the optimum) and t1, t2 (their signed logarithms)."""
    out = fronts.join(optimum.select(*keys, "pos_cell"), list(keys))
    out = out.withColumns({f"d{i}": (F.col(f"front{i}") - F.col("pos_cell")) * res_m for i in (1, 2)})
    return out.select(*keys, "r", "d1", "d2", signed_log(F.col("d1")).alias("t1"), signed_log(F.col("d2")).alias("t2"))


def advancement_summary(rows: DataFrame, keys=("tid",)) -> DataFrame:
    stats = [f(F.col(f"{x}{i}")).alias(f"{name}_{x}{i}") for x in ("d", "t") for i in (1, 2) for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    beyond = ((F.avg("t1") > 0) & (F.avg("t2") < 0)).alias("beyond")
    return rows.groupBy(*keys).agg(*stats, F.coalesce(beyond, F.lit(False)).alias("beyond"))


def bootstrap(rows: DataFrame, replicates: int, block: int = 1, keys=("tid",)) -> DataFrame:
    """keys, rep, mean_delta: means of resampled rows; delta is t1 + t2 of a row, rows with a missing one left out.

    Draws come from the portable generator on (replicate, place), in circular blocks of `block` rows: an equi-join with
    the numbered rows, replicates being rows themselves.
    """
    k = list(keys)
    delta = rows.where("t1 is not null and t2 is not null").select(*k, "r", (F.col("t1") + F.col("t2")).alias("delta"))
    numbered = delta.withColumn("i", F.row_number().over(Window.partitionBy(*k).orderBy("r")) - 1)
    size = numbered.groupBy(*k).agg(F.count("*").alias("n"))
    draws = size.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("place", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    begin = lcg(lcg(F.col("rep").cast("long") * 65536 + F.floor(F.col("place") / block)))
    pick = F.pmod(F.floor(begin / 1024) + F.pmod(F.col("place"), F.lit(block)), F.col("n")).cast("int")
    return draws.withColumn("i", pick).join(numbered, [*k, "i"]).groupBy(*k, "rep").agg(F.avg("delta").alias("mean_delta"))


def bootstrap_interval(means: DataFrame, rows: DataFrame, level: float = 0.95, keys=("tid",)) -> DataFrame:
    """Observed mean, percentile interval and the share of replicates on the other side of zero."""
    k = list(keys)
    seen = rows.groupBy(*k).agg(F.avg(F.col("t1") + F.col("t2")).alias("t0"))
    other = F.when(F.abs("t0") < 1e-9, 1.0).otherwise(F.when(F.signum("mean_delta") != F.signum("t0"), 1.0).otherwise(0.0))
    tail = (1 - level) / 2
    return means.join(seen, k).groupBy(*k).agg(F.first("t0").alias("t0"), F.percentile("mean_delta", tail).alias("low"), F.percentile("mean_delta", 1 - tail).alias("high"), F.avg(other).alias("freq_p"))


def signed_ranks(rows: DataFrame, keys=("tid",)) -> DataFrame:
    """Wilcoxon's signed-rank statistics of t1 against -t2, zeros kept in the ranking (Pratt) and left out of the sums.

    w_plus, w_minus, z (normal approximation with ties) and n of the differences that are not zero.
    """
    k = list(keys)
    delta = rows.where("t1 is not null and t2 is not null").select(*k, "r", F.round(F.col("t1") + F.col("t2"), 9).alias("d"))
    w = Window.partitionBy(*k).orderBy(F.abs("d"))
    ties = Window.partitionBy(*k, F.abs("d"))
    ranked = delta.withColumn("rank", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)
    out = ranked.groupBy(*k).agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.when(F.col("d") != 0, F.col("rank") * F.col("rank"))), F.lit(0.0)).alias("s2"), F.count(F.when(F.col("d") != 0, 1)).alias("n"),
    )
    return out.select(*k, "n", "w_plus", "w_minus", ((F.col("w_plus") - F.col("w_minus")) / F.sqrt(F.nullif("s2", F.lit(0.0)))).alias("z"))


def rank_measures(d: np.ndarray) -> dict:
    """signed_ranks of one group's rounded differences."""
    rank = pd.Series(np.abs(d)).rank().to_numpy()
    plus, minus, s2 = float(rank[d > 0].sum()), float(rank[d < 0].sum()), float((rank[d != 0] ** 2).sum())
    return {"n": int((d != 0).sum()), "w_plus": plus, "w_minus": minus, "z": (plus - minus) / math.sqrt(s2) if s2 else math.nan}


def exact_p(d: np.ndarray) -> float:
    """exact_signed_rank_p of one group's rounded differences."""
    order = pd.Series(np.abs(d)).rank().to_numpy()
    ranks = np.rint(2 * order[d != 0]).astype(int)
    if not len(ranks):
        return 1.0
    counts = np.ones(1)
    for x in ranks:
        shifted = np.zeros(len(counts) + x)
        shifted[x:] = counts
        shifted[: len(counts)] += counts
        counts = shifted / 2
    at = int(ranks[d[d != 0] > 0].sum())
    return min(1.0, 2 * min(counts[: at + 1].sum(), counts[at:].sum()))


def exact_signed_rank_p(rows: DataFrame, keys=("tid",)) -> DataFrame:
    """keys, p_exact: the two-sided exact p of the signed-rank statistic, by convolution of the doubled ranks."""
    from .patches import grouped

    k = list(keys)
    delta = rows.where("t1 is not null and t2 is not null").select(*k, F.round(F.col("t1") + F.col("t2"), 9).alias("d"))
    return grouped(delta, k, lambda pdf: pd.DataFrame({"p_exact": [exact_p(pdf["d"].to_numpy())]}), "p_exact double")


@lru_cache(maxsize=4096)
def t_quantile(p: float, n: int) -> float:
    """The quantile p > 0.5 of Student's t with n degrees of freedom, by bisection of the finite series of its distribution."""

    def inside(t: float) -> float:
        """The probability between -t and t."""
        angle = math.atan(t / math.sqrt(n))
        c2, total, term = math.cos(angle) ** 2, 0.0, math.cos(angle) if n % 2 else 1.0
        for k in range(2 + n % 2, n + 1, 2):
            total += term
            term *= c2 * (k - 1) / k
        return 2 / math.pi * (angle + math.sin(angle) * total) if n % 2 else math.sin(angle) * total

    low, high = 0.0, 1.0
    while inside(high) < 2 * p - 1:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < 2 * p - 1 else (low, middle)
    return high


def retro_power(rows: DataFrame, keys=("tid",), effect: float = 0.2, level: float = 0.95) -> DataFrame:
    """Power to find a mean difference of `effect`: 1 - (1 + erf((t - effect sqrt(n) / s) / (sqrt(2) s))) / 2.

    n and s are the number and the standard deviation of a group's differences, t the quantile `level` of Student's t
    with n degrees of freedom.  Groups of fewer than two differences or without spread have no row.
    """
    d = F.col("t1") + F.col("t2")
    s = rows.groupBy(*keys).agg(F.stddev_samp(d).alias("s"), F.count(d).alias("n"))
    t_crit = F.udf(lambda n: t_quantile(level, n), "double")(F.col("n"))
    x = (t_crit - effect * F.sqrt(F.col("n").cast("double")) / F.col("s")) / (math.sqrt(2) * F.col("s"))
    return s.where("s > 0").select(*keys, "n", (1 - (1 + erf(x)) / 2).alias("power"))


def power_measures(d: np.ndarray, effect: float = 0.2, level: float = 0.95) -> dict:
    """retro_power of one group's differences; empty where it has no row."""
    n = len(d)
    if n < 2 or np.ptp(d) == 0:
        return {}
    s = float(d.std(ddof=1))
    x = (t_quantile(level, n) - effect * math.sqrt(n) / s) / (math.sqrt(2) * s)
    return {"n": n, "power": 1 - (1 + erf_of(x)) / 2}


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(min(1 - 1e-16, max(1e-300, p)))


def optimal_block(x, most: int | None = None) -> float:
    """The mean block length of the stationary bootstrap by Politis and White's rule, as corrected by Patton in 2009.

    Autocorrelations count up to twice the first lag behind which K of them in a row are insignificant, with a flat-top
    window; the length is between 1 and min(3 sqrt(n), n / 3).
    """
    x = np.asarray(x, float)
    n = len(x)
    if n < 4 or x.std() == 0:
        return 1.0
    k = max(5, math.ceil(math.log10(n)))
    m_max, b_max = math.ceil(math.sqrt(n)) + k, math.ceil(min(3 * math.sqrt(n), n / 3))
    d = x - x.mean()
    cov = np.array([float((d[: n - i] * d[i:]).sum()) / n for i in range(min(n, m_max + 1))])
    rho = cov / cov[0]
    small = np.abs(rho[1:]) < 2 * math.sqrt(math.log10(n) / n)
    runs = [i for i in range(len(small) - k + 1) if small[i : i + k].all()]
    if runs:
        m = runs[0]  # the lags before are significant
    else:
        large = np.nonzero(~small)[0]
        m = int(large[-1]) + 1 if len(large) else 0
    big = min(max(1, 2 * m), len(cov) - 1)
    lags = np.arange(-big, big + 1)
    t = np.abs(lags) / big
    flat = np.where(t <= 0.5, 1.0, np.where(t <= 1, 2 * (1 - t), 0.0))
    r = cov[np.abs(lags)]
    g, d_sb = float((flat * np.abs(lags) * r).sum()), 2 * float((flat * r).sum()) ** 2
    if d_sb <= 0:
        return 1.0
    return float(min(max(1.0, (2 * g * g / d_sb) ** (1 / 3) * n ** (1 / 3)), most or b_max))


TEST_LEVELS = (0.95, 0.99, 0.999)
REPLICATES = 100_000


def _draws(n: int, length: float, replicates: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places that the replicates of n rows take, some replicates at a time: iid ones, and blocks of a mean length."""
    rng = np.random.default_rng(seed)
    for begin in range(0, replicates, 2000):
        size = (min(2000, replicates - begin), n)
        iid = rng.integers(0, n, size)
        # a new block begins with a chance of 1 / length; otherwise the next place follows, around the end
        fresh = rng.random(size) < 1 / length
        fresh[:, 0] = True
        place = rng.integers(0, n, size)
        since = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
        yield iid, (np.take_along_axis(place, since, 1) + np.arange(n) - since) % n


#: The draws depend on nothing but these numbers, so that groups of one size share them: 10 MB for 50 rows, 13 at most.
KEEP_ROWS = 64


@lru_cache(maxsize=12)
def _kept_draws(n: int, length: float, replicates: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(iid.astype(np.uint8), dep.astype(np.uint8)) for iid, dep in _draws(n, length, replicates, seed)]


def bootstrap_measures(x: np.ndarray, replicates: int = REPLICATES, levels: tuple[float, ...] = TEST_LEVELS, seed: int = 123) -> dict:
    """advancement_tests of one group's differences, in the order of r."""
    n = len(x)
    out: dict = {"n": n} | dict.fromkeys(_test_names(levels), math.nan)
    t0 = float(x.mean())
    out["t0"] = t0
    if n < 2 or x.std() == 0:
        return out
    length = float(max(1, min(n, round(optimal_block(x)))))
    out["bstar"] = length
    keep = n <= KEEP_ROWS and replicates <= REPLICATES
    means = [(x[iid].mean(1), x[dep].mean(1)) for iid, dep in (_kept_draws if keep else _draws)(n, length, replicates, seed)]
    left = np.array([(x.sum() - v) / (n - 1) for v in x])  # without one row each
    gap = left.mean() - left
    accel = float((gap**3).sum() / (6 * max(1e-300, (gap**2).sum()) ** 1.5))
    for p, parts in zip(("iid", "dep"), zip(*means, strict=True), strict=True):
        t = np.concatenate(parts)
        z0 = _normal_quantile(float((t < t0).mean()) if (t < t0).any() else 0.5 / len(t))
        ends = [e for level in levels for e in ((1 - level) / 2, (1 + level) / 2)]
        if p == "iid":
            z = [z0 + _normal_quantile(a) for a in ends]
            ends = [0.5 * (1 + math.erf((z0 + v / (1 - accel * v)) / math.sqrt(2))) for v in z]
        limits = np.quantile(t, ends).reshape(-1, 2)
        for level, (low, high) in zip(levels, limits, strict=True):
            out[f"{p}_low_{round(1000 * level)}"], out[f"{p}_high_{round(1000 * level)}"] = low, high
        held = [low <= 1e-9 < high for low, high in limits]
        beyond = [level for level, h in zip(levels, held, strict=True) if not h]
        other = (t <= 1e-9) if t0 > 1e-9 else (t >= -1e-9) if t0 < -1e-9 else np.ones(len(t), bool)
        out |= {f"{p}_mean": t.mean(), f"{p}_bias": t.mean() - t0, f"{p}_se": t.std(ddof=1), f"{p}_ci0_p": 1 - max(beyond, default=0.0), f"{p}_freq_p": other.mean()}
    return out


def _test_names(levels: tuple[float, ...]) -> list[str]:
    tail = [f"{p}_{side}_{round(1000 * x)}" for p in ("iid", "dep") for x in levels for side in ("low", "high")]
    return ["t0", "bstar", *(f"{p}_{x}" for p in ("iid", "dep") for x in ("mean", "bias", "se", "ci0_p", "freq_p")), *tail]


def advancement_tests(rows: DataFrame, replicates: int = REPLICATES, levels: tuple[float, ...] = TEST_LEVELS, keys=("tid",), seed: int = 123) -> DataFrame:
    """Two bootstraps of the mean difference t1 + t2 of a group's rows, in the order of r; a group is one band.

    keys, n, t0; for iid: mean, bias and se of the replicates, bias-corrected and accelerated limits at each level, ci0_p
    (one less the highest level whose interval doesn't hold 0) and freq_p (the share of replicates on the other side of
    0; 1 if t0 is 0).  For dep the same of a stationary bootstrap: circular blocks of geometric lengths, whose mean is
    rounded from optimal_block(), and percentile limits.  Rows with a missing difference are left out; groups of fewer
    than two differences or without spread have t0 only.
    """
    from .patches import grouped

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([bootstrap_measures(pdf.sort_values("r", kind="stable")["delta"].to_numpy(float), replicates, levels, seed)])

    k = list(keys)
    delta = rows.where("t1 is not null and t2 is not null").select(*k, "r", (F.col("t1") + F.col("t2")).alias("delta"))
    return grouped(delta, k, kernel, ", ".join(["n long", *(f"{x} double" for x in _test_names(levels))]))
