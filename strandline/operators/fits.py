"""Boundary models: linear, sigmoid and binomial fits of profiles and of cells, mixed models, and their scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import shifted
from .patches import grouped
from .sampling import may_checkpoint

#: Steps to the neighbours of a cell, the nearest first; ties in the order of rows, then columns.
NEAREST = sorted(((a, b) for a in range(-3, 4) for b in range(-3, 4) if 0 < a * a + b * b <= 9), key=lambda s: (s[0] ** 2 + s[1] ** 2, s))


def unit_scaled(profile: DataFrame, x: str, y: str, keys=("tid",)) -> DataFrame:
    """keys, x, y, xmin, xrange, x1, y1: both scaled to [0, 1]; groups without any spread go."""
    w = Window.partitionBy(*keys)
    out = profile.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    out = out.withColumns({"xmin": F.min("x").over(w), "xrange": F.max("x").over(w) - F.min("x").over(w), "ymin": F.min("y").over(w), "yrange": F.max("y").over(w) - F.min("y").over(w)})
    return out.where("xrange > 0 and yrange > 0").withColumns({"x1": (F.col("x") - F.col("xmin")) / F.col("xrange"), "y1": (F.col("y") - F.col("ymin")) / F.col("yrange")})


def linear_abruptness(profile: DataFrame, x: str = "x", y: str = "y", keys=("tid",)) -> DataFrame:
    """The line through a scaled profile: where it reaches 5, 50 and 95 percent, width, slope, r2 and AIC (three parameters)."""
    s = unit_scaled(profile, x, y, keys)
    fit = s.groupBy(*keys).agg(
        F.regr_intercept("y1", "x1").alias("a"), F.regr_slope("y1", "x1").alias("b"), F.regr_r2("y1", "x1").alias("r2"), F.count("*").alias("n"),
        F.first("xmin").alias("xmin"), F.first("xrange").alias("xrange"), (F.regr_syy("y1", "x1") - F.regr_sxy("y1", "x1") * F.regr_sxy("y1", "x1") / F.regr_sxx("y1", "x1")).alias("rss"),
    )
    at = lambda p: F.col("xmin") + (p - F.col("a")) / F.col("b") * F.col("xrange")
    n = F.col("n").cast("double")
    return fit.where("b <> 0 and rss > 0").select(
        *keys, at(0.05).alias("x05"), at(0.5).alias("x50"), at(0.95).alias("x95"), F.abs(at(0.95) - at(0.05)).alias("width"), F.col("b").alias("slope"), (F.col("b") / F.col("xrange")).alias("slope_x"), "r2",
        (n * F.log(2 * math.pi * F.col("rss") / n) + n + 6).alias("aic"),
    )


def unit_arrays(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float] | None:
    """unit_scaled of one group: x1, y1 by x, then y, xmin and xrange, without pairs that miss either; None without any spread."""
    known = ~(np.isnan(x) | np.isnan(y))
    x, y = x[known], y[known]
    if not len(x) or not (np.ptp(x) > 0 and np.ptp(y) > 0):
        return None
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    return (x - x[0]) / np.ptp(x), (y - y.min()) / np.ptp(y), float(x[0]), float(np.ptp(x))


def line_measures(a: np.ndarray, b: np.ndarray, lo: float, rg: float) -> dict:
    """linear_abruptness of one group's scaled arrays; empty where the line is level or perfect."""
    n, da, db = len(a), a - a.mean(), b - b.mean()
    sxx, sxy, syy = float((da * da).sum()), float((da * db).sum()), float((db * db).sum())
    slope, rss = sxy / sxx, syy - sxy * sxy / sxx
    if slope == 0 or not rss > 0:
        return {}
    start = float(b.mean()) - slope * float(a.mean())
    at = lambda p: lo + (p - start) / slope * rg
    return {
        "x05": at(0.05), "x50": at(0.5), "x95": at(0.95), "width": abs(at(0.95) - at(0.05)), "slope": slope, "slope_x": slope / rg, "r2": sxy * sxy / (sxx * syy),
        "aic": n * math.log(2 * math.pi * rss / n) + n + 6,
    }


def _sigmoid(x: np.ndarray, centre: float, slope: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * (x - centre), -500, 500)))


def fit_sigmoid(x: np.ndarray, y: np.ndarray, restarts: int = 51, seed: int = 1) -> tuple[float, float, float] | None:
    """centre, slope and residual sum of squares by damped Gauss-Newton; the first start that converges counts."""
    rng = np.random.default_rng(seed)
    for start in range(restarts):
        p = np.array([0.5, 1.0]) if not start else rng.uniform(0, 1, 2)
        rss, damp = float(((y - _sigmoid(x, *p)) ** 2).sum()), 1e-3
        for _ in range(200):
            f = _sigmoid(x, *p)
            d = f * (1 - f)
            jac = np.column_stack([-p[1] * d, (x - p[0]) * d])
            normal = jac.T @ jac
            try:
                step = np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-12), jac.T @ (y - f))
            except np.linalg.LinAlgError:
                break
            new = float(((y - _sigmoid(x, *(p + step))) ** 2).sum())
            if new <= rss:
                done = rss - new <= 1e-12 * (rss + 1e-12) and np.abs(step).max() < 1e-6
                p, rss, damp = p + step, new, damp / 10
                if done:
                    return float(p[0]), float(p[1]), rss
            else:
                damp *= 10
                if damp > 1e12:
                    break
    return None


def sigmoid_measures(a: np.ndarray, b: np.ndarray, lo: float, rg: float) -> dict:
    """sigmoid_abruptness of one group's scaled arrays, in the order of x, then y."""
    n = len(a)
    out = dict.fromkeys(("x05", "x50", "x95", "width", "slope", "r2", "aic", "delta_aic"), math.nan) | {"best": None}
    line = np.polyfit(a, b, 1) if n > 1 else np.zeros(2)
    rss_line = float(((b - np.polyval(line, a)) ** 2).sum())
    aic = lambda rss: n * math.log(2 * math.pi * max(rss, 1e-300) / n) + n + 6
    if (fit := fit_sigmoid(a, b)) is not None and fit[1] != 0:
        centre, slope, rss = fit
        place = lambda p: lo + rg * (centre - math.log(1 / p - 1) / slope)
        tss = float(((b - b.mean()) ** 2).sum())
        out |= {"x05": place(0.05), "x50": place(0.5), "x95": place(0.95), "width": abs(place(0.95) - place(0.05)), "slope": slope, "r2": 1 - rss / tss if tss else math.nan, "aic": aic(rss), "delta_aic": aic(rss) - aic(rss_line)}
        out["best"] = "sigmoid" if out["delta_aic"] < 0 else "linear"
    return out


def sigmoid_abruptness(profile: DataFrame, x: str = "x", y: str = "y", keys=("tid",)) -> DataFrame:
    """As linear_abruptness for 1 / (1 + exp(-slope (x - centre))), and the model that AIC prefers."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"], kind="stable")
        return pd.DataFrame([sigmoid_measures(pdf["x1"].to_numpy(), pdf["y1"].to_numpy(), pdf["xmin"].iloc[0], pdf["xrange"].iloc[0])])

    s = unit_scaled(profile, x, y, keys)
    return grouped(s, list(keys), kernel, "x05 double, x50 double, x95 double, width double, slope double, r2 double, aic double, delta_aic double, best string")


def binomial_glm(rows: DataFrame, x: str, y: str, link: str = "logit", keys=("tid",), iterations: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """keys, b0, b1, rounds, converged: iteratively reweighted least squares of a binary y on x, every round one grouped sum.

    The rows are stored once and read once a round, but only sums are shuffled; coefficients come back by a join on the
    group, so that no group is gathered in one place.  Each round's coefficients are stored; rounds end when no group's
    moves by more than the tolerance, or after `iterations` rounds: groups that still move (a perfect split has no optimum)
    are not converged.  Groups whose weights vanish keep their last coefficients.
    """
    if link not in ("logit", "cloglog"):
        raise ValueError(f"unknown link {link!r}")
    k = list(keys)
    may_checkpoint(rows.sparkSession)
    data = rows.select(*k, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null").checkpoint()
    mean = data.groupBy(*k).agg(F.avg("y").alias("m")).where("m > 0 and m < 1")
    first = F.log(F.col("m") / (1 - F.col("m"))) if link == "logit" else F.log(-F.log(1 - F.col("m")))
    beta = mean.select(*k, first.alias("b0"), F.lit(0.0).alias("b1"))
    for n_round in range(1, iterations + 1):
        eta = F.greatest(F.lit(-30.0), F.least(F.lit(30.0 if link == "logit" else 3.0), F.col("b0") + F.col("b1") * F.col("x")))
        now = data.join(beta, k).withColumn("eta", eta)
        if link == "logit":
            mu = 1 / (1 + F.exp(-F.col("eta")))
            slope = mu * (1 - mu)
        else:
            mu = 1 - F.exp(-F.exp(F.col("eta")))
            slope = F.exp(F.col("eta") - F.exp(F.col("eta")))
        now = now.withColumns({"mu": mu, "dm": slope})
        var = F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(1e-12))
        now = now.withColumns({"w": F.col("dm") * F.col("dm") / var, "z": F.col("eta") + (F.col("y") - F.col("mu")) / F.greatest("dm", F.lit(1e-12))})
        w, z = F.col("w"), F.col("z")
        sums = now.groupBy(*k).agg(F.sum(w).alias("sw"), F.sum(w * F.col("x")).alias("sx"), F.sum(w * F.col("x") * F.col("x")).alias("sxx"), F.sum(w * z).alias("sz"), F.sum(w * F.col("x") * z).alias("sxz"), F.first("b0").alias("p0"), F.first("b1").alias("p1"))
        det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
        ok = det > 1e-12
        b0, b1 = (F.col("sxx") * F.col("sz") - F.col("sx") * F.col("sxz")) / det, (F.col("sw") * F.col("sxz") - F.col("sx") * F.col("sz")) / det
        found = sums.select(*k, F.when(ok, b0).otherwise(F.col("p0")).alias("b0"), F.when(ok, b1).otherwise(F.col("p1")).alias("b1"), "p0", "p1")
        still = lambda b, p: F.abs(F.col(b) - F.col(p)) <= tolerance * (1 + F.abs(b))
        beta = found.select(*k, "b0", "b1", F.lit(n_round).alias("rounds"), (still("b0", "p0") & still("b1", "p1")).alias("converged")).checkpoint()
        if beta.where("not converged").isEmpty():
            break
    return beta


def glm_measures(a: np.ndarray, b: np.ndarray, link: str = "logit", iterations: int = 25) -> dict:
    """grouped_glm of one group's arrays."""
    out = dict.fromkeys(("b0", "b1", "se0", "se1", "deviance", "aic"), math.nan) | {"converged": False, "n": len(b)}
    if len(b) and 0 < b.mean() < 1 and np.ptp(a) > 0:
        beta, cov, dev, ok = irls(np.column_stack([np.ones_like(a), a]), b, link, iterations)
        out |= {"b0": beta[0], "b1": beta[1], "se0": math.sqrt(cov[0, 0]), "se1": math.sqrt(cov[1, 1]), "deviance": dev, "aic": dev + 4, "converged": ok}
    return out


def grouped_glm(rows: DataFrame, x: str, y: str, link: str = "logit", keys=("tid",), iterations: int = 25) -> DataFrame:
    """binomial_glm for many groups of bounded size: all rounds in one pass, with deviance, standard errors and AIC."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([glm_measures(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), link, iterations)])

    data = rows.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    return grouped(data, list(keys), kernel, "b0 double, b1 double, se0 double, se1 double, deviance double, aic double, converged boolean, n long")


def _first_eta(m: float, link: str) -> float:
    return math.log(m / (1 - m)) if link == "logit" else math.log(-math.log(1 - m))


def _working(eta: np.ndarray, y: np.ndarray, link: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, working residuals, the clipped predictor and the deviance of a round of least squares."""
    eta = np.minimum(np.maximum(eta, -30), 30 if link == "logit" else 3)
    if link == "logit":
        mu = 1 / (1 + np.exp(-eta))
        dm = mu * (1 - mu)
    else:
        e = np.exp(eta)
        mu = -np.expm1(-e)
        dm = np.exp(eta - e)
    mu, dm = np.minimum(np.maximum(mu, 1e-10), 1 - 1e-10), np.maximum(dm, 1e-10)
    no = 1 - mu
    return dm * dm / (mu * no), (y - mu) / dm, eta, float(-2 * (y @ np.log(mu) + (1 - y) @ np.log(no)))


def irls(X: np.ndarray, y: np.ndarray, link: str = "logit", iterations: int = 25, penalty: np.ndarray | None = None, offset: np.ndarray | float = 0.0):
    """Coefficients, their covariance, deviance and whether the deviance settled; `penalty` is added to the normal matrix."""
    beta = np.zeros(X.shape[1])
    beta[0] = _first_eta(y.mean(), link)
    penalty = np.zeros((X.shape[1],) * 2) if penalty is None else penalty
    dev, ok = math.inf, False
    for _ in range(iterations):
        w, off, eta, new = _working(X @ beta + offset, y, link)
        normal = X.T @ (w[:, None] * X) + penalty + 1e-10 * np.eye(X.shape[1])
        beta = np.linalg.solve(normal, X.T @ (w * (eta - offset + off)))
        if abs(new - dev) < 1e-8 * (abs(new) + 0.1):
            ok = True
            break
        dev = new
    return beta, np.linalg.inv(normal), new, ok


def random_irls(fixed: np.ndarray, y: np.ndarray, starts: np.ndarray, var: np.ndarray, link: str = "logit", iterations: int = 25):
    """irls of fixed effects and of random ones, which the rows from each start to the next share: coefficients and the
    random effects' posterior variances (both by group, then effect), deviance.

    The columns of fixed are 1, the slope's variable and any others; the random effects are those of the first two, with
    variances var.  A group's random effects meet only its own rows and the fixed effects, so that each round solves a
    2 by 2 matrix of each group and one of the fixed effects' size: the dense normal matrix is never built.
    """
    f, n, groups = fixed.shape[1], len(starts), np.diff(np.append(starts, len(y)))
    one = fixed.T.copy()
    i, j = np.triu_indices(f)
    pairs = one[i] * one[j]
    shared, own = np.empty((n, f, f)), np.empty((n, 2, 2))
    beta, u, dev = np.zeros(f), np.zeros((n, 2)), math.inf
    beta[0] = _first_eta(y.mean(), link)
    for _ in range(iterations):
        w, off, eta, new = _working(beta @ one + np.repeat(u[:, 0], groups) + np.repeat(u[:, 1], groups) * one[1], y, link)
        shared[:, i, j] = shared[:, j, i] = np.add.reduceat(pairs * w, starts, axis=1).T
        right = np.add.reduceat(one * (w * (eta + off)), starts, axis=1).T
        a, d, cross = shared[:, 0, 0] + (1 / var[0] + 1e-10), shared[:, 1, 1] + (1 / var[1] + 1e-10), shared[:, 0, 1]
        own[:, 0, 0], own[:, 1, 1], own[:, 0, 1] = d, a, -cross
        own[:, 1, 0] = own[:, 0, 1]
        own /= (a * d - cross * cross)[:, None, None]
        half = shared[:, :2, :]
        across = own[:, :, :1] * half[:, :1, :] + own[:, :, 1:] * half[:, 1:, :]  # own @ half
        flat = across.reshape(-1, f).T
        rest = shared.sum(0) + 1e-10 * np.eye(f) - flat @ half.reshape(-1, f)
        beta = np.linalg.solve(rest, right.sum(0) - flat @ right[:, :2].ravel())
        left = right[:, :2] - half @ beta
        u = own[:, :, 0] * left[:, :1] + own[:, :, 1] * left[:, 1:]
        if abs(new - dev) < 1e-8 * (abs(new) + 0.1):
            break
        dev = new
    spread = np.diagonal(own, axis1=1, axis2=2) + ((across @ np.linalg.inv(rest)) * across).sum(2)
    return beta, u, spread, new


def pql_measures(by: np.ndarray, a: np.ndarray, b: np.ndarray, auto: np.ndarray | None = None, link: str = "logit", rounds: int = 20) -> dict:
    """mixed_pql of one group's arrays, whose rows are together by `by`."""
    out = dict.fromkeys(("b0", "b1", "b_auto", "var0", "var1", "deviance"), math.nan)
    if not len(b) or not (0 < b.mean() < 1 and a.std() > 0):
        return out
    mean, sd = a.mean(), a.std(ddof=1)
    a = (a - mean) / sd
    starts = np.nonzero(np.append(True, by[1:] != by[:-1]))[0]
    fixed = np.column_stack([np.ones_like(a), a] + ([] if auto is None else [auto]))
    var = np.array([0.5, 0.5])
    for _ in range(rounds):
        beta, u, s, dev = random_irls(fixed, b, starts, var, link)
        new = np.maximum((u**2 + s).mean(0), 1e-6)
        done, var = np.abs(new - var).max() < 1e-4, new
        if done:
            break
    return out | {"b0": beta[0] - beta[1] * mean / sd, "b1": beta[1] / sd, "var0": var[0], "var1": var[1], "deviance": dev} | ({} if auto is None else {"b_auto": beta[2]})


def mixed_pql(rows: DataFrame, x: str, y: str, by: str = "r", link: str = "logit", autocovariate: str | None = None, keys=("tid",), rounds: int = 20) -> DataFrame:
    """Penalised quasi-likelihood with a random intercept and slope of each row of the band: fixed b0 and b1, variances.

    Variances are updated from the predicted effects and their posterior variances until they settle.  With an
    autocovariate its coefficient is a third fixed effect.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([by, "x", "y"], kind="stable")
        auto = pdf["auto"].to_numpy(float) if autocovariate else None
        return pd.DataFrame([pql_measures(pdf[by].to_numpy(), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), auto, link, rounds)])

    more = [F.col(autocovariate).cast("double").alias("auto")] if autocovariate else []
    data = rows.select(*keys, by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *more).dropna()
    return grouped(data, list(keys), kernel, "b0 double, b1 double, b_auto double, var0 double, var1 double, deviance double")


def bernoulli_performance(scored: DataFrame, p: str = "p", y: str = "y", keys=("tid",)) -> DataFrame:
    """Brier score, AUC, and the largest TSS, kappa with the mean cut-off, sensitivity, specificity of ties, per group.

    One window over the distinct scores: a row is predicted 1 if its score is at least the cut-off.
    """
    k = list(keys)
    at = scored.groupBy(*k, F.col(p).alias("cut")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"))
    down = Window.partitionBy(*k).orderBy(F.desc("cut"))
    whole = Window.partitionBy(*k)
    at = at.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum(F.col("n") - F.col("pos")).over(down), "positives": F.sum("pos").over(whole), "total": F.sum("n").over(whole), "squares": F.sum("sq").over(whole)})
    at = at.withColumn("negatives", F.col("total") - F.col("positives")).where("positives > 0 and negatives > 0")
    sens, spec = F.col("tp") / F.col("positives"), 1 - F.col("fp") / F.col("negatives")
    at = at.withColumns({"sens": sens, "spec": spec, "tss": sens + spec - 1, "prev": F.col("positives") / F.col("total")})
    po = F.col("prev") * F.col("sens") + (1 - F.col("prev")) * F.col("spec")
    at = at.withColumn("po", po).withColumn("pe", -2 * F.col("tss") * F.col("prev") * (1 - F.col("prev")) + F.col("po"))
    at = at.withColumn("kappa", (F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    # rank sums with ties: a positive beats all negatives of lower score and half of those of its own
    wins = F.col("pos") * (F.col("negatives") - F.col("fp") + (F.col("n") - F.col("pos")) / 2.0)
    at = at.withColumns({"wins": wins, "t_max": F.round(F.max("tss").over(whole), 9), "k_max": F.round(F.max("kappa").over(whole), 9)})
    on = lambda best, of, c: F.avg(F.when(F.round(of, 9) == F.col(best), F.col(c)))
    return at.groupBy(*k).agg(
        (F.first("squares") / F.first("total")).alias("brier"), (F.sum("wins") / (F.first("positives") * F.first("negatives"))).alias("auc"), F.first("t_max").alias("tss"), on("t_max", F.col("tss"), "cut").alias("tss_cut"),
        on("t_max", F.col("tss"), "sens").alias("tss_sens"), on("t_max", F.col("tss"), "spec").alias("tss_spec"), F.first("k_max").alias("kappa"), on("k_max", F.col("kappa"), "cut").alias("kappa_cut"),
    )


def morans_i(cells: DataFrame, value: str, keys=("tid",)) -> DataFrame:
    """keys, morans_i: the eight nearest neighbours of each cell (NEAREST), weights that add up to 1; value centred by its mean.

    Weights made symmetric give the same statistic.  Cells without a value are no neighbours; a cell with fewer than
    eight within NEAREST has weights over those that there are.
    """
    k = list(keys)
    mean = cells.groupBy(*k).agg(F.avg(value).alias("m"))
    dev = cells.where(F.col(value).isNotNull()).join(mean, k).select(*k, "r", "c", (F.col(value) - F.col("m")).alias("d"))
    near = shifted(dev, NEAREST, keys, (F.col("d").alias("d0"),)).join(dev, [*k, "r", "c"])
    order = Window.partitionBy(*k, "from_r", "from_c").orderBy(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"), "dr", "dc")
    eight = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 8)
    lagged = eight.groupBy(*k, "from_r", "from_c").agg((F.first("d0") * F.avg("d")).alias("cross"))
    cross = lagged.groupBy(*k).agg(F.sum("cross").alias("num"), F.count("*").alias("w"))
    total = dev.groupBy(*k).agg(F.sum(F.col("d") * F.col("d")).alias("den"), F.count("*").alias("n"))
    return cross.join(total, k).where("den > 0").select(*k, (F.col("n") / F.col("w") * F.col("num") / F.col("den")).alias("morans_i"))


def nearest_eight(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct cells: indices of the (at most) eight nearest within NEAREST, and which of the eight there are."""
    n, width = len(r), int(c.max() - c.min()) + 7
    at = r.astype(np.int64) * width + c
    by = np.argsort(at)
    place, found = np.zeros((n, 8), np.int64), np.zeros(n, np.int64)
    for dr, dc in NEAREST:
        want = at + dr * width + dc
        there = np.minimum(np.searchsorted(at[by], want), n - 1)
        hit = np.nonzero((at[by][there] == want) & (found < 8))[0]
        place[hit, found[hit]] = by[there[hit]]
        found[hit] += 1
    return place, np.arange(8) < found[:, None]


def morans_p(cells: DataFrame, value: str, permutations: int = 199, keys=("tid",), seed: int = 123) -> DataFrame:
    """keys, morans_i, p: the share of seeded permutations that reach the observed statistic."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], kind="stable")
        near, there = nearest_eight(pdf["r"].to_numpy(), pdf["c"].to_numpy())
        d = pdf["d"].to_numpy() - pdf["d"].mean()
        share = there / np.maximum(1, there.sum(1, keepdims=True))
        weight = share.sum()

        def stat(v: np.ndarray) -> float:
            return len(v) / weight * float((v * (v[near] * share).sum(1)).sum()) / float((v * v).sum())

        if not (d * d).sum() or not weight:
            return pd.DataFrame({"morans_i": [math.nan], "p": [math.nan]})
        rng = np.random.default_rng(seed)
        seen = stat(d)
        more = sum(stat(rng.permutation(d)) >= seen for _ in range(permutations))
        return pd.DataFrame({"morans_i": [seen], "p": [(more + 1) / (permutations + 1)]})

    return grouped(cells.where(F.col(value).isNotNull()).select(*keys, "r", "c", F.col(value).alias("d")), list(keys), kernel, "morans_i double, p double")


def semivariogram(profile: DataFrame, value: str, keys=("tid",), max_lag: int = 20, order: str = "c") -> DataFrame:
    """keys, lag, gamma, n_pairs of an evenly spaced profile: half the mean squared difference at each lag up to max_lag."""
    k = list(keys)
    a = profile.select(*k, F.col(order).alias("i"), F.col(value).alias("x")).where("x is not null")
    pairs = a.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("j", F.col("i") + F.col("lag"))
    other = a.select(*k, F.col("i").alias("j"), F.col("x").alias("y"))
    return pairs.join(other, [*k, "j"]).groupBy(*k, "lag").agg((F.avg(F.pow(F.col("x") - F.col("y"), 2)) / 2).alias("gamma"), F.count("*").alias("n_pairs"))


def variogram_range(gammas: DataFrame, keys=("tid",), max_range: float = 64.0) -> DataFrame:
    """keys, model, range, sill, nugget: a spherical model by weighted least squares over a grid of ranges; a Gaussian
    one where the spherical range is beyond max_range."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        h, g, w = (pdf[c].to_numpy(float) for c in ("lag", "gamma", "n_pairs"))
        best: dict = {}
        for model in ("spherical", "gaussian"):
            for a in np.linspace(1, 2 * max_range, 255):
                t = np.minimum(h / a, 1)
                f = 1.5 * t - 0.5 * t**3 if model == "spherical" else 1 - np.exp(-((h / a) ** 2))
                X = np.column_stack([np.ones_like(f), f]) * np.sqrt(w)[:, None]
                p, *_ = np.linalg.lstsq(X, g * np.sqrt(w), rcond=None)
                p = np.maximum(p, 0)
                rss = float((w * (g - p[0] - p[1] * f) ** 2).sum())
                if model not in best or rss < best[model][0]:
                    best[model] = (rss, a, p[1], p[0])
            if best[model][1] <= max_range:
                break
        _, a, sill, nugget = best[model]
        return pd.DataFrame([{"model": model, "range": a, "sill": sill, "nugget": nugget}])

    return grouped(gammas, list(keys), kernel, "model string, range double, sill double, nugget double")


def global_glm(rows: DataFrame, formula: str = "y ~ x + cols + rows", max_iter: int = 25):
    """One binomial model over all transects: distributed IRLS of Spark ML; the model's coefficients as rows (term, beta)."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    prepared = RFormula(formula=formula).fit(rows).transform(rows)
    model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=max_iter).fit(prepared)
    names = [a["name"] for group in prepared.schema["features"].metadata["ml_attr"]["attrs"].values() for a in sorted(group, key=lambda a: a["idx"])]
    return rows.sparkSession.createDataFrame([("(Intercept)", float(model.intercept)), *zip(names, map(float, model.coefficients), strict=True)], "term string, beta double")


def terrain_classes(cells: DataFrame, columns=("elev", "slope", "aspect"), k: int = 3, seed: int = 123) -> DataFrame:
    """keys, class_id: clusters of cells by k-means, named again by a forest that learns them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = cells.dropna(subset=list(columns))
    clustered = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(k=k, seed=seed, predictionCol="cluster")]).fit(rows).transform(rows)
    forest = RandomForestClassifier(labelCol="cluster", featuresCol="features", numTrees=10, seed=seed, predictionCol="named").fit(clustered)
    return forest.transform(clustered).select("tid", "r", "c", F.col("named").cast("int").alias("class_id"))
