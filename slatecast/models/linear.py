"""Small linear models from one pass of moments; only p x p sums reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import quantiles


@dataclass
class Fit:
    terms: list[str]
    beta: np.ndarray
    se: np.ndarray
    r2: float
    n: int

    def predict(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for term, b in zip(self.terms[1:], self.beta[1:], strict=True):
            out = out + F.lit(float(b)) * F.col(term)
        return out

    def table(self, spark) -> DataFrame:
        t = [float(b / s) if s > 0 else None for b, s in zip(self.beta, self.se, strict=True)]
        rows = list(zip(self.terms, map(float, self.beta), map(float, self.se), t, strict=True))
        return spark.createDataFrame(rows, "term string, beta double, se double, t double")


def moments(df: DataFrame, terms: Sequence[str], target: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n with an intercept first; rows with a null are passed over."""
    xs = [F.lit(1.0), *(F.col(t).cast("double") for t in terms)]
    y = F.col(target).cast("double")
    w = F.lit(1.0) if weight is None else weight
    rows = df.dropna(subset=[*terms, target])
    p = len(xs)
    sums = [F.sum(w * xs[i] * xs[j]) for i in range(p) for j in range(i, p)] + [F.sum(w * x * y) for x in xs] + [F.sum(w * y * y), F.count("*")]
    got = list(rows.agg(*(s.alias(f"m{k}") for k, s in enumerate(sums))).first())
    n = int(got[-1])
    values = np.array([v or 0.0 for v in got[:-1]])
    xx = np.zeros((p, p))
    xx[np.triu_indices(p)] = values[: p * (p + 1) // 2]
    return xx + np.triu(xx, 1).T, values[p * (p + 1) // 2 : -1], float(values[-1]), n


def solve(xx: np.ndarray, xy: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and the inverse; a singular matrix gets 1e-9 on its diagonal."""
    a = xx + ridge * np.diag([0.0, *np.ones(len(xx) - 1)])
    try:
        if np.linalg.cond(a) > 1e14:
            raise np.linalg.LinAlgError
        inverse = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        inverse = np.linalg.inv(a + 1e-9 * np.eye(len(a)))
    return inverse @ xy, inverse


def ols(df: DataFrame, terms: Sequence[str], target: str, ridge: float = 0.0) -> Fit:
    xx, xy, yy, n = moments(df, terms, target)
    beta, inverse = solve(xx, xy, ridge)
    rss = max(0.0, yy - beta @ xy)
    tss = yy - xy[0] ** 2 / n if n else 0.0
    sigma2 = rss / (n - len(beta)) if n > len(beta) else 0.0
    return Fit(["intercept", *terms], beta, np.sqrt(np.maximum(sigma2 * np.diag(inverse), 0)), 1 - rss / tss if tss > 0 else 0.0, n)


def _eliminated(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower triangle and pivots of a matrix of products; a column whose pivot rounding may have made takes nothing out of later ones."""
    a, lower, least = a.copy(), np.eye(len(a)), 1e-13 * np.diag(a)
    for j in range(len(a)):
        if a[j, j] > least[j]:
            lower[j + 1 :, j] = a[j + 1 :, j] / a[j, j]
            a[j + 1 :] -= np.outer(lower[j + 1 :, j], a[j])
    return lower, np.diag(a)


def two_stage(df: DataFrame, endogenous: Sequence[str], instruments: Sequence[str], controls: Sequence[str], target: str) -> Fit:
    """Two-stage least squares of ``target`` on ``endogenous`` and ``controls``, from one pass of moments or two.

    The first stage regresses all regressors on instruments and controls; both stages are products of one
    matrix of sums, so the data is read once. Where the columns before it leave less than 1e-4 of an instrument's or control's
    squares, these sums lack the digits that tell it from them, and a second pass sums what is left of each column. Errors use
    the residuals of the second stage at the observed regressors. There must be as many instruments as endogenous terms, at least. An
    instrument that adds nothing to the others is passed over; coefficients are nan if the rest doesn't tell the regressors apart.
    """
    if len(instruments) < len(endogenous):
        raise ValueError("fewer instruments than endogenous terms")
    given, k = [*controls, *instruments], 1 + len(controls) + len(instruments)
    sums, xy, yy, n = moments(df, [*given, *endogenous], target)
    size = np.sqrt(np.diag(sums) / max(n, 1))
    size = np.where((size > 0) & (np.arange(len(size)) < k), size, 1.0)
    sums, xy, lower = sums / np.outer(size, size), xy / size, np.eye(len(sums))
    triangle, pivots = _eliminated(sums[:k, :k])
    if (pivots < 1e-4 * n).any():
        lower[:k, :k], names = triangle, [f"left{i}_" for i in range(1, k)]
        left = [sum((F.lit(float(b)) * F.col(c) for c, b in zip(given, row[1:], strict=True)), F.lit(float(row[0]))) for row in (np.linalg.inv(triangle) / size[:k])[1:]]
        rows = df.dropna(subset=[*given, *endogenous, target]).select(*(v.alias(c) for v, c in zip(left, names, strict=True)), *endogenous, target)
        sums, xy, yy, n = moments(rows, [*names, *endogenous], target)
    x = (lower * size[:, None])[[0, *range(k, len(sums)), *range(1, 1 + len(controls))]]  # regressors by the columns of the sums
    z = np.flatnonzero(np.diag(sums)[:k] > 1e-14 * n)
    unit = np.sqrt(np.diag(sums)[z])
    zx = sums[z] @ x.T / unit[:, None]
    first = np.linalg.solve(sums[np.ix_(z, z)] / np.outer(unit, unit), zx)
    fitted, own = zx.T @ first, np.sqrt(np.diag(x @ sums @ x.T))
    own[own == 0] = 1.0
    fitted /= np.outer(own, own)
    order = [0, *range(1 + len(endogenous), len(x)), *range(1, 1 + len(endogenous))]
    apart = (_eliminated(fitted[np.ix_(order, order)])[1] > 1e-13 * np.diag(fitted)[order]).all()
    inverse = np.linalg.inv(fitted) / np.outer(own, own) if apart else np.full(fitted.shape, np.nan)
    beta = inverse @ (first.T @ (xy[z] / unit))
    rss = float(np.maximum(0.0, yy - 2 * beta @ (x @ xy) + beta @ (x @ sums @ x.T) @ beta))
    tss = yy - xy[0] ** 2 / n if n else 0.0
    sigma2 = rss / (n - len(beta)) if n > len(beta) else 0.0
    return Fit(["intercept", *endogenous, *controls], beta, np.sqrt(np.maximum(sigma2 * np.diag(inverse), 0)), 1 - rss / tss if tss > 0 else 0.0, n)


def cluster_bootstrap(df: DataFrame, cluster: str, x: str, y: str, repetitions: int = 80, seed: int = 1729) -> DataFrame:
    """(repetition, n, slope) of ``y`` on ``x`` with whole clusters redrawn.

    Each cluster is first reduced to its sums. A repetition weighs it by a Poisson(1) draw hashed from seed,
    repetition and cluster, so draws need no exchange and a lost task makes the same ones again. Rows with
    a null are passed over; a repetition in which ``x`` doesn't vary has a null slope.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.dropna(subset=[cluster, x, y]).groupBy(F.col(cluster).alias("cluster_"))
    sums = sums.agg(F.count("*").alias("n_"), F.sum(a).alias("x_"), F.sum(b).alias("y_"), F.sum(a * a).alias("xx_"), F.sum(a * b).alias("xy_"))
    draws = sums.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    uniform = F.pmod(F.xxhash64(F.lit(seed), "repetition", "cluster_"), F.lit(1 << 53)) / float(1 << 53)
    upto = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
    weight = sum(((F.col("u_") >= float(c)).cast("int") for c in upto), F.lit(0))
    draws = draws.withColumn("u_", uniform).withColumn("w_", weight).where("w_ > 0")
    got = draws.groupBy("repetition").agg(*(F.sum(F.col("w_") * F.col(c)).alias(c) for c in ("n_", "x_", "y_", "xx_", "xy_")))
    spread = F.col("n_") * F.col("xx_") - F.col("x_") * F.col("x_")
    slope = F.when(spread > 1e-12 * F.col("n_") * F.col("xx_"), (F.col("n_") * F.col("xy_") - F.col("x_") * F.col("y_")) / spread)
    return got.select("repetition", F.col("n_").alias("n"), slope.alias("slope"))


def decay_fit(df: DataFrame, keys: Sequence[str], week: str, amount: str) -> DataFrame:
    """For each key the log-linear decay: beta, r2 and half_life = ln 2 / beta, null unless the amount falls."""
    rows = df.where(F.col(amount) > 0).select(*keys, F.col(week).cast("double").alias("w_"), F.ln(F.col(amount).cast("double")).alias("y_"))
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n_weeks"), F.regr_slope("y_", "w_").alias("s_"), F.regr_r2("y_", "w_").alias("r2"))
    beta = -F.col("s_")
    return fit.select(*keys, "n_weeks", beta.alias("beta"), F.when(beta > 0, F.lit(float(np.log(2))) / beta).alias("half_life"), "r2")


def intervals(train: DataFrame, residual: str, bucket: str, levels: Sequence[float] = (0.5, 0.8, 0.9), least: int = 5) -> DataFrame:
    """For each bucket the quantiles of absolute residuals; buckets of fewer than ``least`` rows take the global ones."""
    sizes = train.withColumn("abs_", F.abs(F.col(residual)))
    names = [f"q{k}" for k in range(len(levels))]
    own = quantiles(sizes, "abs_", levels, [bucket]).select(bucket, F.array(*names).alias("own_"))
    own = train.groupBy(bucket).agg(F.count("*").alias("n")).join(own, bucket)
    all_ = quantiles(sizes, "abs_", levels).select(F.array(*names).alias("all_"))
    chosen = F.when(F.col("n") >= least, F.col("own_")).otherwise(F.col("all_"))
    source = F.when(F.col("n") >= least, "bucket").otherwise("global")
    return own.crossJoin(F.broadcast(all_)).select(bucket, "n", source.alias("source"), *(F.get(chosen, F.lit(k)).alias(f"q{int(100 * x)}") for k, x in enumerate(levels)))
