"""Choosing and judging linear models from sums: folds, leave-one-out errors, ridge grids, two-way effects, bootstraps."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.writers import written
from .linear import Fit, moments, solve


def standardised(df: DataFrame, terms: Sequence[str], train: Column) -> tuple[DataFrame, list[tuple[float, float]]]:
    """The rows with terms less their mean over the training rows, by their population deviation there (1 if it is 0)."""
    got = df.where(train).agg(*(f(F.col(t).cast("double")).alias(f"{n}{k}") for k, t in enumerate(terms) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scales = [(got[f"m{k}"] or 0.0, got[f"s{k}"] or 1.0) for k in range(len(terms))]
    return df.withColumns({t: (F.col(t) - F.lit(m)) / F.lit(s) for t, (m, s) in zip(terms, scales, strict=True)}), scales


def dot(beta: np.ndarray, terms: Sequence[str]) -> Column:
    out = F.lit(float(beta[0]))
    for t, b in zip(terms, beta[1:], strict=True):
        out = out + F.lit(float(b)) * F.col(t)
    return out


def hat(inverse: np.ndarray, terms: Sequence[str]) -> Column:
    """x' A x of each row, with an intercept: how much a row pulls its own prediction."""
    xs = [F.lit(1.0), *(F.col(t).cast("double") for t in terms)]
    out = F.lit(0.0)
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            out = out + F.lit(float(inverse[i, j] * (1 if i == j else 2))) * xs[i] * xs[j]
    return out


def leave_one_out(df: DataFrame, terms: Sequence[str], target: str, ridge: float = 0.0, name: str = "loo_residual") -> DataFrame:
    """Adds each row's residual under the fit without it, e / (1 - h), from one fit; null where a row decides the fit alone."""
    xx, xy, _, _ = moments(df, terms, target)
    beta, inverse = solve(xx, xy, ridge)
    left = F.lit(1.0) - hat(inverse, terms)
    return df.withColumn(name, F.when(left > 1e-12, (F.col(target) - dot(beta, terms)) / left))


def ridge_grid(df: DataFrame, terms: Sequence[str], target: str, alphas: Sequence[float]) -> list[tuple[float, float, np.ndarray]]:
    """(alpha, mean squared leave-one-out error, coefficients) of each alpha: one pass for the sums, one for all errors."""
    xx, xy, _, n = moments(df, terms, target)
    fits = [solve(xx, xy, a) for a in alphas]
    errors = [F.avg(((F.col(target) - dot(b, terms)) / (F.lit(1.0) - hat(inv, terms))) ** 2).alias(f"e{k}") for k, (b, inv) in enumerate(fits)]
    got = df.dropna(subset=[*terms, target]).agg(*errors).first()
    return [(a, got[f"e{k}"] if n else 0.0, b) for k, (a, (b, _)) in enumerate(zip(alphas, fits, strict=True))]


def grouped_moments(df: DataFrame, by: str, terms: Sequence[str], target: str) -> dict:
    """X'X, X'y, y'y and n of each value of ``by``, which has few values (folds, years, buckets)."""
    xs = [F.lit(1.0), *(F.col(t).cast("double") for t in terms)]
    y, p = F.col(target).cast("double"), len(terms) + 1
    sums = [F.sum(xs[i] * xs[j]) for i in range(p) for j in range(i, p)] + [F.sum(x * y) for x in xs] + [F.sum(y * y), F.count("*")]
    out = {}
    for row in df.dropna(subset=[*terms, target]).groupBy(by).agg(*(s.alias(f"m{k}") for k, s in enumerate(sums))).collect():
        values = np.array([float(row[f"m{k}"] or 0) for k in range(len(sums))])
        xx = np.zeros((p, p))
        xx[np.triu_indices(p)] = values[: p * (p + 1) // 2]
        out[row[by]] = (xx + np.triu(xx, 1).T, values[p * (p + 1) // 2 : -2], values[-2], int(values[-1]))
    return out


def fold(key: Column | str, n: int) -> Column:
    """A fold from 0 for each key, the same on every run."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), 1, 7), 16, 10).cast("bigint") % n


def out_of_fold(df: DataFrame, by: str, terms: Sequence[str], target: str, name: str = "predicted") -> DataFrame:
    """Adds each row's prediction by the fit on all other values of ``by``: the sums of the others are the total less its own."""
    sums = grouped_moments(df, by, terms, target)
    if not sums:
        return df.withColumn(name, F.lit(None).cast("double"))
    total_xx, total_xy = (sum(s[k] for s in sums.values()) for k in (0, 1))
    out = F.lit(None).cast("double")
    for value, (xx, xy, _, _) in sums.items():
        beta, _ = solve(total_xx - xx, total_xy - xy)
        out = F.when(F.col(by) == value, dot(beta, terms)).otherwise(out)
    return df.withColumn(name, out)


def two_way(df: DataFrame, columns: Sequence[str], first: str, second: str, tolerance: float = 1e-10, most: int = 500) -> DataFrame:
    """Columns less the effects of two groupings, as alternating means would leave them at their limit.

    The effects of ``second`` solve the normal equations from which those of ``first`` are taken out. Conjugate gradients find them: a step
    takes the mean of a direction in each group of ``first`` and the sum of these in each of ``second``, two aggregations of the
    distinct pairs; only a few dot products reach the driver, so either grouping may have millions of values. Steps are written tables. It
    ends when the residual has shrunk by ``tolerance`` in every column, and raises an error after ``most`` steps. Groups that
    aren't connected keep their own levels, which the effects of ``first`` take up. What the tolerance has left of the effects is taken out
    in a second round, and values under 1e-12 of their column's root mean square are then 0: a column that the effects explain
    leaves zeros, not rounding errors.
    """
    out, squares, n = _less_effects(df, columns, first, second, tolerance, most)
    out, _, _ = _less_effects(out, columns, first, second, tolerance, most, [1e-28 * s for s in squares])
    least = {c: 1e-12 * sqrt(s / n) if n else 0.0 for c, s in zip(columns, squares, strict=True)}
    return out.withColumns({c: F.when(F.abs(c) <= F.lit(v), 0.0).otherwise(F.col(c)) for c, v in least.items()})


def _less_effects(df: DataFrame, columns: Sequence[str], first: str, second: str, tolerance: float, most: int, floor: Sequence[float] | None = None) -> tuple[DataFrame, list[float], float]:
    """The columns less effects that leave ``tolerance`` of the first residual, or squares under ``floor``; each column's sum of squares, and the rows."""
    k = range(len(columns))
    pairs = df.groupBy(F.col(first).alias("a_"), F.col(second).alias("b_")).agg(F.count("*").cast("double").alias("w_"), *(F.avg(c).alias(f"x{i}_") for i, c in enumerate(columns)))
    pairs = written(pairs, "pairs")

    def means(rows: DataFrame, values: Sequence[Column]) -> DataFrame:
        """The mean of each value in each group of ``first``, as m0_, m1_, ..."""
        return rows.groupBy("a_").agg(*((F.sum(F.col("w_") * v) / F.sum("w_")).alias(f"m{i}_") for i, v in enumerate(values)))

    def meet(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
        side = side.withColumnRenamed(key, f"{key}s_")
        return rows.join(side, rows[key].eqNullSafe(side[f"{key}s_"])).drop(f"{key}s_")

    start = meet(pairs, means(pairs, [F.col(f"x{i}_") for i in k]), "a_")
    state = start.groupBy("b_").agg(F.sum("w_").alias("n_"), *(F.sum(F.col("w_") * (F.col(f"x{i}_") - F.col(f"m{i}_"))).alias(f"r{i}_") for i in k))
    state = written(state.select("b_", "n_", *(F.lit(0.0).alias(f"g{i}_") for i in k), *(f"r{i}_" for i in k), *((F.col(f"r{i}_") / F.col("n_")).alias(f"p{i}_") for i in k)), "effects")
    scale = state.agg(*(F.coalesce(F.sum(F.col(f"r{i}_") ** 2 / F.col("n_")), F.lit(0.0)).alias(f"s{i}_") for i in k)).first()
    *size, n = pairs.agg(*(F.coalesce(F.sum(F.col("w_") * F.col(f"x{i}_") ** 2), F.lit(0.0)).alias(f"s{i}_") for i in k), F.sum("w_")).first()
    left, goal = list(scale), [max(tolerance**2 * s, t) for s, t in zip(scale, floor or [1e-30 * t for t in size], strict=True)]
    for _ in range(most):
        if all(now <= end for now, end in zip(left, goal, strict=True)):
            break
        ahead = means(meet(pairs, state.select("b_", *(f"p{i}_" for i in k)), "b_"), [F.col(f"p{i}_") for i in k])
        back = meet(pairs.select("a_", "b_", "w_"), ahead, "a_").groupBy("b_").agg(*(F.sum(F.col("w_") * F.col(f"m{i}_")).alias(f"t{i}_") for i in k))
        held = meet(state, back, "b_")
        held = written(held.select(*state.columns, *((F.col("n_") * F.col(f"p{i}_") - F.col(f"t{i}_")).alias(f"q{i}_") for i in k)), "effects")
        dot = lambda a, b, i, by="": F.sum(F.col(f"{a}{i}_") * F.col(f"{b}{i}_") / (F.col("n_") if by else 1.0))
        sums = held.agg(*(e.alias(f"{n}{i}") for i in k for n, e in (("pq", dot("p", "q", i)), ("rr", dot("r", "r", i, "n")), ("rq", dot("r", "q", i, "n")), ("qq", dot("q", "q", i, "n"))))).first()
        new = {}
        for i in k:
            open_ = left[i] > goal[i] and sums[f"pq{i}"] > 0
            alpha = sums[f"rr{i}"] / sums[f"pq{i}"] if open_ else 0.0
            after = max(0.0, sums[f"rr{i}"] - 2 * alpha * sums[f"rq{i}"] + alpha**2 * sums[f"qq{i}"])
            beta = after / sums[f"rr{i}"] if open_ and sums[f"rr{i}"] > 0 else 0.0
            r = F.col(f"r{i}_") - F.lit(alpha) * F.col(f"q{i}_")
            new |= {f"g{i}_": F.col(f"g{i}_") + F.lit(alpha) * F.col(f"p{i}_"), f"r{i}_": r, f"p{i}_": r / F.col("n_") + F.lit(beta) * F.col(f"p{i}_")}
            left[i] = after if open_ else min(left[i], goal[i])
        state = held.withColumns(new).drop(*(f"q{i}_" for i in k))
    else:
        raise RuntimeError(f"effects of {first} and {second} not found in {most} steps")
    effects = written(state.select("b_", *(f"g{i}_" for i in k)), "effects")
    rest = written(means(meet(pairs, effects, "b_"), [F.col(f"x{i}_") - F.col(f"g{i}_") for i in k]), "means")
    out = meet(meet(df.withColumns({"a_": F.col(first), "b_": F.col(second)}), effects, "b_"), rest, "a_")
    gone = {c: F.col(c) - F.col(f"g{i}_") - F.col(f"m{i}_") for i, c in enumerate(columns)}
    return out.select(*(gone[c].alias(c) if c in gone else F.col(c) for c in df.columns)), size, n


def p_value(t: float | None) -> float | None:
    """Two-sided, from the normal distribution."""
    return None if t is None else erfc(abs(t) / sqrt(2))


def coefficients(fit: Fit, model: str) -> list[tuple]:
    """(model, term, beta, se, t, p) of a fit."""
    t = [float(b / s) if s > 0 else None for b, s in zip(fit.beta, fit.se, strict=True)]
    return [(model, term, float(b), float(s), x, p_value(x)) for term, b, s, x in zip(fit.terms, fit.beta, fit.se, t, strict=True)]
