"""Model selection from sums against numpy on whole matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from slatecast.models.linear import Fit, ols
from slatecast.sources.writers import written
from slatecast.models.selection import coefficients, fold, grouped_moments, leave_one_out, out_of_fold, p_value, ridge_grid, standardised, two_way


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=150)
    rows = [(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "k int, a double, b double, y double")


def test_leave_one_out(data):
    x, y, df = data
    one = np.column_stack([np.ones(len(y)), x])
    want = [y[i] - one[i] @ np.linalg.lstsq(np.delete(one, i, 0), np.delete(y, i), rcond=None)[0] for i in range(len(y))]
    got = {r["k"]: r["loo_residual"] for r in leave_one_out(df, ["a", "b"], "y").collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(want)


def test_a_row_that_decides_its_own_fit_has_no_residual(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (1.0, 5.0)], "a double, y double")
    got = {r["a"]: r["loo_residual"] for r in leave_one_out(df, ["a"], "y").collect()}
    assert got[1.0] is None and got[0.0] is not None


def test_ridge_grid(data):
    x, y, df = data
    one = np.column_stack([np.ones(len(y)), x])
    for alpha, error, beta in ridge_grid(df, ["a", "b"], "y", (0.1, 10.0, 1000.0)):
        penalty = alpha * np.diag([0, 1, 1])
        left = []
        for i in range(len(y)):
            a, b = np.delete(one, i, 0), np.delete(y, i)
            left.append(y[i] - one[i] @ np.linalg.solve(a.T @ a + penalty, a.T @ b))
        assert error == pytest.approx(np.mean(np.square(left)))
        assert beta == pytest.approx(np.linalg.solve(one.T @ one + penalty, one.T @ y))


def test_folds(data):
    x, y, df = data
    one = np.column_stack([np.ones(len(y)), x])
    rows = out_of_fold(df.withColumn("f", F.col("k") % 4), "f", ["a", "b"], "y").collect()
    for r in rows:
        others = np.arange(len(y)) % 4 != r["f"]
        beta = np.linalg.lstsq(one[others], y[others], rcond=None)[0]
        assert r["predicted"] == pytest.approx(one[r["k"]] @ beta)
    sizes = df.groupBy(fold("k", 5)).count().collect()
    assert sum(r["count"] for r in sizes) == 150 and len(sizes) == 5
    assert grouped_moments(df.where("k < 0"), "k", ["a"], "y") == {}


def test_standardised(data):
    x, _, df = data
    got, scales = standardised(df.withColumn("c", F.lit(3.0)), ["a", "c"], F.col("k") < 100)
    assert scales[0] == pytest.approx((x[:100, 0].mean(), x[:100, 0].std())) and scales[1] == (3.0, 1.0)
    assert got.where("k < 100").agg(F.avg("a")).first()[0] == pytest.approx(0, abs=1e-9)


def test_two_way_effects_of_an_unbalanced_table(spark):
    """Equal to the residuals on both sets of dummies, which is where alternating means end up."""
    rng = np.random.default_rng(6)
    rows = [(f"m{g}", int(t), float(v), float(w)) for g, t, v, w in zip(rng.integers(0, 7, 120), rng.integers(0, 12, 120), rng.normal(size=120), rng.normal(size=120), strict=True)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, g string, t int, x double, y double")
    dummies = np.column_stack([*(np.array([r[0] == f"m{g}" for r in rows], float) for g in range(7)), *(np.array([r[1] == t for r in rows], float) for t in range(12))])
    got = {r["k"]: (r["x"], r["y"]) for r in two_way(df, ["x", "y"], "g", "t").collect()}
    for c in (0, 1):
        v = np.array([r[2 + c] for r in rows])
        want = v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
        assert [got[k][c] for k in range(120)] == pytest.approx(want, abs=1e-8)


def test_two_way_effects_of_many_groups(spark):
    """100,000 values on either side: what is left sums to 0 in every group, and known slopes come back."""
    k = spark.range(500_000)
    g, t = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100_000))
    g = F.when(F.col("id") % 5 == 0, 7).otherwise(g)  # a hot group
    df = k.select("id", g.alias("g"), t.alias("t")).withColumn("x", F.randn(5) + F.col("g") % 7).withColumn("y", 2 * F.col("x") + F.sin(F.col("g").cast("double")) - F.col("t") % 11)
    df = written(df, "two-way")
    out = written(two_way(df, ["x", "y"], "g", "t", tolerance=1e-7), "two-way-done")
    assert out.count() == 500_000 and out.columns == df.columns
    for by in ("g", "t"):
        worst = out.groupBy(by).agg(F.abs(F.sum("x")).alias("x"), F.abs(F.sum("y")).alias("y")).agg(F.max("x"), F.max("y")).first()
        assert max(worst) < 1e-3
    assert out.agg(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") ** 2)).first()[0] == pytest.approx(2, abs=1e-4)


def test_two_way_of_a_column_that_effects_explain(spark):
    """Zeros are left, in a table with gaps too, and a part of 1e-9 that they don't explain stays."""
    rng = np.random.default_rng(8)
    have = [(g, t) for g in range(9) for t in range(14) if rng.random() < 0.6]
    df = spark.createDataFrame([(g, t, math.log(90 + g) + math.log(30 + t), math.log(90 + g) + math.log(30 + t) + 1e-9 * (g * t % 3)) for g, t in have], "g int, t int, x double, y double")
    got = two_way(df, ["x", "y"], "g", "t").toPandas()
    assert len(got) == len(have) and (got.x == 0).all()
    dummies = np.column_stack([*((got.g == g).to_numpy(float) for g in range(9)), *((got.t == t).to_numpy(float) for t in range(14))])
    more = (got.g * got.t % 3).to_numpy(float)
    assert 1e9 * got.y.to_numpy() == pytest.approx(more - dummies @ np.linalg.lstsq(dummies, more, rcond=None)[0], abs=1e-4)


def test_two_way_edges(spark):
    df = spark.createDataFrame([(1, None, "a", 2.0), (2, "p", "a", 4.0), (3, "q", None, 5.0)], "k int, g string, t string, x double")
    assert {r["k"]: round(r["x"], 9) for r in two_way(df, ["x"], "g", "t").collect()} == {1: 0.0, 2: 0.0, 3: 0.0}
    assert two_way(df.limit(0), ["x"], "g", "t").isEmpty()


def test_p_values_and_tables(data):
    _, _, df = data
    assert p_value(1.959963984540054) == pytest.approx(0.05) and p_value(None) is None
    rows = coefficients(ols(df, ["a"], "y"), "m")
    assert [r[1] for r in rows] == ["intercept", "a"] and all(r[5] == pytest.approx(math.erfc(abs(r[4]) / math.sqrt(2))) for r in rows)
    assert coefficients(Fit(["intercept"], np.array([1.0]), np.array([0.0]), 0.0, 1), "m")[0][4:] == (None, None)
