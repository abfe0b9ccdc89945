"""Regressions by group against numpy, with dependent, short and far-off groups."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from slatecast.functions.scalars import two_sided_p
from slatecast.models.grouped import coefficient_rows, cross_moments, fits, judged, predicted, served


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    n = 40_000
    d = pd.DataFrame({"g": rng.integers(0, 2000, n), "a": rng.normal(5e4, 1, n), "b": rng.normal(0, 3, n), "c": rng.exponential(1, n), "d": rng.integers(0, 2, n).astype(float)})
    d["y"] = 3 + d.a * 0.5 - d.b + (d.g % 7) * d.c + 0.2 * d.d + rng.normal(0, 0.3, n)
    d.loc[d.g == 5, "d"] = 1.0  # no variation
    d.loc[d.g == 6, "c"] = 2 * d.b - 1  # dependent terms
    d.loc[d.g == 8, "y"] = np.nan
    return d


def test_thousands_of_groups(spark, frame):
    df = spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    columns, terms = ["a", "b", "c", "d", "y"], ["d", "a", "b", "c"]
    sums = cross_moments(df, ["g"], columns)
    got = fits(sums, columns, terms, "y").toPandas().set_index("g")
    small = fits(sums, columns, ["b"], "y").toPandas().set_index("g")  # another model from the same sums
    assert len(got) == 1999
    for g, rows in frame[(frame.g != 8)].groupby("g"):
        one = got.loc[g]
        x = np.column_stack([np.ones(len(rows)), rows[terms]])
        if len(rows) <= 5 or np.linalg.matrix_rank(np.column_stack([np.ones(len(rows)), (rows[terms] - rows[terms].mean())])) < 5:
            assert one.beta is None and one.se is None and np.isnan(one.r2)
            continue
        centred = np.column_stack([np.ones(len(rows)), rows[terms] - rows[terms].mean()])
        beta, rss = np.linalg.lstsq(centred, rows.y, rcond=None)[:2]
        inverse = np.linalg.inv(centred.T @ centred)
        assert one.beta[1:] == pytest.approx(beta[1:], rel=1e-6, abs=1e-6)
        assert one.se[1:] == pytest.approx(np.sqrt(rss[0] / (len(rows) - 5) * np.diag(inverse))[1:], rel=1e-5)
        fitted = x @ one.beta
        assert ((rows.y - fitted) ** 2).sum() == pytest.approx(rss[0], rel=1e-5) and one.sse == pytest.approx(rss[0], rel=1e-5)
        m = np.array(rows[terms].mean())
        s = rss[0] / (len(rows) - 5)
        assert one.se[0] == pytest.approx(np.sqrt(s * (1 / len(rows) + m @ inverse[1:, 1:] @ m)), rel=1e-5)
        assert one.r2 == pytest.approx(1 - rss[0] / ((rows.y - rows.y.mean()) ** 2).sum(), rel=1e-6)
        assert small.loc[g].beta == pytest.approx(np.polyfit(rows.b, rows.y, 1)[::-1], rel=1e-6, abs=1e-6)
    assert got.loc[5].beta is None and got.loc[6].beta is None


def test_prediction_and_judgement(spark, frame):
    d = frame[frame.g.isin([1, 2, 3])].drop(columns="d")
    df = spark.createDataFrame(d).withColumn("g", F.when(F.col("g") < 3, F.col("g")))  # a null key
    fitted = fits(cross_moments(df, ["g"], ["b", "y"]), ["b", "y"], ["b"], "y")
    got = judged(predicted(df, fitted, ["g"], ["b"]), ["g"], "y", before="a").toPandas().sort_values("g", na_position="last")
    for (_, rows), one in zip(d.groupby("g"), got.itertuples(), strict=True):
        said = np.polyval(np.polyfit(rows.b, rows.y, 1), rows.b)
        assert (one.test_n, one.rmse, one.mae) == (len(rows), pytest.approx(np.sqrt(((rows.y - said) ** 2).mean())), pytest.approx(abs(rows.y - said).mean()))
        assert one.directional == pytest.approx((np.sign(rows.y - rows.a) == np.sign(said - rows.a)).mean())
    assert fits(cross_moments(df.limit(0), ["g"], ["b", "y"]), ["b", "y"], ["b"], "y").isEmpty()
    whole = predicted(df, fits(cross_moments(df, [], ["b", "y"]), ["b", "y"], ["b"], "y"), [], ["b"])
    assert judged(whole, [], "y").first()["test_n"] == len(d)


def test_p_values(spark):
    ts = [0.0, 0.3, -1.96, 2.0, 4.2, -4.3, 6.0, 12.0, 30.0]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in ts], "t double").select(two_sided_p(F.col("t"))).collect()]
    assert got == pytest.approx([math.erfc(abs(t) / math.sqrt(2)) for t in ts], rel=1e-12, abs=1e-300)


def test_coefficient_rows(spark, frame):
    df = spark.createDataFrame(frame[frame.g == 1])
    rows = coefficient_rows(fits(cross_moments(df, ["g"], ["b", "y"]), ["b", "y"], ["b"], "y"), ["g"]).orderBy("term").collect()
    assert [r["term"] for r in rows] == ["b", "intercept"] and all(r["t"] == pytest.approx(r["beta"] / r["se"]) for r in rows)


def test_models_are_served_by_what_a_row_has(spark):
    models = spark.createDataFrame([("small", 1, ["intercept", "a"], [1.0, 2.0]), ("large", 0, ["intercept", "a", "b"], [0.0, 1.0, 10.0]), ("bare", 2, ["intercept"], [7.0])], "model string, priority int, terms array<string>, beta array<double>")
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None), (3, None, 5.0)], "k int, a double, b double")
    assert {r["k"]: (r["model"], r["predicted"]) for r in served(df, models, ["a", "b"]).collect()} == {1: ("large", 21.0), 2: ("small", 7.0), 3: ("bare", 7.0)}
    assert {(r["model"], r["predicted"]) for r in served(df, models.where("priority < 2"), ["a", "b"]).where("k = 3").collect()} == {(None, None)}
    assert {r["predicted"] for r in served(df, models.limit(0), ["a", "b"]).collect()} == {None}
