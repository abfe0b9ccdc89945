"""Places and agreements of orders against plain counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from slatecast.operators.orders import order_agreement
from slatecast.operators.ranks import counted, places, slices


@pytest.mark.parametrize("rows,block_rows", [(0, 10), (1, 10), (300, 10), (300, 1000), (400, 40)])
def test_agreement_counts_every_pair(spark, rows, block_rows):
    rng = np.random.default_rng(rows + block_rows)
    x = np.where(rng.random(rows) < 0.4, 5, rng.integers(0, 60, rows))  # a hot value
    y = np.where(rng.random(rows) < 0.2, 9, rng.integers(0, 40, rows) + x // 2)
    k = rng.integers(0, 2, rows)
    df = spark.createDataFrame([(*map(int, r),) for r in zip(k, x, y, strict=True)] + [(0, None, 1), (1, 1, None)], "k int, x int, y int")
    got = {r["k"]: tuple(r)[1:] for r in order_agreement(df, ["k"], "x", "y", block_rows).collect()}
    want = {}
    for g in set(k.tolist()):
        a, b = x[k == g], y[k == g]
        i, j = np.triu_indices(len(a), 1)
        p, q = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
        want[g] = (len(i), int((p == q).sum()), int((p * q < 0).sum()), int((p == 0).sum()), int((q == 0).sum()), int(((p == 0) & (q == 0)).sum()))
    assert got == want
    whole = order_agreement(df, [], "x", "y", block_rows).collect()
    if rows:
        i, j = np.triu_indices(rows, 1)
        assert whole[0]["crossed"] == int((np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) < 0).sum())


def test_places(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("k"), F.xxhash64("id").alias("h")).repartition(7)
    got = places(df, ["k"], ["h"], size="n").toPandas()
    for _, part in got.groupby("k", dropna=False):
        assert part.sort_values("h").place.tolist() == list(range(len(part))) and set(part.n) == {len(part)}
    same = places(df.withColumn("h", F.lit(1)), [], ["h"]).select("place").distinct().count()
    assert same == 5000


def test_counted_with_weights(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 2), ("a", 1, 1), (None, 9, 4), ("a", None, 7)], "k string, v int, w long")
    got = {(r["k"], r["v"]): (r["c_"], r["below_"], r["n_"]) for r in counted(df, "v", ["k"], "w").collect()}
    assert got == {("a", 1): (6, 0, 8), ("a", 3): (2, 6, 8), (None, 9): (4, 0, 4)}


def test_slices_of_one_value(spark):
    df = spark.range(1000).select("id", F.lit(4.0).alias("v"))
    got = slices(df, "v", "id", 10, "s").groupBy("s").agg(F.min("id"), F.count("*")).orderBy("s").collect()
    assert [tuple(r) for r in got] == [(k + 1, 100 * k, 100) for k in range(10)]
