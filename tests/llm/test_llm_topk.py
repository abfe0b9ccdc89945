"""Exact top-k against all pairs, SQL, and the places where the search stops."""

import duckdb
import numpy as np
import pytest
from plain import SMALL
from pyspark.sql import functions as F
from slatecast.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, uid int, score string"


def all_pairs(rows, k, every):
    out = []
    for n, (q, x) in enumerate(rows):
        if q is None or q % every or not fine(x):
            continue
        found = [(-float(np.dot(np.array(x, float), np.array(y, float))), i is None, i) for m, (i, y) in enumerate(rows) if m != n and fine(y) and len(y) == len(x)]
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def fine(x):
    return x is not None and all(c is not None and np.isfinite(c) for c in x)


def got(spark, rows, k=5, every=50, **bounds):
    df = spark.createDataFrame([(i, x, 1, "s") for i, x in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % every == 0, k, **bounds).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs_with_ties_and_blocks(llm, seed):
    rng = np.random.default_rng(seed)
    dims = (2, 5, 16)[seed]
    rows = [(int(i), [float(v) for v in rng.integers(-3, 4, dims)]) for i in rng.permutation(700)]
    assert got(llm, rows, block_rows=64, group_queries=5) == all_pairs(rows, 5, 50)


def test_awkward_vectors(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [inf, 0.0]), (250, []), (300, []), (350, [1.0, 0.0, 2.0])]
    rows += [(None, [5.0, 5.0]), (7, [5.0, 5.0]), (9, [-1e3, 0.0]), (400, [0.0, 0.0]), (450, [2.0**90, -(2.0**90)]), (-50, [0.5, 0.25])]
    assert got(llm, rows, 3) == all_pairs(rows, 3, 50)
    assert got(llm, []) == [] and got(llm, [(1, [1.0])]) == [] and got(llm, [(50, [1.0])]) == []


def test_driver_rows_against_sql(llm):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = db.sql(topk.OP11_SQL)
    out = topk.op11_exact_topk(llm, SMALL)
    assert out.columns == want.columns and [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint"]
    rows = sorted(map(tuple, out.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) >= 20


def test_search_stops_early_and_is_right():
    rng = np.random.default_rng(5)
    x = np.round(rng.exponential(10, (5000, 3)) ** 2)
    block = topk.Block(np.arange(5000), np.arange(5000), np.ones(5000, bool), x)
    for weights in ([3.0, 1.0, 0.0], [1.0, 1.0, 1.0], [0.0, 0.0, 2.0]):
        best = topk.Best(5)
        went = topk.search(block, -1, np.array(weights), best)
        s = x @ np.array(weights)
        assert went < 1000 and best.ids.tolist() == sorted(range(5000), key=lambda i: (-s[i], i))[:5]
    best = topk.Best(5)
    assert topk.search(block, -1, np.zeros(3), best) == 5000 and best.ids.tolist() == [0, 1, 2, 3, 4]


def test_blocks_survive_packing():
    x = np.array([[1.5, -2.0], [0.1, 7.0]])
    block = topk.Block(np.array([4, 5]), np.array([7, 0]), np.array([True, False]), x)
    back = topk.Block.unpack(block.pack())
    assert np.array_equal(back.x, x) and np.array_equal(back.lists, block.lists) and back.known.tolist() == [True, False] and back.ids.tolist() == [7, 0]
