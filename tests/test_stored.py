"""Stored tables and permutations."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from slatecast.operators.permutation import permuted
from slatecast.sources.stored import StoredTable

SCHEMA = "k int, part string, v int"


def files(at):
    return {p.relative_to(at): p.stat().st_mtime_ns for p in Path(at).rglob("*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_changed_partitions_are_written(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "part")
    new = lambda *r: spark.createDataFrame(r, SCHEMA)
    assert t.read().isEmpty()
    assert t.merge("a", new((1, "x", 1), (2, "x", 2), (3, "y", 3), (4, None, 4)))
    before = files(tmp_path / "t" / "rows")
    assert t.merge("b", new((2, "x", 20), (2, "x", 21), (5, "x", 5)), order=[F.col("v")])
    after = files(tmp_path / "t" / "rows")
    same = {p: m for p, m in before.items() if "part=x" not in str(p)}
    assert len(same) == 2 and same.items() <= after.items() and not {p for p in before if "part=x" in str(p)} & set(after)
    want = [(1, "x", 1), (2, "x", 21), (3, "y", 3), (4, None, 4), (5, "x", 5)]
    assert rows(t.read()) == sorted(want, key=str)
    assert not t.merge("a", new((1, "x", 99))) and files(tmp_path / "t" / "rows") == after
    assert {r["batch"]: r["partitions"] for r in t.batches().collect()} == {"a": 3, "b": 1}
    assert t.merge("empty", new()) and files(tmp_path / "t" / "rows") == after
    assert t.delete("c", new((3, "y", 0), (4, None, 0), (1, "x", 0)))
    assert rows(t.read()) == [(2, "x", 21), (5, "x", 5)]


def test_a_batch_that_broke_off_is_merged_again(spark, tmp_path, monkeypatch):
    t = StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], "part")
    t.merge("a", spark.createDataFrame([(1, "x", 1), (2, "y", None)], SCHEMA))
    update = spark.createDataFrame([(1, "x", 7), (2, "y", 8)], SCHEMA)
    note = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")) if a[0] and a[0][0][0] == "b" else note(*a, **k))
    with pytest.raises(OSError, match="lost"):
        t.merge("b", update, keep_old=["v"])
    monkeypatch.undo()
    assert t.merge("b", update, keep_old=["v"]) and rows(t.read()) == [(1, "x", 1), (2, "y", 8)]


def test_columns_have_to_be_there(spark, tmp_path):
    with pytest.raises(ValueError, match="columns"):
        StoredTable(spark, str(tmp_path), SCHEMA, ["k"], "day")


def test_permutations(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, 1).when(F.col("id") < 2999, F.col("id") % 50).alias("g"), F.col("id").cast("string").alias("row"), (F.col("id") * 2).alias("v"))
    a = permuted(df, ["g"], ["v"], "row", 3).toPandas().sort_values("id").reset_index(drop=True)
    b = permuted(df.repartition(5), ["g"], ["v"], "row", 3).toPandas().sort_values("id").reset_index(drop=True)
    assert a.equals(b) and not a.v_permuted.equals(permuted(df, ["g"], ["v"], "row", 4).toPandas().sort_values("id").reset_index(drop=True).v_permuted)
    for _, part in a.groupby("g", dropna=False):
        assert sorted(part.v) == sorted(part.v_permuted)
    assert (a.v == a.v_permuted).mean() < 0.1
    whole = permuted(df, [], ["v", "id"], "row", 3).toPandas()
    assert sorted(whole.v_permuted) == sorted(whole.v) and (whole.v_permuted == 2 * whole.id_permuted).all()
