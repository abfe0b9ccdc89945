"""The typed TSV scan on suppliers whose names and balances are odd, against its SQL."""

import duckdb

from slatecast.plans import catalog

NAMES = ["plain", None, "", " ", "x" * 250, "blanks after  ", "  before", "a\tb", "tab\t", "a\nb", "a\r\nb", "a\rb", "nul\0", "\\N", "\\", "a\\tb", "a\\\\", "\\\n", '"', 'a"b"', "#é漢😀"]
BALANCES = [1.0, None, -1.0, 0.0, -0.0, 0.285, 1.005, 2.675, 0.125, 123456789012345.67, 1e307, float("inf"), float("nan")]


def test_typed_scan_of_odd_suppliers(spark, tmp_path):
    """Every row is found, names come back whole, balances are rounded as in SQL."""
    ids = [-5, None, 2**62]
    values = [(ids[k] if k < 3 else k, NAMES[k % len(NAMES)], 1, BALANCES[k % len(BALANCES)]) for k in range(len(NAMES) * len(BALANCES))]
    spark.createDataFrame(values, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.QUERIES["tsv_typed_scan"](spark, str(tmp_path))
    cur = duckdb.connect().execute(f"WITH supplier AS (FROM '{tmp_path}/supplier.parquet/*.parquet') " + catalog.SQL["tsv_typed_scan"])
    assert got.columns == [d[0] for d in cur.description] == ["id", "found", "name", "balance"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, cur.fetchall()))
