"""Operators on small inputs whose results are known."""

import hashlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from slatecast.functions.scalars import business_minute, canonical_url, day_block, decayed_loss, parse_date, parse_number, season, title_key, title_variants
from slatecast.models.linear import cluster_bootstrap, decay_fit, intervals, ols, two_stage
from slatecast.operators.aggregates import concentration_without_self, correlation
from slatecast.operators.joins import as_of_join, interval_join
from slatecast.operators.sampling import first_by_hash, stratified, with_certainty
from slatecast.operators.tables import insert_ignore, upsert
from slatecast.operators.ranks import midranks, quantiles, slices, value_quartiles
from slatecast.operators.windows import gap_episodes
from slatecast.sources.readers import html_cells, html_records, read_tsv, with_names
from slatecast.streaming.events import run_once, snapshots, stream, tumbling


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_scalars(spark):
    lit = F.lit
    assert one(spark, title_key(lit("The Fast & Furious (2001)!")), title_key(lit("  "))) == ["the fast and furious", None]
    assert one(spark, title_variants(lit("Matrix, The"))) == [["matrix the", "the matrix"]]
    assert one(spark, *(parse_number(lit(x)) for x in ("$1,234,567", "+12.3%", "(45)", "n/a", "1.5k", "2M"))) == [1234567.0, 12.3, -45.0, None, 1500.0, 2e6]
    assert one(spark, *(parse_date(lit(x)) for x in ("2026-03-04", "3/4/2026", "Mar 4th, 2026", "soon"))) == [date(2026, 3, 4)] * 3 + [None]
    assert one(spark, canonical_url(lit("http://a.b/c/?utm_x=1&q=2#t"))) == ["http://a.b/c?q=2"]
    at = [business_minute(F.expr(f"timestamp_ntz'2026-01-01 {t}'")) for t in ("00:30:00", "05:00:00", "19:00:00")]
    assert one(spark, *at, *(day_block(a) for a in at)) == [1470, 300, 1140, 4, 1, 3]
    days = ("2026-06-01", "2026-12-20", "2027-01-03", "2026-10-01")
    assert one(spark, *(season(lit(d).cast("date")) for d in days)) == ["summer_2026", "holiday_2026", "holiday_2026", None]
    assert one(spark, F.round(decayed_loss(lit(0.0), lit(-0.4), lit(0.75)), 9)) == [0.0]


def test_competitors(spark):
    df = spark.createDataFrame([(1, 1, 100), (1, 2, 50), (1, 3, 25), (1, 4, 0), (2, 1, 5)], "day int, movie int, gross long")
    got = {(r["day"], r["movie"]): r for r in concentration_without_self(df, ["day"], "movie", "gross").collect()}
    r = got[1, 1]
    assert (r["others_total"], r["others_top1"], r["others_count"], round(r["own_share"], 6)) == (75.0, 50.0, 2, round(100 / 175, 6))
    assert got[2, 1]["others_total"] == 0 and got[2, 1]["others_hhi"] == 0 and (1, 4) not in got


def test_as_of_and_interval(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 7, "c"), (2, 9, None)], "k int, t int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in as_of_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None, (None, 3): None}
    spans = spark.createDataFrame([(1, 2, 5)], "k int, a int, b int")
    assert sorted(r["v"] for r in interval_join(spans, right, ["k"], "t", "a", "b").collect()) == ["a", "b"]


def test_episodes_and_decay(spark):
    d = [date(2026, 5, 1), date(2026, 5, 2), date(2026, 5, 16), date(2026, 6, 1)]
    got = gap_episodes(spark.createDataFrame([(10, x) for x in d], "run int, day date"), ["run"], "day", 14).orderBy("day").collect()
    assert [r["episode"] for r in got] == [1, 1, 1, 2]
    fit = decay_fit(spark.createDataFrame([(1, w, g) for w, g in enumerate((1000, 500, 250, 125))], "k int, w int, g int"), ["k"], "w", "g").first()
    assert fit["half_life"] == pytest.approx(1.0) and fit["r2"] == pytest.approx(1.0)


def test_quartiles_keep_ties_together(spark):
    values = [1, 1, 1, 2, 3, 4, 4, 9, 10, 11, None]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    have = sorted(v for v in values if v is not None)
    mid = {v: np.mean([k for k, x in enumerate(have) if x == v]) for v in have}
    got = sorted((r["v"], r["quartile"]) for r in value_quartiles(df, "v").collect() if r["v"] is not None)
    assert got == [(v, int(mid[v] * 4 // len(have)) + 1) for v in have]


def test_ranks_over_many_values(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), int(g), float(v)) for k, (g, v) in enumerate(zip(rng.integers(0, 3, 5000), np.round(rng.normal(size=5000), 2), strict=True))]
    df = spark.createDataFrame([*rows, (9999, 0, None)], "k int, g int, v double").repartition(7)
    by = {g: np.array([v for _, h, v in rows if h == g]) for g in range(3)}
    for r in quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).collect():
        assert [r[f"q{k}"] for k in range(5)] == pytest.approx(np.quantile(by[r["g"]], [0, 0.25, 0.5, 0.9, 1.0]))
    for r in midranks(df, "v", "mid", ["g"]).where("v is not null").collect():
        assert r["mid"] == pytest.approx((by[r["g"]] < r["v"]).sum() + ((by[r["g"]] == r["v"]).sum() - 1) / 2)
    order = sorted(rows, key=lambda x: (x[2], x[0]))
    want = {row[0]: k + 1 for k in range(10) for row in order[k * 5000 // 10 : (k + 1) * 5000 // 10]}
    assert {r["k"]: r["d"] for r in slices(df, "v", "k", 10, "d").collect()} == want
    seven = {row[0]: k + 1 for k in range(7) for row in order[:100][k * 100 // 7 : (k + 1) * 100 // 7]}
    assert {r["k"]: r["d"] for r in slices(df.where(F.col("k").isin(*seven)), "v", "k", 7, "d").collect()} == seven


def test_tables(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (None, "n", 0.0)], "k int, s string, x double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 7.0), (2, "z", None), (None, "m", 1.0)], "k int, s string, x double")
    got = {r["k"]: (r["s"], r["x"]) for r in upsert(base, new.where("s is not null"), ["k"], keep_old=["s"], keep_new=["x"]).collect()}
    assert got == {1: ("a", 1.0), 2: ("b", None), 3: ("c", 7.0), None: ("n", 1.0)}
    assert sorted(r["k"] for r in insert_ignore(base.dropna(subset=["k"]), new.dropna(subset=["k"]), ["k"]).collect()) == [1, 2, 3]


def test_samples(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 1.0).alias("v"))
    out = stratified(df, "id", "g", 10, "seed")
    assert out.count() == 10 and out.agg(F.sum("weight")).first()[0] == pytest.approx(100)
    skewed = spark.range(30_000).select("id", F.when(F.col("id") < 20, 1).otherwise(0).alias("g"))
    quotas = spark.createDataFrame([(0, 29_980, 40), (1, 20, 30)], "g int, n_ long, quota_ long")
    picked = first_by_hash(skewed, "id", "g", quotas, "s").collect()
    digest = lambda k: hashlib.sha256(f"s:{k}".encode()).hexdigest()
    assert {r["id"] for r in picked} == {*sorted(range(20, 30_000), key=digest)[:40], *range(20)}
    both = with_certainty(df, "id", "g", "v", 12, 4, "seed")
    assert {r["id"] for r in both.where("is_certain").collect()} == {96, 97, 98, 99} and both.count() == 12


def test_linear_model(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2, -3] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    fit = ols(df, ["a", "b"], "y")
    want = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
    assert fit.beta == pytest.approx(want) and fit.r2 > 0.99 and fit.n == 200
    same = df.withColumn("b", F.col("a") * 2)
    assert np.isfinite(ols(same, ["a", "b"], "y").beta).all()
    r = spark.createDataFrame([("x", 1.0)] * 3 + [("y", float(k)) for k in range(10)], "g string, e double")
    assert {q["g"]: q["source"] for q in intervals(r, "e", "g").collect()} == {"x": "global", "y": "bucket"}
    assert spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double").agg(correlation(F.col("x"), F.col("y"))).first()[0] is None


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('id\tname\n1\t"x\n2\t\\N\n3\t\n')
    assert [tuple(r) for r in read_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("1", '"x'), ("2", None), ("3", None)]
    df = spark.createDataFrame([(1, 2)], "`﻿Movie Title` int, Gross int")
    assert with_names(df, {"title": ["movie_title"], "gross": []}, ("title",)).columns == ["title", "gross"]
    with pytest.raises(ValueError, match="theaters"):
        with_names(df, {"theaters": ["screens"]}, ("theaters",))
    page = "<table><tr><th>Rank<th>Title<th>Gross</tr><tr><td>1</td><td><a href='/movie/x'>X  y</a></td><td>$5</td></tr></table>"
    cells = html_cells(spark.createDataFrame([(7, page), (8, None)], "page_id long, html string"), "page_id", "html")
    assert [tuple(r) for r in html_records(cells, "page_id", {"rank": 0, "title": 1, "gross": 2}, 3).collect()] == [(7, 0, 1, "1", "X y", "$5", "/movie/x")]


def test_streams_equal_batches(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = {}
    flow = tumbling(stream(spark, sf, "events.parquet"), "ts", ["user_id"], "6 hours", "90 days", "value")
    flow.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    want = tumbling(events, "ts", ["user_id"], "6 hours", "90 days", "value")
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, want.collect()))
    run_once(snapshots(stream(spark, sf, "events.parquet"), "ts", ["user_id"], "90 days"), str(tmp_path / "c2"), lambda df, n: out.update({n: df.count()}))
    assert sum(out.values()) == events.select("user_id").distinct().count()


def test_two_stage(spark):
    rng = np.random.default_rng(3)
    z, w, u = rng.normal(size=(3, 400))
    x = z + 0.5 * w + u
    y = 2 * x - w + 3 * u + 1
    df = spark.createDataFrame([*zip(*(v.tolist() for v in (x, z, w, y)), strict=True), (None, 1.0, 1.0, 1.0)], "x double, z double, w double, y double")
    fit = two_stage(df, ["x"], ["z"], ["w"], "y")
    both, have = np.column_stack([np.ones(400), x, w]), np.column_stack([np.ones(400), z, w])
    assert fit.terms == ["intercept", "x", "w"] and fit.n == 400
    assert np.allclose(fit.beta, np.linalg.solve(have.T @ both, have.T @ y))
    with pytest.raises(ValueError):
        two_stage(df, ["x"], [], ["w"], "y")


def test_two_stage_of_instruments_alike(spark):
    rng = np.random.default_rng(4)
    z, w, u, v = rng.normal(size=(4, 400))
    x = z + 0.5 * w + u
    near = 3 * z + 2e-6 * v + 7
    df = spark.createDataFrame([*zip(*(c.tolist() for c in (x, z, w, 2 * x - w + 3 * u + 1, near, 3 * z + 7, near * 0)), strict=True)], "x double, z double, w double, y double, near double, again double, zero double")
    fit = two_stage(df, ["x"], ["z"], ["w"], "y")
    assert np.allclose(two_stage(df, ["x"], ["z", "again"], ["w"], "y").beta, fit.beta)
    have, both = np.column_stack([np.ones(400), z, w, v]), np.column_stack([np.ones(400), x, w])
    said = have @ np.linalg.lstsq(have, both, rcond=None)[0]
    assert np.allclose(two_stage(df, ["x"], ["z", "near"], ["w"], "y").beta, np.linalg.lstsq(said, 2 * x - w + 3 * u + 1, rcond=None)[0], atol=1e-8)
    assert np.isnan(two_stage(df, ["x"], ["zero"], ["w"], "y").beta).all() and np.isnan(two_stage(df.limit(0), ["x"], ["z"], [], "y").beta).all()


def test_cluster_bootstrap(spark):
    rng = np.random.default_rng(5)
    rows = [(c, float(v), float(2.0 * v + rng.normal())) for c in range(60) for v in rng.normal(size=5)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1, None, 1.0)], "c int, x double, y double")
    got = cluster_bootstrap(df, "c", "x", "y").collect()
    assert sorted(r.repetition for r in got) == list(range(1, 81))
    slopes = np.array([r.slope for r in got])
    assert abs(slopes.mean() - 2) < 0.2 and 0.01 < slopes.std() < 0.3
    assert 240 < np.mean([r.n for r in got]) < 360
    assert cluster_bootstrap(df.where("c < 0"), "c", "x", "y").count() == 0
    assert {r.slope for r in cluster_bootstrap(df.withColumn("x", F.lit(1.0)), "c", "x", "y").collect()} == {None}
