"""Behaviour that callers rely on although it looks odd."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from slatecast.operators.aggregates import concentration_without_self, group_concentration, without_self
from slatecast.operators.joins import as_of_best, resolve
from slatecast.operators.windows import change_flag
from slatecast.plans import catalog
from slatecast.plans.rules import clean_lines

SF = "/root/testdata/sf0.001"


def test_a_run_opens_on_any_row_and_a_movie_with_its_first_gross(spark, tmp_path):
    """Opening features count a day without gross as the opening; the ridge frame wants gross above 0."""
    rows = [(1, datetime(2026, 1, 2), 0.0, "N"), (1, datetime(2026, 1, 4), 5.0, "N"), (1, datetime(2025, 12, 1), 9.0, "R"), (2, datetime(2026, 5, 1), 7.0, "N")]
    spark.createDataFrame(rows, "l_partkey bigint, l_shipdate timestamp_ntz, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["part"]: (r["opening_date"], r["opening_day"], r["opening_weekend"]) for r in catalog.QUERIES["opening_features"](spark, str(tmp_path)).collect()}
    assert got == {1: (date(2026, 1, 2), 0.0, 5.0), 2: (date(2026, 5, 1), 7.0, 7.0)}
    events = [(r["user_id"], r["ts"].date(), r["value"]) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    positive = {}
    for user, d, value in events:
        positive[user, d] = positive.get((user, d), 0) + round(100 * value)
    opened = {}
    for (user, d), cents in positive.items():
        if cents > 0:
            opened[user] = min(d, opened.get(user, d))
    frame = catalog.QUERIES["ridge_training_frame"](spark, SF).collect()
    assert frame and all(r["age"] == (r["day"] - opened[r["user_id"]]).days >= 0 for r in frame)


def test_previews_are_out_unless_asked_for(spark):
    lines = spark.createDataFrame([("R", "O", 5.0), ("N", "F", 4.0), ("N", "O", 0.0), ("N", "O", None), ("N", "O", 3.0)], "l_returnflag string, l_linestatus string, l_extendedprice double")
    assert [clean_lines(lines, *flags).count() for flags in ((), (False,), (True, False), (True, True, True), (False, False))] == [2, 3, 3, 1, 4]


def test_change_flags_count_from_where_history_starts(spark):
    d = spark.createDataFrame([(1, t, u) for t, u in enumerate("aabba")], "k int, t int, u string")
    whole = change_flag(d, ["k"], ["t"], "u", "f").where("t >= 1").agg(F.sum("f")).first()[0]
    window = change_flag(d.where("t >= 1"), ["k"], ["t"], "u", "f").agg(F.sum("f")).first()[0]
    assert (whole, window) == (2, 3)


def test_coverage_is_null_unless_all_blocks_are_there(spark):
    rows = catalog.QUERIES["seat_coverage"](spark, SF).collect()
    whole = [r for r in rows if r["capacity_coverage"] is not None]
    assert whole and len(whole) < len(rows) and all(r["capacity_coverage"] == 1 for r in whole)


def test_rank_zero_counts_as_no_rank(spark):
    f = spark.createDataFrame([("m", 1, 0, 10), ("m", 1, 7, 11), ("m", 1, None, 12)], "movie string, day int, rank int, id int")
    t = spark.createDataFrame([("m", 1)], "movie string, at int")
    got = as_of_best(t, f.withColumn("known", F.col("day")), ["movie"], "at", "known", [-F.coalesce(F.nullif("rank", F.lit(0)), F.lit(999999)), F.col("id")], ["id"]).first()
    assert got["id"] == 11


def test_the_latest_sunday_may_be_the_day_itself(spark):
    rows = {r["day"]: r["previous_end"] for r in catalog.QUERIES["previous_weekend_window"](spark, SF).collect()}
    assert all(end.isoweekday() == 7 and 0 <= (day - end).days <= 6 for day, end in rows.items())
    assert any(day == end for day, end in rows.items())


def test_small_samples_have_no_fit(spark):
    got = {r["segment"]: r for r in catalog.QUERIES["age_segment_metrics"](spark, SF).collect()}
    assert all((r["slope"] is not None) == (r["n"] >= 40) for r in got.values())


def test_the_leaking_placebo_is_marked(spark):
    assert {r["mode"]: r["valid"] for r in catalog.QUERIES["placebo_effects"](spark, SF).collect()} == {"observed": True, "shifted": True, "future": False}


def test_unmatched_items_stay_and_ties_are_ambiguous(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "item int, key string")
    names = spark.createDataFrame([("a", 10), ("a", 10), ("b", 11), ("b", 12)], "key string, entity int")
    got = {r["item"]: (r["status"], r["method"], r["entity"]) for r in resolve(items, [("exact", names, ["key"])], "item", "entity").collect()}
    assert got == {1: ("matched", "exact", 10), 2: ("ambiguous", "exact", None), 3: ("unmatched", None, None), 4: ("unmatched", None, None)}


def test_others_of_an_entity_that_is_not_in_the_group(spark):
    d = spark.createDataFrame([(1, m, g) for m, g in enumerate((50, 40, 30, 20, 10, 5, 0))], "day int, movie int, gross int")
    top = group_concentration(d, ["day"], "movie", "gross").crossJoin(spark.createDataFrame([(99, None), (0, 50), (6, 0)], "movie int, own int"))
    got = {r["movie"]: r for r in top.select("movie", *(v.alias(c) for c, v in without_self("movie", "gross", F.col("own")).items())).collect()}
    assert (got[99]["others_total"], got[99]["others_count"], got[99]["others_top1"], got[99]["own_share"]) == (155.0, 6, 50.0, 0.0)
    assert (got[0]["others_total"], got[0]["others_top3"], got[0]["others_top5"]) == (105.0, 90.0, 105.0)
    assert (got[6]["others_count"], got[6]["others_hhi"]) == (6, pytest.approx(sum(g * g for g in (50, 40, 30, 20, 10, 5)) / 155**2))
    assert concentration_without_self(d, ["day"], "movie", "gross").count() == 6


def test_nulls_sort_last_only_where_it_is_said(spark):
    """As the other database sorts them: last in rising order, where Spark alone has them first."""
    query = catalog.QUERIES["top_k_nulls_last"](spark, SF)
    assert "NULLS LAST" in query._jdf.queryExecution().logical().toString().upper() and query.count() > 0
