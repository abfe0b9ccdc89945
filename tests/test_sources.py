"""Readers, writers, matching and the rules that callers rely on, on small inputs."""

import gzip
import math
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F
from slatecast.functions.scalars import estimate_bucket, log1p_floor, near_holiday, term
from slatecast.functions.text import age_text, article_key, audience_key, date_range_of, looks_like_bot, markup_off, money_range, money_text, rank_and_title, size_bucket, time_zone, to_utc, user_key, variant_keys, wallet
from slatecast.operators.matching import match_forecasts, match_scored, match_title_year
from slatecast.sources.readers import balanced_json, film_page, filtered_tsv, graph_objects, html_cells, paper_tables, resolved, seat_fill, tables_with, zip_members
from slatecast.sources.writers import append_jsonl, pending, transition, write_csv
from slatecast.streaming.events import stale_reset


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_title_keys(spark):
    lit = F.lit
    assert one(spark, audience_key(lit("Disney's Amélie & Co. (2001)")), article_key(lit("Pixar's Up (2009)")), article_key(lit("Marvel's")), audience_key(lit(None).cast("string"))) == ["amelie and co", "up", "marvel s", None]
    assert one(spark, audience_key(lit("Pixar's Up")), audience_key(lit("Film (1999) two"))) == ["pixar s up", "film 1999 two"]
    assert one(spark, variant_keys(lit("Matrix, The"), lit("http://x/movie/Matrix-The-(1999)"))) == [["matrix the", "the matrix"]]
    assert one(spark, markup_off(lit("<p>a&nbsp;b</p>"))) == ["a b"]
    assert [tuple(x) for x in one(spark, rank_and_title(lit("3. The Film")), rank_and_title(lit("12 Monkeys")))] == [(3, "The Film"), (None, "12 Monkeys")]


def test_written_values(spark):
    lit, year = F.lit, F.lit(2026)
    got = one(spark, date_range_of(lit("March 28-30"), year), date_range_of(lit("December 30 - January 2"), year), date_range_of(lit("soon"), year))
    assert [tuple(x) for x in got] == [(date(2026, 3, 28), date(2026, 3, 30)), (date(2026, 12, 30), date(2027, 1, 2)), (None, None)]
    assert [tuple(x) for x in one(spark, money_range(lit("$10M - $15M")), money_range(lit("$8–12M")), money_range(lit("$7M")))] == [(1e7, 1.5e7), (8e6, 1.2e7), (7e6, 7e6)]
    assert one(spark, money_text(lit(2.5e6)), money_text(lit(None).cast("double")), age_text(lit(59)), age_text(lit(7300))) == ["$2.5M", "n/a", "just now", "2h ago"]
    assert one(spark, wallet(lit("0X" + "a" * 40)), wallet(lit("0x12")), looks_like_bot(lit("HelperBot")), looks_like_bot(lit("Abbot Smith"))) == ["0x" + "a" * 40, None, True, True]
    assert one(spark, user_key(lit("A B "), lit(0)), user_key(lit(None).cast("string"), lit(None).cast("int"))) == ["name:a b", "anonymous"]
    assert one(spark, *(near_holiday(lit(d).cast("date")) for d in ("2026-07-03", "2026-07-06", "2026-12-31", "2026-11-25", "2026-11-24"))) == [True, False, True, True, False]
    assert one(spark, log1p_floor(lit(-3)), log1p_floor(lit(None).cast("int")), estimate_bucket(lit(15e6)), estimate_bucket(lit(None).cast("double"))) == [0.0, 0.0, "15_30", None]


def test_a_zero_signal_counts_as_missing(spark):
    assert one(spark, size_bucket(F.lit(0), F.lit(20)), size_bucket(F.lit(None).cast("int"), F.lit(0)), size_bucket(F.lit(7))) == ["large", "unknown", "small"]


def test_repeated_hour_takes_the_earlier_offset(spark):
    zone = time_zone(F.lit("ny"), F.lit(-120.0))
    local = F.expr("timestamp_ntz'2026-11-01 01:30:00'")
    assert one(spark, to_utc(local, zone).cast("string"), time_zone(F.lit("KS"), F.lit(-98.0)), time_zone(F.lit(None).cast("string"), F.lit(-120.0))) == ["2026-11-01 05:30:00", "America/Chicago", "America/Los_Angeles"]


def test_tables_inside_tables(spark):
    page = "<h2>Main</h2><table><tr><td>a<table><tr><td>inner</table></td><td>b</td></tr><tr><td><a href='/m'>c</a><td>d</table><table><tr><th>X<th>Y</table>"
    cells = html_cells(spark.createDataFrame([("p", page), ("q", None), ("r", "no table")], "k string, h string"), "k", "h")
    got = sorted((r["table_no"], r["row_no"], r["cell_no"], r["text"], r["link"], r["heading"]) for r in cells.collect())
    assert got == [(0, 0, 0, "a", None, "Main"), (0, 0, 1, "b", None, "Main"), (0, 1, 0, "c", "/m", "Main"), (0, 1, 1, "d", None, "Main"), (1, 0, 0, "inner", None, "Main"), (2, 0, 0, "X", None, "Main"), (2, 0, 1, "Y", None, "Main")]
    assert {r["table_no"] for r in tables_with(cells, "k", ["x", "Y"]).collect()} == {2}


def test_json_in_pages(spark):
    text = 'x = 1; data: {"a": "} { \\" }", "b": {"c": [1, {"d": 2}]}} tail {'
    assert one(spark, balanced_json(F.lit(text), F.lit("data:")), balanced_json(F.lit("data: {open"), F.lit("data:")), balanced_json(F.lit(None).cast("string"), F.lit("data:"))) == [text[text.index("{") : text.index(" tail")], None, None]
    page = 'window.__APOLLO_STATE__ = {"S:1":{"__typename":"Show","m":{"__ref":"M:1"}},"S:2":{"__typename":"Show","m":{"__ref":"M:9"}},"M:1":{"__typename":"Movie","name":"Up"}};'
    graph = graph_objects(spark.createDataFrame([(1, page), (2, "none")], "k int, h string"), "k", "h")
    assert sorted((r["id"], r["name"]) for r in resolved(graph, "k", "Show", "$.m", {"name": "$.name"}).collect()) == [("S:1", "Up"), ("S:2", None)]
    seats = "array(named_struct('shown', true, 'type', 'standard', 'available', true), named_struct('shown', true, 'type', 'recliner', 'available', false), named_struct('shown', false, 'type', 'standard', 'available', true), named_struct('shown', true, 'type', 'aisle', 'available', true))"
    empty = F.expr(f"filter({seats}, s -> false)")
    assert [tuple(x) for x in one(spark, seat_fill(F.expr(seats)), seat_fill(empty))] == [(2, 1, 1, 0.5), (0, 0, 0, None)]


def test_film_pages_and_papers(spark):
    html = '<meta property="og:title" content="Up"><script type="application/ld+json">{"aggregateRating":{"ratingValue":4.1}}</script><a href="http://imdb.com/title/tt123/">x</a> 1.2K ratings and 3 likes'
    got = film_page(spark.createDataFrame([(1, html), (2, None)], "k int, h string"), "k", "h").orderBy("k").collect()
    assert tuple(got[0]) == (1, "Up", "tt123", 4.1, 1200, 3) and tuple(got[1])[1:] == (None, "", None, None, None)
    text = "Table 1. One\n| a | b |\n|--|--|\n| 1 | 2 |\nwords\nTable 2. Two\n| c |\n"
    rows = paper_tables(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()
    assert sorted((r["caption"], r["row_no"], r["cells"]) for r in rows) == [("Table 1. One", 0, ["a", "b"]), ("Table 1. One", 1, ["1", "2"]), ("Table 2. Two", 0, ["c"])]


def test_files(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("tt1\tThe Matrix\t1999\ntt2\tUp\t\\N\ntt3\tOther\t2001\ntt4\tshort\n")
    got = filtered_tsv(spark, str(tmp_path / "t.tsv.gz"), "id string, title string, year int", 3, spark.createDataFrame([("up",)], "key string"), spark.createDataFrame([("tt1",)], "id string"), "id", "title", audience_key)
    assert sorted(map(tuple, got.collect())) == [("tt1", "The Matrix", 1999), ("tt2", "Up", None)]
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("d/index.txt", "﻿1\ta\n2\tb\n")
        z.writestr("d/1.txt", "x\n")
    lines = zip_members(spark, str(tmp_path / "s.zip"))
    assert sorted((r["member"], r["line_no"], r["line"]) for r in lines.collect()) == [("d/1.txt", 0, "x"), ("d/index.txt", 0, "1\ta"), ("d/index.txt", 1, "2\tb")]
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "k int, s string, x double")
    write_csv(df, str(tmp_path / "c"), ["x", "k"], one_file=True)
    assert next((tmp_path / "c").glob("*.csv")).read_text() == "x,k\n,1\n0.5,2\n"
    append_jsonl(df.where("k = 1").withColumn("run", F.lit("r")), str(tmp_path / "j"))
    done = spark.read.schema("k int, s string, x double, run string").json(str(tmp_path / "j"))
    assert [r["k"] for r in pending(df, done, "r", ["k"]).collect()] == [2] and pending(df, done, "other", ["k"]).count() == 2


def test_transitions_and_stale_tasks(spark):
    base = spark.createDataFrame([(1, "queued", 0, None), (2, "running", 1, None), (3, "done", 1, date(2026, 1, 1)), (4, "queued", 2, None)], "k int, status string, attempts int, finished_at date")
    changes = spark.createDataFrame([(1, "running"), (2, "running"), (3, "running"), (5, "failed")], "k int, new_status string")
    got = {r["k"]: tuple(r)[1:] for r in transition(base, changes, "k", F.lit("2026-02-02").cast("date")).collect()}
    assert got == {1: ("running", 1, None), 2: ("running", 1, None), 3: ("running", 2, None), 4: ("queued", 2, None), 5: ("failed", 0, date(2026, 2, 2))}
    q = spark.sql("SELECT 1 AS task_id, 'running' AS status, timestamp_ntz'2026-01-01 10:00:00' AS started_at UNION ALL SELECT 2, 'running', timestamp_ntz'2026-01-01 10:56:00' UNION ALL SELECT 3, 'done', timestamp_ntz'2026-01-01 09:00:00'")
    assert {r["task_id"]: r["status"] for r in stale_reset(q, "2026-01-01 11:00:00", 5).collect()} == {1: "queued", 2: "running", 3: "done"}


def test_match_title_year(spark):
    items = spark.createDataFrame([(1, ["up"], 2009), (2, ["up", "up two"], 2015), (3, ["home"], 2000), (4, ["x"], None), (5, ["none"], 2000)], "item int, keys array<string>, year int")
    names = spark.createDataFrame([("a", "up", 2009), ("a", "upp", 2009), ("b", "up two", 2016), ("c", "home", 2000), ("d", "home", 2001), ("e", "x", 1950)], "entity string, key string, year int")
    got = {r["item"]: tuple(r)[1:] for r in match_title_year(items, names).collect()}
    assert got == {1: ("matched", "title_year_exact", "a"), 2: ("matched", "title_year_near_or_missing", "b"), 3: ("ambiguous", "title_year", None), 4: ("matched", "title_year_near_or_missing", "e"), 5: ("not_found", "title_year", None)}


def test_match_scored(spark):
    items = spark.createDataFrame([(1, "the great escape", 1963), (2, "alien", 1979), (3, "lost world", None)], "item int, key string, year int")
    records = spark.createDataFrame([("a", "the great escape", 1963, True), ("b", "great escape", 1990, False), ("c", "alien", 1979, False), ("d", "alien", 1979, True), ("e", "lost world", 1997, False)], "entity string, key string, year int, has_id boolean")
    got = {r["item"]: (r["entity"], round(r["score"], 3), r["status"]) for r in match_scored(items, records).collect()}
    assert got == {1: ("a", 140.0, "matched"), 2: ("d", 140.0, "matched"), 3: ("e", 105.0, "ambiguous")}
    close = match_scored(items.where("item = 2"), records.withColumn("has_id", F.lit(True)))
    assert [r["status"] for r in close.collect()] == ["ambiguous"]


def test_match_forecasts(spark):
    day = lambda y: date(y, 5, 1)
    movies = spark.createDataFrame([(1, "up", day(2009), True), (2, "home", day(2000), True), (3, "home", day(2015), True), (4, "it", day(2017), False), (5, "it", day(2017), False), (6, "solo", day(2018), False)], "movie long, key string, released date, listed boolean")
    f = spark.createDataFrame(
        [(1, "up", day(2009), True, None), (2, "home", day(2014), True, None), (3, "home", day(2015), True, None), (4, "it", day(2018), True, "s1"), (5, "it", day(2018), True, None), (6, "new", day(2020), True, "s9"), (7, "new film", day(2020), True, "s9"), (8, "over", day(2020), True, None), (9, "solo", day(2018), False, None)],
        "forecast int, key string, target date, opening boolean, source_id string",
    )
    got = {r["forecast"]: (r["status"], r["method"], r["movie"]) for r in match_forecasts(f, movies, spark.createDataFrame([("over", 2)], "key string, movie long"), spark.createDataFrame([("s1", 5)], "source_id string, movie long")).collect()}
    assert got[1] == ("matched", "normalized_exact_release_date", 1) and got[2] == ("matched", "normalized_exact_release_year", 3) and got[3] == ("matched", "normalized_exact_release_date", 3)
    assert got[4] == ("matched", "source_id", 5) and got[5] == ("ambiguous", None, None) and got[8] == ("matched", "override", 2) and got[9] == ("provisional", "normalized_exact", 6)
    assert got[6][:2] == ("provisional", "provisioned") and got[6] == got[7]  # one movie for both


@pytest.mark.parametrize("text", [None, "", "<table>", "<table><tr><td>a"])
def test_odd_pages(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, h string")
    assert html_cells(df, "k", "h").count() == 0 and graph_objects(df, "k", "h").count() == 0 and film_page(df, "k", "h").count() == 1


def test_terms(spark):
    df = spark.createDataFrame([(2.0, 3.0), (-1.0, 4.0), (None, 1.0)], "a double, b double")
    got = [tuple(r) for r in df.select(term("log:a*b"), term("log1p:a"), term("square:b"), term("a*b"), term("sqrt:b")).collect()]
    assert got[0] == pytest.approx((math.log(6), math.log(3), 9.0, 6.0, math.sqrt(3)))
    assert got[1] == pytest.approx((None, 0.0, 16.0, -4.0, 2.0)) and got[2] == (None, 0.0, 1.0, None, 1.0)
    with pytest.raises(KeyError):
        term("tan:a")


def test_time_zones_of_towns(spark):
    towns = {("ID", -116.2): "America/Denver", ("ID", -117.0): "America/Los_Angeles", ("OR", -122.7): "America/Los_Angeles", ("OR", -116.4): "America/Denver", ("FL", -87.2): "America/Chicago", ("FL", -80.2): "America/New_York", ("TX", -106.4): "America/Denver", ("tx", -95.4): "America/Chicago", ("TN", -83.9): "America/New_York", ("TN", -90.0): "America/Chicago", ("IN", -87.3): "America/Chicago", ("IN", -86.2): "America/Indiana/Indianapolis", ("MI", -83.0): "America/Detroit", ("AZ", -112.1): "America/Phoenix", ("AK", -176.6): "America/Adak", ("AK", None): "America/Anchorage", ("SD", -103.2): "America/Denver", (None, None): "America/New_York", ("PR", -66.1): "America/New_York", ("WY", -104.8): "America/Denver", (" KY ", -86.0): "America/Chicago", ("KY", -84.5): "America/New_York"}
    df = spark.createDataFrame([(s, x, z) for (s, x), z in towns.items()], "state string, x double, zone string")
    wrong = df.where(~time_zone(F.col("state"), F.col("x")).eqNullSafe(F.col("zone"))).collect()
    assert not wrong
