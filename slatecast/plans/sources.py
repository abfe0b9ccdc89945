"""Readers, writers and matching on the driver tables.

The driver's pages hold no charts, feeds or graphs, so these queries write them from its tables first (HTML, XML, TSV,
CSV, JSON lines) and read them back; the SQL works on the tables themselves.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import day, money_sum, parse_date, parse_number, title_key
from ..functions.text import article_key, audience_key, date_range_of, epoch_date, markup_off, money_range, rank_and_title, variant_keys
from ..operators.matching import match_forecasts, match_pages, match_scored, match_title_year
from ..operators.ranks import places
from ..sources.readers import balanced_json, bindings, feed_items, film_page, filtered_tsv, graph_objects, html_cells, html_records, paper_tables, read_tsv, read_xml, resolved, seat_fill, tables_with, unescaped, with_names, zip_lines
from ..sources.paging import offset_tokens, paged_items
from ..sources.writers import append_jsonl, delete_counts, escaped, folder, pending, transition, update_from, write_csv, write_tsv, written
from .registry import registry, table

QUERIES, SQL, query = registry()


def _row(*cells: Column) -> Column:
    """An HTML table row of columns."""
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))


def chart_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation: a heading, a table of links, and the chart of its suppliers with rank, link and balance."""
    s = table(spark, sf_dir, "supplier").withColumn("rank", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")))
    link = F.concat(F.lit("<a href='/supplier/"), F.col("s_suppkey").cast("string"), F.lit("'>"), F.col("s_name"), F.lit("</a>"))
    money = F.concat(F.when(F.col("s_acctbal") < 0, "($").otherwise("$"), F.format_number(F.abs("s_acctbal"), 2), F.when(F.col("s_acctbal") < 0, ")").otherwise(""))
    row = _row(F.when(F.col("rank") == 1, "P").otherwise(F.col("rank").cast("string")), link, F.lit("<table><tr><td>inner</table>"), money)
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", row.alias("html")))), lambda x: x["html"]), "")
    head = "<html><body><h1>Suppliers</h1><table><tr><td>Home<td>About</table><h2>Chart</h2><table><tr><th>Rank<th>Name<th>Note<th>Balance</tr>"
    return s.groupBy("s_nationkey").agg(F.concat(F.lit(head), rows, F.lit("</table></body></html>")).alias("html"))


@query("""
SELECT s_nationkey, s_suppkey, s_name AS name, round(s_acctbal, 2) AS balance, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1 AS is_preview FROM supplier""")
def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart pages read back: the table with the right headers, rows with a link and all cells, P as the mark of previews."""
    cells = tables_with(html_cells(chart_pages(spark, sf_dir), "s_nationkey", "html"), "s_nationkey", ["rank", "balance"])
    rows = html_records(cells, "s_nationkey", {"rank": 0, "name": 1, "balance": 3}, 4).where("link IS NOT NULL")
    return rows.select("s_nationkey", F.regexp_extract("link", r"/supplier/(\d+)", 1).cast("bigint").alias("s_suppkey"), "name", F.round(parse_number("balance"), 2).alias("balance"), (F.col("rank") == "P").alias("is_preview"))


@query("""
SELECT s_nationkey, CAST(t AS INTEGER) AS table_no, CASE WHEN t = 0 THEN 'Suppliers' ELSE 'Chart' END AS heading, CAST(CASE t WHEN 0 THEN 2 WHEN 1 THEN 4 + 4 * COUNT(*) END AS BIGINT) AS cells FROM supplier, (SELECT UNNEST([0, 1]) AS t) GROUP BY s_nationkey, t
UNION ALL SELECT s_nationkey, CAST(1 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER), 'Chart', 1 FROM supplier""")
def page_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of chart pages, nested ones for themselves, with the heading before them and their cells."""
    return html_cells(chart_pages(spark, sf_dir), "s_nationkey", "html").groupBy("s_nationkey", "table_no", "heading").agg(F.count("*").alias("cells"))


@query("""
SELECT p_partkey AS id, p_name AS title, p_size AS year FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) OR p_name IN (SELECT p_name FROM part WHERE p_retailprice > 1500 AND p_brand = 'Brand#2')""")
def tsv_filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzip TSV of titles, read with wanted ids and wanted titles pushed into the scan."""
    at = folder(spark, "titles")
    p = table(spark, sf_dir, "part")
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") > 0, F.col("p_size").cast("string")).otherwise(r"\N"))
    short = F.concat(F.lit("x"), F.col("p_partkey").cast("string"))
    p.select(line.alias("value")).union(p.select(short)).write.option("compression", "gzip").text(at)
    ids = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("id"))
    wanted = p.where("p_retailprice > 1500 AND p_brand = 'Brand#2'").select(title_key("p_name").alias("key"))
    return filtered_tsv(spark, at, "id bigint, title string, year int", 3, wanted, ids, "id", "title", title_key)


@query("""SELECT c_custkey AS movie_id, c_name AS title, nullif(c_mktsegment, 'BUILDING') AS studio, round(c_acctbal, 2) AS gross FROM customer""")
def csv_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with a byte order mark and its own names for columns, written in a fixed order and read under the agreed names."""
    at = folder(spark, "panel")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("﻿Movie ID"), F.col("c_name").alias("Title "), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("Distributor"), F.format_string("%.2f", "c_acctbal").alias("GROSS USD"))
    write_csv(c, at, c.columns)
    raw = spark.read.option("header", True).csv(at)
    named = with_names(raw, {"movie_id": ["id"], "title": [], "studio": ["distributor"], "gross": ["gross_usd"]}, ("movie_id", "gross"))
    return named.select(F.col("movie_id").cast("bigint").alias("movie_id"), F.trim("title").alias("title"), "studio", F.col("gross").cast("double").alias("gross"))


@query("""SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'error'""")
def jsonl_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done when a run goes on from its checkpoint: lines appended before, of this run only, and the pending ones after."""
    at = folder(spark, "checkpoint")
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", "event_id", "event_type")
    append_jsonl(e.where("event_type = 'view'").withColumn("run", F.lit("a")), at)
    append_jsonl(e.where("event_type = 'purchase'").withColumn("run", F.lit("other")), at)
    schema = "user_id bigint, event_id bigint, event_type string, run string"
    append_jsonl(pending(e, spark.read.schema(schema).json(at), "a", ["event_id"]).withColumn("run", F.lit("a")), at)
    return spark.read.schema(schema).json(at).where("run = 'a'").drop("run")


@query("""
SELECT regexp_replace(url, '[?#].*$', '') AS link, CAST(1700000000 + 86400 * MIN(page_id % 2) AS BIGINT) AS published, CAST(MIN(page_id % 2) AS INTEGER) AS kind FROM pages WHERE page_id % 3 < 2 GROUP BY 1""")
def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of the pages in XML, read back: one item for each address, the first by date, none of kind other."""
    at = folder(spark, "feed")
    p = table(spark, sf_dir, "pages")
    when = F.date_format(F.timestamp_seconds(F.col("page_id") % 2 * 86400 + 1_700_000_000), "EEE, dd MMM yyyy HH:mm:ss Z")
    title = F.when(F.col("page_id") % 3 == 2, "News").when(F.col("page_id") % 2 == 0, "Weekend Preview").otherwise("Review of it")
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</link><pubDate>"), when, F.lit("</pubDate></item>"))
    # feeds of 200 items each
    feeds = places(p.select("page_id", item.alias("item")), [], ["page_id"], "n").groupBy(F.expr("n DIV 200").alias("feed")).agg(F.array_join(F.collect_list("item"), "").alias("items"))
    feeds.select(F.concat(F.lit('<rss version="2.0"><channel>'), "items", F.lit("</channel></rss>")).alias("value")).write.text(at)
    channel = read_xml(spark.read.text(at), "value", "channel", "item array<struct<title:string,link:string,pubDate:string>>")
    got = feed_items(channel.select(F.explode("item").alias("i")).select("i.*"))
    return got.select("link", F.unix_seconds("published").alias("published"), F.when(F.col("kind") == "forecast", 0).otherwise(1).alias("kind"))


@query("""SELECT s_suppkey AS id, 'theatre-' || s_suppkey AS slug, CAST(1 + s_suppkey % 9 AS INTEGER) AS screens, s_name AS name FROM supplier""")
def sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap of suppliers in XML with attributes, read back with slugs and screens."""
    at = folder(spark, "sitemap")
    k = F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("<url><loc>https://x.example.com/theatres/theatre-"), k, F.lit('</loc><PageMap><DataObject type="theatre"><Attribute name="theatreId" value="'), k, F.lit('"/><Attribute name="title" value="'), F.col("s_name"), F.lit(" "), (1 + F.col("s_suppkey") % 9).cast("string"), F.lit(' Screens"/></DataObject></PageMap></url>'))
    maps = places(table(spark, sf_dir, "supplier").select("s_suppkey", url.alias("url")), [], ["s_suppkey"], "n")
    maps = maps.groupBy(F.expr("n DIV 500").alias("map")).agg(F.array_join(F.collect_list("url"), "").alias("urls"))
    maps.select(F.concat(F.lit("<urlset>"), "urls", F.lit("</urlset>")).alias("value")).write.text(at)
    rows = read_xml(spark.read.text(at), "value", "url", "loc string, PageMap struct<DataObject:struct<_type:string,Attribute:array<struct<_name:string,_value:string>>>>")
    attribute = F.map_from_entries(F.transform("PageMap.DataObject.Attribute", lambda a: F.struct(a["_name"], a["_value"])))
    title = attribute["title"]
    return rows.select(attribute["theatreId"].cast("bigint").alias("id"), F.regexp_extract("loc", r"/([^/]+)/?$", 1).alias("slug"), F.regexp_extract(title, r"(\d+) Screens", 1).cast("int").alias("screens"), F.regexp_replace(title, r" \d+ Screens$", "").alias("name"))


@query("""
SELECT o_custkey AS page, o_orderkey AS showtime, c_name AS movie, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey""")
def json_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Showtimes out of the JSON graph in a page's script, with the movie that each refers to."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("o"))
    rows = o.join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    movie = F.concat(F.lit('"Movie:1":{"__typename":"Movie","note":"a } in \\"text\\" {","name":'), quote(F.col("c_name")), F.lit("}"))
    show = F.transform("o", lambda x: F.concat(F.lit('"Showtime:'), x["o_orderkey"].cast("string"), F.lit('":{"__typename":"Showtime","id":'), x["o_orderkey"].cast("string"), F.lit(',"status":'), quote(x["o_orderstatus"]), F.lit(',"movie":{"__ref":"Movie:1"}}')))
    html = F.concat(F.lit("<html><script>window.x = 1;window.__APOLLO_STATE__ = {"), movie, F.lit(","), F.array_join(show, ","), F.lit("};</script></html>"))
    objects = graph_objects(rows.select(F.col("o_custkey").alias("page"), html.alias("html")), "page", "html")
    found = resolved(objects, "page", "Showtime", "$.movie", {"movie": "$.name"})
    return found.select("page", F.get_json_object("own", "$.id").cast("bigint").alias("showtime"), "movie", F.get_json_object("own", "$.status").alias("status"))


@query("""
WITH s AS (SELECT l_orderkey, COUNT(*) FILTER (WHERE l_returnflag <> 'N') AS total, COUNT(*) FILTER (WHERE l_returnflag <> 'N' AND l_linestatus = 'O') AS available FROM lineitem GROUP BY 1)
SELECT l_orderkey AS showtime, CAST(total AS INTEGER) AS total, CAST(available AS INTEGER) AS available, CAST(total - available AS INTEGER) AS filled, round((total - available) / nullif(total, 0), 6) AS fill_rate FROM s""")
def seat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats of each showtime: those of a type that is sold, taken and free."""
    kind = F.when(F.col("l_returnflag") == "A", "standard").when(F.col("l_returnflag") == "R", "recliner").otherwise("stairs")
    seats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("showtime")).agg(F.collect_list(F.struct(F.lit(True).alias("shown"), kind.alias("type"), (F.col("l_linestatus") == "O").alias("available"))).alias("seats"))
    fill = seats.select("showtime", seat_fill(F.col("seats")).alias("f")).select("showtime", "f.*")
    return fill.withColumn("fill_rate", F.round("fill_rate", 6))


@query("""
SELECT 'Q' || c_nationkey AS entity, min(c_name) AS label, list_sort(list_distinct(list(CAST(1990 + c_custkey % 7 AS INTEGER)))) AS years, min(CASE WHEN c_custkey % 2 = 0 THEN 'tt' || c_custkey END) AS imdb FROM customer GROUP BY c_nationkey""")
def knowledge_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a knowledge base, grouped by entity: label, years and the first id that is set."""
    k = F.col("c_custkey")
    val = lambda c: F.struct(c.alias("value"))
    b = F.struct(val(F.concat(F.lit("http://kb.example.org/entity/Q"), F.col("c_nationkey").cast("string"))).alias("item"), val(F.col("c_name")).alias("label"), val((1990 + k % 7).cast("string")).alias("year"), F.when(k % 2 == 0, val(F.concat(F.lit("tt"), k.cast("string")))).alias("imdb"))
    said = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.struct(F.array(b).alias("bindings")).alias("results"))).alias("answer"))
    return bindings(said, "answer")


@query("""
SELECT p_partkey, p_name AS title, 'tt' || p_partkey AS imdb, CAST(p_size AS DOUBLE) AS rating, CAST(p_size * 1000 AS BIGINT) AS n_ratings, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) END AS n_likes FROM part""")
def film_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Film pages read by meta tags, linked data, and counts beside their labels."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    html = F.concat(F.lit('<meta property="og:title" content="'), F.col("p_name"), F.lit('"><script type="application/ld+json">{"aggregateRating":{"ratingValue":'), size, F.lit('}}</script><a href="http://imdb.com/title/tt'), k, F.lit('/">IMDb</a><p>'), size, F.lit("K ratings"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" and "), size, F.lit(" likes"))).otherwise(""), F.lit("</p>"))
    return film_page(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")


@query("""
SELECT c_nationkey, 'Table ' || c_nationkey || '. Balances' AS caption, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS row_no, [c_name, c_mktsegment] AS cells FROM customer""")
def paper_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown tables by caption, header rows (0) left out."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", F.concat(F.lit("| "), F.col("c_name"), F.lit(" | "), F.col("c_mktsegment"), F.lit(" |")).alias("l")))), lambda x: x["l"]), "\n").alias("rows"))
    text = F.concat(F.lit("Some words\n\nTable "), F.col("c_nationkey").cast("string"), F.lit(". Balances\n\n| name | segment |\n|---|:---|\n"), F.col("rows"))
    return paper_tables(c.select("c_nationkey", text.alias("text")), "c_nationkey", "text").where("row_no > 0")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'running' WHEN c_mktsegment = 'BUILDING' THEN 'done' ELSE 'queued' END AS status, CASE WHEN c_acctbal < 0 AND c_nationkey >= 5 THEN 2 WHEN c_nationkey < 5 THEN 1 ELSE 1 END AS attempts,
       CASE WHEN c_acctbal < 0 AND c_nationkey >= 5 THEN NULL WHEN c_acctbal >= 0 AND c_mktsegment = 'BUILDING' THEN DATE '2024-02-01' WHEN c_nationkey >= 5 THEN DATE '2024-01-01' END AS finished_at FROM customer""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after a batch of changes: attempts grow only on the way into running."""
    c = table(spark, sf_dir, "customer")
    busy = F.col("c_nationkey") < 5
    base = c.select("c_custkey", F.when(busy, "running").otherwise("queued").alias("status"), F.lit(1).alias("attempts"), F.when(~busy, F.lit("2024-01-01").cast("date")).alias("finished_at"))
    changes = c.select("c_custkey", F.when(F.col("c_acctbal") < 0, "running").when(F.col("c_mktsegment") == "BUILDING", "done").otherwise("queued").alias("new_status"))
    return transition(base, changes, "c_custkey", F.lit("2024-02-01").cast("date"))


@query("""
WITH a AS (SELECT o_custkey, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, c_name, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(total, 0) AS total FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def counters_from_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each run refreshed from its tasks, 0 without any."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(-1).cast("bigint").alias("n"), F.lit(-1.0).alias("total"))
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), money_sum("o_totalprice").alias("total"))
    return update_from(base, a, ["c_custkey"], ["n", "total"])


@query("""
WITH g AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') SELECT 'orders' AS name, COUNT(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM g)) AS deleted, COUNT(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM g)) AS kept FROM orders
UNION ALL SELECT 'customer', COUNT(*) FILTER (WHERE c_custkey IN (SELECT c_custkey FROM g)), COUNT(*) FILTER (WHERE c_custkey NOT IN (SELECT c_custkey FROM g)) FROM customer""")
def delete_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table a reset deletes and keeps."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return delete_counts({"orders": (o, "o_custkey"), "customer": (c, "c_custkey")}, c.where("c_mktsegment = 'MACHINERY'").select("c_custkey"), "c_custkey")


@query("""SELECT s_suppkey, 'amelie and co ' || lower(replace(s_name, '#', ' ')) AS audience, 'amelie and co ' || lower(replace(s_name, '#', ' ')) AS article, 'x < y & "z"' AS plain FROM supplier""")
def studio_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with marks, a studio's possessive, a year and an ampersand under the two rules, and markup taken off."""
    said = F.concat(F.lit("Disney's Amélie & Co "), F.col("s_name"), F.lit(" (2001)"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", audience_key(said).alias("audience"), article_key(said).alias("article"), markup_off(F.lit("<b>x</b> &lt;&nbsp;y &amp; &quot;z&quot;")).alias("plain"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS from_epoch, CAST(o_orderdate AS DATE) AS first, CAST(o_orderdate AS DATE) + 3 AS last, CAST(o_orderkey % 90 + 1 AS DOUBLE) * 1e6 AS low, CAST(o_orderkey % 90 + 6 AS DOUBLE) * 1e6 AS high FROM orders""")
def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written in words, as epoch seconds and as ranges that may end in the next year, and ranges of money."""
    d = day("o_orderdate")
    k = F.dayofmonth(d)
    suffix = F.when(k.isin(11, 12, 13), "th").when(k % 10 == 1, "st").when(k % 10 == 2, "nd").when(k % 10 == 3, "rd").otherwise("th")
    said = F.concat(F.date_format(d, "MMMM d"), suffix, F.date_format(d, ", yyyy"))
    span = date_range_of(F.concat(F.date_format(d, "MMMM d"), F.lit(" – "), F.date_format(F.date_add(d, 3), "MMMM d")), F.year(d))
    money = money_range(F.concat(F.lit("$"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit("–$"), (F.col("o_orderkey") % 90 + 6).cast("string"), F.lit("M")))
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(said).alias("day"), epoch_date(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")).alias("from_epoch"), span["start"].alias("first"), span["end"].alias("last"), money["low"].alias("low"), money["high"].alias("high"))


@query("""
WITH a AS (SELECT DISTINCT o_custkey, p_name, lower(p_name) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1), b AS (SELECT lower(p_name) AS k, COUNT(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1)
SELECT o_custkey, p_name, CAST(n AS BIGINT) AS n, first FROM a JOIN b ON a.k = b.k""")
def normalised_title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles joined on their normal form instead of compared pair by pair."""
    o, l, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")  # noqa: E741
    a = l.where("l_linenumber = 1").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", "p_name").distinct()
    b = p.groupBy(title_key("p_name").alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return a.withColumn("key", title_key(F.upper("p_name"))).join(b, "key").select("o_custkey", "p_name", "n", "first")


@query("""
WITH i AS (SELECT s_suppkey AS item, lower(replace(s_name, '#', ' ')) AS key, 1990 + s_suppkey % 5 AS year FROM supplier), n AS (SELECT c_custkey AS entity, 'supplier ' || lpad(CAST(c_custkey % 400 AS VARCHAR), 9, '0') AS key, CASE WHEN c_custkey % 7 <> 0 THEN 1990 + c_custkey % 6 END AS year FROM customer),
c AS (SELECT item, entity, i.year = n.year AS exact FROM i JOIN n ON i.key = n.key WHERE n.year IS NULL OR abs(i.year - n.year) <= 1), g AS (SELECT item, COUNT(DISTINCT entity) AS n, min(entity) AS e, bool_or(coalesce(exact, FALSE)) AS exact FROM c GROUP BY 1)
SELECT i.item, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 AND exact THEN 'title_year_exact' WHEN n = 1 THEN 'title_year_near_or_missing' ELSE 'title_year' END AS method, CASE WHEN n = 1 THEN e END AS entity FROM i LEFT JOIN g ON i.item = g.item""")
def title_year_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles matched by name and nearness of years; several candidates are ambiguous."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    items = s.select(F.col("s_suppkey").alias("item"), variant_keys("s_name").alias("keys"), (1990 + F.col("s_suppkey") % 5).alias("year"))
    k = F.col("c_custkey")
    name = F.concat(F.lit("Supplier "), F.lpad((k % 400).cast("string"), 9, "0"))
    return match_title_year(items, c.select(k.alias("entity"), audience_key(name).alias("key"), F.when(k % 7 != 0, 1990 + k % 6).alias("year")))


@query("""
WITH m AS (SELECT p_partkey AS movie, p_name || ' ' || p_size AS key, (SELECT MIN(CAST(l_shipdate AS DATE)) FROM lineitem WHERE l_partkey = p_partkey) AS released, p_size % 3 > 0 AS listed FROM part),
f AS (SELECT o_orderkey AS forecast, p_name || ' ' || CASE WHEN o_orderstatus = 'P' THEN p_size + 100 ELSE p_size END AS key, CAST(l_shipdate AS DATE) AS target, o_orderstatus = 'O' AS opening, CASE WHEN o_custkey % 2 = 0 THEN 's' || (o_custkey % 9) END AS source_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part ON l_partkey = p_partkey QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY target, key) = 1),
v AS (SELECT DISTINCT key, min(movie) OVER (PARTITION BY key) AS over_ FROM m WHERE key LIKE 'red bolt%'), src AS (SELECT 's0' AS source_id, 1 AS sourced UNION ALL SELECT 's3', 2),
d AS (SELECT key, released AS target, min(CASE WHEN listed THEN 0 ELSE 1000000000 END + movie) AS c FROM m WHERE released IS NOT NULL GROUP BY 1, 2), s AS (SELECT key, COUNT(*) AS n, min(CASE WHEN listed THEN 0 ELSE 1000000000 END + movie) AS c FROM m GROUP BY 1),
y AS (SELECT f.forecast, COUNT(*) AS ny, COUNT(*) FILTER (WHERE listed) AS nl, min(CASE WHEN listed THEN 0 ELSE 1000000000 END + movie) AS c FROM (SELECT f.forecast, f.key, f.target, min(abs(year(coalesce(m.released, f.target)) - year(f.target))) AS best FROM f JOIN m ON f.key = m.key GROUP BY 1, 2, 3) f JOIN m ON f.key = m.key AND abs(year(coalesce(m.released, f.target)) - year(f.target)) = best GROUP BY 1),
j AS (SELECT f.*, v.over_, d.c AS dc, s.n, s.c AS sc, y.ny, y.nl, y.c AS yc, src.sourced FROM f LEFT JOIN v ON f.key = v.key LEFT JOIN d ON f.key = d.key AND f.target = d.target LEFT JOIN s ON f.key = s.key LEFT JOIN y ON y.forecast = f.forecast LEFT JOIN src ON src.source_id = f.source_id),
r AS (SELECT forecast, CASE WHEN over_ IS NOT NULL THEN 'override' WHEN opening AND dc IS NOT NULL THEN 'normalized_exact_release_date' WHEN n = 1 THEN 'normalized_exact' WHEN n > 1 AND (nl = 1 OR ny = 1) THEN 'normalized_exact_release_year' WHEN sourced IS NOT NULL THEN 'source_id' WHEN n IS NULL THEN 'provisioned' END AS method,
      CASE WHEN over_ IS NOT NULL THEN over_ WHEN opening AND dc IS NOT NULL THEN dc WHEN n = 1 THEN sc WHEN n > 1 AND (nl = 1 OR ny = 1) THEN yc WHEN sourced IS NOT NULL THEN sourced END AS c FROM j)
SELECT forecast, method, CASE WHEN method = 'provisioned' THEN 'provisional' WHEN method IS NULL THEN 'ambiguous' WHEN c >= 1000000000 THEN 'provisional' ELSE 'matched' END AS status, c % 1000000000 AS movie FROM r""")
def forecast_match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts matched to movies by the whole cascade; the id of a provisional movie is left out."""
    p, l, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")  # noqa: E741
    first = l.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(day("l_shipdate")).alias("released"))
    key = lambda size: F.concat_ws(" ", "p_name", size.cast("string"))
    movies = p.join(first, "p_partkey", "left").select(F.col("p_partkey").alias("movie"), key(F.col("p_size")).alias("key"), "released", (F.col("p_size") % 3 > 0).alias("listed"))
    f = l.where("l_linenumber = 1").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    f = f.select(F.col("o_orderkey").alias("forecast"), key(F.when(F.col("o_orderstatus") == "P", F.col("p_size") + 100).otherwise(F.col("p_size"))).alias("key"), day("l_shipdate").alias("target"), (F.col("o_orderstatus") == "O").alias("opening"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string"))).alias("source_id"))
    f = f.groupBy("forecast").agg(*(F.min_by(c, F.struct("target", "key", "opening")).alias(c) for c in ("key", "target", "opening", "source_id")))
    over = movies.where("key LIKE 'red bolt%'").select("key", "movie")
    ids = spark.createDataFrame([("s0", 1), ("s3", 2)], "source_id string, movie bigint")
    return match_forecasts(f, movies, over, ids).select("forecast", "method", "status", F.when(F.col("method") != "provisioned", F.col("movie")).alias("movie"))


@query("""SELECT s_suppkey AS id, CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) > 0 AS found, s_name AS name, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 2) END AS balance FROM supplier""")
def tsv_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""A TSV with header, quotes that are ordinary, and \N for what is missing, read with types; rows found are those with a number by id, which all get."""
    at = folder(spark, "typed")
    b = F.col("s_acctbal")
    cents = F.format_string("%.2f", F.when((b == 0) | (b * 100 == float("inf")), b).otherwise(F.round(b * 100) / 100))  # rounded as SQL does; -0 keeps its sign
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit('"'), escaped("s_name")).alias("name"), F.when(b >= 0, cents).alias("balance"))
    write_tsv(s, at)
    got = places(read_tsv(spark, at, "id bigint, name string, balance double"), [], ["id"], "n")
    return got.select("id", (F.col("n") + 1 > 0).alias("found"), unescaped(F.substr("name", F.lit(2))).alias("name"), "balance")


@query()
def fuzzy_match_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of documents, half of them with a letter dropped, matched to the titles of all documents by similarity, years and known ids."""
    start = F.regexp_extract("text", r"^(?:\P{L}*+\p{L}++){1,4}", 0)  # the first four words, without a look at the rest
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.regexp_extract_all(start, F.lit(r"(\p{L}+)")), " ").alias("title"))
    d = written(d.select("doc_id", audience_key("title").alias("key")).where("key IS NOT NULL"), "titles")
    i = F.col("doc_id")
    at = (i % F.length("key") + 1).cast("int")
    typo = F.when(i % 2 == 0, F.concat(F.substring("key", F.lit(1), at - 1), F.substring("key", at + 1, F.length("key")))).otherwise(F.col("key"))
    year = F.when(i % 23 > 0, (1920 + F.crc32("key") % 97 + F.when(i % 5 == 0, 1).otherwise(0)).cast("int"))
    items = d.select(i.alias("item"), typo.alias("key"), year.alias("year"))
    records = d.select(i.alias("entity"), "key", F.when(i % 19 > 0, (1920 + F.crc32("key") % 97).cast("int")).alias("year"), (i % 3 > 0).alias("has_id"))
    return match_scored(items, records).select("item", "entity", F.round("score", 6).alias("score"), "status")


@query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part)
SELECT p_brand AS page, p_partkey AS movie, DATE '2026-01-01' + p_size AS release_date, CASE WHEN p_partkey % 3 = 0 THEN 'Limited' ELSE 'Wide' END AS pattern FROM p""")
def release_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release schedules read from pages: columns found by their headers, dates carried down to the rows below that leave them out."""
    p = table(spark, sf_dir, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")))
    date = F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size"))
    p = p.withColumn("date_", date).withColumn("old_", F.lag("date_").over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")))
    said = F.when(F.col("date_").eqNullSafe(F.col("old_")), "").otherwise(F.date_format("date_", "MMMM d, yyyy"))
    link = F.concat(F.lit("<a href='/movie/"), F.col("p_partkey").cast("string"), F.lit("'>"), F.col("p_name"), F.lit("</a>"))
    row = _row(link, said, F.when(F.col("p_partkey") % 3 == 0, "Limited").otherwise("Wide"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", row.alias("html")))), lambda x: x["html"]), "")
    pages = p.groupBy(F.col("p_brand").alias("page")).agg(F.concat(F.lit("<table><tr><th>Film</th><th> Release Date </th><th>Pattern</th></tr>"), rows, F.lit("</table>")).alias("html"))
    cells = html_cells(pages, "page", "html")
    names = cells.where("row_no = 0").select("page", "table_no", "cell_no", F.regexp_replace(F.lower("text"), "[^a-z]+", "_").alias("name"))
    rows = cells.where("row_no > 0").join(names, ["page", "table_no", "cell_no"]).groupBy("page", "table_no", "row_no")
    rows = rows.agg(F.max(F.when(F.col("name").isin("film", "title", "movie"), F.col("link"))).alias("link"), F.max(F.when(F.col("name") == "release_date", F.col("text"))).alias("said"), F.max(F.when(F.col("name") == "pattern", F.col("text"))).alias("pattern"))
    down = Window.partitionBy("page", "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("page", F.regexp_extract("link", r"/movie/(\d+)", 1).cast("bigint").alias("movie"), F.last(parse_date("said"), ignorenulls=True).over(down).alias("release_date"), "pattern")


@query("""
SELECT s_nationkey AS page, 'https://x.example.com/a/' || s_suppkey AS url, s_name AS title, CASE WHEN s_nationkey % 2 = 0 THEN 'archive' ELSE 'fallback' END AS parser FROM supplier""")
def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of archive pages by the first parser, and by the second where that finds none."""
    s = table(spark, sf_dir, "supplier")
    url = F.concat(F.lit("https://x.example.com/a/"), F.col("s_suppkey").cast("string"))
    new = F.concat(F.lit('<article class="item"><a href="'), url, F.lit('"><h2>'), F.col("s_name"), F.lit("</h2></a></article>"))
    old = F.concat(F.lit('<h3><a href="'), url, F.lit('">'), F.col("s_name"), F.lit("</a></h3>"))
    pages = s.select("s_nationkey", F.when(F.col("s_nationkey") % 2 == 0, new).otherwise(old).alias("i")).groupBy(F.col("s_nationkey").alias("page")).agg(F.array_join(F.collect_list("i"), "\n").alias("html"))
    found = lambda pattern: F.arrays_zip(*(F.regexp_extract_all("html", F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "url"), (2, "title"))))
    first, second = found(r'<article[^>]*>\s*<a href="([^"]+)">\s*<h2>([^<]*)'), found(r'<h3>\s*<a href="([^"]+)">([^<]*)')
    rows = pages.select("page", F.when(F.size(first) > 0, first).otherwise(second).alias("items"), F.when(F.size(first) > 0, "archive").otherwise("fallback").alias("parser"))
    return rows.select("page", "parser", F.explode("items").alias("i")).select("page", "i.url", "i.title", "parser")


@query("""
SELECT p_brand AS article, CASE WHEN p_partkey % 4 = 0 THEN 'rejected' ELSE 'prediction' END AS kind, COUNT(*) AS n, CAST(SUM(CASE WHEN p_partkey % 4 > 0 THEN p_size END) AS DOUBLE) * 1e6 AS low, CAST(SUM(CASE WHEN p_partkey % 4 > 0 THEN p_size + 5 END) AS DOUBLE) * 1e6 AS high, CAST(COUNT(*) FILTER (WHERE p_partkey % 2 = 1) AS BIGINT) AS holdovers FROM part GROUP BY 1, 2""")
def article_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast blocks of articles: rank, title, status and range; blocks without a range are rejected, and kept apart."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    span = F.when(F.col("p_partkey") % 4 == 0, "no forecast yet").otherwise(F.concat(F.lit("Weekend range: $"), size, F.lit(" – $"), (F.col("p_size") + 5).cast("string"), F.lit(" million")))
    block = F.concat((F.col("p_partkey") % 20).cast("string"), F.lit(". "), F.col("p_name"), F.lit("\nStudio | "), F.when(F.col("p_partkey") % 2 == 1, "Week 2").otherwise("NEW"), F.lit("\n"), span)
    articles = p.groupBy(F.col("p_brand").alias("article")).agg(F.array_join(F.collect_list(block), "\n\n").alias("text"))
    blocks = articles.select("article", F.explode(F.split("text", r"\n\s*\n")).alias("block"))
    lines = F.split("block", "\n")
    said = money_range(F.regexp_replace(F.regexp_extract("block", r"range: (.*)", 1), " million$", "M"))
    rows = blocks.select("article", rank_and_title(F.get(lines, F.lit(0)))["title"].alias("title"), F.get(lines, F.lit(1)).rlike(r"Week \d").alias("holdover"), said.alias("r"))
    kind = F.when(F.col("r.low").isNull() | (F.col("title") == ""), "rejected").otherwise("prediction")
    return rows.groupBy("article", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("r.low").alias("low"), F.sum("r.high").alias("high"), F.count_if("holdover").alias("holdovers"))


@query("""
WITH s AS (SELECT l_orderkey, COUNT(*) AS total, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS available FROM lineitem GROUP BY 1)
SELECT l_orderkey AS showtime, CASE l_orderkey % 4 WHEN 0 THEN 'rsc' WHEN 1 THEN 'embedded_json' WHEN 2 THEN 'rendered' ELSE 'none' END AS parse_method, CASE WHEN l_orderkey % 4 < 3 THEN CAST(total AS INTEGER) END AS total, CASE WHEN l_orderkey % 4 < 3 THEN CAST(available AS INTEGER) END AS available FROM s""")
def seat_fill_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats of showtime pages in three formats: a streamed payload, JSON in a script, or rendered inputs; the first that parses counts."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("showtime")).agg(F.collect_list((F.col("l_linestatus") == "O")).alias("free"))
    k = F.col("showtime") % 4
    listed = F.array_join(F.transform("free", lambda a: F.concat(F.lit('{"shown":true,"type":"standard","available":'), a.cast("string"), F.lit("}"))), ",")
    inputs = F.array_join(F.transform("free", lambda a: F.concat(F.lit('<input type="checkbox" name="seat"'), F.when(a, "").otherwise(" disabled"), F.lit(">"))), "")
    html = F.when(k == 0, F.concat(F.lit('0:["$","x"] payload: {"seats":['), listed, F.lit("]} tail }"))).when(k == 1, F.concat(F.lit("<script>window.SEATS = {"), F.lit('"layout":{"seats":['), listed, F.lit("]}};</script>"))).when(k == 2, inputs).otherwise("<p>sold out?</p>")
    pages = n.select("showtime", html.alias("html"))
    seat = "array<struct<shown:boolean,type:string,available:boolean>>"
    rsc = F.from_json(balanced_json("html", F.lit("payload:")), f"seats {seat}")["seats"]
    embedded = F.from_json(balanced_json("html", F.lit("window.SEATS")), f"layout struct<seats:{seat}>")["layout"]["seats"]
    boxes = F.regexp_extract_all("html", F.lit(r'<input type="checkbox" name="seat"([^>]*)>'), F.lit(1))
    rendered = F.when(F.size(boxes) > 0, F.transform(boxes, lambda x: F.struct(F.lit(True).alias("shown"), F.lit("standard").alias("type"), (~x.contains("disabled")).alias("available"))))
    chosen = F.coalesce(*(F.when(seats.isNotNull(), F.struct(F.lit(m).alias("m"), seats.alias("seats"))) for m, seats in (("rsc", rsc), ("embedded_json", embedded), ("rendered", rendered))))
    fill = pages.select("showtime", chosen.alias("c")).select("showtime", F.coalesce("c.m", F.lit("none")).alias("parse_method"), F.when(F.col("c").isNotNull(), seat_fill(F.col("c.seats"))).alias("f"))
    return fill.select("showtime", "parse_method", "f.total", "f.available")


@query("""
WITH p AS (SELECT c_custkey AS page, CASE WHEN c_custkey % 9 = 8 THEN -1 ELSE c_custkey % 2000 END AS movie, CASE WHEN c_custkey % 3 = 0 THEN 'tt' || (c_custkey % 2000 + CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 1 END) WHEN c_custkey % 3 = 1 THEN '' END AS page_id, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE 'title ' || (c_custkey % 2000) END AS page_key, CASE WHEN c_custkey % 4 > 0 THEN 1990 + c_custkey % 7 END AS page_year FROM customer),
m AS (SELECT p_partkey AS movie, 'tt' || p_partkey AS known_id, 'title ' || p_partkey AS key, CASE WHEN p_partkey % 8 > 0 THEN 1990 + p_partkey % 5 END AS year FROM part)
SELECT page, p.movie, CASE WHEN m.movie IS NOT NULL AND (page_id = known_id OR page_key = key AND coalesce(abs(page_year - year) <= 1, TRUE)) THEN 'matched' ELSE 'not_found' END AS status,
       CASE WHEN m.movie IS NULL THEN 'rejected' WHEN page_id = known_id THEN 'id' WHEN page_key = key AND coalesce(abs(page_year - year) <= 1, TRUE) THEN 'title_year' ELSE 'rejected' END AS method,
       CASE WHEN m.movie IS NULL THEN NULL WHEN page_id = known_id THEN 1.0 WHEN page_key = key AND coalesce(abs(page_year - year) <= 1, TRUE) THEN CASE WHEN page_year IS NOT DISTINCT FROM year THEN 1.0 ELSE 0.75 END END::DOUBLE AS score
FROM p LEFT JOIN m ON p.movie = m.movie""")
def page_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pages of customers, held against the parts that they were fetched for: by id, else by title and year."""
    k = F.col("c_custkey")
    n = (k % 2000).cast("string")
    pages = table(spark, sf_dir, "customer").select(
        k.alias("page"), F.when(k % 9 == 8, -1).otherwise(k % 2000).alias("movie"),
        F.when(k % 3 == 0, F.concat(F.lit("tt"), (k % 2000 + F.when(k % 6 == 0, 0).otherwise(1)).cast("string"))).when(k % 3 == 1, "").alias("page_id"),
        F.when(k % 5 == 0, "other").otherwise(F.concat(F.lit("title "), n)).alias("page_key"), F.when(k % 4 > 0, 1990 + k % 7).alias("page_year"),
    )
    p = F.col("p_partkey")
    movies = table(spark, sf_dir, "part").select(p.alias("movie"), F.concat(F.lit("tt"), p.cast("string")).alias("known_id"), F.concat(F.lit("title "), p.cast("string")).alias("key"), F.when(p % 8 > 0, 1990 + p % 5).alias("year"))
    return match_pages(pages, movies)


@query("""
WITH r AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 50 AS m, row_number() OVER (PARTITION BY o_orderkey % 50 ORDER BY o_orderkey) - 1 AS i FROM orders),
k AS (SELECT *, 'a' || (i // 400) || '.zip' AS archive, 'm' || m || '.tsv' AS member FROM r)
SELECT archive, member, CAST(i % 400 + 1 AS INTEGER) AS line_no, o_orderkey || chr(9) || o_orderstatus AS line, CAST(NULL AS VARCHAR) AS error FROM k WHERE m <> 7
UNION ALL SELECT archive, member, CAST(0 AS INTEGER), 'key' || chr(9) || 'status', NULL FROM (SELECT DISTINCT archive, member FROM k WHERE m <> 7)
UNION ALL SELECT archive, member, NULL, NULL, 'checksum' FROM (SELECT DISTINCT archive, member FROM k WHERE m = 7)""")
def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in ZIP archives of 50 tables of 400 rows each, one of them damaged, unpacked member by member."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 50).alias("m"))
    o = places(o, ["m"], ["o_orderkey"], "i").withColumn("archive", F.expr("i DIV 400"))

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w") as z:
            for m, part in rows.sort_values("i").groupby("m"):
                text = "\ufeffkey\tstatus\n" + "".join(f"{k}\t{s}\n" for k, s in zip(part["o_orderkey"], part["o_orderstatus"], strict=True))
                z.writestr(f"m{m}.tsv", text, zipfile.ZIP_STORED if m % 3 == 0 or m == 7 else zipfile.ZIP_DEFLATED)
        content = body.getvalue()
        at = content.find(b"m7.tsv")
        if at > 0:  # a letter of the stored table changes
            content = content[: at + 12] + bytes([content[at + 12] ^ 1]) + content[at + 13 :]
        return pd.DataFrame({"path": [f"/a{key[0]}.zip"], "content": [content]})

    return zip_lines(o.groupBy("archive").applyInPandas(packed, "path string, content binary"))


_PAGED = """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events WHERE user_id IS NOT NULL),
s AS (SELECT user_id, COUNT(*) AS n, CASE WHEN user_id % 10 = 3 AND COUNT(*) > 20 THEN 20 WHEN user_id % 10 = 4 THEN 0 ELSE COUNT(*) END AS reached FROM e GROUP BY 1)"""


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of 10 events each by user: where they start, and their ids. A third page (user 3, 13, ...) and first pages (user 4, 14, ...) got lost."""
    e = places(table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "event_id"), ["user_id"], ["event_id"], "k")
    p = e.groupBy("user_id", F.expr("k DIV 10").alias("page")).agg(F.sort_array(F.collect_list("event_id")).alias("items"))
    lost = ((F.col("user_id") % 10 == 3) & (F.col("page") == 2)) | ((F.col("user_id") % 10 == 4) & (F.col("page") == 0))
    return written(p.where(~lost), "responses")


@query(_PAGED + """
SELECT e.user_id, e.k AS n, e.event_id FROM e JOIN s ON e.user_id = s.user_id WHERE k < least(reached, 65)""")
def keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read page by page, each page naming the last event before the next, 65 a user at most."""
    p = event_pages(spark, sf_dir)
    after = p.groupBy("user_id").agg(F.max("page").alias("last"))
    p = p.join(after, "user_id")
    ahead = p.select("user_id", (F.col("page") + 1).alias("page"), F.element_at("items", -1).cast("string").alias("token"))
    pages = p.join(ahead, ["user_id", "page"], "left").select(
        F.col("user_id").alias("source"), F.when(F.col("page") == 0, "").otherwise(F.coalesce("token", F.concat(F.lit("lost "), F.col("page").cast("string")))).alias("token"),
        F.when(F.col("page") < F.col("last"), F.element_at("items", -1).cast("string")).alias("next_token"), "items",
    )
    items, _ = paged_items(pages, 65)
    return items.select(F.col("source").alias("user_id"), "n", F.col("item").alias("event_id"))


@query(_PAGED + """
SELECT user_id, CAST(least(reached, 65) AS BIGINT) AS n_items, CASE WHEN user_id % 10 = 4 THEN 'empty' WHEN reached > 65 THEN 'limit' WHEN reached < n OR n % 10 = 0 THEN 'gap' ELSE 'complete' END AS status FROM s""")
def offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far reading by offset came for each user: a full last page asks for one that isn't there."""
    p = event_pages(spark, sf_dir).withColumn("offset", F.col("page") * 10)
    pages = offset_tokens(p, "offset", "items", 10).select(F.col("user_id").alias("source"), "token", "next_token", "items")
    _, found = paged_items(pages, 65, first="0")
    return found.select(F.col("source").alias("user_id"), "n_items", "status")
