"""Panels of competition, activity and forecasts around openings, on the driver tables.

A brand stands for a title and its ship days for its run; a customer's orders are forecasts of the customer's own
title; events are a page's activity, with the first purchase as its opening.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import business_minute, cents, day, day_block, estimate_bucket, log1p_floor, money_sum, near_holiday, safe_divide, season
from ..models.linear import decay_fit
from ..operators.aggregates import block_pivot, group_concentration, without_self
from ..operators.joins import as_of_best, as_of_join, shifted, spine
from ..operators.orders import order_agreement
from ..operators.ranks import value_quartiles
from ..sources.writers import written
from ..operators.windows import gap_episodes
from .panels import _BRAND_DAY, brand_days
from .registry import registry, table

QUERIES, SQL, query = registry()

_NEAR = "(CASE WHEN month({0}) IN (7, 12) AND day({0}) BETWEEN CASE month({0}) WHEN 7 THEN 3 ELSE 24 END AND CASE month({0}) WHEN 7 THEN 5 ELSE 26 END THEN 1 WHEN month({0}) = 12 AND day({0}) = 31 THEN 1 WHEN month({0}) = 1 AND day({0}) <= 2 THEN 1 WHEN month({0}) = 11 AND isodow({0}) IN (3, 4, 5) AND day({0}) - isodow({0}) + 4 BETWEEN 22 AND 28 THEN 1 ELSE 0 END)"


@query(f"""
WITH {_BRAND_DAY},
o AS (SELECT brand, MIN(day) AS first, MAX(outlets) AS widest FROM brand_day GROUP BY 1),
d AS (SELECT b.*, date_diff('day', first, day) AS age FROM brand_day b JOIN o ON b.brand = o.brand WHERE widest >= 2),
t AS (SELECT day, SUM(outlets) AS outlets FROM d GROUP BY 1),
c AS (SELECT a.brand, a.day, b.gross AS g, row_number() OVER (PARTITION BY a.brand, a.day ORDER BY b.gross DESC NULLS LAST, b.brand DESC) AS rn FROM d a LEFT JOIN d b ON b.day = a.day - 1 AND b.brand <> a.brand AND b.gross > 0),
x AS (SELECT brand, day, COUNT(g) AS n, coalesce(CAST(SUM(g) AS DOUBLE), 0) AS total, coalesce(CAST(MAX(g) AS DOUBLE), 0) AS top1, coalesce(CAST(SUM(CASE WHEN rn <= 3 THEN g END) AS DOUBLE), 0) AS top3,
             coalesce(CAST(SUM(CASE WHEN rn <= 5 THEN g END) AS DOUBLE), 0) AS top5, coalesce(SUM(CAST(g AS DOUBLE) ^ 2) / SUM(CAST(g AS DOUBLE)) ^ 2, 0) AS hhi FROM c GROUP BY 1, 2)
SELECT d.brand, d.day, CAST(d.age AS BIGINT) AS age, round(ln(1 + CAST(d.gross AS DOUBLE)), 6) AS log_gross, round(ln(1 + coalesce(CAST(p.gross AS DOUBLE), 0)), 6) AS log_prior_day, p.gross IS NULL AS prior_day_missing,
       round(ln(1 + coalesce(CAST(w.gross AS DOUBLE), 0)), 6) AS log_prior_week, w.gross IS NULL AS prior_week_missing, round(d.outlets / t.outlets, 6) AS outlet_share, isodow(d.day) >= 5 AS is_weekend,
       {_NEAR.format('d.day')} = 1 AS is_holiday_or_adjacent, n AS rivals, round(ln(1 + total), 6) AS log_rivals_total, round(ln(1 + top1), 6) AS log_rivals_top1, round(ln(1 + top3), 6) AS log_rivals_top3,
       round(ln(1 + top5), 6) AS log_rivals_top5, round(hhi, 6) AS rivals_hhi, round(ln(1 + total) * (isodow(d.day) - 4), 5) + 0.0 AS rivals_x_weekday
FROM d JOIN t ON d.day = t.day JOIN x ON x.brand = d.brand AND x.day = d.day LEFT JOIN d p ON p.brand = d.brand AND p.day = d.day - 1 LEFT JOIN d w ON w.brand = d.brand AND w.day = d.day - 7""")
def daily_competition_lag_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wide brand's day with its own gross a day and a week before, and what the other brands came to the day before."""
    per = Window.partitionBy("brand")
    d = brand_days(spark, sf_dir).withColumns({"first_": F.min("day").over(per), "widest_": F.max("outlets").over(per)}).where("widest_ >= 2")
    d = d.withColumn("age", F.datediff("day", "first_").cast("bigint")).drop("first_", "widest_")
    rivals = group_concentration(d, ["day"], "brand", "gross").withColumn("day", F.date_add("day", 1))
    x = shifted(shifted(d, ["brand"], "day", "gross", 1, "before1"), ["brand"], "day", "gross", 7, "before7").join(rivals, "day", "left")
    x = x.join(d.groupBy("day").agg(F.sum("outlets").alias("all_outlets")), "day")
    own = without_self("brand", "gross", F.col("before1"))
    weekday = F.weekday("day") + 1
    log = lambda c: F.round(log1p_floor(c), 6)
    return x.select(
        "brand", "day", "age", log(F.col("gross")).alias("log_gross"), log(F.col("before1")).alias("log_prior_day"), F.col("before1").isNull().alias("prior_day_missing"),
        log(F.col("before7")).alias("log_prior_week"), F.col("before7").isNull().alias("prior_week_missing"), F.round(safe_divide("outlets", "all_outlets"), 6).alias("outlet_share"),
        (weekday >= 5).alias("is_weekend"), near_holiday("day").alias("is_holiday_or_adjacent"), own["others_count"].alias("rivals"), log(own["others_total"]).alias("log_rivals_total"),
        log(own["others_top1"]).alias("log_rivals_top1"), log(own["others_top3"]).alias("log_rivals_top3"), log(own["others_top5"]).alias("log_rivals_top5"),
        F.round(own["others_hhi"], 6).alias("rivals_hhi"), (F.round(log1p_floor(own["others_total"]) * (weekday - 4), 5) + 0.0).alias("rivals_x_weekday"),
    )


def _rivals_sql(n: int) -> str:
    return f"""r{n} AS (SELECT a.brand, a.day, COUNT(*) FILTER (WHERE b.g{n} > 0) AS n, coalesce(CAST(SUM(b.g{n}) AS DOUBLE), 0) AS total, coalesce(CAST(MAX(b.g{n}) AS DOUBLE), 0) AS top1,
  coalesce(SUM(CAST(b.g{n} AS DOUBLE) ^ 2) / nullif(SUM(CAST(b.g{n} AS DOUBLE)), 0) ^ 2, 0) AS hhi FROM brand_day a JOIN g b ON b.day = a.day AND b.brand <> a.brand GROUP BY 1, 2)"""


@query(f"""
WITH {_BRAND_DAY}, days AS (SELECT DISTINCT day FROM brand_day), brands AS (SELECT DISTINCT brand FROM brand_day),
g AS (SELECT s.brand, s.day, {', '.join(f"coalesce(SUM(b.gross) FILTER (WHERE b.day >= s.day - {n}), 0) AS g{n}" for n in (1, 3, 7))} FROM (SELECT * FROM brands, days) s LEFT JOIN brand_day b ON b.brand = s.brand AND b.day BETWEEN s.day - 7 AND s.day - 1 GROUP BY 1, 2),
{', '.join(_rivals_sql(n) for n in (1, 3, 7))}
SELECT r1.brand, r1.day, {', '.join(f"r{n}.n AS rivals{n}, r{n}.total AS total{n}, r{n}.top1 AS top1_{n}, round(r{n}.hhi, 6) AS hhi{n}" for n in (1, 3, 7))}
FROM r1 JOIN r3 ON r1.brand = r3.brand AND r1.day = r3.day JOIN r7 ON r1.brand = r7.brand AND r1.day = r7.day""")
def competitor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other brands came to over the 1, 3 and 7 days before each brand's day: each rival is summed first, then compared."""
    daily = written(brand_days(spark, sf_dir).select("brand", "day", "gross"), "days")
    # each day counts for the seven after it, of which those count on which somebody sold
    ahead = daily.select("brand", "gross", "day", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"))
    sums = ahead.groupBy("brand", F.expr("date_add(day, k)").alias("day")).agg(*(F.coalesce(F.sum(F.when(F.col("k") <= n, F.col("gross"))), F.lit(0)).alias(f"g{n}") for n in (1, 3, 7)))
    sums = written(sums.join(daily.select("day").distinct(), "day", "left_semi"), "windows")
    out = daily.select("brand", "day").join(sums, ["brand", "day"], "left").fillna(0, ["g1", "g3", "g7"])
    for n in (1, 3, 7):
        own = without_self("brand", f"g{n}", F.col(f"g{n}"))
        named = {"others_count": f"rivals{n}", "others_total": f"total{n}", "others_top1": f"top1_{n}"}
        joined = out.join(group_concentration(sums, ["day"], "brand", f"g{n}"), "day", "left")
        out = joined.select(*out.columns, *(own[c].alias(name) for c, name in named.items()), F.round(own["others_hhi"], 6).alias(f"hhi{n}"))
    return out.drop("g1", "g3", "g7")


@query("""
WITH f AS (SELECT o_custkey AS movie, CAST(date_trunc('month', o_orderdate) AS DATE) AS target, CAST(o_orderdate AS DATE) AS published, MAX(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3),
p AS (SELECT *, row_number() OVER (PARTITION BY movie, target ORDER BY published) AS k FROM f),
r AS (SELECT a.movie, a.target, a.published, b.movie AS rival, max_by(b.value, b.published) AS v FROM f a JOIN f b ON a.target = b.target AND b.movie <> a.movie AND b.published <= a.published GROUP BY 1, 2, 3, 4)
SELECT f.movie, f.target, f.published, f.value, COUNT(r.v) AS rivals, round(coalesce(CAST(SUM(CAST(r.v AS DECIMAL(18,2))) AS DOUBLE), 0), 2) AS rivals_total
FROM f LEFT JOIN r ON r.movie = f.movie AND r.target = f.target AND r.published = f.published GROUP BY 1, 2, 3, 4""")
def same_target_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each forecast with the latest forecasts that others had out for the same target by then: how many, and their sum.

    A revision adds its change, so running sums give what all latest forecasts come to; no pair is made.
    """
    o = table(spark, sf_dir, "orders")
    f = o.groupBy(F.col("o_custkey").alias("movie"), F.date_trunc("month", "o_orderdate").cast("date").alias("target"), day("o_orderdate").alias("published")).agg(F.max(cents("o_totalprice")).alias("value"))
    own = Window.partitionBy("movie", "target").orderBy("published")
    f = f.withColumn("change_", F.col("value") - F.coalesce(F.lag("value").over(own), F.lit(0))).withColumn("new_", (F.row_number().over(own) == 1).cast("long"))
    # sums by target and day first, so that a target takes as many rows as it has days
    daily = f.groupBy("target", "published").agg(F.sum("change_").alias("change_"), F.sum("new_").alias("new_"))
    upto = Window.partitionBy("target").orderBy("published").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.select("target", "published", F.sum("change_").over(upto).alias("all_"), F.sum("new_").over(upto).alias("n_"))
    return f.join(daily, ["target", "published"]).select("movie", "target", "published", F.col("value").cast("double").alias("value"), (F.col("n_") - 1).alias("rivals"), F.round((F.col("all_") - F.col("value")).cast("double"), 2).alias("rivals_total"))


@query(f"""
WITH {_BRAND_DAY}, w AS (SELECT brand, CAST(date_trunc('week', day) AS DATE) AS week, SUM(gross) AS gross FROM brand_day GROUP BY 1, 2),
x AS (SELECT a.week, a.brand, a.gross, b.gross AS said FROM w a JOIN w b ON a.brand = b.brand AND b.week = a.week - 7)
SELECT l.week, COUNT(*) AS pairs, COUNT(*) FILTER (WHERE sign(l.gross - r.gross) = sign(l.said - r.said)) AS in_order, round(COUNT(*) FILTER (WHERE sign(l.gross - r.gross) = sign(l.said - r.said)) / COUNT(*), 6) AS accuracy
FROM x l JOIN x r ON l.week = r.week AND l.brand < r.brand GROUP BY 1""")
def pairwise_order_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pairs of brands of a week that the week before puts in their order, counted without pairs."""
    w = written(brand_days(spark, sf_dir).groupBy("brand", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.sum("gross").alias("gross")), "weeks")
    x = w.join(w.select("brand", F.date_add("week", 7).alias("week"), F.col("gross").alias("said")), ["brand", "week"])
    out = order_agreement(x, ["week"], "said", "gross").where("pairs > 0")
    return out.select("week", "pairs", "in_order", F.round(F.col("in_order") / F.col("pairs"), 6).alias("accuracy"))


@query("""
WITH u AS (SELECT l_partkey % 3 AS region, CAST(l_quantity AS BIGINT) AS x, CAST(round(l_extendedprice / 1000) AS BIGINT) AS y, COUNT(*) AS w FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT a.region, SUM(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) > 0 THEN a.w * b.w END) / 2 AS same, SUM(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) < 0 THEN a.w * b.w END) / 2 AS crossed FROM u a JOIN u b ON a.region = b.region GROUP BY 1),
n AS (SELECT region, SUM(w) AS n FROM u GROUP BY 1), tx AS (SELECT region, SUM(s * (s - 1)) / 2 AS t FROM (SELECT region, x, SUM(w) AS s FROM u GROUP BY 1, 2) GROUP BY 1), ty AS (SELECT region, SUM(s * (s - 1)) / 2 AS t FROM (SELECT region, y, SUM(w) AS s FROM u GROUP BY 1, 2) GROUP BY 1)
SELECT p.region, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs, CAST(crossed AS BIGINT) AS crossed, round((same - crossed) / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS tau
FROM p JOIN n ON p.region = n.region JOIN tx ON p.region = tx.region JOIN ty ON p.region = ty.region""")
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of quantity and price over all lines of three regions, ties and hot values included."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3).alias("region"), F.col("l_quantity").cast("bigint").alias("x"), F.round(F.col("l_extendedprice") / 1000).cast("bigint").alias("y"))
    a = order_agreement(rows, ["region"], "x", "y")
    same = F.col("in_order") - F.col("tied_both")
    tau = (same - F.col("crossed")) / F.sqrt((F.col("pairs") - F.col("tied_x")).cast("double") * (F.col("pairs") - F.col("tied_y")))
    return a.select("region", "pairs", "crossed", F.round(tau, 6).alias("tau"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, SUM(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
c AS (SELECT user_id, day, v, SUM(v) OVER (PARTITION BY user_id ORDER BY day) AS total FROM d),
q AS (SELECT user_id, v AS opening, rank() OVER (ORDER BY v) - 1 + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0 AS mid, COUNT(*) OVER () AS n FROM (SELECT user_id, min_by(v, day) AS v FROM d GROUP BY 1))
SELECT c.user_id, c.day, CAST(c.v AS DOUBLE) AS value, CAST(n.v AS DOUBLE) AS next_value, CAST(floor(mid * 4 / q.n) + 1 AS INTEGER) AS opening_quartile,
       """ + ", ".join(f"CAST(greatest(0, c.total - coalesce((SELECT max(p.total) FROM c p WHERE p.user_id = c.user_id AND p.day = c.day - {k}), 0)) AS DOUBLE) AS delta{k}" for k in (1, 3, 7)) + """
FROM c JOIN d n ON n.user_id = c.user_id AND n.day = c.day + 1 JOIN q ON q.user_id = c.user_id""")
def next_day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that have a next day, with its value, changes of the running total over 1, 3 and 7 calendar days (nothing before counts as 0) and the opening's quartile."""
    d = table(spark, sf_dir, "events").groupBy("user_id", day("ts").alias("day")).agg(F.sum(cents("value")).alias("v"))
    c = d.withColumn("total", F.sum("v").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    for k in (1, 3, 7):
        c = shifted(c, ["user_id"], "day", "total", k, f"t{k}")
    c = shifted(c, ["user_id"], "day", "v", -1, "next").where("next IS NOT NULL")
    first = value_quartiles(d.groupBy("user_id").agg(F.min_by("v", "day").alias("opening")), "opening", "opening_quartile").select("user_id", "opening_quartile")
    delta = lambda k: F.greatest(F.lit(0), F.col("total") - F.coalesce(f"t{k}", F.lit(0))).cast("double").alias(f"delta{k}")
    return c.join(first, "user_id").select("user_id", "day", F.col("v").cast("double").alias("value"), F.col("next").cast("double").alias("next_value"), "opening_quartile", *(delta(k) for k in (1, 3, 7)))


@query(f"""
WITH {_BRAND_DAY}, w AS (SELECT brand, CAST(date_trunc('week', day) AS DATE) AS week, CAST(SUM(gross) AS DOUBLE) AS gross, MAX(outlets) AS outlets FROM brand_day GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER x - 1 AS week_no, lag(gross) OVER x AS gross_1, lag(outlets) OVER x AS outlets_1, lag(gross, 2) OVER x AS gross_2, lag(week) OVER x AS week_1, SUM(gross) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM w WINDOW x AS (PARTITION BY brand ORDER BY week))
SELECT brand, week, week_no, gross, gross_1, outlets_1, gross_2, week_1, round(so_far, 2) AS so_far FROM l WHERE week_no >= 1""")
def weekly_lag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand weeks from the second on, merged with the row before, by row and not by calendar."""
    w = brand_days(spark, sf_dir).groupBy("brand", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.sum("gross").cast("double").alias("gross"), F.max("outlets").alias("outlets"))
    x = Window.partitionBy("brand").orderBy("week")
    so_far = F.round(F.sum("gross").over(x.rowsBetween(Window.unboundedPreceding, -1)), 2)
    out = w.select("brand", "week", (F.row_number().over(x) - 1).cast("bigint").alias("week_no"), "gross", F.lag("gross").over(x).alias("gross_1"), F.lag("outlets").over(x).alias("outlets_1"), F.lag("gross", 2).over(x).alias("gross_2"), F.lag("week").over(x).alias("week_1"), so_far.alias("so_far"))
    return out.where("week_no >= 1")


@query("""
WITH w AS (SELECT s_suppkey, 1.0 + s_nationkey / 25.0 AS weight FROM supplier),
l AS (SELECT p_brand AS brand, CAST(l_shipdate AS DATE) AS day, l_suppkey, SUM(l_quantity) AS sold FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
n AS (SELECT brand, day, COUNT(DISTINCT l_suppkey) AS outlets FROM l GROUP BY 1, 2)
SELECT l.brand, l.day, outlets, outlets <= 2 AS weighted, round(SUM(sold * CASE WHEN outlets <= 2 THEN weight ELSE 1 END), 4) AS sold FROM l JOIN n ON l.brand = n.brand AND l.day = n.day JOIN w ON s_suppkey = l_suppkey GROUP BY 1, 2, 3""")
def design_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of a brand's day by design weight, but only where no more outlets were seen than the sample has (2)."""
    weights = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (1.0 + F.col("s_nationkey") / 25.0).alias("weight"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", day("l_shipdate").alias("day")).join(parts, "l_partkey")
    rows = rows.groupBy("brand", "day", "l_suppkey").agg(F.sum("l_quantity").alias("sold")).join(weights, "l_suppkey")
    out = rows.groupBy("brand", "day").agg(F.count("*").alias("outlets"), F.sum("sold").alias("plain_"), F.sum(F.col("sold") * F.col("weight")).alias("by_weight_"))
    weighted = F.col("outlets") <= 2
    return out.select("brand", "day", "outlets", weighted.alias("weighted"), F.round(F.when(weighted, F.col("by_weight_")).otherwise(F.col("plain_")), 4).alias("sold"))


_SEATS = """e AS (SELECT *, CASE WHEN hour(ts) * 60 + minute(ts) < 300 THEN hour(ts) * 60 + minute(ts) + 1440 ELSE hour(ts) * 60 + minute(ts) END AS m, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day FROM events),
b AS (SELECT user_id, day, CASE WHEN m < 900 THEN 1 WHEN m < 1080 THEN 2 WHEN m < 1260 THEN 3 ELSE 4 END AS block, CAST(value AS DECIMAL(18,2)) AS v, event_type FROM e),
s AS (SELECT user_id, day, """ + ", ".join(f"CAST(SUM(v) FILTER (WHERE block = {k}) AS DOUBLE) AS c{k}, CAST(SUM(v) FILTER (WHERE block = {k} AND event_type = 'purchase') AS DOUBLE) AS s{k}" for k in (1, 2, 3, 4)) + ", CAST(SUM(v) AS DOUBLE) AS capacity FROM b GROUP BY 1, 2)"


def seat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, business day, capacity (c1 to c4) and sold (s1 to s4) by block, and the whole capacity."""
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", (F.col("ts") - F.expr("INTERVAL 5 HOURS")).cast("date").alias("day"), day_block(business_minute("ts")).alias("block"), cents("value").alias("v"), "event_type")
    sold = F.when(F.col("event_type") == "purchase", F.col("v"))
    out = block_pivot(rows, ["user_id", "day"], "block", (1, 2, 3, 4), {"c": F.col("v"), "s": sold})
    whole = rows.groupBy("user_id", "day").agg(money_sum("v").alias("capacity"))
    return out.join(whole, ["user_id", "day"]).select("user_id", "day", *(F.col(f"{x}{k}").cast("double").alias(f"{x}{k}") for k in (1, 2, 3, 4) for x in "cs"), "capacity")


@query(f"""
WITH {_SEATS}
SELECT user_id, day, capacity, round((c1 + c2 + c3 + c4) / nullif(capacity, 0), 6) AS capacity_coverage, {', '.join(f"round(s{k} / nullif(c{k}, 0), 6) AS fill{k}" for k in (1, 2, 3, 4))},
       c1 > 0 AND c2 > 0 AND coalesce(s1, 0) >= 0 AND coalesce(s2, 0) >= 0 AS ready_by_block_2 FROM s""")
def seat_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill rates by block; coverage adds the four capacities as they are, so it is null unless all are there; and whether the blocks up to the cutoff can be used."""
    s = seat_blocks(spark, sf_dir)
    whole = F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4")
    ready = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.coalesce("s1", F.lit(0)) >= 0) & (F.coalesce("s2", F.lit(0)) >= 0)
    return s.select("user_id", "day", "capacity", F.round(safe_divide(whole, "capacity"), 6).alias("capacity_coverage"), *(F.round(safe_divide(f"s{k}", f"c{k}"), 6).alias(f"fill{k}") for k in (1, 2, 3, 4)), ready.alias("ready_by_block_2"))


@query(f"""
WITH {_SEATS},
a AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS actual FROM events GROUP BY 1, 2 HAVING SUM(CAST(value AS DECIMAL(18,2))) > 0),
o AS (SELECT user_id, MIN(day) AS opened FROM a GROUP BY 1),
n AS (SELECT user_id, CAST(ts AS DATE) AS day, MAX(value) AS baseline FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT s.user_id, s.day, actual, round(ln(1 + greatest(0, c1)), 6) AS log_c1, round(ln(1 + greatest(0, coalesce(s1, 0))), 6) AS log_s1, round(ln(1 + greatest(0, coalesce(s2, 0))), 6) AS log_s2, isodow(s.day) AS weekday, CAST(date_diff('day', opened, s.day) AS BIGINT) AS age,
       (SELECT max_by(baseline, n.day) FROM n WHERE n.user_id = s.user_id AND n.day < s.day) AS baseline
FROM s JOIN a ON a.user_id = s.user_id AND a.day = s.day JOIN o ON o.user_id = s.user_id WHERE c1 > 0 AND c2 > 0 AND s.day >= opened""")
def ridge_training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seat blocks that pass the cutoff, joined to the day's actual, the latest baseline before it and the calendar."""
    e = table(spark, sf_dir, "events")
    actual = e.groupBy("user_id", day("ts").alias("day")).agg(money_sum("value").alias("actual")).where("actual > 0")
    actual = actual.withColumn("opened", F.min("day").over(Window.partitionBy("user_id")))
    base = e.where("event_type = 'view'").groupBy("user_id", F.date_add(day("ts"), 1).alias("known")).agg(F.max("value").alias("baseline"))
    rows = seat_blocks(spark, sf_dir).where("c1 > 0 AND c2 > 0").join(actual, ["user_id", "day"])
    rows = as_of_join(rows, base, ["user_id"], "day", "known", ["baseline"])
    log = lambda c: F.round(log1p_floor(F.col(c)), 6)
    return rows.select("user_id", "day", "actual", log("c1").alias("log_c1"), log("s1").alias("log_s1"), log("s2").alias("log_s2"), (F.weekday("day") + 1).cast("bigint").alias("weekday"), F.datediff("day", "opened").cast("bigint").alias("age"), "baseline")


@query("""
WITH f AS (SELECT o_custkey AS movie, CAST(o_orderdate AS DATE) AS published, CAST(left(o_orderpriority, 1) AS INTEGER) % 5 AS rank, o_orderkey, o_totalprice AS mid FROM orders),
t AS (SELECT movie, MAX(published) AS target, max_by(mid, struct_pack(a := published, b := o_orderkey)) AS actual FROM f GROUP BY 1),
s AS (SELECT movie, target, actual, CAST(k AS INTEGER) AS snapshot_day, CAST(target + CAST(k AS INTEGER) AS DATE) AS as_of FROM t, (SELECT UNNEST(range(-14, 0)) AS k)),
x AS (SELECT s.*, b.mid, b.published, b.o_orderkey FROM s LEFT JOIN LATERAL (SELECT * FROM f WHERE f.movie = s.movie AND published <= as_of ORDER BY published DESC, coalesce(nullif(f.rank, 0), 999999), f.o_orderkey DESC LIMIT 1) b ON TRUE)
SELECT movie, snapshot_day, as_of, o_orderkey AS forecast, mid, CAST(date_diff('day', published, as_of) AS BIGINT) AS forecast_age, CASE WHEN mid IS NULL THEN NULL WHEN mid < 15e3 THEN 'under_15' WHEN mid < 30e3 THEN '15_30' WHEN mid < 60e3 THEN '30_60' WHEN mid < 100e3 THEN '60_100' ELSE 'over_100' END AS bucket,
       round(ln(actual / nullif(mid, 0)), 6) AS residual FROM x""")
def day_by_day_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each title on each of the 14 days before its target: the latest forecast, its size and what it missed. Rank 0 counts as no rank."""
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("movie"), day("o_orderdate").alias("published"), (F.left("o_orderpriority", F.lit(1)).cast("int") % 5).alias("rank"), F.col("o_orderkey").alias("forecast"), F.col("o_totalprice").alias("mid"))
    target = f.groupBy("movie").agg(F.max("published").alias("target"), F.max_by("mid", F.struct("published", "forecast")).alias("actual"))
    snap = target.withColumn("snapshot_day", F.explode(F.sequence(F.lit(-14), F.lit(-1)))).withColumn("as_of", F.date_add("target", F.col("snapshot_day")))
    found = as_of_best(snap, f.withColumn("known", F.col("published")), ["movie"], "as_of", "known", [-F.coalesce(F.nullif("rank", F.lit(0)), F.lit(999999)), F.col("forecast")], ["forecast", "mid", "published"])
    return found.select("movie", "snapshot_day", "as_of", "forecast", "mid", F.datediff("as_of", "published").cast("bigint").alias("forecast_age"), estimate_bucket(F.col("mid") * 1000).alias("bucket"), F.round(F.ln(safe_divide("actual", "mid")), 6).alias("residual"))


_ACTIVITY = """d AS (SELECT user_id, CAST(ts AS DATE) AS day, SUM(CAST(value AS DECIMAL(18,2))) AS v, COUNT(*) AS n FROM events GROUP BY 1, 2),
o AS (SELECT user_id, MIN(CAST(ts AS DATE)) + 5 AS opening FROM events WHERE event_type = 'purchase' GROUP BY 1),
c AS (SELECT user_id, day, SUM(v) OVER w AS v, SUM(n) OVER w AS n FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
g AS (SELECT user_id, opening, CAST(a AS INTEGER) AS activity_day, CAST(k AS INTEGER) AS competition_day FROM o, (SELECT UNNEST(range(-3, 0)) AS a), (SELECT UNNEST(range(-3, 0)) AS k))"""


@query(f"""
WITH {_ACTIVITY}, t AS (SELECT day, SUM(v) AS total, COUNT(*) AS n FROM d GROUP BY 1)
SELECT g.user_id, g.opening, activity_day, competition_day, CAST(coalesce((SELECT max_by(v, day) FROM c WHERE c.user_id = g.user_id AND c.day <= g.opening + activity_day), 0) AS DOUBLE) AS views,
       CAST(coalesce((SELECT max_by(n, day) FROM c WHERE c.user_id = g.user_id AND c.day <= g.opening + activity_day), 0) AS BIGINT) AS edits,
       CAST(coalesce(t.total, 0) - coalesce(d.v, 0) AS DOUBLE) AS rivals_total, CAST(coalesce(t.n, 0) - CASE WHEN d.v IS NULL THEN 0 ELSE 1 END AS BIGINT) AS rivals, month(g.opening) AS month
FROM g LEFT JOIN t ON t.day = g.opening + competition_day LEFT JOIN d ON d.user_id = g.user_id AND d.day = g.opening + competition_day""")
def competition_activity_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by activity day and competition day: running activity as of the one (zero if there is none yet), rivals on the other."""
    e = table(spark, sf_dir, "events")
    d = e.groupBy("user_id", day("ts").alias("day")).agg(F.sum(cents("value")).alias("v"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    c = d.select("user_id", F.col("day").alias("known"), F.sum("v").over(w).alias("views"), F.sum("n").over(w).alias("edits"))
    o = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.date_add(F.min(day("ts")), 5).alias("opening"))
    g = o.withColumn("activity_day", F.explode(F.sequence(F.lit(-3), F.lit(-1)))).withColumn("at_", F.date_add("opening", F.col("activity_day")))
    g = as_of_join(g, c, ["user_id"], "at_", "known", ["views", "edits"]).withColumn("competition_day", F.explode(F.sequence(F.lit(-3), F.lit(-1))))
    g = g.withColumn("day", F.date_add("opening", F.col("competition_day")))
    t = d.groupBy("day").agg(F.sum("v").alias("total"), F.count("*").alias("all_"))
    x = g.join(t, "day", "left").join(d.select("user_id", "day", F.col("v").alias("own_")), ["user_id", "day"], "left")
    zero = F.lit(0)
    return x.select(
        "user_id", "opening", "activity_day", "competition_day", F.coalesce("views", zero).cast("double").alias("views"), F.coalesce("edits", zero).cast("bigint").alias("edits"),
        (F.coalesce("total", zero) - F.coalesce("own_", zero)).cast("double").alias("rivals_total"), (F.coalesce("all_", zero) - F.col("own_").isNotNull().cast("int")).cast("bigint").alias("rivals"), F.month("opening").cast("bigint").alias("month"),
    )


@query(f"""
WITH {_ACTIVITY}, p AS (SELECT user_id, day, MAX(value) AS said FROM (SELECT user_id, CAST(ts AS DATE) AS day, value FROM events WHERE event_type = 'view') GROUP BY 1, 2),
x AS (SELECT g.user_id, g.opening, forecast_day, (SELECT max_by(said, day) FROM p WHERE p.user_id = g.user_id AND p.day <= g.opening + forecast_day) AS said FROM (SELECT user_id, opening, CAST(f AS INTEGER) AS forecast_day FROM o, (SELECT UNNEST(range(-3, 0)) AS f)) g)
SELECT x.user_id, x.forecast_day, x.said, COUNT(r.said) AS rivals_with_forecast, round(coalesce(CAST(SUM(CAST(r.said AS DECIMAL(18,2))) AS DOUBLE), 0), 2) AS rivals_said, CASE WHEN x.said >= 50 THEN 1 WHEN x.said IS NOT NULL THEN 0 END AS is_large
FROM x LEFT JOIN x r ON r.opening = x.opening AND r.forecast_day = x.forecast_day AND r.user_id <> x.user_id GROUP BY 1, 2, 3""")
def competition_forecast_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by forecast day: their latest forecast by then, and those of titles with the same opening."""
    e = table(spark, sf_dir, "events")
    o = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.date_add(F.min(day("ts")), 5).alias("opening"))
    p = e.where("event_type = 'view'").groupBy("user_id", day("ts").alias("known")).agg(F.max("value").alias("said"))
    g = o.withColumn("forecast_day", F.explode(F.sequence(F.lit(-3), F.lit(-1)))).withColumn("at_", F.date_add("opening", F.col("forecast_day")))
    x = as_of_join(g, p, ["user_id"], "at_", "known", ["said"])
    t = x.groupBy("opening", "forecast_day").agg(F.count("said").alias("n_"), F.sum(cents("said")).alias("all_"))
    own = F.coalesce(cents("said"), F.lit(0))
    return x.join(t, ["opening", "forecast_day"]).select(
        "user_id", "forecast_day", "said", (F.col("n_") - F.col("said").isNotNull().cast("int")).alias("rivals_with_forecast"), F.round((F.coalesce("all_", F.lit(0)) - own).cast("double"), 2).alias("rivals_said"), F.when(F.col("said") >= 50, 1).when(F.col("said").isNotNull(), 0).alias("is_large")
    )


@query(f"""
WITH {_BRAND_DAY}, f AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 4 THEN 0 ELSE 1 END AS new FROM brand_day WINDOW w AS (PARTITION BY brand ORDER BY day)),
e AS (SELECT *, SUM(new) OVER (PARTITION BY brand ORDER BY day) AS episode FROM f),
o AS (SELECT *, MIN(day) OVER (PARTITION BY brand, episode) AS opened FROM e),
w AS (SELECT brand, episode, opened, CAST(floor(date_diff('day', opened, day) / 7) AS BIGINT) AS week, SUM(gross) AS gross, COUNT(*) AS days, SUM(CASE WHEN day < opened + 3 THEN gross END) AS weekend FROM o GROUP BY 1, 2, 3, 4)
SELECT brand, CAST(episode AS BIGINT) AS episode, opened, COUNT(*) AS weeks, CAST(SUM(days) AS BIGINT) AS days, CAST(SUM(weekend) AS DOUBLE) AS opening_weekend,
       CASE WHEN month(opened) * 100 + day(opened) BETWEEN 525 AND 905 THEN 'summer_' || year(opened) WHEN month(opened) >= 11 THEN 'holiday_' || year(opened) WHEN month(opened) * 100 + day(opened) <= 105 THEN 'holiday_' || (year(opened) - 1) END AS season,
       round(CASE WHEN COUNT(*) > 1 THEN -regr_slope(ln(CAST(gross AS DOUBLE)), week) END, 6) AS beta FROM w GROUP BY 1, 2, 3""")
def episode_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a brand without a gap of over four days: weeks, opening weekend, season and decay."""
    d = gap_episodes(brand_days(spark, sf_dir), ["brand"], "day", 4).withColumn("opened", F.min("day").over(Window.partitionBy("brand", "episode")))
    age = F.datediff("day", "opened")
    w = d.groupBy("brand", "episode", "opened", F.floor(age / 7).alias("week")).agg(F.sum("gross").alias("gross"), F.count("*").alias("days"), F.sum(F.when(age < 3, F.col("gross"))).alias("weekend"))
    whole = w.groupBy("brand", "episode", "opened").agg(F.count("*").alias("weeks"), F.sum("days").alias("days"), money_sum("weekend").alias("opening_weekend"))
    fit = decay_fit(w, ["brand", "episode"], "week", "gross").select("brand", "episode", F.round("beta", 6).alias("beta"))
    return whole.join(fit, ["brand", "episode"], "left").select("brand", "episode", "opened", "weeks", "days", "opening_weekend", season("opened").alias("season"), "beta")


@query("""
WITH o AS (SELECT user_id, MIN(CAST(ts AS DATE)) + 12 AS opening FROM events GROUP BY 1), d AS (SELECT user_id, CAST(ts AS DATE) AS day, SUM(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
g AS (SELECT user_id, opening, CAST(k AS INTEGER) AS t FROM o, (SELECT UNNEST(range(-500, 101)) AS k))
SELECT g.user_id, g.t, CAST(coalesce(SUM(d.v) OVER (PARTITION BY g.user_id ORDER BY g.t), 0) AS DOUBLE) AS views FROM g LEFT JOIN d ON d.user_id = g.user_id AND d.day = g.opening + g.t""")
def relative_day_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running views on every day from 500 before to 100 after the opening."""
    e = table(spark, sf_dir, "events")
    d = e.groupBy("user_id", day("ts").alias("day")).agg(F.sum(cents("value")).alias("v")).withColumn("opening", F.date_add(F.min("day").over(Window.partitionBy("user_id")), 12))
    d = d.select("user_id", F.datediff("day", "opening").alias("t"), "v")
    grid = spine(d.select("user_id").distinct(), spark.range(-500, 101).select(F.col("id").cast("int").alias("t")))
    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(d, ["user_id", "t"], "left").select("user_id", "t", F.coalesce(F.sum("v").over(w), F.lit(0)).cast("double").alias("views"))


@query(f"""
WITH {_BRAND_DAY}, t AS (SELECT day, CAST(SUM(gross) AS DOUBLE) AS total, COUNT(*) AS n FROM brand_day GROUP BY 1)
SELECT t.day, t.total, t.n, isodow(t.day) >= 5 AS is_weekend, {_NEAR.format('t.day')} = 1 AS is_holiday_or_adjacent, p.total AS total_1d, w.total AS total_7d FROM t LEFT JOIN t p ON p.day = t.day - 1 LEFT JOIN t w ON w.day = t.day - 7""")
def industry_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry totals by day with those of a day and a week before."""
    t = brand_days(spark, sf_dir).groupBy("day").agg(money_sum("gross").alias("total"), F.count("*").alias("n"))
    out = shifted(shifted(t, [], "day", "total", 1, "total_1d"), [], "day", "total", 7, "total_7d")
    return out.select("day", "total", "n", (F.weekday("day") >= 4).alias("is_weekend"), near_holiday("day").alias("is_holiday_or_adjacent"), "total_1d", "total_7d")


@query("""
WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross FROM lineitem GROUP BY 1),
x AS (SELECT day, day - CAST(isodow(day) % 7 AS INTEGER) AS previous_end FROM d)
SELECT x.day, previous_end, CAST(SUM(gross) AS DOUBLE) AS previous_weekend FROM x LEFT JOIN d ON d.day BETWEEN previous_end - 2 AND previous_end GROUP BY 1, 2""")
def previous_weekend_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekend (Friday to Sunday) that ends on the latest Sunday on or before each day, and its total."""
    totals = table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate").alias("day")).agg(F.sum(cents("l_extendedprice")).alias("g"))
    x = totals.select("day", F.date_sub("day", (F.weekday("day") + 1) % 7).alias("previous_end"))
    x = x.withColumn("at_", F.explode(F.sequence(F.date_sub("previous_end", 2), F.col("previous_end"))))
    return x.join(totals.withColumnRenamed("day", "at_"), "at_", "left").groupBy("day", "previous_end").agg(money_sum("g").alias("previous_weekend"))
