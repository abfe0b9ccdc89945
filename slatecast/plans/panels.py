"""Feature panels: openings, daily competition, shares, episodes, activity and seat blocks on the driver tables.

A part or brand stands for a title, a line item's ship day for a calendar day and its price for that day's gross.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import age_bucket, business_minute, cents, day, day_block, is_holiday, money_sum, safe_divide, season
from ..models.linear import decay_fit
from ..operators.aggregates import block_pivot, concentration_without_self
from ..operators.joins import as_of_join, date_range, shifted, spine
from ..operators.ranks import quantiles
from ..operators.windows import change_flag, gap_episodes, running_distinct, trailing
from .registry import registry, table

QUERIES, SQL, query = registry()

_BRAND_DAY = """brand_day AS (
  SELECT p_brand AS brand, CAST(l_shipdate AS DATE) AS day, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross, COUNT(DISTINCT l_suppkey) AS outlets
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def brand_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, day, gross (exact) and outlets."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", day("l_shipdate").alias("day"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return lines.join(parts, "l_partkey").groupBy("brand", "day").agg(F.sum(cents("l_extendedprice")).alias("gross"), F.count_distinct("l_suppkey").alias("outlets"))


@query("""
WITH d AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS day, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross
           FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
o AS (SELECT part, MIN(day) AS opening_date FROM d GROUP BY 1)
SELECT d.part, opening_date, CAST(SUM(CASE WHEN day = opening_date THEN gross END) AS DOUBLE) AS opening_day,
       CAST(SUM(CASE WHEN day < opening_date + 3 THEN gross END) AS DOUBLE) AS opening_weekend, CAST(SUM(gross) AS DOUBLE) AS total, COUNT(*) AS n_days
FROM d JOIN o ON d.part = o.part GROUP BY 1, 2""")
def opening_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening date, opening day and opening three days of each part, without previews (returned lines)."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    daily = lines.groupBy(F.col("l_partkey").alias("part"), day("l_shipdate").alias("day")).agg(F.sum(cents("l_extendedprice")).alias("gross"))
    opened = daily.withColumn("opening_date", F.min("day").over(Window.partitionBy("part")))
    age = F.datediff("day", "opening_date")
    return opened.groupBy("part", "opening_date").agg(
        money_sum(F.when(age == 0, F.col("gross"))).alias("opening_day"),
        money_sum(F.when(age < 3, F.col("gross"))).alias("opening_weekend"),
        money_sum("gross").alias("total"),
        F.count("*").alias("n_days"),
    )


@query(f"""
WITH {_BRAND_DAY},
j AS (SELECT a.brand, a.day, b.gross, row_number() OVER (PARTITION BY a.brand, a.day ORDER BY b.gross DESC NULLS LAST, b.brand DESC) AS rn
      FROM brand_day a LEFT JOIN brand_day b ON b.day = a.day AND b.brand <> a.brand AND b.gross > 0 WHERE a.gross > 0),
o AS (SELECT brand, day, CAST(SUM(gross) AS DOUBLE) AS others_total, CAST(MAX(gross) AS DOUBLE) AS top1, COUNT(gross) AS n,
             CAST(SUM(CASE WHEN rn <= 3 THEN gross END) AS DOUBLE) AS top3, CAST(SUM(CASE WHEN rn <= 5 THEN gross END) AS DOUBLE) AS top5, SUM(CAST(gross AS DOUBLE) * CAST(gross AS DOUBLE)) AS q FROM j GROUP BY 1, 2)
SELECT o.brand, o.day, coalesce(others_total, 0) AS others_total, coalesce(top1, 0) AS others_top1, coalesce(top3, 0) AS others_top3, coalesce(top5, 0) AS others_top5, n AS others_count,
       round(coalesce(q / (others_total * others_total), 0), 6) AS others_hhi,
       round(CAST(d.gross AS DOUBLE) / (coalesce(others_total, 0) + CAST(d.gross AS DOUBLE)), 6) AS own_share
FROM o JOIN brand_day d ON o.brand = d.brand AND o.day = d.day""")
def competitor_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other brands of a day come to for each brand: total, largest, three and five largest, count, HHI, share."""
    out = concentration_without_self(brand_days(spark, sf_dir), ["day"], "brand", "gross").drop("gross")
    return out.withColumns({c: F.round(c, d) for c, d in (("others_hhi", 6), ("own_share", 6), ("others_top3", 2), ("others_top5", 2))})


@query(f"""
WITH {_BRAND_DAY}
SELECT d.brand, d.day, CAST(d.gross AS DOUBLE) AS gross, CAST(p1.gross AS DOUBLE) AS gross_1d, CAST(p7.gross AS DOUBLE) AS gross_7d,
       round(CAST(d.gross AS DOUBLE) / NULLIF(CAST(p7.gross AS DOUBLE), 0) - 1, 6) AS change_7d
FROM brand_day d LEFT JOIN brand_day p1 ON p1.brand = d.brand AND p1.day = d.day - 1 LEFT JOIN brand_day p7 ON p7.brand = d.brand AND p7.day = d.day - 7""")
def calendar_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross a day and a week before by the calendar: gaps stay missing."""
    daily = brand_days(spark, sf_dir).select("brand", "day", F.col("gross").cast("double").alias("gross"))
    out = shifted(shifted(daily, ["brand"], "day", "gross", 1, "gross_1d"), ["brand"], "day", "gross", 7, "gross_7d")
    return out.select("brand", "day", "gross", "gross_1d", "gross_7d", F.round(safe_divide("gross", "gross_7d") - 1, 6).alias("change_7d"))


@query(f"""
WITH {_BRAND_DAY}
SELECT a.brand, a.day, {', '.join(f"CAST(coalesce(SUM(b.gross) FILTER (WHERE b.day >= a.day - {n} AND b.day < a.day), 0) AS DOUBLE) AS before{n}" for n in (1, 3, 7))}
FROM brand_day a LEFT JOIN brand_day b ON a.brand = b.brand AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2""")
def trailing_window_1_3_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's gross over the 1, 3 and 7 days before each day."""
    daily = brand_days(spark, sf_dir).withColumn("n_", F.unix_date("day"))
    out = trailing(daily, ["brand"], "n_", F.col("gross"), (1, 3, 7), "before")
    return out.select("brand", "day", *(F.col(f"before{n}").cast("double").alias(f"before{n}") for n in (1, 3, 7)))


@query(f"""
WITH {_BRAND_DAY},
w AS (SELECT brand, CAST(date_trunc('week', day) AS DATE) AS week, SUM(gross) AS gross, MAX(outlets) AS outlets, COUNT(*) AS n_days FROM brand_day GROUP BY 1, 2),
t AS (SELECT week, SUM(gross) AS total FROM w GROUP BY 1)
SELECT brand, w.week, lpad(CAST(weekofyear(w.week) AS VARCHAR), 2, '0') AS calendar_week, CAST(gross AS DOUBLE) AS gross, outlets, n_days,
       round(CAST(gross AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share,
       round(CAST(gross AS DOUBLE) / ((SELECT CAST(MAX(total) AS DOUBLE) FROM t) / 0.08), 8) AS market_share,
       CAST(date_diff('day', MIN(w.week) OVER (PARTITION BY brand), w.week) / 7 AS BIGINT) AS age
FROM w JOIN t ON w.week = t.week""")
def movie_week_market_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand weeks with their share of the week and of a market whose peak week takes 8 percent."""
    week = F.date_trunc("week", "day").cast("date")
    weekly = brand_days(spark, sf_dir).groupBy("brand", week.alias("week")).agg(F.sum("gross").alias("gross"), F.max("outlets").alias("outlets"), F.count("*").alias("n_days"))
    totals = weekly.groupBy("week").agg(F.sum("gross").alias("total"))
    peak = totals.agg(F.max("total").alias("peak"))
    out = weekly.join(totals, "week").crossJoin(F.broadcast(peak))
    age = F.datediff("week", F.min("week").over(Window.partitionBy("brand"))) / 7
    return out.select(
        "brand", "week", F.lpad(F.weekofyear("week").cast("string"), 2, "0").alias("calendar_week"), F.col("gross").cast("double").alias("gross"), "outlets", "n_days",
        F.round(safe_divide("gross", "total"), 6).alias("share"),
        F.round(F.col("gross").cast("double") / (F.col("peak").cast("double") / 0.08), 8).alias("market_share"),
        age.cast("bigint").alias("age"),
    )


@query(f"""
WITH {_BRAND_DAY},
t AS (SELECT day, CAST(SUM(gross) AS DOUBLE) AS total FROM brand_day GROUP BY 1),
s AS (SELECT brand, brand_day.day, least(greatest(CAST(gross AS DOUBLE) / total, 1e-9), 1 - 1e-9) AS share FROM brand_day JOIN t ON brand_day.day = t.day)
SELECT a.brand, a.day, round(a.share, 6) AS share, round(ln(a.share / (1 - a.share)), 6) AS logit_share, round(b.share, 6) AS share_1d
FROM s a LEFT JOIN s b ON a.brand = b.brand AND b.day = a.day - 1""")
def prior_day_share_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily share, its logit (clamped) and the share of the day before."""
    daily = brand_days(spark, sf_dir)
    share = safe_divide("gross", F.sum("gross").over(Window.partitionBy("day")))
    shares = daily.select("brand", "day", F.least(F.greatest(share, F.lit(1e-9)), F.lit(1 - 1e-9)).alias("share"))
    out = shifted(shares, ["brand"], "day", "share", 1, "share_1d")
    return out.select("brand", "day", F.round("share", 6).alias("share"), F.round(F.ln(F.col("share") / (1 - F.col("share"))), 6).alias("logit_share"), F.round("share_1d", 6).alias("share_1d"))


@query("""
WITH d AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS day, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 90 THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY part ORDER BY day)),
e AS (SELECT *, SUM(new) OVER (PARTITION BY part ORDER BY day) AS episode FROM f)
SELECT part, CAST(episode AS BIGINT) AS episode, MIN(day) AS first_day, MAX(day) AS last_day, COUNT(*) AS n_days, CAST(SUM(gross) AS DOUBLE) AS gross FROM e GROUP BY 1, 2""")
def gap_split_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a part's days without a gap of over 90 days."""
    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), day("l_shipdate").alias("day")).agg(F.sum(cents("l_extendedprice")).alias("gross"))
    return gap_episodes(daily, ["part"], "day", 90).groupBy("part", "episode").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"), money_sum("gross").alias("gross"))


@query(f"""
WITH {_BRAND_DAY},
o AS (SELECT brand, MIN(day) AS opened FROM brand_day GROUP BY 1),
w AS (SELECT b.brand, CAST(floor(date_diff('day', opened, day) / 7) AS BIGINT) AS week, SUM(gross) AS gross FROM brand_day b JOIN o ON b.brand = o.brand GROUP BY 1, 2)
SELECT brand, COUNT(*) AS n_weeks, round(-regr_slope(ln(CAST(gross AS DOUBLE)), week), 6) AS beta,
       round(CASE WHEN -regr_slope(ln(CAST(gross AS DOUBLE)), week) > 0 THEN ln(2) / -regr_slope(ln(CAST(gross AS DOUBLE)), week) END, 2) AS half_life
FROM w WHERE gross > 0 GROUP BY 1""")
def lifecycle_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-linear decay of each brand's weekly gross since its first day."""
    daily = brand_days(spark, sf_dir).withColumn("opened", F.min("day").over(Window.partitionBy("brand")))
    weekly = daily.groupBy("brand", F.floor(F.datediff("day", "opened") / 7).alias("week")).agg(F.sum("gross").alias("gross"))
    return decay_fit(weekly, ["brand"], "week", "gross").select("brand", "n_weeks", F.round("beta", 6).alias("beta"), F.round("half_life", 2).alias("half_life"))


@query(f"""
WITH {_BRAND_DAY},
t AS (SELECT day, SUM(gross) AS total FROM brand_day GROUP BY 1),
o AS (SELECT brand, MIN(day) AS opened FROM brand_day GROUP BY 1),
x AS (SELECT o.brand, o.opened, COUNT(*) AS n_days, CAST(SUM(coalesce(b.gross, 0)) AS DOUBLE) AS own, CAST(SUM(t.total) AS DOUBLE) AS total
      FROM o JOIN t ON t.day BETWEEN opened AND opened + 6 LEFT JOIN brand_day b ON b.brand = o.brand AND b.day = t.day GROUP BY 1, 2)
SELECT brand, opened, n_days, round(CASE WHEN n_days >= 3 AND own > 0 THEN own / total END, 6) AS share,
       round(CASE WHEN n_days >= 3 AND own > 0 AND own < total THEN (own / total) / (1 - own / total) END, 6) AS attraction FROM x""")
def opening_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first seven days that the charts cover, at least three, and the attraction s / (1 - s)."""
    daily = brand_days(spark, sf_dir)
    opened = daily.groupBy("brand").agg(F.min("day").alias("opened"))
    week = opened.select("brand", "opened", F.explode(F.sequence("opened", F.date_add("opened", 6))).alias("day"))
    totals = daily.groupBy("day").agg(F.sum("gross").alias("total"))
    rows = week.join(totals, "day").join(daily.select("brand", "day", "gross"), ["brand", "day"], "left")
    x = rows.groupBy("brand", "opened").agg(F.count("*").alias("n_days"), money_sum(F.coalesce("gross", F.lit(0))).alias("own"), money_sum("total").alias("total"))
    share = F.when((F.col("n_days") >= 3) & (F.col("own") > 0), safe_divide("own", "total"))
    return x.select("brand", "opened", "n_days", F.round(share, 6).alias("share"), F.round(F.when(share < 1, share / (1 - share)), 6).alias("attraction"))


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1)
SELECT day, n, total, isodow(day) AS weekday, isodow(day) >= 6 AS is_weekend, lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS calendar_week,
       (month(day) = 1 AND day(day) = 1) OR (month(day) = 7 AND day(day) = 4) OR (month(day) = 12 AND day(day) = 25) OR (month(day) = 11 AND isodow(day) = 4 AND day(day) BETWEEN 22 AND 28) AS is_holiday,
       CASE WHEN month(day) * 100 + day(day) BETWEEN 525 AND 905 THEN 'summer_' || year(day) WHEN month(day) >= 11 THEN 'holiday_' || year(day)
            WHEN month(day) * 100 + day(day) <= 105 THEN 'holiday_' || (year(day) - 1) END AS season
FROM d""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily industry totals with weekday, ISO week, holiday and season."""
    d = table(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("day")).agg(F.count("*").alias("n"), money_sum("o_totalprice").alias("total"))
    weekday = (F.weekday("day") + 1).cast("bigint")
    return d.select("day", "n", "total", weekday.alias("weekday"), (weekday >= 6).alias("is_weekend"), F.lpad(F.weekofyear("day").cast("string"), 2, "0").alias("calendar_week"), is_holiday("day").alias("is_holiday"), season("day").alias("season"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, SUM(CAST(value AS DECIMAL(18,2))) AS views FROM events GROUP BY 1, 2),
r AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS rigor,
             CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS first
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, day, SUM(rigor) AS rigor, SUM(first) AS users, COUNT(*) AS edits FROM r GROUP BY 1, 2)
SELECT d.user_id, d.day, CAST(SUM(d.views) OVER w AS DOUBLE) AS v, CAST(SUM(g.users) OVER w AS BIGINT) AS u, CAST(SUM(g.rigor) OVER w AS BIGINT) AS r, CAST(SUM(g.edits) OVER w AS BIGINT) AS e
FROM d JOIN g ON d.user_id = g.user_id AND d.day = g.day WINDOW w AS (PARTITION BY d.user_id ORDER BY d.day)""")
def cumulative_views_users_rigor_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running views, different editors, changes of editor and edits of each page, by day."""
    e = table(spark, sf_dir, "events")
    rows = change_flag(e, ["user_id"], ["ts", "event_id"], "event_type", "rigor")
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) == 1
    daily = rows.withColumn("first", first.cast("long")).groupBy("user_id", day("ts").alias("day")).agg(F.sum(cents("value")).alias("views"), F.sum("first").alias("users"), F.sum("rigor").alias("rigor"), F.count("*").alias("edits"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("user_id", "day", F.sum("views").over(w).cast("double").alias("v"), *(F.sum(c).over(w).alias(a) for c, a in (("users", "u"), ("rigor", "r"), ("edits", "e"))))


@query("""
SELECT event_id, user_id, COUNT(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_types FROM events""")
def running_distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many event types each user has shown by each event."""
    return running_distinct(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "n_types").select("event_id", "user_id", "n_types")


@query("""
WITH s AS (SELECT user_id, UNNEST(generate_series(MIN(CAST(ts AS DATE)) OVER (), MAX(CAST(ts AS DATE)) OVER (), INTERVAL 1 DAY)) AS d FROM (SELECT user_id, MIN(ts) AS ts FROM events GROUP BY 1 UNION ALL SELECT user_id, MAX(ts) FROM events GROUP BY 1)),
g AS (SELECT DISTINCT user_id, CAST(d AS DATE) AS day FROM s),
v AS (SELECT user_id, CAST(ts AS DATE) AS day, SUM(CAST(value AS DECIMAL(18,2))) AS x FROM events GROUP BY 1, 2)
SELECT g.user_id, g.day, CAST(coalesce(SUM(v.x) OVER (PARTITION BY g.user_id ORDER BY g.day), 0) AS DOUBLE) AS total FROM g LEFT JOIN v ON g.user_id = v.user_id AND g.day = v.day""")
def dense_day_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running value of every user on every day of the table, days without events included."""
    daily = table(spark, sf_dir, "events").groupBy("user_id", day("ts").alias("day")).agg(F.sum(cents("value")).alias("x"))
    grid = spine(daily.select("user_id").distinct(), date_range(daily, "day"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(daily, ["user_id", "day"], "left").select("user_id", "day", F.coalesce(F.sum("x").over(w), F.lit(0)).cast("double").alias("total"))


_SNAPSHOT = "snap AS (SELECT user_id, CAST(ts AS DATE) AS snapshot_day, MAX(value) AS level FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2)"


@query(f"""
WITH {_SNAPSHOT}
SELECT e.event_id, e.user_id, CAST(e.ts AS DATE) AS day, (SELECT max_by(level, snapshot_day) FROM snap s WHERE s.user_id = e.user_id AND s.snapshot_day <= CAST(e.ts AS DATE)) AS level,
       (SELECT MAX(snapshot_day) FROM snap s WHERE s.user_id = e.user_id AND s.snapshot_day <= CAST(e.ts AS DATE)) AS snapshot_day
FROM events e WHERE event_type = 'purchase'""")
def asof_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest daily snapshot on or before its day."""
    e = table(spark, sf_dir, "events")
    snaps = e.where("event_type <> 'purchase'").groupBy("user_id", day("ts").alias("snapshot_day")).agg(F.max("value").alias("level"))
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", day("ts").alias("day"))
    return as_of_join(buys, snaps.withColumn("at", F.col("snapshot_day")), ["user_id"], "day", "at", ["level", "snapshot_day"])


@query("""
WITH e AS (SELECT *, CASE WHEN hour(ts) * 60 + minute(ts) < 300 THEN hour(ts) * 60 + minute(ts) + 1440 ELSE hour(ts) * 60 + minute(ts) END AS m, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day FROM events),
b AS (SELECT user_id, day, CASE WHEN m < 900 THEN 1 WHEN m < 1080 THEN 2 WHEN m < 1260 THEN 3 ELSE 4 END AS block, CAST(value AS DECIMAL(18,2)) AS v, event_type FROM e)
SELECT user_id, day, """ + ", ".join(f"CAST(SUM(v) FILTER (WHERE block = {k}) AS DOUBLE) AS c{k}, CAST(SUM(v) FILTER (WHERE block = {k} AND event_type = 'purchase') AS DOUBLE) AS s{k}" for k in (1, 2, 3, 4)) + """,
       COUNT(DISTINCT block) AS n_blocks, COUNT(*) FILTER (WHERE event_type = 'error') AS n_failed
FROM b GROUP BY 1, 2""")
def block_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity and sold value of each user's business day in four blocks of the day."""
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", (F.col("ts") - F.expr("INTERVAL 5 HOURS")).cast("date").alias("day"), day_block(business_minute("ts")).alias("block"), cents("value").alias("v"), "event_type")
    sold = F.when(F.col("event_type") == "purchase", F.col("v"))
    out = block_pivot(rows, ["user_id", "day"], "block", (1, 2, 3, 4), {"c": F.col("v"), "s": sold})
    counts = rows.groupBy("user_id", "day").agg(F.count_distinct("block").alias("n_blocks"), F.count_if(F.col("event_type") == "error").alias("n_failed"))
    names = [f"{x}{k}" for k in (1, 2, 3, 4) for x in "cs"]
    return out.join(counts, ["user_id", "day"]).select("user_id", "day", *(F.col(c).cast("double").alias(c) for c in names), "n_blocks", "n_failed")


@query("""
WITH d AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS day, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross FROM lineitem GROUP BY 1, 2),
a AS (SELECT part, gross, date_diff('day', MIN(day) OVER (PARTITION BY part), day) AS age FROM d)
SELECT CASE WHEN age < 0 THEN 'before' WHEN age <= 2 THEN 'opening' WHEN age <= 6 THEN 'week_1' WHEN age <= 27 THEN 'weeks_2_4' ELSE 'later' END AS age_bucket,
       COUNT(*) AS n_rows, COUNT(DISTINCT part) AS n_parts, CAST(SUM(gross) AS DOUBLE) AS gross, round(CAST(median(CAST(gross AS DOUBLE)) AS DOUBLE), 2) AS median_gross
FROM a GROUP BY 1""")
def age_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, parts, gross and median gross by age since the part's first day."""
    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), day("l_shipdate").alias("day")).agg(F.sum(cents("l_extendedprice")).alias("gross"))
    aged = daily.withColumn("age", F.datediff("day", F.min("day").over(Window.partitionBy("part"))))
    aged = aged.select("part", "gross", age_bucket(F.col("age")).alias("age_bucket"))
    out = aged.groupBy("age_bucket").agg(F.count("*").alias("n_rows"), F.count_distinct("part").alias("n_parts"), money_sum("gross").alias("gross"))
    return out.join(quantiles(aged, "gross", [0.5], ["age_bucket"]), "age_bucket").select("age_bucket", "n_rows", "n_parts", "gross", F.round("q0", 2).alias("median_gross"))
