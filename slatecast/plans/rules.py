"""Predicates, sorts, text keys, queues and account rules on the driver tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import age_bucket, canonical_url, cents, day, decayed_loss, has_any, hash_rank, money_sum, safe_divide, title_variants
from ..functions.text import age_text, in_morning, looks_like_bot, money_text, rank_and_title, size_bucket, slug_candidates, time_zone, to_utc, user_key, wallet
from ..operators.aggregates import checks
from ..operators.sampling import first_by_hash
from ..operators.tables import insert_ignore, union_of
from ..sources.writers import folder
from ..streaming.events import autoscaled, claimed, snapshots, stale_reset
from ..streaming.queue import Rules, replay, state_now
from .panels import _BRAND_DAY, brand_days
from .registry import registry, table

QUERIES, SQL, query = registry()


def clean_lines(lines: DataFrame, no_previews: bool = True, positive: bool = True, no_estimates: bool = False) -> DataFrame:
    """Lines that count as actuals: returned ones are previews, those of status F estimates."""
    asked = [(no_previews, F.col("l_returnflag") != "R"), (positive, F.col("l_extendedprice") > 0), (no_estimates, F.col("l_linestatus") != "F")]
    return where_all(lines.where("l_extendedprice IS NOT NULL"), [c for on, c in asked if on])


def where_all(df: DataFrame, predicates: list[Column]) -> DataFrame:
    """Rows that meet every predicate of a list made at run time; an empty list keeps all."""
    return df.where(reduce(and_, predicates)) if predicates else df


@query("""
SELECT 'strict' AS variant, COUNT(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross FROM lineitem WHERE l_extendedprice > 0 AND l_returnflag <> 'R' AND l_linestatus <> 'F'
UNION ALL SELECT 'positive', COUNT(*), CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem WHERE l_extendedprice > 0 AND l_returnflag <> 'R' UNION ALL SELECT 'all', COUNT(*), CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem WHERE l_extendedprice IS NOT NULL""")
def clean_actuals_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actuals that each caller's flags leave."""
    lines = table(spark, sf_dir, "lineitem")
    made = {"strict": clean_lines(lines, no_estimates=True), "positive": clean_lines(lines), "all": clean_lines(lines, False, False)}
    return union_of([df.agg(F.count("*").alias("n"), money_sum("l_extendedprice").alias("gross")).select(F.lit(k).alias("variant"), "n", "gross") for k, df in made.items()])


@query("""
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BOLT%' AND p_type = ANY(['SMALL', 'LARGE', 'PROMO']) AND p_size BETWEEN 5 AND 40 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) AND p_brand NOT ILIKE '%#1'""")
def run_time_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by predicates put together at run time: patterns whatever their case, lists, ranges and another table's keys."""
    asked = {"name": "%BOLT%", "types": ["SMALL", "LARGE", "PROMO"], "sizes": (5, 40), "not_brand": "%#1"}
    made = {"name": lambda v: F.col("p_name").ilike(v), "types": lambda v: F.col("p_type").isin(v), "sizes": lambda v: F.col("p_size").between(*v), "not_brand": lambda v: ~F.col("p_brand").ilike(v)}
    parts = where_all(table(spark, sf_dir, "part"), [made[k](v) for k, v in asked.items()])
    bought = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return parts.join(bought, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("""
SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda t: regexp_matches(t, '^(red|blue)$'))) > 0 OR regexp_matches(lower(p_name || ' ' || p_type), 'promo') AS in_focus, len(list_filter(string_split(p_name, ' '), lambda t: regexp_matches(lower(t), 'bolt|gear'))) > 0 AS premium FROM part""")
def focus_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in focus, by their tags or by all their text, and those with a premium tag."""
    tags = F.split("p_name", " ")
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", (has_any(tags, "^(red|blue)$") | text.contains("promo")).alias("in_focus"), has_any(tags, "bolt|gear").alias("premium"))


@query("""
SELECT page_id, CASE WHEN url LIKE '%page=%' THEN 'listing' WHEN regexp_matches(url, '/\\d+(\\.html)?/?([?#].*)?$') THEN 'article' ELSE 'other' END AS kind, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) = 'en' AS domestic FROM pages""")
def article_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each page by its address, and whether it is domestic."""
    u = F.col("url")
    kind = F.when(u.contains("page="), "listing").when(u.rlike(r"/\d+(\.html)?/?([?#].*)?$"), "article").otherwise("other")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), (F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1) == "en").alias("domestic"))


POPULATIONS = {"covered": "orders_ > 0", "covered_final": "final_ > 0", "full_with_fallback": "true"}
SAMPLE_MODES = {"all": (0, None), "wide_first_4_weeks": (2, 28), "wide_first_10_weeks": (2, 70)}


@query(f"""
WITH {_BRAND_DAY}, b AS (SELECT *, date_diff('day', MIN(day) OVER (PARTITION BY brand), day) AS age, MAX(outlets) OVER (PARTITION BY brand) AS widest FROM brand_day),
c AS (SELECT c_custkey, COUNT(o_orderkey) AS n, COUNT(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT 'sample' AS kind, 'all' AS name, COUNT(*) AS n FROM b UNION ALL SELECT 'sample', 'wide_first_4_weeks', COUNT(*) FROM b WHERE widest >= 2 AND age < 28 UNION ALL SELECT 'sample', 'wide_first_10_weeks', COUNT(*) FROM b WHERE widest >= 2 AND age < 70
UNION ALL SELECT 'population', 'covered', COUNT(*) FROM c WHERE n > 0 UNION ALL SELECT 'population', 'covered_final', COUNT(*) FROM c WHERE f > 0 UNION ALL SELECT 'population', 'full_with_fallback', COUNT(*) FROM c""")
def sample_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each sample mode and each population leaves."""
    per = Window.partitionBy("brand")
    b = brand_days(spark, sf_dir).withColumns({"age": F.datediff("day", F.min("day").over(per)), "widest": F.max("outlets").over(per)})
    kept = lambda least, most: (F.col("widest") >= least) & (F.lit(True) if most is None else F.col("age") < most)
    modes = b.agg(*(F.count_if(kept(*v)).alias(k) for k, v in SAMPLE_MODES.items())).unpivot([], list(SAMPLE_MODES), "name", "n")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders_"), F.count_if(F.col("o_orderstatus") == "F").alias("final_"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    pops = c.agg(*(F.count_if(F.expr(v)).alias(k) for k, v in POPULATIONS.items())).unpivot([], list(POPULATIONS), "name", "n")
    return modes.select(F.lit("sample").alias("kind"), "name", "n").union(pops.select(F.lit("population").alias("kind"), "name", "n"))


@query("""SELECT * FROM (SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25) ORDER BY ts, event_id""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 25 events, oldest first."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).orderBy("ts", "event_id")


@query("""
SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), '9') , o_orderdate DESC, o_orderkey LIMIT 30""")
def order_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 orders by rank of status, then priority (unspecified last), then newest."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    priority = F.coalesce(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), F.lit("9"))
    return table(spark, sf_dir, "orders").orderBy(rank, priority, F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("""
SELECT l_suppkey, COUNT(*) AS n, COUNT(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem ORDER BY 1 DESC LIMIT 7) GROUP BY 1""")
def last_seven_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier shipped on the last seven days with any shipment."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", day("l_shipdate").alias("day"))
    last = lines.select("day").distinct().orderBy(F.desc("day")).limit(7)
    return lines.join(last, "day", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


@query("""
WITH k AS (SELECT p_size, CASE WHEN p_size % 10 = 0 THEN 'week ' || p_size ELSE CAST(p_size AS VARCHAR) END AS label, COUNT(*) AS n FROM part GROUP BY 1, 2)
SELECT label, n, CAST(row_number() OVER (ORDER BY coalesce(TRY_CAST(label AS INTEGER), 9999), label) AS INTEGER) AS place FROM k""")
def natural_week_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the order of the number that they are, those that are none last. There are as many labels as weeks."""
    label = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("week "), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    k = table(spark, sf_dir, "part").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return k.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce(F.col("label").try_cast("int"), F.lit(9999)), "label")))


@query("""
WITH q AS (SELECT o_orderkey AS task_id, 'queued' AS status, 0 AS attempts, o_orderdate AS scheduled_for, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority FROM orders WHERE o_orderstatus = 'O'),
t AS (SELECT task_id FROM q WHERE scheduled_for <= TIMESTAMP '1996-06-01' ORDER BY scheduled_for, priority DESC, task_id LIMIT 40)
SELECT q.task_id, CASE WHEN t.task_id IS NULL THEN 'queued' ELSE 'running' END AS status, CASE WHEN t.task_id IS NULL THEN 0 ELSE 1 END AS attempts, scheduled_for, priority, CASE WHEN t.task_id IS NOT NULL THEN TIMESTAMP '1996-06-01' END AS started_at FROM q LEFT JOIN t ON q.task_id = t.task_id""")
def claim_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after the next 40 due tasks were claimed: running, with one attempt more."""
    q = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("task_id"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.col("o_orderdate").alias("scheduled_for"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), F.lit(None).cast("timestamp_ntz").alias("started_at"))
    return claimed(q, "1996-06-01", 40)


@query("""
SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 5 MINUTE THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS status,
       CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 5 MINUTE THEN NULL ELSE o_orderdate END AS started_at FROM orders""")
def stale_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after tasks that have run for over five minutes went back into it."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("started_at"))
    return stale_reset(q, "1998-01-01", 5)


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) FILTER (WHERE event_type <> 'error') AS due, COUNT(*) FILTER (WHERE event_type = 'error') AS late FROM events GROUP BY 1), m AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1, date_trunc('hour', ts)), p AS (SELECT day, max(n) AS peak FROM m GROUP BY 1)
SELECT d.day, due, late, peak, late * 1.0 / (due + late) > 0.25 AS pressure, CAST(CASE WHEN late * 1.0 / (due + late) > 0.25 THEN least(2, greatest(1, ceil(due / 80.0), ceil(late / 40.0), ceil(peak / 220.0))) ELSE greatest(1, ceil(due / 80.0), ceil(late / 40.0), ceil(peak / 220.0)) END AS BIGINT) AS workers FROM d JOIN p ON d.day = p.day""")
def autoscale_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers wanted each day by what is due, what is late and the peak hour; under pressure two at most."""
    e = table(spark, sf_dir, "events").select(day("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"), (F.col("event_type") == "error").alias("bad"))
    hours = e.groupBy("day", "hour").agg(F.count_if(~F.col("bad")).alias("due"), F.count_if("bad").alias("late"), F.count("*").alias("n"))
    d = hours.groupBy("day").agg(F.sum("due").alias("due"), F.sum("late").alias("late"), F.max("n").alias("peak"))
    d = d.withColumn("pressure", F.col("late") / (F.col("due") + F.col("late")) > 0.25)
    return d.withColumn("workers", autoscaled(F.col("due"), F.col("late"), F.col("peak"), F.col("pressure"), 1, 2))


@query("""
WITH p AS (SELECT s_suppkey, -66.0 - (s_suppkey * 7) % 105 AS lon, (['CA', 'NY', ' tx ', 'HI', 'AK', 'AZ', 'ID', 'OR', 'FL', 'IN', 'KS', 'KY', 'MI', 'ND', 'NE', 'SD', 'TN', 'MT', 'XX', NULL, ''])[1 + s_suppkey % 21] AS state FROM supplier), q AS (SELECT s_suppkey, lon, upper(trim(state)) AS st FROM p)
SELECT s_suppkey, CASE WHEN st = 'AK' THEN CASE WHEN lon < -169 THEN 'America/Adak' ELSE 'America/Anchorage' END WHEN st = 'HI' THEN 'Pacific/Honolulu' WHEN st = 'AZ' THEN 'America/Phoenix' WHEN st IN ('ID', 'OR') AND lon > -116.5 THEN 'America/Denver' WHEN st IN ('CA', 'OR') THEN 'America/Los_Angeles' WHEN st = 'NY' THEN 'America/New_York' WHEN st = 'MT' THEN 'America/Denver'
       WHEN st IN ('FL', 'KY') AND lon < -85.2 + CASE st WHEN 'FL' THEN 0.1 ELSE 0 END THEN 'America/Chicago' WHEN st = 'IN' THEN CASE WHEN lon < -86.8 THEN 'America/Chicago' ELSE 'America/Indiana/Indianapolis' END WHEN st = 'MI' THEN CASE WHEN lon < -87 THEN 'America/Chicago' ELSE 'America/Detroit' END
       WHEN st IN ('KS', 'ND', 'NE') THEN CASE WHEN lon < -101 THEN 'America/Denver' ELSE 'America/Chicago' END WHEN st = 'SD' THEN CASE WHEN lon < -100.3 THEN 'America/Denver' ELSE 'America/Chicago' END WHEN st = 'TX' THEN CASE WHEN lon < -104.6 THEN 'America/Denver' ELSE 'America/Chicago' END WHEN st = 'TN' THEN CASE WHEN lon > -84.9 THEN 'America/New_York' ELSE 'America/Chicago' END
       WHEN lon <= -125 THEN 'America/Anchorage' WHEN lon <= -115 THEN 'America/Los_Angeles' WHEN lon <= -100 THEN 'America/Denver' WHEN lon <= -85 THEN 'America/Chicago' ELSE 'America/New_York' END AS zone FROM q""")
def time_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time zone of each supplier by a made state and longitude, split states and unknown ones among them."""
    states = ("CA", "NY", " tx ", "HI", "AK", "AZ", "ID", "OR", "FL", "IN", "KS", "KY", "MI", "ND", "NE", "SD", "TN", "MT", "XX", None, "")
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", time_zone(F.get(F.array(*map(F.lit, states)), (k % 21).cast("int")), -66.0 - (k * 7) % 105).alias("zone"))


@query("""
WITH z AS (SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN -8 WHEN 1 THEN -6 ELSE -5 END AS o FROM events) SELECT event_id, ts - to_hours(o) AS utc, hour(ts + to_hours(o)) BETWEEN 6 AND 11 AS in_morning FROM z""")
def local_mornings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times read as local ones, in UTC, and whether it is morning there when they are read as UTC. January has no summer time."""
    zone = F.get(F.array(*map(F.lit, ("America/Los_Angeles", "America/Chicago", "America/New_York"))), (F.col("user_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", to_utc(F.col("ts"), zone).alias("utc"), in_morning(F.col("ts"), zone).alias("in_morning"))


@query("""
SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS slot, CAST(COUNT(*) AS BIGINT) AS seen, min_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1, 2""")
def hourly_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot for each user and hour, the first, however often it was taken."""
    e = table(spark, sf_dir, "events").withColumn("slot", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    first = e.groupBy("user_id", "slot").agg(F.count("*").alias("seen"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return first.join(snapshots(e, "ts", ["user_id", "slot"], "1 day").select("user_id", "slot"), ["user_id", "slot"], "left_semi")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'id:' || c_custkey WHEN c_custkey % 10 = 0 THEN 'anonymous' ELSE 'name:' || lower(c_name) END AS user_key, lower(c_mktsegment) LIKE '%bot' AS is_bot,
       CASE WHEN c_custkey % 2 = 0 THEN '0x' || lpad(CAST(c_custkey AS VARCHAR), 40, '0') END AS wallet, CASE WHEN coalesce(nullif(c_nationkey, 0), nullif(c_custkey % 20, 0)) IS NULL THEN 'unknown' WHEN coalesce(nullif(c_nationkey, 0), nullif(c_custkey % 20, 0)) < 8 THEN 'small' WHEN coalesce(nullif(c_nationkey, 0), nullif(c_custkey % 20, 0)) < 14 THEN 'medium' ELSE 'large' END AS size FROM customer""")
def account_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable keys, bots, wallets and sizes; a 0 counts as missing."""
    k = F.col("c_custkey")
    address = F.concat(F.lit("0X"), F.lpad(k.cast("string"), 40, "0"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", user_key(F.when(k % 10 == 0, " ").otherwise(F.col("c_name")), F.when(k % 5 != 0, k)).alias("user_key"), looks_like_bot(F.col("c_mktsegment")).alias("is_bot"),
        wallet(F.when(k % 2 == 0, address).otherwise(F.substring(address, 1, 20))).alias("wallet"), size_bucket(F.col("c_nationkey").cast("bigint"), k % 20).alias("size"),
    )


@query("""
WITH t AS (SELECT p_partkey, (p_partkey % 30) || '. ' || p_name AS said, CASE WHEN p_partkey % 3 = 0 THEN p_name || ', The' ELSE p_name END AS title, p_size FROM part)
SELECT p_partkey, CAST(p_partkey % 30 AS INTEGER) AS rank, regexp_replace(said, '^\\d{1,2}\\. ', '') AS title, CASE WHEN p_partkey % 3 = 0 THEN [lower(replace(title, ',', '')), 'the ' || lower(p_name_)] ELSE [lower(title)] END AS variants, [replace(lower(p_name_), ' ', '-'), replace(lower(p_name_), ' ', '-') || '-' || (1990 + p_size)] AS slugs
FROM (SELECT t.*, replace(title, ', The', '') AS p_name_ FROM t)""")
def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks split off titles, the forms that a title may take, and the slugs to try."""
    k, name = F.col("p_partkey"), F.col("p_name")
    said = rank_and_title(F.concat((k % 30).cast("string"), F.lit(". "), name))
    return table(spark, sf_dir, "part").select("p_partkey", said["rank"].alias("rank"), said["title"].alias("title"), title_variants(F.when(k % 3 == 0, F.concat(name, F.lit(", The"))).otherwise(name)).alias("variants"), slug_candidates("p_name", 1990 + F.col("p_size")).alias("slugs"))


@query("""
SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, len(string_split(event_type || '|' || user_id, '|')) AS parts, sha256(props) AS digest, '{"user":' || user_id || ',"kind":"' || event_type || '"}' AS said FROM events""")
def json_and_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value out of JSON, a split list, a digest, and JSON made from columns."""
    made = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")))
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("user_id", "event_id", k.alias("k"), F.size(F.split(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), r"\|")).cast("bigint").alias("parts"), F.sha2("props", 256).alias("digest"), made.alias("said"))


@query("""
SELECT s_suppkey, CASE WHEN abs(s_acctbal * 1000) >= 1e6 THEN '$' || format('{:,.1f}', s_acctbal / 1000) || 'M' ELSE '$' || format('{:,.0f}', s_acctbal * 1000) END AS money, CASE WHEN s_suppkey * 997 < 60 THEN 'just now' WHEN s_suppkey * 997 < 3600 THEN (s_suppkey * 997 // 60) || 'm ago' WHEN s_suppkey * 997 < 86400 THEN (s_suppkey * 997 // 3600) || 'h ago' ELSE (s_suppkey * 997 // 86400) || 'd ago' END AS age FROM supplier""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money and ages as they are shown."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", money_text(F.col("s_acctbal") * 1000).alias("money"), age_text(F.col("s_suppkey") * 997).alias("age"))


@query("""
WITH g AS (SELECT UNNEST([0.1, 0.2, 0.4]) AS decay, UNNEST([-0.0965, -0.2, -0.05]) AS tau, UNNEST([-0.4024, -0.1, -0.4]) AS rho), w AS (SELECT UNNEST(range(1, 13)) AS w)
SELECT CAST(decay AS DOUBLE) AS decay, round((sum(exp(-decay * w)) - sum(exp(-decay * w + tau * exp(rho * (w - 1))))) / sum(exp(-decay * w)), 8) AS loss FROM g, w GROUP BY decay, tau, rho""")
def revenue_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of twelve weeks' revenue lost, for three sets of parameters."""
    g = spark.createDataFrame([(0.1, -0.0965, -0.4024), (0.2, -0.2, -0.1), (0.4, -0.05, -0.4)], "decay double, tau double, rho double")
    return g.select("decay", F.round(decayed_loss(F.col("tau"), F.col("rho"), F.col("decay")), 8).alias("loss"))


@query("""
WITH l AS (SELECT o_custkey, p_brand, CAST(l_extendedprice AS DECIMAL(18,2)) AS v, l_extendedprice * (1 - l_discount) - 0.9 * l_extendedprice AS profit, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
b AS (SELECT o_custkey, p_brand, SUM(v) AS v FROM l GROUP BY 1, 2), t AS (SELECT o_custkey, string_agg(p_brand, '; ' ORDER BY v DESC, p_brand) AS top3 FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, p_brand) <= 3) GROUP BY 1)
SELECT l.o_custkey, COUNT(*) AS n, CAST(SUM(v) AS DOUBLE) AS volume, CAST(coalesce(SUM(v) FILTER (WHERE p_brand = 'Brand#1'), 0) AS DOUBLE) AS focus_volume, round(CAST(coalesce(SUM(v) FILTER (WHERE p_brand = 'Brand#1'), 0) AS DOUBLE) / CAST(SUM(v) AS DOUBLE), 6) AS focus_share, round(SUM(profit), 2) + 0.0 AS profit,
       round(avg(profit / CAST(v AS DOUBLE)), 6) + 0.0 AS roi_mean, round(avg(profit / CAST(v AS DOUBLE)) / nullif(round(stddev_samp(profit / CAST(v AS DOUBLE)), 12), 0) * sqrt(COUNT(*)), 4) + 0.0 AS sharpe, MIN(day) AS first_day, MAX(day) AS last_day, any_value(top3) AS top3 FROM l JOIN t ON l.o_custkey = t.o_custkey GROUP BY 1""")
def account_scores_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, focus, profit, return, Sharpe ratio and the three largest brands of each account."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    price = F.col("l_extendedprice")
    l = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").join(p, "l_partkey").select("o_custkey", "p_brand", cents(price).alias("v"), (price * (1 - F.col("l_discount")) - 0.9 * price).alias("profit"), day("l_shipdate").alias("day"))  # noqa: E741
    brands = l.groupBy("o_custkey", "p_brand").agg(F.sum("v").alias("v"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("v"), "p_brand"))
    top = brands.withColumn("r", place).where("r <= 3").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "p_brand"))), lambda x: x["p_brand"]), "; ").alias("top3"))
    roi, focus = F.col("profit") / F.col("v").cast("double"), F.when(F.col("p_brand") == "Brand#1", F.col("v")).otherwise(0)
    out = l.groupBy("o_custkey").agg(
        F.count("*").alias("n"), money_sum("v").alias("volume"), money_sum(focus).alias("focus_volume"), (F.round(F.sum("profit"), 2) + 0.0).alias("profit"), F.avg(roi).alias("m_"), F.round(F.stddev_samp(roi), 12).alias("s_"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    ).join(top, "o_custkey")
    return out.select("o_custkey", "n", "volume", "focus_volume", F.round(safe_divide("focus_volume", "volume"), 6).alias("focus_share"), "profit", (F.round("m_", 6) + 0.0).alias("roi_mean"), (F.round(safe_divide("m_", "s_") * F.sqrt("n"), 4) + 0.0).alias("sharpe"), "first_day", "last_day", "top3")


@query("""
SELECT 'customer' AS name, COUNT(*) AS n, CAST(NULL AS TIMESTAMP) AS newest FROM customer UNION ALL SELECT 'orders', COUNT(*), MAX(o_orderdate) FROM orders UNION ALL SELECT 'lineitem', COUNT(*), MAX(l_shipdate) FROM lineitem UNION ALL SELECT 'events', COUNT(*), MAX(ts) FROM events UNION ALL SELECT 'part', COUNT(*), NULL FROM part""")
def table_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and newest time of each table."""
    newest = {"customer": None, "orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts", "part": None}
    return union_of([table(spark, sf_dir, t).agg(F.count("*").alias("n"), F.max(F.col(c) if c else F.lit(None)).cast("timestamp_ntz").alias("newest")).select(F.lit(t).alias("name"), "n", "newest") for t, c in newest.items()])


@query("""
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE event_type = 'error') AS errors, COUNT(DISTINCT user_id) FILTER (WHERE event_type = 'error') AS users, round(COUNT(*) FILTER (WHERE event_type = 'error') / COUNT(*), 6) AS pressure, MAX(ts) FILTER (WHERE event_type = 'error') AS last_error FROM events""")
def event_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the log and the share that they make."""
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"), F.count_distinct(F.when(bad, F.col("user_id"))).alias("users"), F.round(F.count_if(bad) / F.count("*"), 6).alias("pressure"), F.max(F.when(bad, F.col("ts"))).alias("last_error"))


@query(f"""
WITH {_BRAND_DAY}, s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), i AS (SELECT p_brand AS brand, CAST(l_shipdate AS DATE) AS day, COUNT(DISTINCT l_suppkey) AS sampled, COUNT(*) AS sampled_lines FROM lineitem JOIN part ON l_partkey = p_partkey JOIN s ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT b.brand, b.day, b.outlets, CAST(coalesce(sampled, 0) AS BIGINT) AS sampled, CAST(coalesce(sampled_lines, 0) AS BIGINT) AS sampled_lines, coalesce(sampled, 0) = b.outlets AS complete FROM brand_day b LEFT JOIN i ON b.brand = i.brand AND b.day = i.day""")
def inventory_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets of each brand and day, all of them and those of the sample (0 where it has none)."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    i = table(spark, sf_dir, "lineitem").join(s, "l_suppkey", "left_semi").join(p, "l_partkey").groupBy("brand", day("l_shipdate").alias("day")).agg(F.count_distinct("l_suppkey").alias("sampled"), F.count("*").alias("sampled_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return brand_days(spark, sf_dir).join(i, ["brand", "day"], "left").select("brand", "day", "outlets", zero("sampled"), zero("sampled_lines"), (F.coalesce("sampled", F.lit(0)) == F.col("outlets")).alias("complete"))


_CHECKS = {
    "price_positive": "l_extendedprice > 0", "quantity_whole": "l_quantity = floor(l_quantity)", "discount_in_range": "l_discount BETWEEN 0 AND 0.1", "tax_in_range": "l_tax BETWEEN 0 AND 0.08", "line_from_1": "l_linenumber >= 1",
    "flag_known": "l_returnflag IN ('R', 'A', 'N')", "status_known": "l_linestatus IN ('O', 'F')", "shipped": "l_shipdate IS NOT NULL", "unit_price_low": "l_extendedprice / l_quantity < 1050", "not_huge": "l_quantity <= 50",
}


@query("WITH l AS (SELECT " + ", ".join(f"CAST(coalesce(SUM(CASE WHEN NOT ({v}) THEN 1 ELSE 0 END), 0) AS BIGINT) AS {k}" for k, v in _CHECKS.items()) + " FROM lineitem) SELECT rule, broken, broken = 0 AS passed FROM (UNPIVOT l ON " + ", ".join(_CHECKS) + " INTO NAME rule VALUE broken)")
def validation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten named checks of the lines, in one pass."""
    return checks(table(spark, sf_dir, "lineitem"), {k: F.expr(v) for k, v in _CHECKS.items()}).withColumn("passed", F.col("broken") == 0)


@query("""
WITH d AS (SELECT c_nationkey AS k, COUNT(*) AS n, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) SELECT s_suppkey, s_nationkey, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(v, 0) AS DOUBLE) AS volume FROM supplier LEFT JOIN d ON k = s_nationkey""")
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dimension says of each supplier's nation, 0 where it says nothing."""
    d = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"), F.sum(cents("c_acctbal")).alias("v"))
    return table(spark, sf_dir, "supplier").join(d, "s_nationkey", "left").select("s_suppkey", "s_nationkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).cast("double").alias("volume"))


@query("""
WITH p AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, MAX(o_totalprice) AS said FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, s.o_custkey, s.day, said, round(o_totalprice / said, 6) AS response FROM s JOIN p ON s.o_custkey = p.o_custkey AND s.day = p.day + 1 UNION ALL SELECT o_orderkey, s.o_custkey, s.day, NULL, NULL FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE s.o_custkey = p.o_custkey AND s.day = p.day + 1)""")
def prediction_to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the prediction of the day before, looked up by title and date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("day"), "o_totalprice", "o_orderstatus")
    p = o.where("o_orderstatus = 'F'").groupBy("o_custkey", F.date_add("day", 1).alias("day")).agg(F.max("o_totalprice").alias("said"))
    return o.where("o_orderstatus <> 'F'").join(p, ["o_custkey", "day"], "left").select("o_orderkey", "o_custkey", "day", "said", F.round(F.col("o_totalprice") / F.col("said"), 6).alias("response"))


@query("""
WITH h AS (SELECT c_custkey, c_nationkey, sha256('s5:' || c_custkey) AS h FROM customer), s AS (SELECT c_custkey, c_nationkey FROM h QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY h) <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('s5:' || c_custkey)) AS turn, sha256('s5:' || c_nationkey) AS state_hash FROM s) SELECT c_custkey, c_nationkey, turn, CAST(row_number() OVER (ORDER BY turn, state_hash) AS INTEGER) AS place FROM r""")
def state_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three customers of each nation, in turns: all first ones before all second ones, nations by hash. The sample is small, so one task orders it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    quotas = c.groupBy("c_nationkey").agg(F.count("*").alias("n_")).withColumn("quota_", F.lit(3).cast("bigint"))
    s = first_by_hash(c, "c_custkey", "c_nationkey", quotas, "s5").withColumnRenamed("place_", "turn")
    return s.select("c_custkey", "c_nationkey", "turn", F.row_number().over(Window.orderBy("turn", hash_rank("s5", "c_nationkey"))).alias("place"))


@query("""
WITH old AS (SELECT c_custkey, 'v1' AS version FROM customer WHERE c_acctbal > 9000), wanted AS (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) SELECT c_custkey, version FROM old UNION ALL SELECT c_custkey, 'v2' FROM wanted WHERE c_custkey NOT IN (SELECT c_custkey FROM old)""")
def sample_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that was drawn before stays as it is; only units that it lacks are added, under a new version."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_acctbal > 9000").select("c_custkey", F.lit("v1").alias("version"))
    return insert_ignore(old, c.where("c_acctbal > 8000").select("c_custkey", F.lit("v2").alias("version")), ["c_custkey"])


@query("""
WITH f AS (SELECT 'feed' AS source, page_id, url FROM pages WHERE url LIKE 'https%'), a AS (SELECT 'archive' AS source, page_id, url FROM pages), e AS (SELECT min(page_id) AS oldest FROM f),
u AS (SELECT source, page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '/+$', '') AS key FROM f UNION ALL SELECT a.source, a.page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '/+$', '') FROM a, e WHERE oldest > 1)
SELECT key, min_by(page_id, struct_pack(a := CASE source WHEN 'feed' THEN 0 ELSE 1 END, b := page_id)) AS page_id, min_by(source, struct_pack(a := CASE source WHEN 'feed' THEN 0 ELSE 1 END, b := page_id)) AS source FROM u GROUP BY 1""")
def source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the feed if it reaches back far enough, else of feed and archive; one of each address, the feed's first."""
    pages = table(spark, sf_dir, "pages")
    feed, archive = (pages.where(c).select(F.lit(s).alias("source"), "page_id", "url") for s, c in (("feed", "url LIKE 'https%'"), ("archive", "true")))
    oldest = feed.agg(F.min("page_id").alias("oldest"))
    rows = feed.union(archive.crossJoin(F.broadcast(oldest)).where("oldest > 1").select("source", "page_id", "url"))
    rows = rows.withColumn("key", F.regexp_replace(canonical_url("url"), r"\?.*$", "")).withColumn("o_", F.struct((F.col("source") != "feed").cast("int"), F.col("page_id")))
    return rows.groupBy(F.regexp_replace("key", "/+$", "").alias("key")).agg(F.min_by("page_id", "o_").alias("page_id"), F.min_by("source", "o_").alias("source"))


@query("""
WITH l AS (SELECT date_diff('day', MIN(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_partkey), CAST(l_shipdate AS DATE)) AS age FROM lineitem)
SELECT CASE WHEN age <= 2 THEN 'opening' WHEN age <= 6 THEN 'week_1' WHEN age <= 27 THEN 'weeks_2_4' ELSE 'later' END AS regression_bucket, CASE WHEN age < 7 THEN 'first_week' WHEN age < 28 THEN 'first_month' ELSE 'long_tail' END AS segment, CASE WHEN age = 0 THEN 'day_0' WHEN age <= 6 THEN 'days_1_6' WHEN age <= 13 THEN 'days_7_13' ELSE 'days_14_on' END AS next_day_bucket, COUNT(*) AS n FROM l GROUP BY 1, 2, 3""")
def age_bucket_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by age under the three definitions that the models use."""
    d = day("l_shipdate")
    l = table(spark, sf_dir, "lineitem").select("l_partkey", d.alias("day"))  # noqa: E741
    l = l.join(l.groupBy("l_partkey").agg(F.min("day").alias("first")), "l_partkey").select(F.datediff("day", "first").alias("age"))  # noqa: E741
    a = F.col("age")
    return l.groupBy(age_bucket(a).alias("regression_bucket"), F.when(a < 7, "first_week").when(a < 28, "first_month").otherwise("long_tail").alias("segment"), F.when(a == 0, "day_0").when(a <= 6, "days_1_6").when(a <= 13, "days_7_13").otherwise("days_14_on").alias("next_day_bucket")).agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT '0x' || lpad(CAST(o_custkey % 500 AS VARCHAR), 40, '0') AS wallet, COUNT(*) AS trades, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS volume FROM orders WHERE o_custkey % 500 > 0 GROUP BY 1) SELECT wallet, trades, CAST(volume AS DOUBLE) AS volume FROM w ORDER BY w.volume DESC, trades DESC, wallet LIMIT 40""")
def wallet_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 wallets with the largest volume; addresses that aren't well-formed don't count."""
    address = F.when(F.col("o_custkey") % 500 > 0, F.concat(F.lit("0X"), F.lpad((F.col("o_custkey") % 500).cast("string"), 40, "0"))).otherwise("0x0")
    w = table(spark, sf_dir, "orders").select(wallet(address).alias("wallet"), cents("o_totalprice").alias("v")).where("wallet IS NOT NULL")
    w = w.groupBy("wallet").agg(F.count("*").alias("trades"), F.sum("v").alias("v")).orderBy(F.desc("v"), F.desc("trades"), "wallet").limit(40)
    return w.select("wallet", "trades", F.col("v").cast("double").alias("volume"))


#: Published estimates, held as a table.
REPORTED = (("decay", -0.220, 0.0014), ("sigma", 0.524, 0.030), ("decay_plain", -0.163, None), ("sigma_plain", 0.577, None), ("loss_12_weeks", 0.191, None))


@query("""SELECT * FROM (VALUES ('decay', -0.220, 0.0014), ('sigma', 0.524, 0.030), ('decay_plain', -0.163, NULL), ('sigma_plain', 0.577, NULL), ('loss_12_weeks', 0.191, NULL)) t(name, value, error)""")
def reported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published estimates that fits are compared with."""
    return spark.createDataFrame(list(REPORTED), "name string, value double, error double")


@query("""
WITH RECURSIVE e AS (
  SELECT user_id AS task_id, event_id, ts AS tm, CASE WHEN row_number() OVER w = 1 THEN 'add' WHEN event_type IN ('click', 'view') THEN 'claim' WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'done' END AS kind, row_number() OVER w AS k
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
c AS (SELECT * REPLACE (row_number() OVER (PARTITION BY task_id ORDER BY k) AS k) FROM e WHERE kind IS NOT NULL UNION ALL SELECT task_id, NULL, (SELECT max(tm) FROM e) + INTERVAL 30 DAY, 'end', COUNT(*) + 1 FROM e WHERE kind IS NOT NULL GROUP BY 1),
s AS (
  SELECT task_id, k, 1 AS number, 'queued' AS status, 0 AS attempts, tm AS available, CAST(NULL AS TIMESTAMP) AS started, CAST(NULL AS BIGINT) AS result FROM c WHERE k = 1
  UNION ALL
  SELECT task_id, k, number + CAST(lost + claimed + failed + done AS INTEGER), CASE WHEN claimed = 1 THEN 'running' WHEN done = 1 THEN 'succeeded' WHEN failed = 1 THEN CASE WHEN attempts < 4 THEN 'retry' ELSE 'failed' END ELSE status END, attempts + claimed,
         CASE WHEN failed = 1 THEN CASE WHEN attempts < 4 THEN tm + INTERVAL 90 MINUTE END ELSE available END, CASE WHEN claimed = 1 THEN tm WHEN failed = 0 AND done = 0 THEN started END, CASE WHEN done = 1 THEN event_id ELSE result END
  FROM (
    SELECT *, CAST(kind = 'claim' AND status IN ('queued', 'retry') AND available <= tm AS INTEGER) AS claimed, CAST(kind = 'fail' AND status = 'running' AS INTEGER) AS failed, CAST(kind = 'done' AND status = 'running' AS INTEGER) AS done
    FROM (
      SELECT n.task_id, n.k, n.event_id, n.tm, n.kind, number, attempts, result, CASE WHEN old THEN 1 ELSE 0 END AS lost, CASE WHEN old THEN CASE WHEN attempts < 4 THEN 'retry' ELSE 'failed' END ELSE status END AS status,
             CASE WHEN old THEN CASE WHEN attempts < 4 THEN started + INTERVAL 24 HOUR END ELSE available END AS available, CASE WHEN NOT old THEN started END AS started
      FROM (SELECT *, status = 'running' AND started + INTERVAL 24 HOUR < (SELECT n.tm FROM c n WHERE n.task_id = s.task_id AND n.k = s.k + 1) AS old FROM s) s JOIN c n ON n.task_id = s.task_id AND n.k = s.k + 1
    )
  )
)
SELECT task_id, number, status, attempts, available, started, result FROM s QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY k DESC) = 1""")
def queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a task whose events are claims, failures and results, replayed as a stream in three runs with late rows; its state at the end.

    A day without an event takes a running task from its worker. The last run adds a row after all others, so that the watermark passes them.
    """
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").cast("bigint").alias("task_id"), F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    first = e.groupBy("task_id").agg(F.min(F.struct("at", "event_id")).alias("first"))
    kind = F.when(F.struct("at", "event_id") == F.col("first"), "add").when(F.col("event_type").isin("click", "view"), "claim").when(F.col("event_type") == "error", "fail").when((F.col("event_type") == "purchase") & (F.col("event_id") % 4 == 0), "done")
    e = e.join(first, "task_id").select("task_id", "event_id", "at", kind.alias("kind")).where("kind IS NOT NULL")
    low, high = e.agg(F.min("at"), F.max("at")).first()
    if low is None:
        low = high = datetime(2026, 1, 1)
    seen = F.col("at") + F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 6 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    cuts = [low + (high - low) * k / 3 for k in range(4)]
    parts = [e.where((seen >= F.lit(a)) & (seen < F.lit(b))) for a, b in zip(cuts, [*cuts[1:3], high + timedelta(days=1)], strict=False)]
    end = spark.createDataFrame([(-1, -1, high + timedelta(days=31), "add")], "task_id bigint, event_id bigint, at timestamp, kind string")
    changes = replay(spark, [*parts[:2], parts[2].unionByName(end)], folder(spark, "queue"), "12 hours", Rules(4, 90 * 60 * 1_000_000, 24 * 3600 * 1_000_000))
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("available", "started")]
    return state_now(changes).where("task_id >= 0").select("task_id", "number", "status", "attempts", *ntz, "result")
