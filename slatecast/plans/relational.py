"""Relational operators on the driver tables: upserts, reconciliation, matching, sampling, queues, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_url, cents, clean_text, day, money_sum, parse_number, reasons, slug, title_key
from ..operators.joins import latest_per_key, reconcile, resolve, unreconciled
from ..operators.sampling import stratified, with_certainty
from ..operators.tables import common_values, delete_by, insert_ignore, union_of, upsert
from ..sources.readers import page_facts
from ..streaming.events import after_failure, due_tasks, observed, schedule, sessions, tumbling
from ..sources.stored import StoredTable
from ..sources.writers import folder
from .registry import registry, table

QUERIES, SQL, query = registry()


@query("""
WITH u AS (SELECT o_custkey, max(o_orderstatus) AS segment, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS balance FROM orders GROUP BY 1)
SELECT coalesce(u.o_custkey, c_custkey) AS o_custkey, CASE WHEN u.o_custkey IS NULL THEN c_mktsegment ELSE segment END AS segment, coalesce(u.balance, c_acctbal) AS balance,
       CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE u.balance END AS first_balance
FROM customer FULL JOIN u ON u.o_custkey = c_custkey""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written over by what their orders say; a balance stays where the update has none, a first balance where there was one."""
    b = F.col("c_acctbal")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), b.alias("balance"), F.when(b >= 0, b).alias("first_balance"))
    price = F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")))
    updates = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("segment"), price.alias("balance"), price.alias("first_balance"))
    return upsert(c, updates, ["o_custkey"], keep_new=["balance"], keep_old=["first_balance"])


@query("""
WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT k, s FROM b UNION ALL SELECT DISTINCT l_orderkey, 'X' FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM b)""")
def insert_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows deleted by a join, then rows inserted whose keys are new."""
    o = table(spark, sf_dir, "orders")
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    base = delete_by(o, gone, ["o_custkey"]).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return insert_ignore(base, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("X").alias("s")), ["k"])


@query("""
WITH l AS (SELECT l_orderkey AS k, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS line_total, COUNT(*) AS n_lines FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_totalprice AS total, length(o_orderpriority) AS n FROM orders),
j AS (SELECT coalesce(o.k, l.k) AS k, total, line_total, n, n_lines FROM o FULL JOIN l ON o.k = l.k)
SELECT k AS orderkey, 'total_differs' AS issue, total AS left_value, line_total AS right_value FROM j WHERE total IS DISTINCT FROM line_total
UNION ALL SELECT k, 'n_differs', CAST(n AS DOUBLE), CAST(n_lines AS DOUBLE) FROM j WHERE n <> n_lines""")
def reconcile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues between orders and the sums of their lines: totals null-safe, counts only if both are there."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(money_sum("l_extendedprice").alias("line_total"), F.count("*").alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("total"), F.length("o_orderpriority").alias("n"))
    return reconcile(orders, lines, "orderkey", [("total", "line_total"), ("n", "n_lines")], strict=["total"])


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order."""
    return latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
SELECT o_custkey, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (WHERE o_orderstatus = 'O') AS running, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS succeeded,
       max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders GROUP BY 1""")
def latest_per_key_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest running, succeeded and failed order of each customer in one grouping."""
    o, order = table(spark, sf_dir, "orders"), F.struct("o_orderdate", "o_orderkey")
    pick = lambda s: F.max_by(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")), F.when(F.col("o_orderstatus") == s, order))
    return o.groupBy("o_custkey").agg(pick("O").alias("running"), pick("F").alias("succeeded"), pick("P").alias("failed"))


@query("""
SELECT * FROM (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS balance FROM supplier) ORDER BY balance ASC NULLS LAST, s_name DESC, s_suppkey LIMIT 20""")
def top_k_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty smallest balances, with two tie keys and nulls last."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("balance"))
    return s.orderBy(F.asc_nulls_last("balance"), F.desc("s_name"), "s_suppkey").limit(20)


@query("""
SELECT DISTINCT day FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem)""")
def conditional_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that any of the branches that exist has."""
    parts = [table(spark, sf_dir, "orders").select(day("o_orderdate").alias("day")), None, table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("day"))]
    return union_of(parts, distinct=True)


@query("""
WITH d AS (SELECT DISTINCT p_brand AS brand, year(l_shipdate) * 12 + month(l_shipdate) AS month FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT CAST(month AS BIGINT) AS month FROM d GROUP BY 1 HAVING COUNT(DISTINCT brand) = (SELECT COUNT(DISTINCT brand) FROM d)""")
def common_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months in which every brand has lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias("month"))
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select("p_brand", "month").distinct()
    return common_values(rows, "p_brand", "month")


@query("""
SELECT l_partkey FROM lineitem GROUP BY 1 HAVING COUNT(*) >= 1 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1999)""")
def left_anti_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that weren't shipped in 1999."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_partkey").distinct().join(lines.where(F.year("l_shipdate") == 1999).select("l_partkey"), "l_partkey", "left_anti")


_KEY = "NULLIF(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\(\\d{{4}}\\)', ' ', 'g'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"


@query(f"""
SELECT p_partkey, {_KEY.format('p_name')} AS title_key, replace({_KEY.format('p_name')}, ' ', '-') AS slug, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS clean FROM part""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of part names."""
    return table(spark, sf_dir, "part").select("p_partkey", title_key("p_name").alias("title_key"), slug("p_name").alias("slug"), clean_text("p_name").alias("clean"))


@query("""
WITH i AS (SELECT s_suppkey, s_nationkey FROM supplier), c AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer),
a AS (SELECT s_suppkey, c_custkey, 0 AS rank, 'same_key' AS method FROM i JOIN c ON s_suppkey = c_custkey AND s_nationkey = c_nationkey
      UNION SELECT s_suppkey, c_custkey, 1, 'nation_segment' FROM i JOIN c ON s_nationkey = c_nationkey AND c_mktsegment = 'BUILDING'),
b AS (SELECT * FROM a QUALIFY rank = min(rank) OVER (PARTITION BY s_suppkey)),
g AS (SELECT s_suppkey, any_value(method) AS method, COUNT(*) AS n, MIN(c_custkey) AS c FROM b GROUP BY 1)
SELECT i.s_suppkey, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, method, CASE WHEN n = 1 THEN c END AS c_custkey FROM i LEFT JOIN g ON i.s_suppkey = g.s_suppkey""")
def entity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers matched to customers: by key and nation, else by nation within a segment."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    c = c.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"), "c_custkey", "c_mktsegment")
    methods = [("same_key", c, ["s_suppkey", "s_nationkey"]), ("nation_segment", c.where("c_mktsegment = 'BUILDING'"), ["s_nationkey"])]
    return resolve(s, methods, "s_suppkey", "c_custkey")


@query("""
WITH n AS (SELECT c_mktsegment AS g, COUNT(*) AS n FROM customer GROUP BY 1), t AS (SELECT SUM(n) AS t FROM n),
e AS (SELECT g, n, n * least(200.0, t) / t AS e, floor(n * least(200.0, t) / t) AS f FROM n, t),
q AS (SELECT g, n, f + CASE WHEN row_number() OVER (ORDER BY round(e - f, 9) DESC, g) <= least(200, SUM(n) OVER ()) - SUM(f) OVER () THEN 1 ELSE 0 END AS q FROM e),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s1:' || c_custkey)) AS p FROM customer)
SELECT c_custkey, c_mktsegment, round(q / n, 9) AS probability, round(n / q, 6) AS weight FROM r JOIN q ON c_mktsegment = g WHERE p <= q""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred customers by segment, in proportion, with inverse-probability weights."""
    out = stratified(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 200, "s1")
    return out.select("c_custkey", "c_mktsegment", F.round("probability", 9).alias("probability"), F.round("weight", 6).alias("weight"))


@query()
def certainty_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty largest balances for certain, the rest of 175 customers by nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return with_certainty(c, "c_custkey", "c_nationkey", "c_acctbal", 175, 30, "s2")


@query("""
SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS queued, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS failed, COUNT(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS done_customers,
       CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'degraded' WHEN COUNT(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'running' ELSE 'idle' END AS status FROM orders GROUP BY 1""")
def conditional_counts_queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a queue by day and the status that follows."""
    s = F.col("o_orderstatus")
    out = table(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("day")).agg(F.count_if(s == "O").alias("queued"), F.count_if(s == "P").alias("failed"), F.count_distinct(F.when(s == "F", F.col("o_custkey"))).alias("done_customers"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "degraded").when(F.col("queued") > 0, "running").otherwise("idle"))


@query("""
WITH m AS (SELECT CAST(ts AS DATE) AS day, date_trunc('minute', ts) AS minute, COUNT(*) AS n FROM events GROUP BY 1, 2)
SELECT day, n AS peak, minute FROM m QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, minute) = 1""")
def minute_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest minute of each day, the earliest of equals."""
    m = table(spark, sf_dir, "events").groupBy(day("ts").alias("day"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))
    best = m.groupBy("day").agg(F.max_by(F.struct("n", "minute"), F.struct(F.col("n"), -F.unix_seconds(F.col("minute").cast("timestamp")))).alias("b"))
    return best.select("day", F.col("b.n").alias("peak"), F.col("b.minute").alias("minute"))


@query("""
SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by user in windows of six hours; the same function runs on a stream."""
    out = tumbling(table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours", "1 day", "value")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH f AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f)
SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after eight quiet hours; the same function runs on a stream."""
    out = sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "8 hours", "1 day")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("""
WITH t AS (SELECT user_id, event_id AS show, o.o AS offset_minutes, ts - to_minutes(o.o) AS due FROM events, (SELECT UNNEST([30, 10]) AS o) o WHERE event_type = 'signup'),
e AS (SELECT user_id, event_id, ts AS seen_at FROM events WHERE event_type = 'view')
SELECT t.show, t.offset_minutes, e.event_id, CAST(epoch(date_trunc('second', seen_at)) - epoch(date_trunc('second', due)) AS BIGINT) AS lateness_seconds, epoch(date_trunc('second', seen_at)) - epoch(date_trunc('second', due)) > 60 AS is_late
FROM t JOIN e ON t.user_id = e.user_id AND seen_at BETWEEN due AND due + INTERVAL 600 MINUTE""")
def grace_window_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled snapshots of each sign-up and the views that fall into their grace window."""
    e = table(spark, sf_dir, "events")
    shows = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("show"), "ts")
    tasks = schedule(shows, "show", "ts", [30, 10]).join(shows.select("show", "user_id"), "show").select("user_id", "show", "offset_minutes", "due")
    seen = e.where("event_type = 'view'").select("user_id", "event_id", F.col("ts").alias("seen_at"))
    return observed(tasks, seen, "user_id", "due", "seen_at", 600).select("show", "offset_minutes", "event_id", "lateness_seconds", "is_late")


@query("""
WITH q AS (SELECT o_orderkey AS task_id, 'queued' AS status, o_orderdate AS scheduled_for, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority FROM orders WHERE o_orderstatus = 'O')
SELECT * FROM q WHERE scheduled_for <= TIMESTAMP '1996-01-01' ORDER BY scheduled_for, priority DESC, task_id LIMIT 50""")
def due_task_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty tasks to take next."""
    q = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("task_id"), F.lit("queued").alias("status"), F.col("o_orderdate").alias("scheduled_for"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"))
    return due_tasks(q, "1996-01-01", 50)


@query("""
SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN CAST(left(o_orderpriority, 1) AS INTEGER) + 1 >= 3 THEN 'failed' ELSE 'queued' END ELSE 'running' END AS status,
       CAST(left(o_orderpriority, 1) AS INTEGER) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS attempts,
       CASE WHEN o_orderstatus = 'P' AND CAST(left(o_orderpriority, 1) AS INTEGER) + 1 < 3 THEN o_orderdate + INTERVAL 60 SECOND ELSE o_orderdate END AS scheduled_for FROM orders""")
def retry_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue after some of its tasks failed: backed off, or failed for good at the third attempt."""
    o = table(spark, sf_dir, "orders")
    q = o.select(F.col("o_orderkey").alias("task_id"), F.lit("running").alias("status"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("attempts"), F.col("o_orderdate").alias("scheduled_for"))
    failed = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("task_id"))
    return after_failure(q, failed, 3)


@query(r"""
SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?s)<h1[^>]*>([^<]*)</h1>', 1) AS heading,
       CAST(len(regexp_extract_all(html, '<a\s[^>]*href=')) AS BIGINT) AS n_links FROM pages""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language, heading and link count of each page."""
    return page_facts(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""
WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS bare FROM pages),
q AS (SELECT page_id, regexp_replace(regexp_replace(bare, '\\?.*$', ''), '/+$', '') AS path, list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: NOT starts_with(p, 'utm_') AND p <> '') AS kept FROM u)
SELECT page_id, path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM q""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without fragments, campaign parameters and slashes at the end."""
    return table(spark, sf_dir, "pages").select("page_id", canonical_url("url").alias("url"))


@query("""
SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END, CASE WHEN n_name IS NULL THEN 'no_nation' END], lambda x: x IS NOT NULL) AS reasons
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def qualification_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that each customer fails, by name."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", reasons((F.col("c_acctbal") < 0, "negative"), (F.col("c_mktsegment") == "BUILDING", "segment"), (F.col("n_name").isNull(), "no_nation")).alias("reasons"))


@query("""
SELECT s_suppkey, round(s_acctbal, 2) AS parsed FROM supplier""")
def parsed_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances written with $, commas and brackets, read back."""
    said = F.concat(F.when(F.col("s_acctbal") < 0, "($").otherwise("$"), F.format_number(F.abs("s_acctbal"), 2), F.when(F.col("s_acctbal") < 0, ")").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(parse_number(said), 2).alias("parsed"))


@query("""
SELECT c_nationkey, n_name, percentile AS p, CAST(v AS DOUBLE) AS balance FROM (
  SELECT c_nationkey, UNNEST([0.25, 0.5, 0.9]) AS percentile, UNNEST(quantile_disc(CAST(c_acctbal AS DECIMAL(18,2)), [0.25, 0.5, 0.9])) AS v FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of balances by nation."""
    c = table(spark, sf_dir, "customer").withColumn("b", cents("c_acctbal"))
    cuts = [0.25, 0.5, 0.9]
    agg = c.groupBy("c_nationkey").agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY b)").cast("double").alias(f"q{k}") for k, p in enumerate(cuts)))
    long = agg.select("c_nationkey", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"q{k}").alias("balance")) for k, p in enumerate(cuts)))).alias("x")).select("c_nationkey", "x.*")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return long.join(nation, "c_nationkey").select("c_nationkey", "n_name", "p", "balance")


@query("""
WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('s3:' || s_suppkey)) AS round FROM supplier)
SELECT s_suppkey, s_nationkey, round FROM r""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round in which each supplier is drawn when nations take turns."""
    from ..functions.scalars import hash_rank

    w = Window.partitionBy("s_nationkey").orderBy(hash_rank("s3", "s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.row_number().over(w).alias("round"))


@query("""
WITH base AS (SELECT o_orderkey AS k, o_custkey % 16 AS bucket, o_orderstatus AS status, o_totalprice AS price, CAST(NULL AS VARCHAR) AS note FROM orders WHERE o_orderkey % 3 < 2),
one AS (SELECT k, bucket, 'X' AS status, price + 1 AS price, 'first' AS note FROM (SELECT o_orderkey AS k, o_custkey % 16 AS bucket, o_totalprice AS price FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey % 16 < 6)),
a AS (SELECT coalesce(o.k, b.k) AS k, coalesce(o.bucket, b.bucket) AS bucket, coalesce(o.status, b.status) AS status, coalesce(o.price, b.price) AS price, coalesce(b.note, o.note) AS note FROM base b FULL JOIN one o ON b.k = o.k AND b.bucket = o.bucket),
two AS (SELECT o_orderkey AS k, o_custkey % 16 AS bucket, CASE WHEN o_orderkey % 2 = 0 THEN 'Y' END AS status, o_totalprice * 2 AS price, 'second' AS note FROM orders WHERE o_orderkey % 7 = 0 AND o_custkey % 16 BETWEEN 4 AND 9),
b AS (SELECT coalesce(t.k, a.k) AS k, coalesce(t.bucket, a.bucket) AS bucket, coalesce(t.status, a.status) AS status, coalesce(t.price, a.price) AS price, coalesce(a.note, t.note) AS note FROM a FULL JOIN two t ON a.k = t.k AND a.bucket = t.bucket)
SELECT k, CAST(bucket AS INTEGER) AS bucket, status, price, note FROM b WHERE NOT (k % 11 = 0 AND bucket = 3) AND bucket <> 15""")
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of orders after two batches, a repeat of the first, and a delete that empties a partition."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 16).cast("int").alias("bucket"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    stored = StoredTable(spark, folder(spark, "orders"), "k bigint, bucket int, status string, price double, note string", ["k"], "bucket")
    stored.merge("base", o.where("k % 3 < 2").withColumn("note", F.lit(None).cast("string")))
    one = o.where("k % 5 = 0 AND bucket < 6").select("k", "bucket", F.lit("X").alias("status"), (F.col("price") + 1).alias("price"), F.lit("first").alias("note"))
    two = o.where("k % 7 = 0 AND bucket BETWEEN 4 AND 9").select("k", "bucket", F.when(F.col("k") % 2 == 0, "Y").alias("status"), (F.col("price") * 2).alias("price"), F.lit("second").alias("note"))
    for name, rows in (("one", one), ("two", two), ("one", one)):
        stored.merge(name, rows, keep_old=["note"], keep_new=["status"])
    stored.delete("gone", o.where("(k % 11 = 0 AND bucket = 3) OR bucket = 15"))
    return stored.read()


@query("""
WITH d AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS gross, COUNT(*) AS theaters, CAST(CASE WHEN l_partkey % 4 > 0 THEN MAX(l_orderkey) END AS BIGINT) AS cumulative FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_partkey, day, CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN gross + 1 ELSE gross END AS gross, CASE WHEN l_partkey % 5 > 0 THEN theaters + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END END AS theaters, cumulative + CASE WHEN l_partkey % 17 = 0 THEN 2 ELSE 0 END AS cumulative FROM d),
p AS (SELECT * FROM d WHERE l_partkey % 19 > 0)
SELECT l_partkey, day, 'missing_row' AS issue, CAST(gross AS VARCHAR) AS chart_value, CAST(NULL AS VARCHAR) AS page_value FROM c WHERE l_partkey % 19 = 0
UNION ALL SELECT c.l_partkey, c.day, 'gross_mismatch', CAST(c.gross AS VARCHAR), CAST(p.gross AS VARCHAR) FROM c JOIN p ON c.l_partkey = p.l_partkey AND c.day = p.day WHERE c.gross IS DISTINCT FROM p.gross
UNION ALL SELECT c.l_partkey, c.day, 'theaters_mismatch', CAST(c.theaters AS VARCHAR), CAST(p.theaters AS VARCHAR) FROM c JOIN p ON c.l_partkey = p.l_partkey AND c.day = p.day WHERE c.theaters <> p.theaters
UNION ALL SELECT c.l_partkey, c.day, 'cumulative_mismatch', CAST(c.cumulative AS VARCHAR), CAST(p.cumulative AS VARCHAR) FROM c JOIN p ON c.l_partkey = p.l_partkey AND c.day = p.day WHERE c.cumulative <> p.cumulative""")
def chart_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts against pages, part by part and day: missing rows, gross null-safe, theaters and running totals where both are there."""
    k = F.col("l_partkey")
    d = table(spark, sf_dir, "lineitem").groupBy("l_partkey", day("l_shipdate").alias("day")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("gross"), F.count("*").alias("theaters"), F.max("l_orderkey").alias("last"))
    d = d.select("l_partkey", "day", "gross", "theaters", F.when(k % 4 > 0, F.col("last")).alias("cumulative"))
    off = lambda n, by: F.when(k % n == 0, by).otherwise(0)
    chart = d.select("l_partkey", "day", F.when(k % 13 != 0, F.col("gross") + off(7, 1)).alias("gross"), F.when(k % 5 > 0, F.col("theaters") + off(11, 1)).alias("theaters"), (F.col("cumulative") + off(17, 2)).alias("cumulative"))
    return unreconciled(chart, d.where(k % 19 > 0), ["l_partkey", "day"], ["gross"], ["theaters", "cumulative"])
