"""Forecast evaluation on the driver tables: an order's price stands for a forecast, its line items for what came."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cents, day, money_sum, safe_divide
from ..models.linear import cluster_bootstrap, intervals, ols, two_stage
from ..models.selection import dot, ridge_grid, standardised
from ..operators.aggregates import accuracy, checks, correlation, descriptives
from ..operators.joins import as_of_best, interval_join
from ..operators.ranks import quantiles, value_quartiles
from ..operators.windows import threshold_bucket
from .panels import brand_days
from .registry import registry, table

QUERIES, SQL, query = registry()

RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)

_PAIRS = """pairs AS (
  SELECT o_orderkey, o_custkey, o_orderstatus AS metric, o_orderpriority AS context, o_totalprice AS predicted, CAST(o_orderdate AS DATE) AS day, x.actual
  FROM orders JOIN (SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS actual FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast and outcome of each order that has lines."""
    actual = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(money_sum("l_extendedprice").alias("actual"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("metric"), F.col("o_orderpriority").alias("context"), F.col("o_totalprice").alias("predicted"), day("o_orderdate").alias("day"))
    return o.join(actual, "o_orderkey")


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS start, o_totalprice AS mid FROM orders WHERE o_orderstatus = 'O'),
a AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS gross FROM orders GROUP BY 1, 2)
SELECT f.o_orderkey, COUNT(DISTINCT a.day) AS n_days, CAST(SUM(a.gross) AS DOUBLE) AS actual, round(0.9 * mid, 2) AS low, round(1.1 * mid, 2) AS high,
       CAST(SUM(a.gross) AS DOUBLE) BETWEEN 0.9 * mid AND 1.1 * mid AS hit
FROM f JOIN a ON f.o_custkey = a.o_custkey AND a.day BETWEEN f.start AND f.start + 30 GROUP BY f.o_orderkey, mid HAVING COUNT(DISTINCT a.day) >= 2""")
def complete_window_forecast_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts against the actuals of their window of 31 days; windows of fewer than two days are left out."""
    o = table(spark, sf_dir, "orders")
    f = o.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", day("o_orderdate").alias("start"), F.date_add(day("o_orderdate"), 30).alias("end"), F.col("o_totalprice").alias("mid"))
    a = o.groupBy("o_custkey", day("o_orderdate").alias("day")).agg(F.sum(cents("o_totalprice")).alias("gross"))
    found = interval_join(f, a, ["o_custkey"], "day", "start", "end").groupBy("o_orderkey", "mid").agg(F.count_distinct("day").alias("n_days"), money_sum("gross").alias("actual")).where("n_days >= 2")
    low, high = 0.9 * F.col("mid"), 1.1 * F.col("mid")
    return found.select("o_orderkey", "n_days", "actual", F.round(low, 2).alias("low"), F.round(high, 2).alias("high"), F.col("actual").between(low, high).alias("hit"))


@query("""
WITH a AS (SELECT p_brand AS brand, CAST(l_shipdate AS DATE) AS day, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
f AS (SELECT brand, start, start + CASE WHEN day(start) % 2 = 0 THEN 2 ELSE 3 END AS finish FROM (SELECT DISTINCT brand, CAST(date_trunc('week', day) + INTERVAL 4 DAY AS DATE) AS start FROM a)),
w AS (SELECT f.brand, start, date_diff('day', start, finish) + 1 AS expected, COUNT(DISTINCT day) AS n_days, CAST(SUM(gross) AS DOUBLE) AS actual FROM f JOIN a ON a.brand = f.brand AND day BETWEEN start AND finish GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT day) = date_diff('day', start, finish) + 1)
SELECT w.brand, w.start, CAST(w.n_days AS BIGINT) AS n_days, w.actual, round(p.actual / p.n_days * w.n_days, 4) AS predicted FROM w LEFT JOIN w p ON p.brand = w.brand AND p.start = w.start - 7""")
def expected_day_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekends of three or four days of which every day is there, with the complete weekend before, day for day, as their forecast."""
    a = brand_days(spark, sf_dir).select("brand", "day", "gross")
    start = F.date_add(F.date_trunc("week", "day").cast("date"), 4)
    end = F.date_add("start", F.when(F.dayofmonth("start") % 2 == 0, 2).otherwise(3))
    f = a.select("brand", start.alias("start")).distinct().withColumn("end", end)
    w = interval_join(f, a, ["brand"], "day", "start", "end").groupBy("brand", "start", "end").agg(F.count_distinct("day").alias("n_days"), F.sum("gross").cast("double").alias("actual"))
    w = w.where(F.col("n_days") == F.datediff("end", "start") + 1).drop("end")
    before = w.select("brand", F.date_add("start", 7).alias("start"), (F.col("actual") / F.col("n_days")).alias("per_day"))
    out = w.join(before, ["brand", "start"], "left")
    return out.select("brand", "start", "n_days", "actual", F.round(F.col("per_day") * F.col("n_days"), 4).alias("predicted"))


@query(f"""
WITH {_PAIRS}
SELECT metric, context, COUNT(*) AS n, round(avg(abs(predicted - actual)), 2) AS mae, round(sqrt(avg((predicted - actual) * (predicted - actual))), 2) AS rmse,
       round(avg(abs((predicted - actual) / NULLIF(actual, 0))), 5) AS mape, round(avg(predicted - actual), 2) AS bias,
       round(avg(CASE WHEN actual BETWEEN 0.5 * predicted AND 1.5 * predicted THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM pairs GROUP BY GROUPING SETS ((), (metric), (context))""")
def forecast_accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and interval coverage overall, by metric and by context."""
    rows = pairs(spark, sf_dir).withColumns({"low": 0.5 * F.col("predicted"), "high": 1.5 * F.col("predicted")})
    out = accuracy(rows, [[], ["metric"], ["context"]], "actual", "predicted", "low", "high")
    digits = {"mae": 2, "rmse": 2, "mape": 5, "bias": 2, "coverage": 6}
    return out.select("metric", "context", "n", *(F.round(c, d).alias(c) for c, d in digits.items()))


@query("""
WITH f AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS published, o_orderpriority AS rank, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
t AS (SELECT o_orderkey AS target, o_custkey, CAST(o_orderdate AS DATE) AS as_of FROM orders WHERE o_orderstatus = 'O')
SELECT target, t.o_custkey, as_of, b.o_orderkey AS forecast, b.o_totalprice AS price
FROM t LEFT JOIN LATERAL (SELECT * FROM f WHERE f.o_custkey = t.o_custkey AND published <= as_of ORDER BY published DESC, rank DESC, f.o_orderkey DESC LIMIT 1) b ON TRUE""")
def asof_tiebreak_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest forecast of a customer at each target's date; ties go by rank, then by key."""
    o = table(spark, sf_dir, "orders")
    f = o.where("o_orderstatus = 'F'").select("o_custkey", day("o_orderdate").alias("published"), F.col("o_orderpriority").alias("rank"), F.col("o_orderkey").alias("forecast"), F.col("o_totalprice").alias("price"))
    t = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("target"), "o_custkey", day("o_orderdate").alias("as_of"))
    return as_of_best(t, f, ["o_custkey"], "as_of", "published", [F.col("rank"), F.col("forecast")], ["forecast", "price"])


@query(f"""
WITH {_PAIRS}
SELECT metric, COUNT(*) AS n, round(corr(actual, predicted), 5) AS pearson, round(regr_slope(actual, predicted), 6) AS slope, round(regr_intercept(actual, predicted), 1) AS intercept,
       round(avg(ln(actual) - ln(predicted)), 6) AS mean_log_ratio, round(stddev_samp(ln(actual) - ln(predicted)), 6) AS sd_log_ratio
FROM pairs WHERE actual > 0 AND predicted > 0 GROUP BY 1""")
def calibration_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, calibration line and log ratios of forecasts by metric."""
    rows = pairs(spark, sf_dir).where("actual > 0 AND predicted > 0")
    a, p = F.col("actual"), F.col("predicted")
    ratio = F.ln(a) - F.ln(p)
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.round(correlation(a, p), 5).alias("pearson"), F.round(F.regr_slope(a, p), 6).alias("slope"), F.round(F.regr_intercept(a, p), 1).alias("intercept"), F.round(F.avg(ratio), 6).alias("mean_log_ratio"), F.round(F.stddev_samp(ratio), 6).alias("sd_log_ratio"))


@query(f"""
WITH {_PAIRS},
r AS (SELECT *, rank() OVER (ORDER BY predicted) - 1 + (COUNT(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS mid, COUNT(*) OVER () AS n FROM pairs)
SELECT o_orderkey, CAST(floor(mid * 4 / n) + 1 AS INTEGER) AS quartile FROM r""")
def quartile_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile of each forecast, equal values together."""
    return value_quartiles(pairs(spark, sf_dir), "predicted").select("o_orderkey", "quartile")


@query(f"""
WITH {_PAIRS},
q AS (SELECT quantile_cont(predicted, 0.25) AS a, quantile_cont(predicted, 0.5) AS b, quantile_cont(predicted, 0.75) AS c FROM pairs WHERE year(day) < 2000)
SELECT CASE WHEN predicted <= a THEN 1 WHEN predicted <= b THEN 2 WHEN predicted < c THEN 3 ELSE 4 END AS bucket, COUNT(*) AS n, round(avg(actual), 2) AS mean_actual
FROM pairs, q WHERE year(day) >= 2000 GROUP BY 1""")
def train_threshold_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout rows by the quartile cuts of the training years."""
    rows = pairs(spark, sf_dir)
    cuts = quantiles(rows.where(F.year("day") < 2000), "predicted", (0.25, 0.5, 0.75)).select(F.array("q0", "q1", "q2").alias("cuts"))
    held = rows.where(F.year("day") >= 2000).crossJoin(F.broadcast(cuts))
    bucket = threshold_bucket(F.col("predicted"), [F.get("cuts", F.lit(k)) for k in range(3)])
    return held.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("actual"), 2).alias("mean_actual"))


@query(f"""
WITH {_PAIRS},
r AS (SELECT metric, abs(actual - predicted) AS e FROM pairs WHERE year(day) < 2000),
g AS (SELECT quantile_cont(e, [0.5, 0.8, 0.9]) AS q FROM r)
SELECT r.metric, COUNT(*) AS n, CASE WHEN COUNT(*) >= 5 THEN 'bucket' ELSE 'global' END AS source, """ + ", ".join(f"round(CASE WHEN COUNT(*) >= 5 THEN quantile_cont(e, {x / 100}) ELSE any_value(q[{k}]) END, 2) AS q{x}" for k, x in ((1, 50), (2, 80), (3, 90))) + """
FROM r, g GROUP BY 1""")
def conformal_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half widths of 50, 80 and 90 percent intervals by metric, from training residuals."""
    train = pairs(spark, sf_dir).where(F.year("day") < 2000).withColumn("residual", F.col("actual") - F.col("predicted"))
    out = intervals(train, "residual", "metric")
    return out.select("metric", "n", "source", *(F.round(c, 2).alias(c) for c in ("q50", "q80", "q90")))


@query(f"""
WITH {_PAIRS}, x AS (SELECT predicted / 1e5 AS predicted, actual / 1e5 AS actual FROM pairs),
m AS (SELECT regr_slope(actual, predicted) AS b, regr_intercept(actual, predicted) AS a, regr_r2(actual, predicted) AS r2, COUNT(*) AS n,
             sqrt((regr_syy(actual, predicted) - regr_sxy(actual, predicted) * regr_sxy(actual, predicted) / regr_sxx(actual, predicted)) / (COUNT(*) - 2)) AS s, regr_sxx(actual, predicted) AS sxx, avg(predicted) AS mx FROM x)
SELECT 'intercept' AS term, round(a, 5) AS beta, round(s * sqrt(1.0 / n + mx * mx / sxx), 5) AS se FROM m UNION ALL SELECT 'predicted', round(b, 5), round(s / sqrt(sxx), 5) FROM m""")
def ols_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of outcome on forecast from one pass of moments."""
    rows = pairs(spark, sf_dir).select((F.col("predicted") / 1e5).alias("predicted"), (F.col("actual") / 1e5).alias("actual"))
    return ols(rows, ["predicted"], "actual").table(spark).select("term", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"))


@query("""
WITH q AS (SELECT l_orderkey, CAST(SUM(l_quantity) AS DOUBLE) AS x, CAST(COUNT(*) AS DOUBLE) AS z FROM lineitem GROUP BY 1),
r AS (SELECT x, z, o_totalprice / 1e5 AS y FROM orders JOIN q ON l_orderkey = o_orderkey),
b AS (SELECT covar_samp(z, y) / covar_samp(z, x) AS b, avg(x) AS mx, avg(y) AS my FROM r)
SELECT 'x' AS term, round(b, 5) AS beta FROM b UNION ALL SELECT 'intercept', round(my - b * mx, 5) FROM b""")
def two_stage_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage least squares of an order's price on its quantity, with its count of lines as instrument."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    lines = lines.agg(F.sum("l_quantity").cast("double").alias("x"), F.count("*").cast("double").alias("z"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("x", "z", (F.col("o_totalprice") / 1e5).alias("y"))
    return two_stage(rows, ["x"], ["z"], [], "y").table(spark).select("term", F.round("beta", 5).alias("beta"))


@query()
def bootstrap_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the slope of outcome on forecast when customers are redrawn."""
    slopes = cluster_bootstrap(pairs(spark, sf_dir), "o_custkey", "predicted", "actual")
    return slopes.agg(F.count("slope").alias("repetitions"), F.avg("slope").alias("mean"), F.stddev_samp("slope").alias("se"), F.percentile("slope", 0.025).alias("low"), F.percentile("slope", 0.975).alias("high"))


@query()
def ridge_with_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge of log outcome on standardised log forecast and weekday, alpha by leave-one-out error, with the held-out years' errors."""
    rows = pairs(spark, sf_dir).where("actual > 0 AND predicted > 0")
    terms = ["x", *(f"weekday_{k}" for k in range(6))]
    rows = rows.select("day", F.ln("actual").alias("y"), F.ln("predicted").alias("x"), *((F.weekday("day") == k).cast("double").alias(f"weekday_{k}") for k in range(6)))
    early = F.year("day") < 2000
    rows, _ = standardised(rows, ["x"], early)
    alpha, _, beta = min(ridge_grid(rows.where(early), terms, "y", RIDGE_ALPHAS), key=lambda f: (f[1] or 0.0, f[0]))
    error = dot(beta, terms) - F.col("y")
    held = rows.where(F.year("day") >= 2000).withColumn("error", error)
    return held.agg(F.lit(float(alpha)).alias("alpha"), F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("error") ** 2)), 6).alias("rmse"), F.round(F.avg(F.abs("error")), 6).alias("mae"), F.round(F.avg(F.exp(-F.col("error"))), 6).alias("smearing"))


@query(f"""
WITH {_PAIRS}, l AS (SELECT 'actual' AS variable, actual AS x FROM pairs UNION ALL SELECT 'predicted', predicted FROM pairs)
SELECT variable, COUNT(*) AS n, round(avg(x), 2) AS mean, round(stddev_samp(x), 2) AS sd, round(median(x), 2) AS median, min(x) AS min, max(x) AS max FROM l GROUP BY 1""")
def descriptive_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of descriptives for each variable."""
    out = descriptives(pairs(spark, sf_dir), ["actual", "predicted"])
    return out.select("variable", "n", *(F.round(c, 2).alias(c) for c in ("mean", "sd", "median")), "min", "max")


@query(f"""
WITH {_PAIRS}, b AS (SELECT round_even(predicted / 50000, 0) * 50000 AS bin, actual FROM pairs)
SELECT bin, COUNT(*) AS n, round(avg(actual), 2) AS mean_actual FROM b GROUP BY 1""")
def binned_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean outcome by forecast, in bins whose edges round half to even."""
    rows = pairs(spark, sf_dir)
    bin_ = F.bround(F.col("predicted") / 50000) * 50000
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("actual"), 2).alias("mean_actual"))


@query(f"""
WITH {_PAIRS}
SELECT rule, CAST(broken AS BIGINT) AS broken FROM (UNPIVOT (SELECT SUM(CASE WHEN actual <= 0 THEN 1 ELSE 0 END) AS actual_positive, SUM(CASE WHEN predicted NOT BETWEEN 1000 AND 400000 THEN 1 ELSE 0 END) AS predicted_in_range,
       SUM(CASE WHEN metric NOT IN ('O', 'F') THEN 1 ELSE 0 END) AS metric_known FROM pairs) ON actual_positive, predicted_in_range, metric_known INTO NAME rule VALUE broken)""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each named rule."""
    return checks(pairs(spark, sf_dir), {"actual_positive": F.col("actual") > 0, "predicted_in_range": F.col("predicted").between(1000, 400000), "metric_known": F.col("metric").isin("O", "F")})


@query("""
WITH p AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1, 2)
SELECT o_custkey, COUNT(*) AS n_days, CAST(SUM(v) AS DOUBLE) AS volume, round(avg(CAST(v AS DOUBLE)) / NULLIF(stddev_samp(CAST(v AS DOUBLE)), 0) * sqrt(COUNT(*)), 5) AS sharpe, MIN(day) AS first_day, MAX(day) AS last_day
FROM p GROUP BY 1 HAVING COUNT(*) >= 3""")
def account_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and mean over deviation, scaled by the root of the count, of each account with three active days."""
    p = table(spark, sf_dir, "orders").groupBy("o_custkey", day("o_orderdate").alias("day")).agg(F.sum(cents("o_totalprice")).alias("v"))
    v = F.col("v").cast("double")
    out = p.groupBy("o_custkey").agg(F.count("*").alias("n_days"), money_sum("v").alias("volume"), F.avg(v).alias("m_"), F.stddev_samp(v).alias("s_"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).where("n_days >= 3")
    return out.select("o_custkey", "n_days", "volume", F.round(safe_divide("m_", "s_") * F.sqrt("n_days"), 5).alias("sharpe"), "first_day", "last_day")


@query("""
WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice AS price FROM orders)
SELECT o_orderkey, o_custkey, price - lag(price) OVER w AS revision, price - lag(price, 7) OVER w AS revision_7 FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)""")
def forecast_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change from the row before and from seven rows before, by row and not by day."""
    w = Window.partitionBy("o_custkey").orderBy(day("o_orderdate"), "o_orderkey")
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (p - F.lag(p).over(w)).alias("revision"), (p - F.lag(p, 7).over(w)).alias("revision_7"))
