"""Aggregations: concentration without self, accuracy, pivots, descriptives, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_divide
from .ranks import quantiles


def group_concentration(df: DataFrame, group: Sequence[str], entity: str, amount: str, top: int = 6) -> DataFrame:
    """For each group: s_ (sum), q_ (sum of squares), n_ (count) and top_ (its ``top`` largest, largest first).

    Amounts that aren't positive are dropped. Ranks above ``top`` are cut before rows are shuffled, so a
    group of any size adds up to ``top`` rows a task.
    """
    rows = df.where(F.col(amount) > 0).select(*group, entity, amount)
    order = Window.partitionBy(*group).orderBy(F.desc(amount), F.desc(entity))
    best = rows.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= top)
    best = best.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(amount), F.col(entity))), asc=False).alias("top_"))
    total = rows.groupBy(*group).agg(F.sum(amount).alias("s_"), F.sum(F.col(amount).cast("double") ** 2).alias("q_"), F.count("*").alias("n_"))
    return total.join(best, list(group))


def without_self(entity: str, amount: str, own: Column) -> dict[str, Column]:
    """What the others of a group come to, from the columns of ``group_concentration``.

    ``own`` is the entity's amount there, null or not positive where it isn't in the group.
    """
    mine = F.when(own > 0, own)
    exact = F.coalesce(F.col("s_") - F.coalesce(mine, F.lit(0)), F.lit(0))
    total, part = exact.cast("double"), F.coalesce(mine.cast("double"), F.lit(0.0))
    others = F.transform(F.slice(F.filter("top_", lambda x: x[entity] != F.col(entity)), 1, 5), lambda x: x[amount].cast("double"))
    top = lambda n: F.coalesce(F.aggregate(F.slice(others, 1, n), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return {
        "others_total": total,
        "others_top1": top(1),
        "others_top3": top(3),
        "others_top5": top(5),
        "others_count": F.coalesce(F.col("n_"), F.lit(0)) - mine.isNotNull().cast("long"),
        "others_hhi": F.when(exact > 0, F.greatest((F.col("q_") - part * part) / (total * total), F.lit(0.0))).otherwise(0.0),
        "own_share": safe_divide(part, total + part),
    }


def concentration_without_self(df: DataFrame, group: Sequence[str], entity: str, amount: str) -> DataFrame:
    """For each entity of a group, what the others come to: total, top1, top3, top5, count, hhi and its own share.

    A group is summed once: each member then takes itself away, so no pair of entities is ever made.
    """
    joined = df.where(F.col(amount) > 0).join(group_concentration(df, group, entity, amount), list(group))
    return joined.select(*group, entity, amount, *(v.alias(c) for c, v in without_self(entity, amount, F.col(amount)).items()))


def accuracy(df: DataFrame, sets: Sequence[Sequence[str]], actual: str, predicted: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """n, mae, rmse, mape, bias and interval coverage, overall and for each set of columns.

    mape passes over actuals of zero.
    """
    e = F.col(predicted) - F.col(actual)
    measures = [
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(safe_divide(e, F.col(actual)))).alias("mape"),
        F.avg(e).alias("bias"),
    ]
    if low and high:
        measures.append(F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("int")).alias("coverage"))
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*measures)


def block_pivot(df: DataFrame, keys: Sequence[str], block: str, blocks: Sequence[int], values: dict[str, Column]) -> DataFrame:
    """One column for each value and block: ``s1`` is the aggregate ``s`` over block 1; missing blocks are null."""
    out = [agg for name, value in values.items() for b in blocks for agg in [F.sum(F.when(F.col(block) == b, value)).alias(f"{name}{b}")]]
    return df.groupBy(*keys).agg(*out)


def descriptives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column: n, mean, sample sd (0 if n is below 2), median, min and max."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("v.*").where("x IS NOT NULL")
    out = long.groupBy("variable").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))
    return out.join(quantiles(long, "x", [0.5], ["variable"]).withColumnRenamed("q0", "median"), "variable")


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """For each named rule, how many rows break it; a rule that is null for a row counts as kept."""
    sums = df.agg(*(F.coalesce(F.sum((~F.coalesce(rule, F.lit(True))).cast("long")), F.lit(0)).alias(name) for name, rule in rules.items()))
    return sums.unpivot([], list(rules), "rule", "broken")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r, null where either side doesn't vary."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), safe_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))
