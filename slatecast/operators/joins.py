"""Joins in time and without self: as-of, interval, shifted dates, spines, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Every left row with the values of the latest right row of its keys at or before its time.

    Both sides go through one shuffle: their union is ordered by time with right rows first, and a window carries the
    last right row forward. A right row that holds nulls still counts as the latest.
    """
    left = left.select(*keys, F.col(left_time).alias("t_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("row_"))
    right = right.select(*keys, F.col(right_time).alias("t_"), F.lit(0).alias("side_"), F.struct(*values).alias("found_"))
    here = left.withColumn("found_", F.lit(None).cast(right.schema["found_"].dataType))
    there = right.withColumn("row_", F.lit(None).cast(left.schema["row_"].dataType))
    w = Window.partitionBy(*keys).orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    out = here.unionByName(there).withColumn("found_", F.last("found_", ignorenulls=True).over(w)).where("side_ = 1")
    return out.select("row_.*", *(F.col(f"found_.{v}").alias(v) for v in values))


def as_of_best(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """As ``as_of_join``, with ties in time broken by the largest ``order`` of the right row."""
    best = right.groupBy(*keys, right_time).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("best_"))
    return as_of_join(left, best.select(*keys, right_time, *(F.col(f"best_.{v}").alias(v) for v in values)), keys, left_time, right_time, values)


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Right rows of equal keys whose ``at`` lies from ``start`` to ``end`` of the left row, both included."""
    renamed = right.withColumnsRenamed({k: f"right_{k}_" for k in keys})
    on = [F.col(k) == F.col(f"right_{k}_") for k in keys]
    return left.join(renamed, on=[*on, F.col(at).between(F.col(start), F.col(end))]).drop(*(f"right_{k}_" for k in keys))


def shifted(df: DataFrame, keys: Sequence[str], date: str, value: str, days: int, name: str) -> DataFrame:
    """The value ``days`` days earlier by the calendar; null where that day has no row."""
    past = df.select(*keys, F.date_add(F.col(date), days).alias(date), F.col(value).alias(name))
    return df.join(past, [*keys, date], "left")


def spine(entities: DataFrame, days: DataFrame) -> DataFrame:
    """Every entity on every day. ``days`` is a date range, so its size is bounded by the calendar."""
    return entities.crossJoin(days)


def date_range(df: DataFrame, date: str) -> DataFrame:
    """All days from the first to the last of a column."""
    return df.agg(F.min(date).alias("a_"), F.max(date).alias("b_")).select(F.explode(F.sequence("a_", "b_")).alias(date))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def reconcile(a: DataFrame, b: DataFrame, key: str, checks: Sequence[tuple[str, str]], strict: Sequence[str]) -> DataFrame:
    """Issues between two tables: key, issue, left_value and right_value.

    ``checks`` pairs the columns to compare; those in ``strict`` are compared null-safe, the others only if both are set.
    """
    joined = a.join(b, key, "full")
    rows = []
    for x, y in checks:
        differs = ~F.col(x).eqNullSafe(F.col(y)) if x in strict else F.col(x) != F.col(y)
        rows.append(F.when(F.coalesce(differs, F.lit(False)), F.struct(F.lit(f"{x}_differs").alias("issue"), F.col(x).cast("double").alias("left_value"), F.col(y).cast("double").alias("right_value"))))
    return joined.select(key, F.explode(F.array_compact(F.array(*rows))).alias("i_")).select(key, "i_.*")


def unreconciled(chart: DataFrame, pages: DataFrame, keys: Sequence[str], strict: Sequence[str], loose: Sequence[str]) -> DataFrame:
    """keys, issue, chart_value and page_value of what chart rows and the rows of pages don't agree on.

    A chart row without a row of its keys is missing and gives no other issue, with the first strict value. Columns in ``strict``
    are compared null-safe, those in ``loose`` only if both sides are set. ``pages`` has a row for a key at most.
    """
    side = pages.select(*keys, F.lit(True).alias("there_"), *(F.col(c).alias(f"{c}_page_") for c in (*strict, *loose)))
    joined = chart.join(side, list(keys), "left")
    there = F.col("there_").isNotNull()

    def issue(name: str, c: str, when: Column, page: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("issue"), F.col(c).cast("string").alias("chart_value"), page.cast("string").alias("page_value")))

    found = [issue("missing_row", strict[0], ~there, F.lit(None))]
    found += [issue(f"{c}_mismatch", c, there & ~F.col(c).eqNullSafe(F.col(f"{c}_page_")), F.col(f"{c}_page_")) for c in strict]
    found += [issue(f"{c}_mismatch", c, there & (F.col(c) != F.col(f"{c}_page_")), F.col(f"{c}_page_")) for c in loose]
    return joined.select(*keys, F.inline(F.array_compact(F.array(*found))))


def resolve(items: DataFrame, methods: Sequence[tuple[str, DataFrame, Sequence[str]]], item_key: str, entity: str) -> DataFrame:
    """Entity matching by a cascade: the first method with candidates decides, and one candidate only is a match.

    ``methods`` are (name, table of candidates, columns that it shares with the items) in order of trust. Candidates are
    counted by their columns first, so that a method adds one row at most to an item, however many it has. Gives
    item_key, status, method and the entity.
    """
    out, chosen = items, F.lit(None).cast("struct<method_:string,n_:bigint,entity_:bigint>")
    for k, (name, table, keys) in enumerate(methods):
        found = table.groupBy(*(F.col(c).alias(f"{c}_{k}_") for c in keys)).agg(F.count_distinct(entity).alias(f"n{k}_"), F.min(entity).cast("bigint").alias(f"entity{k}_"))
        out = out.join(found, [F.col(c) == F.col(f"{c}_{k}_") for c in keys], "left")
        step = F.when(F.col(f"n{k}_") > 0, F.struct(F.lit(name).alias("method_"), F.col(f"n{k}_").alias("n_"), F.col(f"entity{k}_").alias("entity_")))
        chosen = F.coalesce(chosen, step)
    out = out.select(item_key, chosen.alias("b_"))
    status = F.when(F.col("b_").isNull(), "unmatched").when(F.col("b_.n_") == 1, "matched").otherwise("ambiguous")
    return out.select(item_key, status.alias("status"), F.col("b_.method_").alias("method"), F.when(F.col("b_.n_") == 1, F.col("b_.entity_")).alias(entity))
