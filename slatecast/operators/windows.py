"""Windows over keys and time: episodes, running distinct counts, day grids, ranks and quantile buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_episodes(df: DataFrame, keys: Sequence[str], date: str, gap: int) -> DataFrame:
    """Adds ``episode``, which grows by one where more than ``gap`` days have passed since the row before."""
    w = Window.partitionBy(*keys).orderBy(date)
    new = F.coalesce((F.datediff(F.col(date), F.lag(date).over(w)) > gap).cast("int"), F.lit(1))
    return df.withColumn("new_", new).withColumn("episode", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def change_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """1 on the first row of a key and where ``value`` differs from the row before, else 0."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.when(before.isNull() | (before != F.col(value)), 1).otherwise(0))


def running_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """How many different values a key has had up to each row: first occurrences are flagged, then summed."""
    first = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) == 1
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("f_", first.cast("long")).withColumn(name, F.sum("f_").over(w)).drop("f_")


def trailing(df: DataFrame, keys: Sequence[str], day_number: str, value: Column, spans: Sequence[int], prefix: str) -> DataFrame:
    """Sums over the ``n`` days up to and without each row's day, for each of ``spans``."""
    w = Window.partitionBy(*keys).orderBy(day_number)
    return df.withColumns({f"{prefix}{n}": F.coalesce(F.sum(value).over(w.rangeBetween(-n, -1)), F.lit(0)) for n in spans})


def threshold_bucket(value: Column, cuts: Sequence[Column]) -> Column:
    """1 up to the first cut (included), 2 up to the second, and so on; from the last cut on, one more."""
    out = F.lit(len(cuts) + 1)
    for k in range(len(cuts) - 1, -1, -1):
        out = F.when(value < cuts[k] if k == len(cuts) - 1 else value <= cuts[k], k + 1).otherwise(out)
    return F.when(value.isNotNull(), out)
