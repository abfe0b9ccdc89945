"""Exact places, ranks and quantiles over tables of any size: rows laid out by ranges, ranges added up, places read off.

No task holds all rows of a group: a table is sorted by ranges once and written, so that its rows are numbered within
their range; the ranges' counts are summed from below, and a place is the sum before the range and the number in it. Ranks of
values work the same way on counts by value. Ranges come from Spark's own sample of the rows and their number from
the shuffle partitions; they only balance the work, so results are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import written


def _laid(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows sorted by ranges of keys and order, with ``p_``, the number of the range, and ``at_``, rising within it."""
    by = [*keys, *order]
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at_", F.monotonically_increasing_id())
    return written(laid.withColumn("p_", F.shiftright("at_", 33)), "ranges")


def _before(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, p_, before_ (rows of the keys in lower ranges) and n_ (rows of the keys) from the counts ``t_`` of ranges."""
    over = Window.partitionBy(*keys)  # ranges of a key, as many as there are partitions at most
    upto = F.coalesce(F.sum("t_").over(over.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.withColumns({"before_": upto, "n_": F.sum("t_").over(over)}).drop("t_")


def _met(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = ranges.withColumnsRenamed({k: f"{k}_s_" for k in (*keys, "p_")})
    on = [rows[k].eqNullSafe(side[f"{k}_s_"]) for k in (*keys, "p_")]
    return rows.join(side, on).drop(*(f"{k}_s_" for k in (*keys, "p_")))


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "place", size: str | None = None) -> DataFrame:
    """Adds ``name``, each row's place from 0 among the rows of its keys, by ``order``, and ``size``, how many these are.

    Rows that are equal in ``order`` get different places, in no certain order. Null keys make a group.
    """
    laid = _laid(df, keys, order)
    ranges = laid.groupBy(*keys, "p_").agg(F.count("*").alias("t_"), F.min("at_").alias("first_"))
    out = _met(laid, _before(ranges, keys), keys)
    place = (F.col("before_") + F.col("at_") - F.col("first_")).alias(name)
    return out.select(*df.columns, place, *([F.col("n_").alias(size)] if size else []))


def counted(df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys, value, c_ (rows with it), below_ (rows of the keys with less) and n_ (rows of the keys); nulls are passed over. ``weight`` says how many rows a row stands for."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("c_"))
    laid = _laid(counts, keys, [value])
    ranges = laid.groupBy(*keys, "p_").agg(F.sum("c_").alias("t_"))
    inside = Window.partitionBy(*keys, "p_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    out = _met(laid.withColumn("inside_", F.coalesce(F.sum("c_").over(inside), F.lit(0))), _before(ranges, keys), keys)
    return out.select(*keys, value, "c_", (F.col("before_") + F.col("inside_")).alias("below_"), "n_")


def quantiles(df: DataFrame, value: str, levels: Sequence[float], keys: Sequence[str] = (), prefix: str = "q") -> DataFrame:
    """keys and the exact quantile of each level, interpolated between the two values around it (type 7), as q0, q1, ..."""
    ranked = counted(df, value, keys)

    def at(place):
        held = (F.col("below_") <= place) & (place < F.col("below_") + F.col("c_"))
        return F.max(F.when(held, F.col(value).cast("double")))

    out = []
    for k, level in enumerate(levels):
        place = (F.col("n_") - 1) * F.lit(float(level))
        low, high = F.floor(place), F.ceil(place)
        out += [at(low).alias(f"low{k}_"), at(high).alias(f"high{k}_"), F.max(place - low).alias(f"part{k}_")]
    got = ranked.groupBy(*keys).agg(*out)
    return got.select(*keys, *((F.col(f"low{k}_") + (F.col(f"high{k}_") - F.col(f"low{k}_")) * F.col(f"part{k}_")).alias(f"{prefix}{k}") for k in range(len(levels))))


def midranks(df: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``, the mean of the ranks (from 0) of the rows with a value, and ``n_``, how many rows its keys have."""
    ranked = counted(df, value, keys).select(*(F.col(k).alias(f"{k}_r_") for k in keys), F.col(value).alias("v_r_"), (F.col("below_") + (F.col("c_") - 1) / 2).alias(name), "n_")
    on = [df[k].eqNullSafe(ranked[f"{k}_r_"]) for k in keys] + [df[value] == ranked["v_r_"]]
    return df.join(ranked, on, "left").drop("v_r_", *(f"{k}_r_" for k in keys))


def value_quartiles(df: DataFrame, value: str, name: str = "quartile", keys: Sequence[str] = ()) -> DataFrame:
    """Adds floor(midrank * 4 / n) + 1, so that equal values stay together."""
    out = midranks(df, value, "mid_", keys)
    return out.withColumn(name, (F.floor(F.col("mid_") * 4 / F.col("n_")) + 1).cast("int")).drop("mid_", "n_")


def slices(df: DataFrame, value: str, tie: str, n: int, name: str) -> DataFrame:
    """Adds ``name``: rows in order of value and tie, cut into ``n`` slices from floor(k * rows / n) on, numbered from 1; rows without value are left out."""
    out = places(df.where(F.col(value).isNotNull()), [], [value, tie], "place_", "n_")
    # the last slice k (from 0) with floor(k * rows / n) <= place
    return out.withColumn(name, (F.floor(((F.col("place_") + 1) * n - 1) / F.col("n_")) + 1).cast("int")).drop("place_", "n_")
