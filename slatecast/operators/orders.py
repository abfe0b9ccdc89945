"""How far two orders of the same rows agree, counted without pairs.

Of the n (n - 1) / 2 pairs of a group, those tied in a column follow from counts by value. Pairs that one column puts the other way round are
counted over blocks of ranks: rows are cut into blocks by either column, of like size and with equal values together. Pairs that differ
in both blocks come from the table of block counts and its sums from below; pairs within a block of the first column, and pairs
within a block of the second that lie in different blocks of the first, are counted in a task each. A value with more rows than a
block is a block of its own, in which nothing is left to count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import written
from .ranks import counted


def _crossed(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> int:
    """The weight of pairs with a smaller x and a larger y, by the bits of y's ranks."""
    y = np.unique(y, return_inverse=True)[1].ravel()
    total = 0
    for bit in range(int(y.max(initial=0)).bit_length()):
        node, one = y >> (bit + 1), (y >> bit) & 1
        order = np.lexsort((x, node))
        n, v, w, o = node[order], x[order], weight[order], one[order]
        before = np.concatenate(([0], np.cumsum(w * o)))[:-1]
        start = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (v[1:] != v[:-1])))
        first = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        of_value = before[start[np.searchsorted(start, np.arange(len(n)), side="right") - 1]]
        of_node = before[first[np.searchsorted(first, np.arange(len(n)), side="right") - 1]]
        total += int((w * (1 - o) * (of_value - of_node)).sum())
    return total


def _together(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys; without keys, rows of two tables that have one row or a bounded number of blocks."""
    return a.join(b, keys) if keys else a.crossJoin(b)


def _cells_crossed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, crossed: the pairs of cells (bx_, by_, c_) of which one is further left and higher."""
    grid = _together(cells.select(*keys, "bx_").distinct(), cells.select(*keys, "by_").distinct(), keys)
    grid = grid.join(cells, [*keys, "bx_", "by_"], "left").withColumn("c_", F.coalesce("c_", F.lit(0)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum("c_").over(before(Window.partitionBy(*keys, "by_").orderBy("bx_"))), F.lit(0))
    over = F.coalesce(F.sum("left_").over(before(Window.partitionBy(*keys, "bx_").orderBy(F.desc("by_")))), F.lit(0))
    grid = grid.withColumn("left_", left).withColumn("over_", over)
    return grid.groupBy(*keys).agg(F.sum(F.col("c_") * F.col("over_")).alias("crossed"))


def order_agreement(df: DataFrame, keys: Sequence[str], x: str, y: str, block_rows: int = 100_000, most_blocks: int = 4096) -> DataFrame:
    """keys, pairs, in_order, crossed, tied_x, tied_y and tied_both; ``in_order`` are pairs that both columns put the same way, or both tie.

    Rows with a null in either column are passed over; keys may not be null. Blocks have about ``block_rows`` rows, more where these
    would be over ``most_blocks``: the table of block counts has the square of their number.
    """
    keys = list(keys)
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("x_"), F.col(y).alias("y_")).agg(F.count("*").alias("w_"))
    points = written(points, "points")
    block_rows = max(block_rows, -(-(points.agg(F.sum("w_")).first()[0] or 0) // most_blocks))

    def blocked(rows: DataFrame, c: str) -> DataFrame:
        """Adds the block of a column: even numbers are runs of values, odd ones a single value."""
        block = 2 * F.floor(F.col("below_") / block_rows) + (F.col("c_") > block_rows).cast("long")
        side = counted(points, c, keys, "w_").select(*(F.col(k).alias(f"{k}_v_") for k in keys), F.col(c).alias("v_"), block.alias(f"b{c}"))
        return rows.join(side, [rows[k] == side[f"{k}_v_"] for k in keys] + [rows[c] == side["v_"]]).drop("v_", *(f"{k}_v_" for k in keys))

    rows = written(blocked(blocked(points, "x_"), "y_"), "blocks")
    out = points.groupBy(*keys).agg(F.sum("w_").alias("n_")).select(*keys, F.expr("n_ * (n_ - 1) DIV 2").alias("pairs"))
    for by, name in ((["x_"], "tied_x"), (["y_"], "tied_y"), (["x_", "y_"], "tied_both")):
        sizes = points.groupBy(*keys, *by).agg(F.sum("w_").alias("t_"))
        out = _together(out, sizes.groupBy(*keys).agg(F.sum(F.expr("t_ * (t_ - 1) DIV 2")).alias(name)), keys)
    schema = rows.select(*keys, F.lit(0).cast("long").alias("crossed")).schema

    def task(first: str, second: str):
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            got = _crossed(pd.factorize(part[first], sort=True)[0], pd.factorize(part[second], sort=True)[0], part["w_"].to_numpy(np.int64))
            return pd.DataFrame([(*key[: len(keys)], got)], columns=[*keys, "crossed"])

        return run

    crossed = _cells_crossed(written(rows.groupBy(*keys, "bx_", "by_").agg(F.sum("w_").alias("c_")), "cells"), keys)
    within_x = rows.where("bx_ % 2 = 0").groupBy(*keys, "bx_").applyInPandas(task("x_", "y_"), schema)
    within_y = rows.where("by_ % 2 = 0").groupBy(*keys, "by_").applyInPandas(task("bx_", "y_"), schema)
    out = _together(out, crossed.unionByName(within_x).unionByName(within_y).groupBy(*keys).agg(F.sum("crossed").alias("crossed")), keys)
    in_order = F.col("pairs") - F.col("crossed") - F.col("tied_x") - F.col("tied_y") + 2 * F.col("tied_both")
    return out.where("pairs IS NOT NULL").select(*keys, "pairs", in_order.alias("in_order"), "crossed", "tied_x", "tied_y", "tied_both")
