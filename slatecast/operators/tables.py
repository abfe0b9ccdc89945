"""Changes to tables without a table format: each gives the new rows, to be written to a new path."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), keep_old: Sequence[str] = (), keep_new: Sequence[str] = ()) -> DataFrame:
    """The base with the updates' rows in place of those of equal keys (null keys are equal).

    Of several updates of a key the largest ``order`` wins. Columns in ``keep_old`` change only where the base
    has null, and those in ``keep_new`` only where the update is set.
    """
    others = [c for c in base.columns if c not in keys]
    new = updates.select(*keys, F.struct(*others).alias("new_"), F.struct(*order, F.lit(0)).alias("order_"))
    new = new.groupBy(*keys).agg(F.max_by("new_", "order_").alias("new_"))
    new = new.withColumnsRenamed({k: f"{k}_new_" for k in keys}).withColumn("is_new_", F.lit(True))
    old = base.withColumn("is_old_", F.lit(True))
    joined = old.join(new, [F.col(k).eqNullSafe(F.col(f"{k}_new_")) for k in keys], "full")

    def value(c: str) -> Column:
        a, b = F.col(c), F.col(f"new_.{c}")
        if c in keep_old:
            return F.coalesce(a, b)
        return F.coalesce(b, a) if c in keep_new else F.when(F.col("is_new_"), b).otherwise(a)

    key = {k: F.when(F.col("is_old_"), F.col(k)).otherwise(F.col(f"{k}_new_")) for k in keys}
    return joined.select(*(key[c].alias(c) if c in key else value(c).alias(c) for c in base.columns))


def insert_ignore(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The base and the rows whose keys it doesn't have, one for each key."""
    fresh = rows.select(*base.columns).join(base.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return base.unionByName(fresh)


def delete_by(base: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(gone, list(keys), "left_anti")


def union_of(parts: Sequence[DataFrame | None], distinct: bool = False) -> DataFrame:
    """The parts that exist, by column name; columns that a part lacks are null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for p in parts if p is not None])
    return out.distinct() if distinct else out


def common_values(df: DataFrame, entity: str, value: str) -> DataFrame:
    """The values that every entity has."""
    n = df.agg(F.count_distinct(entity).alias("n_"))
    return df.groupBy(value).agg(F.count_distinct(entity).alias("c_")).crossJoin(F.broadcast(n)).where("c_ = n_").select(value)
