"""Designed samples by hash: strata, quotas with largest remainders, certainty units, inverse weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_rank


def first_by_hash(df: DataFrame, key: str, stratum: str, quotas: DataFrame, seed: str) -> DataFrame:
    """The ``quota_`` rows of each stratum (of ``n_`` rows) that come first by hash, with place_ from 1.

    Only rows with a hash below twice the quota's share and some are ranked, so a stratum of any size sends a few rows
    to its task; strata that are left short that way, if any, are ranked whole.
    """
    ranked = df.withColumn("hash_", hash_rank(seed, key)).join(quotas, stratum)
    share = F.conv(F.substring("hash_", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = ranked.where(share < (2 * F.col("quota_") + 50) / F.col("n_"))
    short = near.groupBy(stratum).agg(F.count("*").alias("got_"))
    short = quotas.join(short, stratum, "left").where(F.coalesce("got_", F.lit(0)) < F.least("quota_", "n_")).select(stratum)
    rows = near.join(short, stratum, "left_anti").unionByName(ranked.join(short, stratum, "left_semi"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("hash_", key))
    return rows.withColumn("place_", place).where(F.col("place_") <= F.col("quota_")).drop("hash_")


def stratified(df: DataFrame, key: str, stratum: str, size: int, seed: str) -> DataFrame:
    """About ``size`` rows, dealt to strata in proportion; adds probability and weight.

    Quotas are floors of the proportional shares, and the largest remainders get what is left, by stratum name
    in ties. Within a stratum rows go by the hash of the seed and their key. Quotas are worked out on the table of
    strata alone.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n_"))
    total = sizes.agg(F.sum("n_").alias("all_"))
    exact = sizes.crossJoin(F.broadcast(total)).withColumn("e_", F.col("n_") * F.least(F.lit(size), F.col("all_")) / F.col("all_"))
    exact = exact.withColumn("f_", F.floor("e_")).withColumn("left_", F.least(F.lit(size), F.col("all_")) - F.sum("f_").over(Window.partitionBy(F.lit(0))))
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("e_") - F.col("f_"), 9)), stratum))
    quotas = exact.select(stratum, "n_", (F.col("f_") + (order <= F.col("left_")).cast("long")).alias("quota_"))
    picked = first_by_hash(df, key, stratum, quotas, seed)
    return picked.select(*df.columns, (F.col("quota_") / F.col("n_")).alias("probability"), (F.col("n_") / F.col("quota_")).alias("weight"))


def with_certainty(df: DataFrame, key: str, stratum: str, volume: str, size: int, certain: int, seed: str) -> DataFrame:
    """The ``certain`` largest units with weight 1, and a stratified sample of the others."""
    top = df.orderBy(F.desc_nulls_last(volume), F.asc(key)).limit(certain)
    rest = stratified(df.join(top.select(key), key, "left_anti").select(*df.columns), key, stratum, size - certain, seed)
    one = F.lit(1.0)
    return top.select("*", one.alias("probability"), one.alias("weight"), F.lit(True).alias("is_certain")).unionByName(rest.withColumn("is_certain", F.lit(False)))
