"""Similarity join of short texts that loses no pair: prefixes of rare letters find candidates, bounds thin them out, the rest is scored.

A text is a bag of letters: its tokens are (letter, how often it came before), so the letters that two texts share are a set
intersection. The matched letters of a sequence comparison are shared letters in order, so a ratio r = 2 * matched / (m + n) needs an
overlap of t = r * (m + n) / 2 tokens or more. In one global order, rarest first, two such texts share one of the first n - t + 1
tokens of either, and k of the first n - t + k. Texts meet on one shared token where few have it; a token that makes more
than ``most`` pairs is split by the next shared one, and so on, up to ``depth`` tokens. Each text brings its tokens as bits, so the overlap is
counted where two texts meet, and only pairs that reach it are sent on.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.writers import written


def _in_order(a: str, b: str) -> int:
    """The longest common subsequence, whose columns are the bits of one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(DoubleType())
def ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio of matching blocks, null where the letters in common order can't reach ``least``."""

    def one(x: str, y: str, r: float) -> float | None:
        size = len(x) + len(y)
        if 2 * _in_order(x, y) < r * size - 1e-9:
            return None
        return SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y, r) for x, y, r in zip(a, b, least, strict=True)], dtype="float64")


def _tokens(key: Column) -> Column:
    letters = F.filter(F.split(key, ""), lambda c: c != "")
    before = lambda c, i: F.size(F.filter(F.slice(letters, F.lit(1), i), lambda x: x == c))
    return F.transform(letters, lambda c, i: F.concat(c, before(c, i).cast("string")))


def _need(ratio: Column, letters: Column) -> Column:
    """The overlap that texts of so many letters together need."""
    return F.ceil(ratio * letters / 2 - 1e-9)


#: Longs that hold the bits of a text's tokens; the most frequent tokens have a bit of their own, the others share theirs.
WORDS = 4


def letter_bags(keys: DataFrame) -> DataFrame:
    """(key, number, tokens, bits, shared): each text's tokens as their ranks, rarest first, the same as bits, and how many tokens found their bit taken."""
    held = written(keys.select("key").where("key <> ''").distinct().withColumn("token", F.explode(_tokens(F.col("key")))), "tokens")
    often = held.groupBy("token").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.orderBy(F.desc("often"), "token")) - 1  # as many rows as an alphabet has letters, times a text's length
    often = often.select("token", rank.alias("rank"), (rank % (64 * WORDS)).alias("bit"))
    word = lambda k: F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("bigint"))).alias(f"bits{k}")
    bags = held.join(often, "token").groupBy("key").agg(F.sort_array(F.collect_list("rank"), asc=False).alias("tokens"), *(word(k) for k in range(WORDS)))
    ones = sum((F.bit_count(f"bits{k}") for k in range(WORDS)), F.lit(0))
    return written(bags.withColumns({"shared": F.size("tokens") - ones, "number": F.monotonically_increasing_id()}), "bags")


def similar_pairs(left: DataFrame, right: DataFrame, most: int = 1_000_000, depth: int = 4, bags: DataFrame | None = None) -> DataFrame:
    """(left, right, cell, ratio): every pair of a cell whose ratio of matching blocks is at least the cell's ``least``.

    Both sides are (id, key, cell, least), with one key for an id; ``least`` is above 0 and the same for all rows of a cell. Pairs have one row for each cell
    that they share. Null and empty keys match nothing. ``bags`` are the ``letter_bags`` of all keys, if they have been made.
    """
    bags = letter_bags(left.select("key").union(right.select("key"))) if bags is None else bags
    sides = left.select(F.lit(True).alias("is_left"), "key", "cell", "least").unionByName(right.select(F.lit(False).alias("is_left"), "key", "cell", "least")).where("least <= 1")
    cells = written(sides.groupBy(F.col("cell").alias("name")).agg(F.min("least").alias("least")).withColumn("cell", F.monotonically_increasing_id()), "cells")
    n = F.size("tokens")
    # the shortest partner has least / (2 - least) as many letters
    sure = F.ceil(F.col("least") / (2 - F.col("least")) * n - 1e-9)
    rows = sides.select("is_left", "key", F.col("cell").alias("name")).distinct().join(cells, "name").join(bags, "key")  # numbers for texts and cells from here on
    rows = rows.select("is_left", "number", "cell", "least", *BITS, n.alias("n"), sure.alias("sure"), F.slice("tokens", F.lit(1), F.least(n, n - sure + depth).cast("int")).alias("head"))
    rows = rows.withColumn("sign", F.xxhash64("cell")).withColumn("pos", F.lit(-1))
    found = None
    for level in range(1, depth + 1):
        nth = F.slice("head", F.col("pos") + 2, F.size("head"))
        if level == 1:  # the first of k shared tokens lies in the first n - sure + 1
            nth = F.slice("head", F.lit(1), F.least(F.size("head"), F.col("n") - F.col("sure") + 1).cast("int"))
        rows = rows.select("*", F.posexplode(nth).alias("step", "token"))
        rows = rows.withColumn("pos", F.col("pos") + 1 + F.col("step")).withColumn("sign", F.xxhash64("sign", "token")).drop("step", "token")
        rows = written(rows, "signs")
        pairs = F.count_if("is_left") * F.count_if(~F.col("is_left"))
        hot = written(rows.groupBy("sign").agg(pairs.alias("pairs")).where(F.col("pairs") > (most if level < depth else float("inf"))).select("sign"), "hot")
        some = _meet(rows.join(hot, "sign", "left_anti"), level)
        last = hot.isEmpty()
        if not last:
            rows = rows.join(hot, "sign", "left_semi")
            some = some.unionByName(_meet(rows.where(F.col("sure") <= level), level))  # texts that may share no further token
        found = some if found is None else found.unionByName(some)
        if last:
            break
    found = written(found.distinct(), "met")
    text = lambda name: bags.select(F.col("number").alias(name), F.col("key").alias(f"{name}_key"))
    both = found.join(text("left"), "left").join(text("right"), "right").withColumn("ratio", ratio_from("left_key", "right_key", "least"))
    both = both.where(F.col("ratio") >= F.col("least") - 1e-12).join(cells.select("cell", "name"), "cell").select("left_key", "right_key", F.col("name").alias("cell"), "ratio")
    side = lambda rows, name: rows.select(F.col("id").alias(name), F.col("key").alias(f"{name}_key"), "cell").distinct()
    return both.join(side(left, "left"), ["left_key", "cell"]).join(side(right, "right"), ["right_key", "cell"]).select("left", "right", "cell", "ratio")


#: What a text brings to a meeting, besides its letters' number.
BITS = ["shared", *(f"bits{k}" for k in range(WORDS))]


def _meet(rows: DataFrame, level: int) -> DataFrame:
    """Pairs of equal signs that share the letters they need; lengths, and letters left behind the last shared one, are looked at first."""
    a = rows.where("is_left").select("sign", "cell", "least", F.col("number").alias("left"), F.col("n").alias("n_l"), F.col("pos").alias("pos_l"), *(F.col(c).alias(f"{c}_l") for c in BITS))
    b = rows.where("NOT is_left").select(F.col("sign").alias("sign_r"), F.col("cell").alias("cell_r"), F.col("number").alias("right"), F.col("n").alias("n_r"), F.col("pos").alias("pos_r"), *(F.col(c).alias(f"{c}_r") for c in BITS))
    need = _need(F.col("least"), F.col("n_l") + F.col("n_r"))
    rest = F.least(F.col("n_l") - F.col("pos_l"), F.col("n_r") - F.col("pos_r")) - 1
    # tokens that share a bit count once, so those of the side with fewer such may be missing
    both = sum((F.bit_count(F.col(f"bits{k}_l").bitwiseAND(F.col(f"bits{k}_r"))) for k in range(WORDS)), F.least("shared_l", "shared_r"))
    fits = (need <= F.least("n_l", "n_r")) & (rest + level >= need) & (both >= need)
    return a.join(b, (F.col("sign") == F.col("sign_r")) & fits & (F.col("cell") == F.col("cell_r"))).select("left", "right", "cell", "least")
