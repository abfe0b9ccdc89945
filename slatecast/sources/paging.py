"""Items of stored response pages in their order, by continuation tokens, up to a limit that is told apart from an end.

A source's pages name their successors. Pages that 2 ** k steps lead to are found by joining steps with themselves, so a chain of n
pages takes log n joins, whatever the number of sources; pages that no chain reaches are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .writers import written


def offset_tokens(pages: DataFrame, offset: str, items: str, size: int) -> DataFrame:
    """Adds token and next_token to pages that count from an offset: a page that isn't full is the last."""
    return pages.withColumns({"token": F.col(offset).cast("string"), "next_token": F.when(F.size(items) >= size, (F.col(offset) + size).cast("string"))})


def in_order(pages: DataFrame, first: str = "", limit: int = 10_000) -> DataFrame:
    """(source, token, page): the pages that the chain from ``first`` reaches, numbered from 0, ``limit`` of them at most.

    ``pages`` are (source, token, next_token), with one page for a token. A chain that comes back to a page ends there.
    """
    step = pages.select("source", F.col("token").alias("at"), F.col("next_token").alias("to"))
    reached = step.where(F.col("at") == first).select("source", F.col("at").alias("token"), F.lit(0).cast("long").alias("page"))
    jump, length = step.where("to IS NOT NULL"), 1
    reached = written(reached, "pages")
    while length < limit:
        there = pages.select(F.col("source").alias("s_"), F.col("token").alias("t_"))
        ahead = reached.join(jump, (reached["source"] == jump["source"]) & (reached["token"] == jump["at"])).select(reached["source"], F.col("to").alias("token"), (F.col("page") + length).alias("page"))
        ahead = ahead.join(there, (F.col("source") == F.col("s_")) & (F.col("token") == F.col("t_")), "left_semi")
        more = written(reached.unionByName(ahead).groupBy("source", "token").agg(F.min("page").alias("page")), "pages")
        if more.count() == reached.count():
            break
        reached = more
        far = jump.select(F.col("source").alias("s_"), F.col("at").alias("via"), F.col("to").alias("next"))
        jump = written(jump.join(far, (F.col("source") == F.col("s_")) & (F.col("to") == F.col("via"))).select("source", "at", F.col("next").alias("to")), "jumps")
        length *= 2
    return reached.where(F.col("page") < limit)


def paged_items(pages: DataFrame, limit: int, first: str = "") -> tuple[DataFrame, DataFrame]:
    """The items (source, n, item) of each source in their order, from 0, ``limit`` at most; and (source, n_items, status) of each source.

    ``pages`` are (source, token, next_token, items). The status is complete, limit (there is more than the limit), gap (a page that is
    named isn't stored), cycle (a page names an earlier one) or empty (no first page).
    """
    order = in_order(pages, first, limit + 1)
    held = pages.join(order, ["source", "token"])
    before = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # pages of a source, limit + 1 at most
    sized = held.select("source", "page", "token", "next_token", "items", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0)).alias("before"))
    sized = written(sized, "paged")
    items = sized.where(F.col("before") < limit).select("source", "before", F.posexplode("items").alias("k", "item")).select("source", (F.col("before") + F.col("k")).alias("n"), "item").where(F.col("n") < limit)
    last = sized.groupBy("source").agg(F.sum(F.size("items")).alias("all_"), F.max_by("next_token", "page").alias("next_"), F.max("page").alias("last_"))
    seen = order.select(F.col("source").alias("s_"), F.col("token").alias("t_"))
    last = last.join(seen, (F.col("source") == F.col("s_")) & (F.col("next_") == F.col("t_")), "left")
    status: Column = F.when(F.col("all_") > limit, "limit").when(F.col("next_").isNull(), "complete").when(F.col("t_").isNotNull(), "cycle").otherwise("gap")
    found = last.select("source", F.least("all_", F.lit(limit)).alias("n_items"), status.alias("status"))
    none = pages.select("source").distinct().join(found, "source", "left_anti").select("source", F.lit(0).cast("long").alias("n_items"), F.lit("empty").alias("status"))
    return items, found.unionByName(none)
