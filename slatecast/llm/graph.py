"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _roots(step: DataFrame) -> tuple[DataFrame, int]:
    """Pointers (at, to) followed to their ends, and in how many passes.

    Every pass doubles how far pointers reach, so a path of n nodes takes log n passes.
    """
    passes = 0
    while True:
        ahead = step.select(F.col("at").alias("via"), F.col("to").alias("next"))
        longer = step.join(ahead, F.col("to") == F.col("via"), "left")
        moved = F.coalesce(F.col("next") != F.col("to"), F.lit(False))
        step = materialise(longer.select("at", F.coalesce("next", "to").alias("to"), moved.alias("moved")), "steps")
        passes += 1
        if step.where("moved").isEmpty():
            return step.select("at", "to"), passes
        step = step.select("at", "to")


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id that it reaches.

    In each round every node points at its smallest neighbour, pointers are followed to the ends of their paths, and
    each tree of pointers becomes one node. A node that isn't the smallest among its neighbours points away, so
    a round leaves at most half of the nodes, and paths, however long, go in one round of log n passes. Hubs are only
    ever aggregated. Null ends are ignored. ``rounds`` gets the passes of each round.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialise(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    found = None
    while not both.isEmpty():
        step = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select(F.col("a").alias("at"), "to")
        step, passes = _roots(materialise(step, "steps"))
        if rounds is not None:
            rounds.append(passes)
        if found is None:
            found = step.select(F.col("at").alias("id"), F.col("to").alias("component"))
        else:
            moved = found.join(step, F.col("component") == F.col("at"), "left")
            found = materialise(moved.select("id", F.coalesce("to", "component").alias("component")), "components")
        shorter = both.join(step.withColumnsRenamed({"at": "at_a", "to": "to_a"}), F.col("a") == F.col("at_a"))
        shorter = shorter.join(step.withColumnsRenamed({"at": "at_b", "to": "to_b"}), F.col("b") == F.col("at_b"))
        shorter = shorter.where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        both = materialise(shorter.distinct(), "edges")
    if found is None:
        found = both.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found
