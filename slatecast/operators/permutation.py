"""Random permutations within groups: every row gets the value of another, each value is used once, and a seed makes the same ones again.

Rows are put in two orders by two hashes of the seed and the row's own id; the row at a place of one takes the value at that place of the
other. Both orders are laid out by ranges, so a group may have any size, and the result doesn't depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import places


def permuted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], row: str, seed: int, suffix: str = "_permuted") -> DataFrame:
    """Adds each of ``columns`` again, its values permuted together among the rows of equal ``keys`` (null is a group).

    ``row`` is a text that tells the rows apart; rows that share it may swap their values from run to run.
    """

    def ordered(part: DataFrame, name: str) -> DataFrame:
        return places(part.withColumn("h_", F.md5(F.concat_ws(":", F.lit(name), F.lit(str(seed)), row))), keys, ["h_", row], "place_").drop("h_")

    takes = ordered(df, "take")
    gives = ordered(df.select(*keys, row, *columns), "give").drop(row)
    gives = gives.withColumnsRenamed({**{k: f"{k}_g_" for k in keys}, **{c: f"{c}{suffix}" for c in columns}, "place_": "place_g_"})
    on = [takes[k].eqNullSafe(gives[f"{k}_g_"]) for k in keys] + [takes["place_"] == gives["place_g_"]]
    return takes.join(gives, on).select(*df.columns, *(f"{c}{suffix}" for c in columns))
