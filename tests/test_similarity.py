"""The similarity join against all pairs."""

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F
from slatecast.operators import similarity
from slatecast.operators.matching import match_scored
from slatecast.operators.similarity import _in_order, similar_pairs

SIDE = "id int, key string, cell string, least double"


def test_letters_in_common_order():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abc d"), rng.integers(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert _in_order(a, b) == table[-1][-1] >= sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


@pytest.mark.parametrize("most,depth,letters", [(1_000_000, 4, "abcdefghijklmnop "), (40, 4, "abcdef "), (5, 2, "ab "), (200, 3, "abcé")])
def test_all_pairs(spark, most, depth, letters):
    rng = np.random.default_rng(depth + most)
    least = {"a": 0.6, "b": 0.85}
    sides = [[(2 * k + i, "".join(rng.choice(list(letters), rng.integers(0, 14))), c, least[c]) for k in range(90) for i, c in enumerate(least)] for _ in range(2)]
    sides[0] += [(1000, None, "a", 0.6), (1001, sides[1][0][1], "none", 0.7), (1002, "x" * 40, "a", 0.6)]
    sides[1] += [(1002, "x" * 39 + "y", "a", 0.6), (1003, "abc", "over", 1.2)]
    want = sorted((i, j, c, round(SequenceMatcher(None, x, y).ratio(), 9)) for i, x, c, r in sides[0] for j, y, d, _ in sides[1] if c == d and x and y and r <= 1 and SequenceMatcher(None, x, y).ratio() >= r - 1e-12)
    got = similar_pairs(*(spark.createDataFrame(s, SIDE) for s in sides), most=most, depth=depth)
    assert sorted((*r[:3], round(r[3], 9)) for r in got.collect()) == want and len(want) > 25


def test_typos_in_the_rare_word(spark):
    items = spark.createDataFrame([(1, "the xylophine returns", 2001), (2, "the return", 2001), (3, "", 2001), (4, None, None)], "item int, key string, year int")
    records = spark.createDataFrame([("a", "the xylophone returns", 2001, True), ("b", "the xylophone returns", 2003, False), ("c", "a zebra", 2001, True), ("d", "", 2001, True)], "entity string, key string, year int, has_id boolean")
    got = {r["item"]: (r["entity"], r["status"]) for r in match_scored(items, records).collect()}
    assert got == {1: ("a", "matched"), 2: ("a", "ambiguous")}
    twins = records.union(records.where("entity = 'a'").withColumn("entity", F.lit("e")))
    assert {r["item"]: (r["entity"], r["status"]) for r in match_scored(items, twins).collect()}[1] == ("a", "ambiguous")
    with pytest.raises(ValueError, match="80"):
        match_scored(items, records, least=80)


def test_only_pairs_with_enough_letters_are_sent_on(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sides = [["".join(rng.choice(list("abcdefghijkl"), 20)) for _ in range(150)] for _ in range(2)]
    want = sum((Counter(a) & Counter(b)).total() >= 16 for a in sides[0] for b in sides[1])
    met, meet = [], similarity._meet

    def counted(rows, level):
        met.append(out := meet(rows, level))
        return out

    monkeypatch.setattr(similarity, "_meet", counted)
    similar_pairs(*(spark.createDataFrame([(k, key, "a", 0.8) for k, key in enumerate(s)], SIDE) for s in sides)).count()
    assert sum(m.select("left", "right").distinct().count() for m in met) == want < 150 * 150 / 4
