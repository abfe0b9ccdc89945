"""MinHash near-dedup against all pairs of full sets."""

import numpy as np
from slatecast.llm.graph import components
from slatecast.llm.near_dedup import COORDINATES, drop_near_duplicates, near_duplicates, shingle_sets, sketch

from plain import AWKWARD, WORDS


def shingles(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets if i is not None)


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect() if r["doc_id"] is not None)


def test_driver_rows(documents, rows):
    assert got(near_duplicates(documents)) == expected([(r["doc_id"], r["text"]) for r in rows])


def test_awkward_rows(awkward):
    out = near_duplicates(awkward)
    assert got(out) == expected([(r[0], r[1]) for r in AWKWARD])
    assert [(r["component_id"], r["kept"]) for r in out.where("doc_id is null").collect()] == [(None, True)]


def test_chain_of_edits(llm):
    """A chain: neighbours are linked, its ends are not, and a hub of many copies joins it."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows, text = [], list(base)
    for i in range(12):
        rows.append((i, " ".join(text)))
        text[7 * i + 3] = f"edit{i}"
    rows += [(100 + i, rows[5][1].upper() if i % 2 else rows[5][1] + f" x{i}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 60))) for i in range(50)]
    out = near_duplicates(llm.createDataFrame(rows, "doc_id bigint, text string"))
    assert got(out) == expected(rows)


def test_empty(no_documents):
    assert near_duplicates(no_documents).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 900):
        a = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
        b = a[: n // 2] + [f"v{x}" for x in rng.integers(0, 10**9, n + 4 - n // 2)]
        sets = shingle_sets([" ".join(a).encode(), " ".join(b).encode()], 5)
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        x, y = sketch(sets)
        assert abs((x == y).mean() - true) < 5 / COORDINATES**0.5 * 0.5 + 1 / 128


def test_long_chains_take_few_rounds(llm):
    """Rising chains, where every node but the first points one step back, in one round of log n passes."""
    n = 1000
    edges = llm.range(1, n).selectExpr("id AS a", "id + 1 AS b").union(llm.createDataFrame([(5000, 5001), (5001, 4999), (7, 7), (None, 3)], "a bigint, b bigint"))
    rounds: list[int] = []
    got = {r["id"]: r["component"] for r in components(edges, rounds).collect()}
    assert got == {**{k: 1 for k in range(1, n + 1)}, **{k: 4999 for k in (4999, 5000, 5001)}}
    assert sum(rounds) <= 12


def test_random_graphs(llm):
    rng = np.random.default_rng(4)
    for n, m in ((60, 40), (60, 90)):
        pairs = [tuple(map(int, p)) for p in rng.integers(0, n, (m, 2))]
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        got = {r["id"]: r["component"] for r in components(llm.createDataFrame(pairs, "a bigint, b bigint")).collect()}
        assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


def test_rows_that_share_an_id_and_clashing_columns(llm):
    words_ = lambda seed: " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 4000, 40))
    a, b, c = words_(1), words_(2), words_(3)
    rows = [(3, a), (5, a), (5, b), (7, b + " tail"), (9, c), (9, c)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS gone_id_", "2 AS GONE_VERSION_", "3 AS version")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(3, a), (5, b), (9, c), (9, c)])
