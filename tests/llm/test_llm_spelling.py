"""Spelling variants against all pairs of words, and SQL."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from plain import AWKWARD, SMALL
from slatecast.llm import spelling


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def plain_variants(n):
    cut = {}
    for w in n:
        for i in range(len(w)):
            cut.setdefault((w[:i] + w[i + 1 :], i), set()).add(w)
    near = {w: set() for w in n}
    for (short, _), ws in cut.items():
        for w in ws:
            near[w] |= ws - {w}
            if short in n:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_driver_rows_and_sql(llm, rows):
    want = plain_variants(plain_words([(r["doc_id"], r["text"]) for r in rows]))
    out = spelling.op12_spelling_variants(llm, SMALL)
    assert got(out) == want and sum(r[1] is not None for r in want) > 100
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    sql = db.sql(spelling.OP12_SQL)
    assert sorted(sql.fetchall()) == want and sql.columns == out.columns


def test_awkward_rows(llm, awkward, no_documents):
    more = [(10, "Étoile étoile ETOILE ×÷abc ×÷abc ×÷abc x×÷abc " * 3), (11, "ÀÉÎõü-àéîõü " * 4), (None, "Hello hello HELLO jello hellos " * 3)]
    rows = [(r[0], r[1]) for r in AWKWARD] + more
    docs = awkward.select("doc_id", "text").union(llm.createDataFrame(more, "doc_id bigint, text string"))
    assert got(spelling.variants(spelling.vocabulary(docs))) == plain_variants(plain_words(rows))
    assert got(spelling.variants(spelling.vocabulary(no_documents))) == []


def test_long_texts_in_parts(monkeypatch):
    text = "abcdef ghijklm, " * 50 + "x" * 300 + " abcdef"
    whole = spelling._counts(text)
    monkeypatch.setattr(spelling, "_PART", 37)
    assert spelling._counts(text) == whole and whole["abcdef"] == 51 and whole["x" * 300] == 1


@pytest.mark.parametrize("letters,least,most,bounds", [("ab", 5, 9, {}), ("ab", 5, 8, {"most": 40, "shard_rows": 200}), ("abcé", 5, 7, {"most": 3, "shard_rows": 50}), ("aÿ", 5, 40, {"shard_rows": 300})])
def test_all_pairs_of_words(llm, letters, least, most, bounds):
    rng = np.random.default_rng(len(letters) + most)
    words = {"".join(rng.choice(list(letters), rng.integers(least, most + 1), p=[0.7, *[0.3 / (len(letters) - 1)] * (len(letters) - 1)])) for _ in range(1200)}
    n = {w: int(k) for w, k in zip(sorted(words), rng.integers(3, 40, len(words)), strict=True)}
    vocab = llm.createDataFrame(list(n.items()), "word string, n bigint")
    want = plain_variants(n)
    assert got(spelling.variants(vocab, **bounds)) == want and sum(r[4] for r in want) > 100


def test_wavelet_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 200):
        values = rng.permutation(n)
        tree = spelling.Wavelet(values)
        left, right, low, high = (rng.integers(0, n + 1, 50) for _ in range(4))
        at, value = tree.report(left, right, low, high)
        want = sorted((k, v) for k in range(50) for v in values[left[k] : max(left[k], right[k])].tolist() if low[k] <= v < high[k])
        assert sorted(zip(at.tolist(), value.tolist(), strict=True)) == want
