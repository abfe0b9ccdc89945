"""Substring dedup against a plain version."""

import hashlib

import numpy as np
from plain import AWKWARD, WORDS
from slatecast.llm.substring_dedup import remove_repeats


def expected(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORDS.findall(text or "")
        gone = set()
        for k in range(len(w) - 19):
            t = tuple(w[k : k + 20])
            if t in seen:
                gone.update(range(k, k + 20))
            seen.add(t)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(df, with_text=False).collect()), key=str)


def test_driver_rows(documents, rows):
    want = expected([(r["doc_id"], r["text"]) for r in rows])
    assert sum(r[2] for r in want) and got(documents.repartition(7)) == want


def test_repeats_within_and_across(llm):
    rng = np.random.default_rng(2)
    text = lambda n, k: " ".join(f"x{v}" for v in rng.integers(0, k, n))
    shared = text(70, 10**6)
    rows = [(i, " ".join([text(40, 10**6), shared[i:], text(30, 10**6), *["same words here"] * (i % 9)])) for i in range(40)]
    rows += [(100, "same " * 500), (101, "same " * 500), (102, text(5000, 2))]
    assert got(llm.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == expected(rows)


def test_awkward_rows(awkward, no_documents):
    assert got(awkward) == expected([(r[0], r[1]) for r in AWKWARD])
    assert got(no_documents) == []
