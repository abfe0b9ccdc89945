"""Line dedup against a plain version."""

from plain import AWKWARD, WORDS
from slatecast.llm.line_dedup import drop_repeated_lines


def expected(rows):
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for i, text in docs:
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if WORDS.search(x)]
        gone = set()
        for j in range(len(at) - 2):
            w = tuple(lines[k] for k in at[j : j + 3])
            if w in seen:
                gone.update(at[j : j + 3])
            seen.add(w)
        out[i, text] = ("\n".join(x for k, x in enumerate(lines) if k not in gone) if text is not None else None, len(at), len(gone))
    return sorted(((i, *out[i, t]) for i, t in rows), key=str)


def got(df):
    out = drop_repeated_lines(df, counts=True)
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()), key=str)


def test_driver_rows(documents, rows):
    want = expected([(r["doc_id"], r["text"]) for r in rows])
    assert sum(r[3] for r in want) and got(documents) == want


def test_awkward_rows(awkward, no_documents):
    assert got(awkward) == expected([(r[0], r[1]) for r in AWKWARD])
    assert drop_repeated_lines(awkward).columns == awkward.columns
    assert got(no_documents) == []


def test_clashing_columns(llm):
    docs = llm.createDataFrame([(1, "a\nb\nc", 1, 2, 3), (2, "x\na\nb\nc", 4, 5, 6)], "doc_id bigint, text string, gone_id_ int, GONE_STARTS_ int, gone_done_ int")
    got = drop_repeated_lines(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb\nc", 1, 2, 3), (2, "x", 4, 5, 6)]
