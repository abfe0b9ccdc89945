"""Decontamination against planted copies, edits and paraphrases, and alignment against a plain table."""

import numpy as np
from plain import AWKWARD, SMALL
from slatecast.llm.decontaminate import align, contaminated, drop_contaminated, normal


def plain_align(item, region):
    table = np.zeros((len(item) + 1, len(region) + 1), dtype=int)
    for i in range(len(item)):
        for j in range(len(region)):
            table[i + 1, j + 1] = max(0, table[i, j] + (2 if item[i] == region[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
    return int(table.max())


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(2))
        assert align(a, b)[0] == plain_align(a, b)


def test_driver_rows(llm, documents, rows):
    bench = llm.read.parquet(f"{SMALL}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(documents, bench).collect()}
    items = {r["item_id"]: f" {normal(r['text']).decode()} " for r in bench.collect()}
    exact = {(r["doc_id"], i) for r in rows for i, t in items.items() if t in f" {normal(r['text']).decode()} "}
    assert exact and exact <= found
    assert drop_contaminated(documents, bench).count() == len(rows) - len({d for d, _ in found})


def test_edited_copies_are_found_and_clean_documents_are_not(llm):
    rng = np.random.default_rng(7)
    common = ["the", "of", "and", "to", "in"]
    prose = lambda n: [str(rng.choice(common)) if rng.random() < 0.4 else f"w{rng.integers(0, 500)}" for _ in range(n)]
    items = [(i, " ".join(prose(int(rng.integers(15, 60))))) for i in range(30)] + [(30, " ".join(prose(1500))), (31, "tiny one"), (32, None)]
    docs, want = [], set()
    for d in range(300):
        body = prose(200)
        if d % 3 == 0:
            item = int(rng.integers(0, 31))
            words = items[item][1].upper().split() if d % 2 else items[item][1].split()
            words = [w for k, w in enumerate(words) if k % 11 != 5]  # words lost
            words = [f"edit{k}" if k % 9 == 4 else w for k, w in enumerate(words)]  # words changed
            body[100:100] = words
            want.add((d, item))
        docs.append((d, ", ".join(body)))
    found = contaminated(llm.createDataFrame(docs, "doc_id bigint, text string"), llm.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_awkward_rows(llm, awkward, no_documents):
    bench = llm.createDataFrame([(1, "d e f g h i j k l m n"), (2, None), (None, "one two three")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(awkward, bench).collect()}
    assert found == {(None, 1), (4, None), (5, None)}
    kept = drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 4
    assert contaminated(no_documents, bench).count() == 0
    assert drop_contaminated(awkward, llm.createDataFrame([], "item_id bigint, text string")).count() == len(AWKWARD)


def test_edits_every_fourth_and_fifth_word_and_in_short_items(llm):
    rng = np.random.default_rng(3)
    prose = lambda n: [f"w{rng.integers(0, 3000)}" for _ in range(n)]
    items = [(i, prose(14 if i < 10 else 40)) for i in range(20)]
    docs, want = [], set()
    for i, words in items:
        for every in (4, 5):
            edited = [f"edit{i}x{k}" if k % every == every - 1 else w for k, w in enumerate(words)]
            if i < 10:
                edited = [f"edit{i}x{k}" if k in (5, 10) else w for k, w in enumerate(words)]
            docs.append((len(docs), prose(80) + edited + prose(80)))
            want.add((docs[-1][0], i))
    docs += [(1000 + k, [w for j in range(0, 12, 3) for w in items[k][1][j : j + 2]] + prose(150)) for k in range(20)]  # pairs of words only
    docs += [(2000 + i, words) for i, words in items[::2]]  # verbatim elsewhere, so that broken grams have counts
    want |= {(2000 + i, i) for i, _ in items[::2]}
    made = [(i, " ".join(words)) for i, words in docs], [(i, " ".join(words)) for i, words in items]
    found = contaminated(llm.createDataFrame(made[0], "doc_id bigint, text string"), llm.createDataFrame(made[1], "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_excerpts_of_long_items(llm):
    prose = lambda name, n: [f"{name}{k}" for k in range(n)]
    items = [(0, prose("a", 500)), (1, prose("b", 1000))]
    cuts = [(0, 200, 260), (0, 0, 40), (1, 480, 520), (1, 490, 535), (1, 960, 1000), (0, 100, 139)]
    docs = [(d, prose(f"x{d}y", 90) + items[i][1][a:b] + prose(f"z{d}y", 90)) for d, (i, a, b) in enumerate(cuts)]
    made = [(i, " ".join(words)) for i, words in docs], [(i, " ".join(words)) for i, words in items]
    found = contaminated(llm.createDataFrame(made[0], "doc_id bigint, text string"), llm.createDataFrame(made[1], "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, i) for d, (i, a, b) in enumerate(cuts) if b - a >= 40}
    assert all((r["first_word"], r["end_word"]) == (90, 90 + cuts[r["doc_id"]][2] - cuts[r["doc_id"]][1]) for r in found)


def test_every_pair_against_plain_alignments(llm, documents, rows):
    """All documents against all items, aligned whole by the plain table."""
    import re

    bench = llm.read.parquet(f"{SMALL}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(documents, bench).collect()}
    split = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    codes: dict[str, int] = {}
    code = lambda t: np.array([codes.setdefault(w, len(codes)) for w in split(t)], dtype=np.uint64)
    docs, items = {r["doc_id"]: code(r["text"]) for r in rows}, {r["item_id"]: code(r["text"]) for r in bench.collect()}
    trigrams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    of_docs, want = {d: trigrams(w.tolist()) for d, w in docs.items()}, set()
    for i, item in items.items():
        grams = trigrams(item.tolist())
        least = min(max(len(item), 2 * min(len(item), 8)), 80)
        for d, w in docs.items():
            if len(grams & of_docs[d]) >= min(2, len(grams)) and align(item, w)[0] >= least:
                want.add((d, i))
    assert want and found == want


def test_excerpts_of_long_items_and_repeated_rows(llm):
    rng = np.random.default_rng(11)
    prose = lambda n: [f"w{rng.integers(0, 5000)}" for _ in range(n)]
    items = {0: prose(300), 1: prose(600), 2: prose(512)}
    docs = [(0, prose(60) + items[0][90:230] + prose(60)), (1, prose(60) + items[1][200:380] + prose(60)), (2, prose(400)), (3, items[2][:20] + prose(50))]
    docs.append((4, prose(30) + [w if k % 5 else f"x{k}" for k, w in enumerate(items[1][300:480])]))
    bench = llm.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    bench = bench.unionAll(llm.range(4400).selectExpr("2L AS item_id", f"'{' '.join(items[2])}' AS text"))
    found = contaminated(llm.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string"), bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(0, 0), (1, 1), (4, 1)]


def test_edited_copies_of_a_passage_that_many_documents_hold(llm):
    """Rarity must not hide edited copies that outnumber the verbatim one."""
    rng = np.random.default_rng(5)
    prose = lambda n: [f"w{rng.integers(0, 3000)}" for _ in range(n)]
    item = prose(40)
    edited = [f"edit{k}" if k % 5 == 4 else w for k, w in enumerate(item)]
    docs = [(k, prose(30) + edited + prose(30)) for k in range(120)] + [(500, prose(30) + item)] + [(600 + k, prose(90)) for k in range(20)]
    found = contaminated(llm.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string"), llm.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert {r["doc_id"] for r in found.collect()} == {*range(120), 500}


def test_clashing_columns(llm, awkward):
    bench = llm.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = awkward.withColumnsRenamed({"id": "leak_id_", "place": "LEAK_VERSION_", "component": "version"})
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD) - 3


def test_items_that_are_worded_alike(llm):
    """Common grams join nothing by themselves, and no copy is lost among thousands of like items, even one that keeps only these grams."""
    rng = np.random.default_rng(8)
    opening = "what is the value of it when".split()
    prose = lambda n: [f"w{rng.integers(0, 4000)}" for _ in range(n)]
    items = [opening + prose(int(rng.integers(6, 14))) for _ in range(3000)]
    docs, want = [], set()
    for d in range(60):
        body = [w for _ in range(15) for w in prose(40) + opening]
        if d % 2:
            i = int(rng.integers(0, 3000))
            copy = list(items[i])
            if d % 4 == 3:  # every gram beyond the opening is broken, but most words stay
                copy = [x for k, w in enumerate(copy) for x in ([w] if k < 8 or k % 2 else [w, f"edit{k}"])]
            body += copy + prose(30)
            want.add((d, i))
        docs.append((d, " ".join(body)))
    found = contaminated(llm.createDataFrame(docs, "doc_id bigint, text string"), llm.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert want <= got
    code = lambda ws: np.array([hash(w) & 0xFFFFFFFF for w in ws], dtype=np.uint64)
    for d, i in got - want:  # whatever else is found reaches the score
        assert align(code(items[i]), code(dict(docs)[d].split()))[0] >= max(len(items[i]), 16)


def test_grams_of_many_pieces_change_no_result(llm, documents, monkeypatch):
    import slatecast.llm.decontaminate as module

    bench = llm.read.parquet(f"{SMALL}/benchmark.parquet")
    texts = [np.frombuffer(bytes(r["words"]), np.uint64) for r in module._items(bench, "item_id", "text").select("words").distinct().collect()]
    docs = module.words.split([normal(r["text"]) for r in documents.select("text").collect()])
    seed = np.ones(len(module._Grams(texts).h), bool)
    want = sorted(module._Judge(texts, seed, 0.5).leaks(docs))
    for held in (0, 1, 3):
        monkeypatch.setattr(module, "_HELD", held)
        assert sorted(module._Judge(texts, seed, 0.5).leaks(docs)) == want and want
