"""Language ID: held-out accuracy, rejection and awkward rows."""

import zlib

from plain import AWKWARD
from slatecast.llm.language_id import fold, identify, known_languages, letters, subwords


def test_held_out_accuracy(documents, rows):
    truth = {r["doc_id"]: r["lang"] for r in rows}
    found = identify(documents, documents, fold(documents["doc_id"]) != 1).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 40
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["rejected"] for r in found) <= 0.01 * len(found)


def test_awkward_rows(documents, awkward, no_documents):
    usable = fold(documents["doc_id"]) != 1
    found = {r["doc_id"]: r for r in identify(awkward, documents, usable).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[1]["score"] == 0
    assert all(found[i]["rejected"] for i in (1, 2, 3))
    kept = known_languages(awkward, documents)
    assert kept.columns == awkward.columns and kept.where("doc_id in (1, 2, 3)").count() == 0
    assert identify(no_documents, documents, usable).count() == 0
    assert len(found) == len({r[0] for r in AWKWARD})


def test_nothing_to_learn_from(awkward, no_documents):
    out = identify(awkward, no_documents, no_documents["lang"].isNotNull()).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}


def test_subwords_stay_within_words():
    text = letters("Ab 1, çd!")
    assert text == " ab çd ".encode()
    parts = [subwords(letters(w)) for w in ("ab", "çd")]
    assert sorted(subwords(text).tolist()) == sorted(x for p in parts for x in p.tolist())


def test_letters_are_unicode_letters():
    assert letters("½ ² Ⅷ 12 _ — ́") == b"" and letters(None) == b""
    assert letters("Hí, ½ नमस्ते") == " hí नमस्ते ".encode()


def test_clashing_columns(llm, documents):
    docs = documents.selectExpr("*", "1 AS score", "2 AS rejected", "3 AS lang_pred", "4 AS c0")
    kept = known_languages(docs, docs)
    plain = known_languages(documents, documents)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in plain.select("doc_id").collect()}
    assert kept.where("score <> 1 or rejected <> 2 or lang_pred <> 3 or c0 <> 4").count() == 0
