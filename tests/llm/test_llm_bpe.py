"""Byte-level BPE against tiktoken, and the round trip."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import AWKWARD
from slatecast.llm.bpe import DIGESTS, Codec, read_ranks, tokenize

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(PATH), P.PATTERN)


def expected(own, i, text):
    ids = own.encode_ordinary(text or "")
    return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("table", ["driver", "awkward", "none"])
def test_tables(own, documents, awkward, no_documents, rows, table):
    df, plain = {"driver": (documents, [(r["doc_id"], r["text"]) for r in rows]), "awkward": (awkward, [(r[0], r[1]) for r in AWKWARD]), "none": (no_documents, [])}[table]
    got = tokenize(df, PATH, P.PATTERN, outputs=DIGESTS).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(own, i, t) for i, t in plain), key=str)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab  '\n\tsS1é.", max_size=40))
def test_any_text(own, codec, text):
    ids, _ = codec.encode([text])
    assert ids.tolist() == own.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_ids(own, documents):
    for r in tokenize(documents.limit(20), PATH, P.PATTERN).join(documents, "doc_id").collect():
        assert r["token_ids"] == own.encode_ordinary(r["text"])
