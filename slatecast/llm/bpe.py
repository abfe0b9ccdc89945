"""Byte-level BPE encoding and decoding (operator 8).

A rank file (token bytes and merge rank) is serialised as a sentencepiece BPE model: every token becomes a
piece spelt with one printable character for each byte, scored by its negative rank, under identity
normalisation. The best-scored merge is then the lowest-ranked one, so each pre-token gets the ids that the
rank file asks for, and piece ids are ranks. Decoding maps ids back to token bytes.

Cases: null text counts as empty (no tokens; digests of the empty string). Repeated rows give repeated
results. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import columns, pieces

#: Output columns that can be asked for, with their SQL types.
OUTPUTS = {
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "token_ids": "array<int>",
    "decoded": "binary",
}
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")
_KEEP = 150_000  # pieces that a task remembers; a full memory is dropped and built anew


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def byte_letters() -> str:
    """256 distinct printable characters, none of them white space, indexed by byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(chr(b) if b in set(shown) else chr(next(other)) for b in range(256))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the id after them is unknown."""
    letters = byte_letters()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    out = [
        _field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(r)) + _field(3, 1))
        for r, t in enumerate(order)
    ]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, len(order)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes with one rank file and one splitting pattern; built once for each task.

    Texts are cut at single spaces between other characters, where no pre-token can cross. Each distinct
    piece is split into pre-tokens and encoded once while it is remembered; ids, decimal spellings and
    decoded bytes of a batch are then gathered from flat arrays.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.find = regex.compile(pattern).findall
        self.wide = re.compile(r"\s\s").search
        self.letters = dict(enumerate(byte_letters()))
        token = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.token = _Ragged(token)
        self.decimal = _Ragged([b"%d " % i for i in range(len(token))])
        self._forget()

    def _forget(self) -> None:
        self.new: list[str] = []
        self.count = 0
        self.spaced, self.plain = _Numbered(self, " "), _Numbered(self, "")
        self.ids, self.bounds = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64)

    def _numbers(self, text: str) -> list[int]:
        """The pieces of a text, by number."""
        if self.wide(text):
            return list(map(self.plain.__getitem__, self.find(text)))
        first, *rest = text.split(" ")
        out = [self.plain[first]] if first else []
        out.extend(map(self.spaced.__getitem__, rest))
        return out

    def _learn(self) -> None:
        """Encode the pieces that are new, each pre-token separately."""
        split = [self.find(p) for p in self.new]
        tokens = list(set(chain.from_iterable(split)))
        spelt = [t.encode().decode("latin-1").translate(self.letters) for t in tokens]
        known = dict(zip(tokens, self.model.encode(spelt, num_threads=1), strict=True))
        made = [list(chain.from_iterable(map(known.__getitem__, s))) for s in split]
        start = self.count - len(self.new)
        flat = np.fromiter(chain.from_iterable(made), np.int32)
        ends = int(self.bounds[start]) + np.cumsum([len(m) for m in made])
        self.ids, self.bounds = _room(self.ids, int(ends[-1])), _room(self.bounds, self.count + 1)
        self.bounds[start + 1 : self.count + 1] = ends
        self.ids[self.bounds[start] : ends[-1]] = flat
        self.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where those of each text start and end."""
        if self.count > _KEEP:
            self._forget()
        numbers = [self._numbers(t) for t in texts]
        if self.new:
            self._learn()
        n = np.array([len(x) for x in numbers], dtype=np.int64)
        pieces = np.fromiter(chain.from_iterable(numbers), np.int64, int(n.sum()))
        starts = self.bounds[pieces]
        sizes = self.bounds[pieces + 1] - starts
        per_text = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(n)))]
        return self.ids[_spread(starts, sizes)], per_text

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token.join(ids)[0]

    def rows(self, texts: list[str], wanted: tuple[str, ...]) -> list[list]:
        """For each wanted output, its value for every text."""
        ids, at = self.encode(texts)
        spans = list(zip(at[:-1], at[1:], strict=True))
        out: dict[str, list] = {"n_tokens": np.diff(at).tolist()}
        if "token_ids" in wanted:
            out["token_ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
        if "ids_sha256" in wanted:
            said, ends = self.decimal.join(ids)
            out["ids_sha256"] = [hashlib.sha256(said[ends[a] : max(ends[a], ends[b] - 1)]).hexdigest() for a, b in spans]
        if "decoded" in wanted or "decoded_sha256" in wanted:
            back, ends = self.token.join(ids)
            out["decoded"] = [back[ends[a] : ends[b]] for a, b in spans]
            out["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in out["decoded"]]
        return [out[w] for w in wanted]


class _Numbered(dict):
    """Numbers strings as they come; new ones, after their prefix, go to the codec's list of new pieces."""

    def __init__(self, codec: Codec, prefix: str):
        self.codec, self.prefix = codec, prefix

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.codec.count
        self.codec.count += 1
        self.codec.new.append(self.prefix + piece)
        return n


class _Ragged:
    """Byte strings in one array; ``join`` concatenates those of the given numbers."""

    def __init__(self, values: list[bytes]):
        self.flat = np.frombuffer(b"".join(values), np.uint8)
        self.size = np.array([len(v) for v in values], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def join(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        sizes = self.size[numbers]
        return self.flat[_spread(self.start[numbers], sizes)].tobytes(), np.concatenate(([0], np.cumsum(sizes)))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


def tokenize(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "token_ids"),
) -> DataFrame:
    """Encode each text and decode it again: the id column and the ``outputs`` asked for.

    ``vocabulary`` is the rank file's path, which every executor can open (it ships with the environment).
    """
    picked = docs.select(docs[id_col], docs[text_col])
    fields = [f for f in picked.schema.fields if f.name == id_col]
    schema = ", ".join([f"`{id_col}` {fields[0].dataType.simpleString()}", *(f"{o} {OUTPUTS[o]}" for o in outputs)])
    types = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for whole in batches:
            for batch in pieces(whole, text_col, 1 << 20):
                codec = codec or Codec(read_ranks(vocabulary), pattern)
                ids, texts = columns(batch, id_col, text_col)
                made = codec.rows([t or "" for t in texts.to_pylist()], outputs)
                made = [c if isinstance(c, pa.Array) else pa.array(c, types[OUTPUTS[o]]) for o, c in zip(outputs, made, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *made], [id_col, *outputs])

    return picked.mapInArrow(run, schema)


def with_public_ranks(docs: DataFrame, outputs: tuple[str, ...]) -> DataFrame:
    """``tokenize`` with the 50k rank file and pattern of the public tokenizers."""
    import public_tokenizers

    return tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=outputs)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded with the 50k rank file and decoded again: counts and digests."""
    from .shared import table

    return with_public_ranks(table(spark, sf_dir, "documents"), DIGESTS)
