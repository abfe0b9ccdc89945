"""Language identification (operator 5): averaged hashed subword embeddings with a linear softmax.

A subword is a run of 2 to 4 bytes of the lower-cased letters of a text, word edges included, that doesn't
cross an edge; it is hashed to one of ``BUCKETS`` embeddings. Embeddings and softmax are trained together by
stochastic gradient descent, in numpy, on the driver, from a sample of at most ``per_language`` labelled documents
of each of at most ``languages`` languages. The average of the subwords' embeddings goes through the softmax,
so a bucket's share of every logit is one row of a small table, and a text is scored by summing rows.

A fifth of the sample calibrates, with at most ``passages`` passages drawn from each document: a temperature that makes the scores of short passages probabilities, and the score under which a
prediction is rejected, the highest that rejects at most ``false_reject`` of right predictions.

Cases: text that is null or has no letter is ``und`` with score 0, and rejected; so is everything if no
labelled row can be learned from. Rows with null language are never learned from. Long texts are scored
whole, in segments. Repeated rows are judged alike. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import columns, pieces

BUCKETS, WIDTH, SIZES = 1 << 16, 12, (2, 3, 4)
_LETTER, _NO_LETTER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")  # marks belong to the letters before them
_SEGMENT = 1 << 20
_SNIPPET = 160


def letters(text: str | None) -> bytes:
    """The words of letters of a text, lower-cased, each with a space on either side; nothing, if it has no letter."""
    if not text or not _LETTER.search(text):
        return b""
    kept = _NO_LETTER.sub(" ", text.lower()).strip().encode()
    return b" " + kept + b" " if kept else b""


def subwords(text: bytes) -> np.ndarray:
    """The bucket of each subword."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    edges = np.cumsum(b == 32)
    out = []
    for n in SIZES:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ b[k : k + m]) * np.uint32(0x01000193)
        inner = edges[n - 2 : n - 2 + m] - edges[:m]  # edges strictly between the first and the last byte
        h = h[inner == 0]
        out.append((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _segments(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at edges, which both parts keep."""
    start = 0
    while len(text) - start > _SEGMENT:
        end = text.find(b" ", start + _SEGMENT)
        if end < 0:
            break
        yield text[start : end + 1]
        start = end
    yield text[start:]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a bucket's share of each logit, divided by the temperature
    bias: np.ndarray
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each language for each text."""
        out = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            total, n = np.zeros(len(self.languages)), 0
            for part in _segments(text):
                found = subwords(part)
                total += self.table[found].sum(axis=0, dtype=np.float64)
                n += len(found)
            out[i] = total / max(n, 1) + self.bias
        return _softmax(out)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _snippets(text: bytes) -> list[bytes]:
    out, start = [], 0
    while start < len(text) - 1:
        end = text.find(b" ", start + _SNIPPET)
        end = len(text) - 1 if end < 0 else end
        out.append(text[start : end + 1])
        start = end
    return out


def train(texts: list[str], langs: list[str], epochs: int = 3, most: int = 3000, false_reject: float = 0.002, seed: int = 1, size: int = 16, passages: int = 8) -> Model | None:
    """Fit the model; ``most`` snippets of each language are seen in each epoch, ``size`` in a step."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    rows = [(letters(t), names.index(y)) for t, y in zip(texts, langs, strict=True)]
    rows = [r for r in rows if r[0]]
    if not rows:
        return None
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist())
    pool: list[list[bytes]] = [[] for _ in names]
    for i, (text, y) in enumerate(rows):
        if i not in held:
            pool[y] += _snippets(text)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    soft, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    turns = max(1, sum(-(-min(len(p), most) // size) for p in pool)) * epochs
    turn = 0
    for _ in range(epochs):
        seen = [(s, y) for y, p in enumerate(pool) for s in (p if len(p) <= most else [p[k] for k in rng.choice(len(p), most, replace=False)])]
        order = rng.permutation(len(seen))
        for part in (order[i : i + size].tolist() for i in range(0, len(order), size)):
            rate = 0.5 * max(0.0, 1 - turn / turns)
            turn += 1
            step = [(f, seen[k][1]) for k in part for f in (subwords(seen[k][0]),) if len(f)]
            if not step:
                continue
            found, of = zip(*step, strict=True)
            n = np.array([len(f) for f in found])
            every = np.concatenate(found)
            mean = np.add.reduceat(embed[every], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / n[:, None]
            error = -_softmax(mean @ soft + bias)
            error[np.arange(len(of)), of] += 1
            back = error @ soft.T * (rate * 8 / n)[:, None]
            soft += (rate * mean.T @ error).astype(np.float32)
            bias += (rate * 0.1 * error.sum(axis=0)).astype(np.float32)
            np.add.at(embed, every, np.repeat(back, n, axis=0).astype(np.float32))
    model = Model(names, embed @ soft, bias, 0.0)
    checked = [rows[i] for i in sorted(held)] or rows
    short = []
    for text, y in checked:
        parts = _snippets(text)
        short += [(parts[k], y) for k in sorted(rng.permutation(len(parts))[:passages].tolist())]

    def judged(pairs: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.log(np.maximum(model.scores([t for t, _ in pairs]), 1e-30)), np.array([y for _, y in pairs])

    logits, truth = judged(short)

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean())

    heat = min(np.geomspace(0.25, 8, 30), key=loss)
    model.table, model.bias = (model.table / heat).astype(np.float32), model.bias / heat
    logits, truth = judged(checked)
    p = _softmax(logits)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    model.threshold = float(min(0.5, right[int(false_reject * len(right))])) if len(right) else 0.0
    return model


def _sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, per_language: int, languages: int) -> DataFrame:
    """At most ``per_language`` usable rows of each of the ``languages`` most frequent languages, spread by hash."""
    usable = usable & docs[lang_col].isNotNull() & docs[text_col].isNotNull()
    counts = docs.where(usable).groupBy(docs[lang_col].alias("lang")).agg(F.count("*").alias("n"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(languages).collect()
    place = F.xxhash64(docs[id_col].cast("string"), docs[text_col])
    share = F.lit(None).cast("double")
    for r in counts:
        share = F.when(docs[lang_col] == r["lang"], 2.0 * per_language / r["n"]).otherwise(share)
    low = place.cast("double") / 2.0**64 + 0.5 < share
    picked = docs.where(usable & low).select(docs[text_col].alias("text"), docs[lang_col].alias("lang"), place.alias("place"))
    return picked.selectExpr("text", "lang", "row_number() OVER (PARTITION BY lang ORDER BY place, text) AS n").where(F.col("n") <= per_language)


def identify(docs: DataFrame, labelled: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, languages: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, lang_pred, score and rejected for every row of ``docs``.

    The model learns from rows of ``labelled`` where ``usable`` holds; their id only spreads the sample. It
    knows the ``languages`` most frequent languages of the labels, and no others.
    """
    rows = _sample(labelled, usable, id_col, text_col, lang_col, per_language, languages).collect()
    rows = sorted((r["lang"], r["text"]) for r in rows)
    model = train([t for _, t in rows], [y for y, _ in rows])
    told = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys((id_col, *keep, text_col)))
    picked = docs.select(*(docs[c] for c in names))
    kept = [c for c in names if c in (id_col, *keep)]
    schema = StructType([*picked.select(*(picked[c] for c in kept)).schema.fields, *StructType.fromDDL("lang_pred string, score double, rejected boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for whole in batches:
            for batch in pieces(whole, text_col):
                texts = [letters(t) for t in columns(batch, text_col)[0].to_pylist()]
                if model is None:
                    pred, score = ["und"] * len(texts), [0.0] * len(texts)
                else:
                    p = model.scores(texts)
                    pred = [model.languages[k] if t else "und" for t, k in zip(texts, p.argmax(axis=1).tolist(), strict=True)]
                    score = np.where([bool(t) for t in texts], p.max(axis=1), 0.0).tolist()
                out = [y == "und" and not t or model is None or s < model.threshold for t, y, s in zip(texts, pred, score, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns(batch, *kept), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*kept, "lang_pred", "score", "rejected"])

    return picked.mapInArrow(run, schema)


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def known_languages(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is not rejected, in their columns."""
    # own columns go by place, so that columns called score or rejected don't clash
    names = [f"c{k}" for k in range(len(docs.columns))]
    called = dict(zip(docs.columns, names, strict=True))
    learned = labelled.select(*(labelled[c].alias(called[c]) for c in (id_col, text_col, lang_col)))
    found = identify(docs.toDF(*names), learned, fold(learned[called[id_col]]) != 1, called[id_col], called[text_col], called[lang_col], keep=tuple(names))
    return found.where("not rejected").select(*(F.col(n).alias(c) for c, n in called.items()))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document; the model learns from documents outside the held-out third."""
    from .shared import table

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs, fold(docs["doc_id"]) != 1)
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
