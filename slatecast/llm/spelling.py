"""Spelling variants of the corpus's words: near words, forms and roots, by range reporting on wavelet trees (operator 12).

Words are maximal runs of Latin letters, lower-cased in A-Z, counted over all texts, of at least ``SHORTEST`` code points and ``FEWEST``
occurrences. Two words are near if one inserted, deleted or replaced code point turns one into the other. A word's form is its near
word of most occurrences (ties: the smallest), if it has twice the word's own or more; following forms leads to the root.

The method is two-dimensional range reporting. Words in forward order and in the order of their reverses are the two axes, a word is a
point. An edit at place p leaves the prefix before p and the suffix after p: the words with both lie in the prefix's interval of
the forward order and the suffix's interval of the reverse order, and a wavelet tree over the points reports those in
the rectangle. Replacements ask the words of the same length, insertions those one longer; deletions are insertions seen
from the longer word. Insertions in a run of one letter count at its last place only, so every pair is found once.

The vocabulary is dealt by what an edit leaves alone: an edit in a word's right half keeps the left half, and the other way round, so each
word goes to the cells of its two halves (as itself and as the longer word of a pair), and a cell asks for edits in its own
places only. A cell of over ``most`` words is halved again, and so on: a cell of one place holds 119 words of one length at
the most. Cells are packed into shards, one index each.

Cases: null and empty texts and texts without letters have no words. A null id leaves all its runs as they are. Repeated
rows count as often as they occur. Very long texts are searched in parts that end between runs. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import _roots
from .manifest import CRC_TABLE, crc32_sql
from .shared import columns, materialise, pieces, table, texts_of

SHORTEST, FEWEST = 5, 3
#: One document's word in so many loses a letter, so that variants exist.
LOSES = 97
_LETTERS = "a-zA-ZÀ-ÿ"
_RUN = re.compile(f"[{_LETTERS}]{{{SHORTEST},}}")
_GAP = re.compile(f"[^{_LETTERS}]")
_PART = 1 << 22
_HELD = 200_000


def _counts(text: str) -> Counter:
    """Runs of a text and how often they occur."""
    if len(text) <= _PART:
        return Counter(_RUN.findall(text))
    out: Counter = Counter()
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(len(text), at + _PART))
        end = gap.start() if gap else len(text)
        out.update(_RUN.findall(text[at:end]))
        at = end
    return out


def _spelt(doc_id, run: str, h: int) -> str:
    """A run as this document spells it: every ``LOSES``th lacks one letter."""
    h = zlib.crc32(run.encode(), h)
    if h % LOSES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fewest: int = FEWEST) -> DataFrame:
    """(word, n): distinct words of at least ``SHORTEST`` code points and how often they occur, if ``fewest`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for part in pieces(batch, text_col):
                ids, texts = columns(part, id_col, text_col)
                for i, text in zip(ids.to_pylist(), texts_of(texts), strict=True):
                    seed = zlib.crc32(f"{i}:".encode())
                    for word, n in _counts(text.lower().decode(errors="replace")).items():
                        if i is not None:
                            word = _spelt(i, word, seed)
                        if len(word) >= SHORTEST:
                            held[word] += n
                    if len(held) > _HELD:
                        yield out()
        if held:
            yield out()

    parts = docs.select(docs[id_col].alias(id_col), docs[text_col].alias(text_col)).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


class Wavelet:
    """A wavelet tree, by levels, over the numbers 0 to n - 1 in some order."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rectangles [left, right) x [low, high): (rectangle, value) of every point in one."""
        at = np.flatnonzero((left < right) & (low < high))
        left, right, value = left[at], right[at], np.zeros(len(at), dtype=np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            l1, r1 = ones[left], ones[right]
            at = np.concatenate((at, at))
            left, right = np.concatenate((left - l1, zeros + l1)), np.concatenate((right - r1, zeros + r1))
            value = np.concatenate((value, value | 1 << b))
            keep = np.flatnonzero((left < right) & (value < high[at]) & (value + (1 << b) > low[at]))
            at, left, right, value = at[keep], left[keep], right[keep], value[keep]
        return at, value


class _Order:
    """Words of one length and the next, cell by cell, in one of the two orders."""

    def __init__(self, cells: np.ndarray, letters: np.ndarray):
        n, width = letters.shape
        keyed = np.zeros((n, width + 5), np.uint8)
        keyed[:, :4] = cells.astype(">u4").view(np.uint8).reshape(n, 4)
        keyed[:, 4:-1] = letters
        keyed[:, -1] = 1  # no key ends in a zero byte, which numpy would take for padding
        self.by_rank = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 5}").ravel(), kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.by_rank] = np.arange(n)
        ordered = letters[self.by_rank]
        differs = np.ones((n, width + 1), bool)
        differs[1:, :width] = ordered[1:] != ordered[:-1]
        #: How much each word shares with the one before it; nothing across cells.
        self.shared = differs.argmax(axis=1)
        self.shared[0] = -1
        self.shared[1:][np.diff(cells[self.by_rank]) != 0] = -1

    def most_shared(self) -> np.ndarray:
        """By entry: the most that it shares with another word of its cell."""
        out = np.empty(len(self.rank), np.int64)
        out[self.by_rank] = np.maximum(self.shared, np.append(self.shared[1:], -1))
        return out

    def interval(self, entries: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the words of each entry's cell that share its first ``length`` letters."""
        cuts = np.append(np.flatnonzero(self.shared < length), len(self.rank))
        at = np.searchsorted(cuts, self.rank[entries], side="right")
        return cuts[at - 1], cuts[at]


def _class_pairs(size: int, words: list[bytes], cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs among the words of ``size`` letters (both ways) and of them with words one longer (one way)."""
    width = size + 1
    lengths = np.array([len(w) for w in words])
    forward = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    backward = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    ahead, behind = _Order(cells, forward), _Order(cells, backward)
    prefix, suffix = ahead.most_shared(), behind.most_shared()
    for longer in (0, 1):
        members = lengths == size + longer
        if not members.any():
            continue
        # ranks among the words asked for
        to_ahead = np.concatenate(([0], np.cumsum(members[ahead.by_rank])))
        to_behind = np.concatenate(([0], np.cumsum(members[behind.by_rank])))
        points = ahead.by_rank[members[ahead.by_rank]]
        by_behind = behind.by_rank[members[behind.by_rank]]
        tree = Wavelet(to_behind[behind.rank[points]])
        # places where an entry shares enough on both sides
        after = size - 1 + longer
        first = np.maximum(low, after - suffix)
        last = np.minimum(high - 1 + (longer == 1) * (high == size), prefix)
        entries = np.flatnonzero((lengths == size) & (first <= last))
        for p in range(int(first[entries].min()), int(last[entries].max()) + 1) if len(entries) else ():
            asked = entries[(first[entries] <= p) & (p <= last[entries])]
            if not len(asked):
                continue
            a, b = ahead.interval(asked, p)
            c, d = behind.interval(asked, after - p)
            at, value = tree.report(to_ahead[a], to_ahead[b], to_behind[c], to_behind[d])
            one, other = asked[at], by_behind[value]
            if longer:
                keep = np.flatnonzero(forward[other, p] != forward[one, p])  # the last place of a run; 0 at the end of the shorter
            else:
                keep = np.flatnonzero(one != other)
            yield one[keep], other[keep]


def _shard(key: tuple, rows: pa.Table) -> pa.Table:
    """Near words within a shard: for each word how many, and the best of them."""
    words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    size, low, high, cell, n = (rows.column(c).to_numpy() for c in ("size", "low", "high", "cell", "n"))
    _, cells = np.unique(np.stack((size, low, high, cell)), axis=1, return_inverse=True)
    cells = cells.ravel()
    ones, others = [], []
    for s in np.unique(size):
        rows_of = np.flatnonzero(size == s)
        for a, b in _class_pairs(int(s), [words[i] for i in rows_of], cells[rows_of], low[rows_of], high[rows_of]):
            a, b = rows_of[a], rows_of[b]
            ones.append(a)
            others.append(b)
            up = np.array([len(words[i]) > s for i in b], bool)
            ones.append(b[up])  # a longer word learns of the shorter; words of one length ask for each other
            others.append(a[up])
    one, other = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, others))
    # the same word sits in several cells: name it by its first entry, and order words by code points
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.zeros(len(words), np.int64)
    for i, (before, now) in enumerate(zip([None, *order], order, strict=False)):
        place[now] = place[before] if i and words[before] == words[now] else i
    one_p, other_p = place[one], place[other]
    by = np.lexsort((other_p, -n[other], one_p))
    one_p, other = one_p[by], other[by]
    starts = np.flatnonzero(np.append(True, one_p[1:] != one_p[:-1])) if len(one_p) else np.zeros(0, np.int64)
    names = [words[order[p]].decode("latin-1") for p in one_p[starts]]
    return pa.table(
        {
            "word": pa.array(names, pa.string()),
            "near": np.diff(np.append(starts, len(one_p))).astype(np.int64),
            "form_n": n[other[starts]].astype(np.int64),
            "form": pa.array([words[i].decode("latin-1") for i in other[starts]], pa.string()),
        }
    )


def _halved(entries: DataFrame) -> DataFrame:
    """Each entry (size, low, high, word, n) in the two halves of its cell's places, with the number of the cell it is in."""
    middle = (F.col("low") + F.expr("(high - low) DIV 2")).alias("middle")
    halves = entries.select("size", "word", "n", "low", "high", middle)
    halves = halves.select("size", "word", "n", F.explode(F.array(F.struct("low", F.col("middle").alias("high")), F.struct(F.col("middle").alias("low"), "high"))).alias("at"))
    halves = halves.select("size", "at.low", "at.high", "word", "n").where("low < high")
    word, after = F.col("word"), F.col("size") - F.col("high")
    kept = [F.substring(word, F.lit(1), F.col("low")), F.substring(word, F.length(word) - after + 1, after)]
    return halves.withColumn("cell", F.xxhash64("size", "low", "high", *kept))


def near_words(vocab: DataFrame, most: int = 50_000, shard_rows: int = 50_000, shard_bytes: int = 16 << 20) -> DataFrame:
    """(word, near, form_n, form): for each word with near words their number and the best of them.

    ``vocab`` is (word, n) with distinct words of ``SHORTEST`` or more letters below code point 256. ``most`` has to be above the 14,161
    words that can differ in two letters.
    """
    length = F.length("word")
    entries = vocab.select(F.explode(F.array(length, length - 1)).alias("size"), F.lit(0).alias("low"), "word", "n").where(F.col("size") >= SHORTEST)
    entries = materialise(_halved(entries.withColumn("high", F.col("size"))), "cells")
    done = None
    while True:
        hot = entries.groupBy("size", "low", "high", "cell").count().where((F.col("count") > most) & (F.col("high") - F.col("low") > 1)).drop("count")
        hot = materialise(hot, "hot-cells")
        if hot.isEmpty():
            break
        keys = ["size", "low", "high", "cell"]
        cool = entries.join(hot, keys, "left_anti")
        done = cool if done is None else done.unionByName(cool)
        entries = materialise(_halved(entries.join(hot, keys, "left_semi")), "cells")
    entries = entries if done is None else done.unionByName(entries)
    n, octets = entries.agg(F.count("*"), F.coalesce(F.sum(F.length("word").cast("long")), F.lit(0))).first()
    shards = max(1, -(-n // shard_rows), -(-octets // shard_bytes))
    # a shard is a few cells: half of them by left halves, half by right ones
    found = entries.withColumn("shard", F.pmod(F.xxhash64("cell"), F.lit(shards))).groupBy("shard").applyInArrow(_shard, "word string, near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("near"), best).selectExpr("word", "near", "-best.less AS form_n", "best.form AS form")


def variants(vocab: DataFrame, **bounds: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocab`` (word, n)."""
    vocab = materialise(vocab, "vocabulary")
    near = near_words(vocab, **bounds).select(F.col("word").alias("word_"), "near", F.col("form_n").alias("n_"), F.col("form").alias("form_"))
    common = F.col("n_") >= 2 * F.col("n")
    out = vocab.join(near, F.col("word") == F.col("word_"), "left")
    out = out.select("word", F.when(common, F.col("form_")).alias("form"), "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("n_")).alias("form_n"))
    out = materialise(out, "forms")
    ends, _ = _roots(out.where("form IS NOT NULL").select(F.col("word").alias("at"), F.col("form").alias("to")))
    out = out.join(ends, F.col("word") == F.col("at"), "left")
    return out.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents: its form, root and counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(vocabulary(docs))


OP12_SQL = f"""
WITH RECURSIVE crcs AS (SELECT {CRC_TABLE} AS crc),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
  ) GROUP BY ALL HAVING length(run) >= {SHORTEST}
),
hashed AS (SELECT run, n, {crc32_sql("(doc_id::VARCHAR || ':' || run)")} AS h FROM runs, crcs),
words AS (
  SELECT CASE WHEN h % {LOSES} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= {FEWEST}
),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS short FROM words, unnest(range(0, length(word))) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.short = b.word
),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n,
         CASE WHEN b.top >= 2 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.n = b.top) END AS form
  FROM words w LEFT JOIN best b ON w.word = b.word
),
walk AS (
  SELECT word, coalesce(form, word) AS at FROM forms
  UNION SELECT w.word, f.form FROM walk w JOIN forms f ON w.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w ON f.word = w.word JOIN forms e ON e.word = w.at AND e.form IS NULL
"""
