"""Benchmark decontamination (operator 1): rare n-gram seeds, then Smith-Waterman alignment of words.

Words are runs of letters and digits, in lower case. Benchmark items are the stated query set: they are cut into
even pieces of at most ``_PIECE`` words, each followed by the next ``_RUN - 1`` words of its item, and pieces go into blocks of at most ``_BLOCK`` bytes. For each block:

1. A scan of the documents counts, for every three-word gram of the block, the documents that hold it.
2. Seeds are the rare grams: those that at most ``_FEW`` documents or one in ``_PART`` hold.
3. A second scan joins documents to pieces. Grams that at most ``_HELD`` pieces have join by themselves. Items that are worded alike share
   grams that many pieces have; such a gram joins only pieces that the document has a better reason to hold: another gram, or, since
   a score takes so many words of the piece within so many words of the document, enough of the piece's rarest words close together.
   Where two grams of a piece (one, if it has no more) lie close together in a document, and the words that the region shares
   with the piece can add up to the least score, the region is aligned with the piece by Smith-Waterman over
   words: 2 for a match, -1 for a mismatch or a gap. So neither common grams nor edits hide a passage. Only leaks leave the task.
4. The score is the share of the piece's perfect score; a leak has at least ``least``, or, however long the piece,
   as much as ``_RUN`` words in a row. Edits that leave fewer than two grams hide a copy.

Benchmarks of over ``_BLOCK`` bytes of word hashes, some two million words, take two scans for each such block.

Cases: null or empty texts match nothing, and neither do items of fewer than three words. Ids are integers. Rows with a
null id are reported with a null id; ``version`` (a hash of the text) tells rows apart that share an id. Repeated rows
of documents give one row, and those of the benchmark count once. Items that share text are all reported. Extra
columns are ignored, and kept by ``drop_contaminated``, whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import columns, fresh, materialise, pieces

GRAM = 3
_PIECE, _BLOCK, _SLACK, _RUN = 512, 16 << 20, 8, 40
_FEW, _PART, _HELD = 50, 10_000, 64
_NO_WORD = re.compile(r"[\W_]+")


def normal(text: str | None) -> bytes:
    return _NO_WORD.sub(" ", (text or "").lower()).strip().encode()


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and where it ends in the region."""
    steps = np.arange(len(region))
    above, best, end = np.zeros(len(region) + 1, dtype=np.int64), 0, 0
    for w in item.tolist():
        row = np.maximum(above[:-1] + np.where(region == np.uint64(w), 2, -1), above[1:] - 1)
        row = np.maximum(np.maximum.accumulate(row + steps) - steps, 0)
        above[1:] = row
        if (top := int(row.max(initial=0))) > best:
            best, end = top, int(row.argmax()) + 1
    return best, end


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items in pieces: item_id, piece, hashes of its words."""
    picked = benchmark.select(benchmark[id_col].cast("bigint").alias("item_id"), benchmark[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                out = []
                for i, text in zip(*(x.to_pylist() for x in columns(batch, "item_id", "text")), strict=True):
                    h = words.word_hashes(normal(text)) if text else np.zeros(0, np.uint64)
                    parts = np.array_split(np.arange(len(h)), -(-len(h) // _PIECE)) if len(h) >= GRAM else []
                    out += [(i, k, h[p[0] : p[-1] + _RUN].tobytes()) for k, p in enumerate(parts)]
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([x[0] for x in out], pa.int64()), "piece": pa.array([x[1] for x in out], pa.int64()), "words": pa.array([x[2] for x in out], pa.binary())})

    return picked.mapInArrow(run, "item_id bigint, piece bigint, words binary")


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each range [start, start + n), and which range they are of."""
    of = np.repeat(np.arange(len(n)), n)
    return of, start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


class _Grams:
    """The grams of a block's pieces, sorted by hash, with a table of bits that says no quickly."""

    def __init__(self, texts: list[np.ndarray]):
        found = [words.window_hashes(t, GRAM) for t in texts]
        h = np.concatenate(found)
        piece = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        place = np.concatenate([np.arange(len(f)) for f in found])
        order = np.argsort(h, kind="stable")
        self.h, self.piece, self.place = h[order], piece[order], place[order]
        self.size = np.array([len(t) for t in texts])
        self.shift = np.uint64(64 - max(16, int(len(h)).bit_length() + 4))
        self.bits = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.bits[h >> self.shift] = True
        self.first = np.flatnonzero(np.append(True, self.h[1:] != self.h[:-1])) if len(h) else np.zeros(0, np.int64)
        self.times = np.diff(np.append(self.first, len(h)))
        self.distinct = self.h[self.first]

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each occurrence in ``h``: its index there and the number of its gram among the distinct ones."""
        near = np.flatnonzero(self.bits[h >> self.shift])
        if not len(self.distinct) or not len(near):
            return near[:0], near[:0]
        at = np.minimum(np.searchsorted(self.distinct, h[near]), len(self.distinct) - 1)
        hit = self.distinct[at] == h[near]
        return near[hit], at[hit]

    def entries(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All entries of distinct grams: the index in ``gram``, and the entry."""
        n = self.times[gram]
        return _ranges(self.first[gram], n)


def _counts(docs: DataFrame, texts) -> DataFrame:
    """(gram, n): in how many documents each gram occurs, by the place of its first entry in ``_Grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Grams(texts.value)
        total = np.zeros(len(g.h), dtype=np.int64)
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                doc = words.split([normal(t) for t in columns(batch, "text")[0].to_pylist()])
                h, at = doc.windows(GRAM)
                where, gram = g.known(h)
                if len(where):
                    held = np.unique(np.stack((doc.owner[at[where]], g.first[gram])), axis=1)[1]
                    total += np.bincount(held, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(seen), "n": pa.array(total[seen])})

    return docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def rare(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """Which grams are seeds, given in how many documents each occurs."""
    return (counts > 0) & (counts <= max(_FEW, n_docs // _PART))


def _wanted(size: int, least: float) -> float:
    """The least score of a leak of a piece of ``size`` words."""
    return min(max(least * 2 * size, 2 * min(size, 8)), 2 * _RUN)


class _RareWords:
    """Which pieces a document has enough rare words of, close together, to reach the least score.

    A score of s takes s / 2 words of the piece, in at most 3 * size - s words of the document, as every other word costs one. Some of
    the words that a piece needs are among its rarest, so only these are looked up, those that fewest pieces have: as many
    as make one of them certain, and up to half of what is needed as long as they aren't common.
    """

    def __init__(self, texts: list[np.ndarray], pieces_: np.ndarray, least: float):
        told = [np.unique(texts[p], return_counts=True) for p in pieces_]
        every = np.concatenate([w for w, _ in told]) if told else np.zeros(0, np.uint64)
        names, often = np.unique(every, return_counts=True)
        hashes, owners = [], []
        self.least, self.span = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for p, (w, n) in zip(pieces_.tolist(), told, strict=True):
            size, wanted = int(n.sum()), _wanted(int(n.sum()), least)
            need = -(-int(np.ceil(wanted)) // 2)
            held = often[np.searchsorted(names, w)]
            order = np.argsort(held, kind="stable")
            left = size - np.cumsum(n[order])  # words that are not looked up, if the first so many are
            k, most_k = (int(np.argmax(left <= need - x)) + 1 for x in (1, max(1, need // 2)))
            k = max(k, min(most_k, int(np.searchsorted(held[order], _HELD, side="right"))))
            sought = need - int(left[k - 1])
            most = np.sort(n[order[:k]])[::-1]
            self.least[p] = int(np.argmax(np.cumsum(most) >= sought)) + 1
            self.span[p] = int(3 * size - wanted) + 1
            hashes.append(w[order[:k]])
            owners.append(np.full(k, p))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h, self.piece = h[order], (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]

    def near(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that the document may hold, and where enough of their rare words begin."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.searchsorted(self.h, doc)
        at, entry = _ranges(start, np.searchsorted(self.h, doc, side="right") - start)
        piece = self.piece[entry]
        order = np.lexsort((at, piece))
        at, piece = at[order], piece[order]
        last = np.arange(len(at)) + self.least[piece] - 1
        fits = last < len(at)
        here, last = np.flatnonzero(fits), last[fits]
        close = (piece[last] == piece[here]) & (at[last] - at[here] < self.span[piece[here]])
        return piece[here[close]], at[here[close]]


def shared_words(words_of_item: tuple[np.ndarray, np.ndarray], region: np.ndarray) -> int:
    """How many of an item's words (sorted, with their counts) the region holds, repeats by the smaller count."""
    item, n = words_of_item
    at = np.searchsorted(item, region)
    at[at == len(item)] = 0
    return int(np.minimum(np.bincount(at[item[at] == region], minlength=len(item)), n).sum())


class _Judge:
    """Regions of documents that meet a piece in its grams, and their alignments."""

    def __init__(self, texts: list[np.ndarray], seed: np.ndarray, least: float):
        self.texts, self.seed, self.least = texts, seed, least
        self.grams = g = _Grams(texts)
        self.n_grams = np.maximum(g.size - GRAM + 1, 0)
        self.vocabulary: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # grams of many pieces, and the pieces that have two of them (or that one only)
        self.common = g.times > _HELD
        self.hot = np.repeat(self.common, g.times)
        of = np.repeat(np.arange(len(g.first)), g.times)
        self.keys = of * len(texts) + g.piece  # rises with the entries
        held = np.unique(self.keys[self.common[of]]) % max(len(texts), 1)
        enough = np.bincount(held, minlength=len(texts)) >= np.minimum(2, self.n_grams) if len(held) else np.zeros(len(texts), bool)
        self.rare_words = _RareWords(texts, np.flatnonzero(enough & (self.n_grams > 0)), least)

    def _hits(self, doc: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of grams and their entries, for all pieces that a document may hold; pieces and places that rare words speak for, as sorted numbers."""
        g = self.grams
        h, at = doc.windows(GRAM)
        where, gram = g.known(h)
        at = at[where]
        common = self.common[gram]
        of, entry = g.entries(gram[~common])
        places, found, spoken = [at[~common][of]], [entry], [np.zeros(0, np.int64)]
        hot_at, hot_gram = at[common], gram[common]
        hot_owner = doc.owner[hot_at]
        cold_owner = doc.owner[places[0]]
        for d in np.unique(hot_owner).tolist():
            mine = slice(*np.searchsorted(hot_owner, (d, d + 1)))
            cold = slice(*np.searchsorted(cold_owner, (d, d + 1)))
            first = int(doc.first[d])
            near, begins = self.rare_words.near(doc.hashes[first : first + int(doc.count[d])])
            spoken.append((near << 32) + first + begins)
            maybe = np.unique(np.concatenate((g.piece[entry[cold]], near)))
            step = max(1, (4 << 20) // max(1, mine.stop - mine.start))
            for k in range(0, len(maybe), step):
                keys = hot_gram[mine][:, None] * len(self.texts) + maybe[None, k : k + step]
                start = np.searchsorted(self.keys, keys.ravel())
                n = np.searchsorted(self.keys, keys.ravel(), side="right") - start
                of, more = _ranges(start, n)
                places.append(hot_at[mine][of // keys.shape[1]])
                found.append(more)
        return np.concatenate(places), np.concatenate(found), np.sort(np.concatenate(spoken))

    def leaks(self, doc: words.Words) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(document, piece, score, seeds hit, first word, end word) of each leak."""
        g = self.grams
        at, gram, spoken = self._hits(doc)
        if not len(at):
            return
        owner, piece = doc.owner[at], g.piece[gram]
        order = np.lexsort((at, piece, owner))
        at, gram, owner, piece = at[order], gram[order], owner[order], piece[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1]) | (np.diff(at) > g.size[piece[1:]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        if not len(starts):
            return
        enough = sizes >= np.minimum(2, self.n_grams[piece[starts]])
        # grams of many pieces alone make no region unless rare words are near
        of, span = piece[starts], self.rare_words.span[piece[starts]] + _SLACK
        low, high = at[starts] - span, at[starts + sizes - 1] + span
        told = np.searchsorted(spoken, (of << 32) + np.maximum(low, 0)) < np.searchsorted(spoken, (of << 32) + high, side="right")
        enough &= ~np.logical_and.reduceat(self.hot[gram], starts) | told
        for a, n in zip(starts[enough].tolist(), sizes[enough].tolist(), strict=True):
            hit, p, d = gram[a : a + n], int(piece[a]), int(owner[a])
            if len(np.unique(g.place[hit])) < min(2, self.n_grams[p]):
                continue
            first, last = int(doc.first[d]), int(doc.first[d] + doc.count[d])
            shift = at[a : a + n] - g.place[hit]
            lo, hi = max(first, int(shift.min()) - _SLACK), min(last, int(shift.max() + g.size[p]) + _SLACK)
            item, near = self.texts[p], doc.hashes[lo:hi]
            wanted = _wanted(len(item), self.least)
            seeds = len(np.unique(g.place[hit[self.seed[hit]]]))
            if p not in self.vocabulary:
                self.vocabulary[p] = np.unique(item, return_counts=True)
            if 2 * shared_words(self.vocabulary[p], near) < wanted:
                continue
            score, end = align(item, near)
            if score >= wanted:
                _, size = align(item[::-1], near[:end][::-1])
                yield d, p, score / (2 * len(item)), seeds, lo - first + end - size, lo - first + end


def _scan(docs: DataFrame, block, least: float) -> DataFrame:
    kinds = {"id": pa.int64(), "version": pa.int64(), "piece": pa.int64(), "score": pa.float64(), "n_seeds": pa.int64(), "first_word": pa.int64(), "end_word": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(*block.value, least)
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                ids, versions, text = (x.to_pylist() for x in columns(batch, "id", "version", "text"))
                out = [(ids[d], versions[d], *rest) for d, *rest in judge.leaks(words.split([normal(t) for t in text]))]
                made = list(zip(*out, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), made, strict=True)})

    return docs.mapInArrow(run, "id bigint, version bigint, piece bigint, score double, n_seeds bigint, first_word bigint, end_word bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, version, item_id, score, n_seeds, first_word and end_word of the best alignment of each leak."""
    spark = docs.sparkSession
    # equal pieces are one, whichever items hold them
    items = materialise(_items(benchmark, item_col, item_text_col), "benchmark-items")
    texts = materialise(items.select("words").distinct(), "benchmark-pieces")
    n_blocks = max(1, -(-(texts.agg(F.sum(F.length("words"))).first()[0] or 0) // _BLOCK))
    picked = docs.select(docs[id_col].cast("bigint").alias("id"), F.xxhash64(docs[text_col]).alias("version"), docs[text_col].alias("text"))
    n_docs, found = picked.count(), []
    for k in range(n_blocks):
        block = texts.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == k).collect()
        if not block:
            continue
        made = [np.frombuffer(bytes(r["words"]), np.uint64) for r in block]
        told = spark.sparkContext.broadcast(made)
        grams = _Grams(made)
        counts = np.zeros(len(grams.h), dtype=np.int64)
        seen = _counts(picked, told).toArrow()
        counts[seen.column("gram").to_numpy()] = seen.column("n").to_numpy()
        told.destroy()
        judged = spark.sparkContext.broadcast((made, rare(counts[np.searchsorted(grams.h, grams.h)], n_docs)))
        part = materialise(_scan(picked, judged, least), "benchmark-leaks")
        judged.destroy()
        pieces_ = spark.createDataFrame(pa.table({"piece": pa.array(range(len(block)), pa.int64()), "words": pa.array([bytes(r["words"]) for r in block], pa.binary())}))
        found.append(part.join(pieces_, "piece").join(items.select("item_id", "words"), "words").drop("words", "piece"))
    if not found:
        found = [spark.createDataFrame([], "id bigint, version bigint, score double, n_seeds bigint, first_word bigint, end_word bigint, item_id bigint")]
    best = reduce(DataFrame.unionByName, found).groupBy("id", "version", "item_id").agg(F.max(F.struct("score", "n_seeds", -F.col("first_word"), "end_word")).alias("best"))
    return best.select(F.col("id").alias("doc_id"), "version", "item_id", F.round("best.score", 6).alias("score"), "best.n_seeds", (-F.col("best.col3")).alias("first_word"), "best.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, in their columns."""
    leak, version = fresh(docs, "leak_id_", "leak_version_")
    found = materialise(contaminated(docs, benchmark, id_col, text_col).select("doc_id", "version").distinct(), "contaminated")
    found = found.select(F.col("doc_id").alias(leak), F.col("version").alias(version))
    same = docs[id_col].cast("bigint").eqNullSafe(found[leak]) & (F.xxhash64(docs[text_col]) == found[version])
    return docs.join(found, same, "left_anti")


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds, copied or edited."""
    from .shared import table

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "n_seeds", "first_word", "end_word")
