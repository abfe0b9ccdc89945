"""Removal of repeated word windows across a corpus (operator 9).

Count-min prefilter, then exact grouping:

1. Documents are written in blocks of a few MB.
2. Each block counts its windows in a count-min sketch. The sketch's width follows the number of windows in
   the table (``_LOAD`` cells a window in each of ``_ROWS`` rows), so its error is the same at every size. No
   task holds it whole: a block sends the cells that it touched, compressed, to the shard that owns that
   range of cells; shards add up the blocks' counts and answer, for each block, which of its cells
   hold two or more. Counts only overestimate, so no repeated window is missed.
3. A block then sends its first occurrence of each window that is estimated repeated, by hash, to a second
   set of shards, which find the first occurrence over all blocks exactly (on 96 bits of hash) and tell each
   block the windows that start earlier elsewhere. A window that is very frequent costs one entry a block.
4. Blocks drop the words that such windows, or own repeats, cover.

Cases: null text counts as empty. Null ids sort last. Rows that share an id are ordered as they come
in a block, and otherwise by block. Repeated rows are repeats like any other: the first is kept. Texts
with fewer words than a window are kept whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .packing import blocks, open_body, pack, unpack
from .shared import columns, materialise

_ROWS, _LOAD = 2, 8
_SEEDS = (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D)
_BLOCK = 6 << 20
_CELLS = 25  # bits of a cell's place in its shard, at most
_LAST = np.iinfo(np.int64).max


def _bits(n_windows: int) -> tuple[int, int, int]:
    """Bits of a cell, of a sketch shard and of a shard of exact grouping."""
    cell = max(20, int(n_windows * _LOAD - 1).bit_length() if n_windows else 0)
    return cell, max(6, cell - _CELLS), max(6, int(n_windows).bit_length() - 21)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return words.mix(h ^ np.uint64(_SEEDS[row])) >> np.uint64(64 - bits)


def _cuts(values: np.ndarray, shift: int, n: int) -> np.ndarray:
    """Where the sorted values of each shard start and end."""
    return np.searchsorted(values, np.arange(1, n, dtype=np.uint64) << np.uint64(shift)).tolist()


def _shards(values: np.ndarray, shift: int, bits: int) -> Iterator[tuple[int, int, int]]:
    ends = [*_cuts(values, shift, 1 << bits), len(values)]
    start = 0
    for shard, end in enumerate(ends):
        if end > start:
            yield shard, start, end
        start = end


def _sketch(found: DataFrame, window: int, cell: int, shard: int) -> DataFrame:
    """Every block's part of the sketch: for each row and shard the cells that it touched and their counts."""
    mask = np.uint64((1 << (cell - shard)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(*(x.to_pylist() for x in columns(batch, "block_id", "body")), strict=True):
                h, _ = words.split(open_body(body)[1]).windows(window)
                out = []
                for row in range(_ROWS):
                    cells, counts = np.unique(_cells(h, row, cell), return_counts=True)
                    counts = np.minimum(counts, 255).astype(np.uint8)
                    for s, a, b in _shards(cells, cell - shard, shard):
                        places = (cells[a:b] & mask).astype(np.uint32)
                        out.append((row, s, block, pack(places, rising=True), pack(counts[a:b])))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(("sketch_row", "shard", "block_id", "places", "counts"), zip(*out, strict=True), strict=True)))

    return found.select("block_id", "body").mapInArrow(run, "sketch_row bigint, shard bigint, block_id bigint, places binary, counts binary")


def _merged(parts: DataFrame, cell: int, shard: int) -> DataFrame:
    """Add up the parts of each shard; answer each part with a bit for every cell that it sent."""
    size = 1 << (cell - shard)

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros(size, dtype=np.uint32)
        places = [unpack(x, np.uint32, rising=True) for x in group["places"].to_pylist()]
        for at, counts in zip(places, group["counts"].to_pylist(), strict=True):
            total[at] += unpack(counts, np.uint8)
        bits = [np.packbits(total[at] > 1).tobytes() for at in places]
        return pa.table({"sketch_row": group["sketch_row"], "shard": group["shard"], "block_id": group["block_id"], "repeated": pa.array(bits, pa.binary())})

    return parts.groupBy("sketch_row", "shard").applyInArrow(run, "sketch_row bigint, shard bigint, block_id bigint, repeated binary")


def _asked(found: DataFrame, answers: DataFrame, window: int, bits: tuple[int, int, int]) -> DataFrame:
    """Each block's first occurrence of every window that the sketch estimates repeated."""
    cell, shard, exact = bits
    names = ("shard", "block_id", "hashes", "checks", "ids")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, body in zip(left["block_id"].to_pylist(), left["body"].to_pylist(), strict=True):
            ids, texts = open_body(body)
            doc = words.split(texts)
            h, at = doc.windows(window)
            bit = {(r, s): b for r, s, b in zip(*(right[c].to_pylist() for c in ("sketch_row", "shard", "repeated")), strict=True)}
            often = np.ones(len(h), dtype=bool)
            for row in range(_ROWS if len(h) else 0):
                cells, back = np.unique(_cells(h, row, cell), return_inverse=True)
                flags = [np.unpackbits(np.frombuffer(bit[row, s], np.uint8), count=b - a) for s, a, b in _shards(cells, cell - shard, shard)]
                often &= np.concatenate(flags).astype(bool)[back]
            chosen = np.flatnonzero(often)
            value, first = np.unique(h[chosen], return_index=True)
            first = chosen[first]
            check = (words.window_hashes(doc.hashes, window, words.WINDOW_B)[at[first]] >> np.uint64(32)).astype(np.uint32)
            order = np.array([_LAST if i is None else i for i in ids], dtype=np.int64)[doc.owner[at[first]]] if len(first) else np.zeros(0, np.int64)
            for s, a, b in _shards(value, 64 - exact, exact):
                out.append((s, block, pack(value[a:b], rising=True), pack(check[a:b]), pack(order[a:b])))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        made = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, made, types, strict=True)})

    left, right = found.select("block_id", "body").groupBy("block_id"), answers.groupBy("block_id")
    return left.cogroup(right).applyInArrow(run, "shard bigint, block_id bigint, hashes binary, checks binary, ids binary")


def _later(asked: DataFrame) -> DataFrame:
    """For each block the windows whose first occurrence is in another block."""

    def run(group: pa.Table) -> pa.Table:
        block = group["block_id"].to_pylist()
        hashes = [unpack(x, np.uint64, rising=True) for x in group["hashes"].to_pylist()]
        row = np.repeat(np.arange(len(block)), [len(x) for x in hashes])
        h = np.concatenate(hashes)
        check = np.concatenate([unpack(x, np.uint32) for x in group["checks"].to_pylist()])
        ids = np.concatenate([unpack(x, np.int64) for x in group["ids"].to_pylist()])
        order = np.lexsort((np.array(block)[row], ids, check, h))
        h, check, row = h[order], check[order], row[order]
        later = np.concatenate(([False], (h[1:] == h[:-1]) & (check[1:] == check[:-1])))
        h, row = h[later], row[later]
        by = np.argsort(row, kind="stable")
        lost = [(block[i], pack(part, rising=True)) for i, part in _runs(row[by], h[by])]
        return pa.table({"block_id": pa.array([x for x, _ in lost], pa.int64()), "hashes": pa.array([x for _, x in lost], pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, "block_id bigint, hashes binary")


def _runs(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(keys):
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
            yield int(keys[part[0]]), values[part[0] : part[-1] + 1]


def _cleaned(found: DataFrame, later: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Documents without the words that repeated windows cover."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lost = [unpack(x, np.uint64, rising=True) for x in right["hashes"].to_pylist()]
        lost = np.unique(np.concatenate(lost)) if lost else np.zeros(0, np.uint64)
        out = []
        for body in left["body"].to_pylist():
            ids, texts = open_body(body)
            doc = words.split(texts)
            h, at = doc.windows(window)
            repeated = np.ones(len(h), dtype=bool)
            repeated[np.unique(h, return_index=True)[1]] = False
            if len(lost) and len(h):
                near = np.minimum(np.searchsorted(lost, h), len(lost) - 1)
                repeated |= lost[near] == h
            edge = np.zeros(int(doc.count.sum()) + 1, dtype=np.int64)
            starts = at[repeated]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            keep = np.cumsum(edge)[:-1] == 0
            for i, text, n, a in zip(ids, texts, doc.count.tolist(), doc.first.tolist(), strict=True):
                own = keep[a : a + n]
                left_over = int(own.sum())
                kept = text if left_over == n else b" ".join(compress(text.split(b" "), own.tolist()))
                out.append((i, n, n - left_over, hashlib.sha256(kept).hexdigest(), kept.decode())[: len(names)])
        made = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, made, types, strict=False)})

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return found.select("block_id", "body").groupBy("block_id").cogroup(later.groupBy("block_id")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = True) -> DataFrame:
    """Remove each word covered by a window of ``window`` words whose sequence also starts earlier.

    Gives doc_id, n_words, n_removed, kept_sha256 and, ``with_text``, the kept words joined by one space.
    """
    found = materialise(blocks(docs, id_col, text_col, window, _BLOCK), "substring-blocks")
    n = found.agg(F.sum("n_windows")).first()[0] or 0
    bits = _bits(n)
    answers = _merged(_sketch(found, window, *bits[:2]), *bits[:2])
    later = _later(_asked(found, answers, window, bits))
    return _cleaned(found, later, window, with_text)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier in the table."""
    from .shared import table

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
