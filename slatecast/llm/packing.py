"""Compact binary forms of integer arrays and of document blocks, for rows that are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import columns, texts_of


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """An integer array as zstd over its byte planes; ``rising`` stores differences."""
    if rising and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype, rising: bool = False) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if rising else values


def _body(ids: list, texts: list[bytes]) -> bytes:
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], names=["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def open_body(body: bytes) -> tuple[list, list[bytes]]:
    """Ids and texts of a block, by id; rows without id last."""
    batch = pa.ipc.open_stream(body).read_all()
    return batch.column("id").to_pylist(), batch.column("text").to_pylist()


def blocks(docs: DataFrame, id_col: str, text_col: str, window: int, most: int) -> DataFrame:
    """Documents in blocks of about ``most`` bytes of text: block_id, n_windows, body.

    Texts are stored as their words joined by single spaces. A block is one row, so what later stages learn
    about it can be joined back by its id; a longer text is a block of its own. Write the result before use:
    ids hold for one run only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        size = n = 0

        def done() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            body = _body([ids[i] for i in order], [texts[i] for i in order])
            return pa.RecordBatch.from_pydict({"block_id": [part << 32 | seq], "n_windows": [n], "body": [body]})

        for batch in batches:
            a, b = columns(batch, id_col, text_col)
            for i, text in zip(a.to_pylist(), texts_of(b), strict=True):
                if size and size + len(text) > most:
                    yield done()
                    seq, ids, texts, size, n = seq + 1, [], [], 0, 0
                words = text.split()
                ids.append(i)
                texts.append(b" ".join(words))
                size += len(text)
                n += max(0, len(words) - window + 1)
        if ids:
            yield done()

    picked = docs.select(docs[id_col].cast("bigint").alias(id_col), docs[text_col])
    return picked.mapInArrow(run, "block_id bigint, n_windows bigint, body binary")
