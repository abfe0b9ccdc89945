"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists (operator 11).

Vectors are dealt by a hash to blocks of like size. A block holds its vectors and, for each dimension, its rows sorted by that
component. A query goes down the lists of its non-zero weights in step, from the end that its weight's sign prefers; rows seen
for the first time are scored in full, and the bound is the score of a vector made of the components last seen. It stops in a
block as soon as its kth score so far is above the bound, since no unseen row can reach it, or when no row is unseen. The kth
score is carried from block to block within a task. With many dimensions and no order in the data the bound falls late; then
every row of a block is scored once, and nothing is lost but the sorting.

Blocks are written to the shared folder. Queries come from the blocks, in groups; every group of queries meets every group of
blocks in a task of its own, and only the best k of each task travel on. A task holds one group of queries and one block
at a time.

Cases: null vectors, and vectors with null or non-finite components, take no part. Only vectors of equal length are compared;
those without components score 0 with each other. A row isn't its own candidate, but a repeated row is. Ties go to the
smaller id, null ids last; rows with null id are candidates. With fewer candidates than k all are returned. Components
are doubles, so scores are exact while sums of whole numbers stay under 2 ** 53. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, table

_FIRST_STEP = 16


class Block:
    """Vectors of a block, their ids, and each dimension's rows from the largest component to the smallest."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, known: np.ndarray, x: np.ndarray, lists: np.ndarray | None = None):
        self.uids, self.ids, self.known, self.x = uids, ids, known, x
        if lists is None:
            lists = np.argsort(-x, axis=0, kind="stable").astype(np.uint16 if len(x) <= 1 << 16 else np.uint32)
        self.lists = lists

    def pack(self) -> bytes:
        narrow = self.x.astype(np.float32)
        x = narrow if np.array_equal(narrow, self.x) else self.x
        parts = [self.uids, self.ids, self.known, x.ravel(), self.lists.ravel()]
        batch = pa.record_batch([pa.array([p], pa.list_(pa.from_numpy_dtype(p.dtype))) for p in parts], names=list("uikxl"))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        got = pa.ipc.open_stream(data).read_all()
        uids, ids, known, x, lists = (got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in "uikxl")
        return cls(uids, ids, known, x.astype(np.float64).reshape(len(uids), -1), lists.reshape(len(uids), -1))


class Best:
    """The k best rows of a query so far: score first, then known and smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.known, self.ids = np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def floor(self) -> float:
        """A score below this can't be among the best."""
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        fit = np.flatnonzero(score >= self.floor)
        if len(fit) > 4 * self.k:  # the kth largest, and its ties
            fit = fit[score[fit] >= np.partition(score[fit], -self.k)[-self.k]]
        if not len(fit):
            return
        score, known, ids = (np.concatenate(p) for p in ((self.score, score[fit]), (self.known, known[fit]), (self.ids, ids[fit])))
        order = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.known, self.ids = score[order], known[order], ids[order]


def search(block: Block, uid: int, weights: np.ndarray, best: Best) -> int:
    """Run one query over one block; returns how far down the lists it went."""
    n, dims = block.x.shape
    falling, rising = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
    if not len(falling) and not len(rising):  # all scores are 0: any list holds every row
        falling = np.arange(min(dims, 1))
    used = np.concatenate((falling, rising))
    unseen = np.ones(n, dtype=bool)
    at, step = 0, _FIRST_STEP
    while at < n:
        end = min(n, at + step)
        before = unseen.copy()
        unseen[block.lists[at:end, falling]] = False
        unseen[block.lists[n - end : n - at, rising]] = False
        if not len(used):
            unseen[:] = False
        new = np.flatnonzero(before & ~unseen)
        new = new[block.uids[new] != uid]
        best.add(block.x[new] @ weights, block.known[new], block.ids[new])
        last = np.concatenate((block.lists[end - 1, falling], block.lists[n - end, rising]))
        if best.floor > weights[used] @ block.x[last, used] or not unseen.any():
            return end
        at, step = end, 2 * step
    return n


def _blocks(key: tuple, rows: pa.Table) -> pa.Table:
    """A block of one dimension, and the queries that it holds."""
    dim = key[0].as_py()
    uids, known, query = (rows.column(c).to_numpy() for c in ("uid", "known", "query"))
    ids = rows.column("id").fill_null(0).to_numpy().astype(np.int64)
    x = rows.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(uids), dim)
    asked = np.flatnonzero(query)
    none = np.zeros((len(asked), 0), np.uint16)
    bodies = [Block(uids, ids, known, x).pack(), Block(uids[asked], ids[asked], known[asked], x[asked], none).pack()]
    return pa.table({"dim": [dim] * 2, "block": [key[1].as_py()] * 2, "n": [len(uids), len(asked)], "asks": [False, True], "body": bodies})


def _searched(k: int):
    def run(key: tuple, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        asked = []
        for body, n in zip(*(queries.column(c).to_pylist() for c in ("body", "n")), strict=True):
            q = Block.unpack(body) if n else None
            asked += [(int(q.uids[i]), int(q.ids[i]), q.x[i], Best(k)) for i in range(n)]
        for body in blocks.column("body"):
            block = Block.unpack(body.as_py())
            for uid, _, weights, best in asked:
                search(block, uid, weights, best)
        sizes = [len(b.score) for *_, b in asked]
        score = np.concatenate([b.score for *_, b in asked]) if asked else np.zeros(0)
        known = np.concatenate([b.known for *_, b in asked]) if asked else np.zeros(0, bool)
        ids = np.concatenate([b.ids for *_, b in asked]) if asked else np.zeros(0, np.int64)
        return pa.table(
            {
                "uid": np.repeat(np.array([u for u, *_ in asked], np.int64), sizes),
                "query_id": np.repeat(np.array([i for _, i, *_ in asked], np.int64), sizes),
                "id": pa.array(ids, mask=~known),
                "score": score,
            }
        )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", component=lambda c: c, block_rows: int = 4096, group_queries: int = 8192) -> DataFrame:
    """(query_id, rank, id, score double): the ``k`` rows of the highest inner product for each row where ``is_query`` holds.

    ``component`` maps each component first. ``block_rows`` bounds a block, ``group_queries`` is about the number of queries
    that a task asks; a query's id has to be known.
    """
    real = F.forall(vectors[vec_col], lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(vectors[vec_col].isNotNull() & real)
    asked = F.coalesce(is_query, F.lit(False)) & vectors[id_col].isNotNull()
    n, asks = kept.agg(F.count("*"), F.coalesce(F.sum(asked.cast("long")), F.lit(0))).first()
    spark = vectors.sparkSession
    tasks = 2 * int(spark.sparkContext.defaultParallelism)
    # blocks are as large as allowed, or small enough for all cores; groups of blocks keep their number
    in_block = max(1, min(block_rows, -(-n // tasks)))
    n_blocks = -(-n // in_block) if n else 1
    per_task = max(1, min(8, n_blocks // tasks))
    per_group = max(1, n_blocks * group_queries // max(1, asks))
    rows = kept.select(
        F.size(vec_col).alias("dim"), F.monotonically_increasing_id().alias("uid"), vectors[id_col].cast("bigint").alias("id"), vectors[id_col].isNotNull().alias("known"),
        asked.alias("query"), F.transform(vec_col, lambda c: component(c).cast("double")).alias("x"),
    )
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int"))
    made = rows.groupBy("dim", "block").applyInArrow(_blocks, "dim bigint, block bigint, n bigint, asks boolean, body binary")
    made = materialise(made, "vector-blocks")
    groups = -(-n_blocks // per_task)
    asking = -(-n_blocks // per_group)
    at = F.col("block")
    queries = made.where("asks AND n > 0").select("dim", F.floor(at / per_group).cast("int").alias("asking"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "n", "body")
    blocks = made.where("NOT asks").select("dim", F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("asking"), F.floor(at / per_task).cast("int").alias("part"), "n", "body")
    keys = ("dim", "asking", "part")
    found = queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(_searched(k), "uid bigint, query_id bigint, id bigint, score double")
    order = Window.partitionBy("uid", "query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", "score")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest scores of each vector whose id 50 divides, against all others, on components in 256ths."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = top_k(vectors, F.col("vec_id") % 50 == 0, component=lambda c: F.floor(c.cast("double") * 256))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


OP11_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.uid <> c.uid AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY uid ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""
