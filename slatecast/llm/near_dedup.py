"""Near-duplicate groups by MinHash (operator 2).

A document's set holds its distinct shingles of five lower-cased words, or its whole word sequence if it is
shorter. Sketches follow fast similarity sketching: in round i every element is hashed to one bin with a value
in [i, i + 1), and from round t on round i fills bin i - t; a set is done once all t bins are full, so every
coordinate fills, in about n + t log t steps, with concentration as for independent samples. Bands of
consecutive coordinates then give candidates, and every link is confirmed on full sets.

1. Equal sets are one class, of which only the representative (smallest id) goes on.
2. Representatives that agree in a band share a bucket. No pairs are made within a bucket: each
   member is first verified against one bucket leader, and verified links give components.
3. Buckets that still hold several components are searched in blocks: members outside the largest component
   are compared, as sketches, with every member. Then the texts of those that came within reach of another are
   fetched, and pairs are verified in the block, closest first, until their components are one. Only links
   leave the block. Sketches meet once for each pair of a query and a member of such a bucket; they are 240 bytes.

With the default 48 bands of 5, a pair at similarity 0.75 shares no bucket with a chance of 2e-6, and
the sketch estimate of 240 coordinates falls below ``_REACH`` for such a pair with a chance of 1e-5.

Cases: ids are integers. Null or empty text has an empty set, linked with nothing. Rows with a null id are returned
with a null component and kept. Rows that share an id but not their text are grouped each by its own text; where
such an id stands for several classes of equal sets, a link of any of them joins them all, and rows that share id
and text stay or go together. ``version`` (a hash of the text) tells rows apart that share an id. Extra
columns are ignored, and kept by ``drop_near_duplicates``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .graph import components
from .shared import columns, fresh, materialise, pieces, texts_of

BANDS, ROWS = 48, 5
COORDINATES = BANDS * ROWS
_REACH = 0.62
_BLOCK = 256  # members verified against a leader in one group
_SEARCH = 2048  # members of a bucket held in one block
_STREAM = 8192  # queries that one task sends past a block
_BODIES = 32 << 20  # bytes of compressed texts of a block
_HELD = 64 << 20  # bytes of full sets kept for a block
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    doc = words.split(texts, lower=True)
    h, at = doc.windows(k)
    ends = np.searchsorted(at, doc.first + np.maximum(doc.count - k + 1, 0)).tolist()
    starts = np.searchsorted(at, doc.first).tolist()
    out = []
    for n, first, a, b in zip(doc.count.tolist(), doc.first.tolist(), starts, ends, strict=True):
        if 0 < n < k:
            out.append(words.window_hashes(doc.hashes[first : first + n], n))
        else:
            out.append(np.unique(h[a:b]) if n else np.zeros(0, dtype=np.uint64))
    return out


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` coordinates for each set, as bytes; of no use for empty sets."""
    table = np.full(len(sets) * t, _EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    turn = 0
    while len(items):
        h = words.mix(items + np.uint64((turn * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if turn < t else turn - t
        np.minimum.at(table, owner * t + bins, (h & np.uint64((1 << 40) - 1)) | np.uint64(turn << 40))
        alive = np.unique(owner) if turn else np.arange(len(sets))
        full = np.zeros(len(sets), dtype=bool)
        full[alive] = (table.reshape(-1, t)[alive] != _EMPTY).all(axis=1)
        left = ~full[owner]
        if not left.all():
            items, owner = items[left], owner[left]
        turn += 1
    return (words.mix(table) >> np.uint64(56)).astype(np.uint8).reshape(-1, t)


def _sketched(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in pieces(whole, "text", 2 << 20):
                ids, text, version = columns(batch, "id", "text", "version")
                texts = texts_of(text)
                sets = shingle_sets(texts, k)
                rows = sketch(sets)
                key = [words.mix(s.copy()) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": ids,
                        "version": version,
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "set_a": pa.array(np.array([x.sum(dtype=np.uint64) for x in key], dtype=np.uint64).view(np.int64)),
                        "set_b": pa.array(np.array([np.bitwise_xor.reduce(words.mix(x + np.uint64(7))) if len(x) else 0 for x in key], dtype=np.uint64).view(np.int64)),
                        "sketch": pa.array([r.tobytes() for r in rows], pa.binary()),
                        "body": pa.array([squeeze(b" ".join(t.split())) for t in texts], pa.binary()),
                    }
                )

    picked = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("version"))
    return picked.mapInArrow(run, "id bigint, version bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch binary, body binary")


def _verified(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The members of a leader a are dealt into groups of about ``_BLOCK``, each of which gets the leader's text;
    rows of a group stream past it one by one.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > _BLOCK)
    dealt = pairs.join(many.withColumnRenamed("a", "many"), F.col("a") == F.col("many"), "left")
    dealt = dealt.select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / _BLOCK)), F.lit(0)).alias("part"))
    dealt = materialise(dealt, "pairs")
    rows = dealt.select("a", "part", F.col("b").alias("at"), F.lit(1).alias("member"))
    rows = rows.union(dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("at"), F.lit(0).alias("member")))
    rows = rows.join(bodies, F.col("at") == F.col("id")).select("a", "part", "member", "at", "body")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        now, leaders = None, []  # an id has several sets where its rows differ in text
        for whole in batches:
            for batch in pieces(whole, "body", 1 << 20):
                a, part, member, at, body = (x.to_pylist() for x in columns(batch, "a", "part", "member", "at", "body"))
                out = []
                for i, s in enumerate(shingle_sets([expand(x) for x in body], k)):
                    if not member[i]:
                        leaders = [*leaders, s] if now == (a[i], part[i]) else [s]
                        now = (a[i], part[i])
                        continue
                    assert now == (a[i], part[i])
                    for leader in leaders:
                        both = len(np.intersect1d(leader, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(leader) + len(s) - both):
                            out.append((a[i], at[i]))
                            break
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return rows.mapInArrow(run, "a bigint, b bigint")


def _dealt(members: DataFrame, carried: DataFrame) -> DataFrame:
    """Members of buckets with several components in blocks and chunks, with the carried columns of their id.

    The largest component of a bucket is its home; members of others are queries. Members are dealt into
    blocks and queries into chunks, and each block meets each chunk: the block is held, the chunk streams past.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    homes = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("home"), F.sum("size").alias("n"), F.sum("bytes").alias("bytes")).where("n > home.size")
    heavy = F.col("bytes") / _BODIES if "body" in carried.columns else F.lit(0.0)
    blocks, chunks = F.ceil(F.greatest(F.col("n") / _SEARCH, heavy)).cast("int"), F.ceil((F.col("n") - F.col("home.size")) / _STREAM).cast("int")
    homes = materialise(homes.select(F.col("bucket").alias("at"), F.col("home.component").alias("home"), blocks.alias("blocks"), chunks.alias("chunks")), "homes")
    rows = members.join(homes, F.col("bucket") == F.col("at"))
    dealt, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    common = ["bucket", "band", "id", "component", (F.col("component") == F.col("home")).alias("inside")]
    held = rows.select(*common, dealt("blocks").alias("block"), F.explode(every("chunks")).alias("chunk"), F.lit(0).alias("query"))
    asked = rows.where("component <> home").select(*common, F.explode(every("blocks")).alias("block"), dealt("chunks").alias("chunk"), F.lit(1).alias("query"))
    rows = held.union(asked).join(carried.withColumnRenamed("id", "own"), F.col("id") == F.col("own")).drop("own")
    return rows.repartition("bucket", "block", "chunk").sortWithinPartitions("bucket", "block", "chunk", "query")


def _cross(members: DataFrame, table: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (a, b) between different components within buckets (bucket, band, id, component, bytes).

    A pair is looked at only in the first band that it shares, where sizes and sketches allow a link. A first pass
    compares sketches alone and tells which members have such a pair at all; only their texts are fetched.
    The second verifies pairs on full sets, closest first, while no link of its block has joined their
    components, so only links leave the task.
    """

    def blocks(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[object, bool, list]]:
        """(place, whether it is a query, the named columns) of each row."""
        for batch in batches:
            for bucket, part, chunk, query, *row in zip(*(x.to_pylist() for x in columns(batch, "bucket", "block", "chunk", "query", *names)), strict=True):
                yield (bucket, part, chunk), bool(query), row

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, _Block(k, percent)
        seen: set[tuple[int, int]] = set()
        for place, query, (band, own, component, inside, n, sketched) in blocks(batches, "band", "id", "component", "inside", "n_shingles", "sketch"):
            if place != now:
                now, block = place, _Block(k, percent)
            if not query:
                block.hold(band, own, component, inside, n, sketched, b"")
                continue
            found = block.near(band, own, component, n, sketched)
            if len(found):
                seen.add((place[0], own))
                seen.update((place[0], i) for i in block.ids[found].tolist())
            if len(seen) >= _STREAM:
                yield pa.RecordBatch.from_pydict({"at": pa.array([b for b, _ in seen], pa.int64()), "own": pa.array([i for _, i in seen], pa.int64())})
                seen = set()
        yield pa.RecordBatch.from_pydict({"at": pa.array([b for b, _ in seen], pa.int64()), "own": pa.array([i for _, i in seen], pa.int64())})

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, out = None, _Block(k, percent), []
        for place, query, row in blocks(batches, "band", "id", "component", "inside", "n_shingles", "sketch", "body"):
            if place != now:
                now, block = place, _Block(k, percent)
            if query:
                out.extend(block.links(*row))
            else:
                block.hold(*row)
            if len(out) >= _STREAM:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
                out = []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    close = _dealt(members, table.select("id", "n_shingles", "sketch")).mapInArrow(near, "at bigint, own bigint")
    close = materialise(close.distinct(), "near-members")
    members = members.join(close, (F.col("bucket") == F.col("at")) & (F.col("id") == F.col("own")), "left_semi")
    return _dealt(materialise(members, "close"), table).mapInArrow(verified, "a bigint, b bigint")


class _Block:
    """Some members of a bucket, against which queries are verified."""

    def __init__(self, k: int, percent: int) -> None:
        self.k, self.percent = k, percent
        self.rows: list[tuple] = []
        self.sets: dict[int, np.ndarray] = {}
        self.kept = 0
        self.parent: dict[int, int] = {}
        self.table: np.ndarray | None = None

    def hold(self, band: int, own: int, component: int, inside: bool, n: int, sketched: bytes, body: bytes) -> None:
        self.rows.append((own, component, inside, n, sketched, body))

    def root(self, component: int) -> int:
        while (up := self.parent.get(component, component)) != component:
            component = up
        return component

    def full(self, body: bytes) -> np.ndarray:
        return shingle_sets([zstandard.ZstdDecompressor().decompress(body)], self.k)[0]

    def member(self, i: int) -> np.ndarray:
        """The set of member ``i``; those at hand take ``_HELD`` bytes at most."""
        if i not in self.sets:
            found = self.full(self.rows[i][5])
            if self.kept + found.nbytes > _HELD:
                self.sets, self.kept = {}, 0
            self.sets[i] = found
            self.kept += found.nbytes
        return self.sets[i]

    def near(self, band: int, own: int, component: int, n: int, sketched: bytes) -> np.ndarray:
        """Places of the members that a query may be linked with, closest first."""
        if not self.rows:
            return np.zeros(0, np.int64)
        if self.table is None:
            ids, parts, home, sizes, rows, _ = zip(*self.rows, strict=True)
            self.ids, self.parts, self.home, self.sizes = np.array(ids), np.array(parts), np.array(home), np.array(sizes)
            self.table = np.stack([np.frombuffer(x, np.uint8) for x in rows])
        row = np.frombuffer(sketched, np.uint8)
        least, most = np.minimum(self.sizes, n), np.maximum(self.sizes, n)
        fit = np.flatnonzero((100 * least >= self.percent * most) & (self.parts != component) & (self.home | (self.ids > own)))
        same = self.table[fit] == row
        near = same.mean(axis=1)
        fit, same, near = fit[near >= _REACH], same[near >= _REACH], near[near >= _REACH]
        first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        return fit[first][np.argsort(-near[first], kind="stable")]

    def links(self, band: int, own: int, component: int, inside: bool, n: int, sketched: bytes, body: bytes) -> Iterator[tuple[int, int]]:
        mine = None
        for i in self.near(band, own, component, n, sketched).tolist():
            a, b = self.root(component), self.root(int(self.parts[i]))
            if a == b:
                continue
            mine = self.full(body) if mine is None else mine
            other = self.member(i)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            if 100 * both >= self.percent * (len(mine) + len(other) - both):
                self.parent[max(a, b)] = min(a, b)
                yield min(own, int(self.ids[i])), max(own, int(self.ids[i]))


def _links(table: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Components of class representatives that have a link."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring(F.col("sketch"), i * ROWS + 1, F.lit(ROWS)), i).alias("bucket")))
    placed = classes.select(F.col("first").alias("id"), "bytes", F.inline(bands))
    lead = placed.groupBy("bucket", "band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    lead = materialise(lead.select(F.col("bucket").alias("at"), "leader"), "leaders")
    members = materialise(placed.join(lead, F.col("bucket") == F.col("at")).select("bucket", "band", "id", "bytes", "leader"), "members")
    inside = members.select(F.col("id").alias("own")).distinct()
    table = materialise(table.join(inside, F.col("id") == F.col("own"), "left_semi").dropDuplicates(["id", "set_a", "set_b"]), "placed")
    stars = members.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("bands"))
    best = stars.groupBy("id").agg(F.max(F.struct("bands", -F.col("leader"))).alias("best"))
    pairs = best.select((-F.col("best.col2")).alias("a"), F.col("id").alias("b"))
    links = materialise(_verified(pairs, table.select("id", "body"), k, percent), "links")
    known = components(links).withColumnRenamed("id", "node")
    members = members.join(known, F.col("id") == F.col("node"), "left").select("bucket", "band", "id", "bytes", F.coalesce("component", "id").alias("component"))
    more = _cross(materialise(members, "grouped"), table, k, percent)
    return components(links.union(materialise(more, "links")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, version, n_shingles, component_id (smallest id that the row's document reaches by links) and kept."""
    table = materialise(_sketched(docs, id_col, text_col, k), "sketches")
    classes = table.where("n_shingles > 0 and id is not null").groupBy("set_a", "set_b", "n_shingles")
    classes = materialise(classes.agg(F.min("id").alias("first"), F.min_by("sketch", "id").alias("sketch"), F.max(F.length("body")).alias("bytes"), F.count("*").alias("copies")), "classes")
    found = _links(table, classes, k, percent)
    several = classes.where("copies > 1").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), F.col("n_shingles").alias("n"), "first")
    rows = table.select("id", "version", "n_shingles", "set_a", "set_b")
    rows = rows.join(several, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & (F.col("n_shingles") == F.col("n")), "left")
    rows = rows.select("id", "version", rows["n_shingles"], F.coalesce("first", "id").alias("node"))
    rows = materialise(rows, "nodes").join(found.withColumnRenamed("id", "own"), F.col("node") == F.col("own"), "left")
    component = F.coalesce("component", "node")
    return rows.select(F.col("id").alias("doc_id"), "version", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """The documents, in their columns, without those that a document with a smaller id stands for.

    Rows with a null id stay. Rows that share id and text stay or go together.
    """
    gone_id, gone_version = fresh(docs, "gone_id_", "gone_version_")
    found = near_duplicates(docs, id_col, text_col, k, percent).where("not kept")
    gone = materialise(found.select(F.col("doc_id").alias(gone_id), F.col("version").alias(gone_version)).distinct(), "near-duplicates")
    same = (docs[id_col].cast("bigint") == gone[gone_id]) & (F.xxhash64(docs[text_col]) == gone[gone_version])
    return docs.join(gone, same, "left_anti")


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at similarity 0.75 of five-word shingles."""
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "documents")).drop("version")
