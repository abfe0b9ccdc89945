"""WARC archives and their capture index (operator 10).

``write_archives`` gives every page a WARC record and writes the records as gzip files of about ``_ARCHIVE``
bytes of records, through Spark's writers, so any file system that Spark knows will do. Of equal payloads of at
least ``LEAST`` bytes the page with the smallest id is a response and the others are revisits of it, without payload.

``read_archives`` parses the files back into one entry for each record, with the digest of the payload as read.

``merge_index`` orders entries by URL key and time as an external merge: each task sorts runs of at most ``_RUN``
entries and cuts them at range bounds, which come from a sample of at most ``_PER_RANGE`` keys a range; there are as
many ranges as shuffle partitions, ``_RANGES`` at most, so that what the driver holds doesn't grow with the entries. A
range's task then merges its runs with a loser tree, row by row, however many they are. Run pieces come to it ordered by their first entry, and one is
opened only when the merge gets there. Bounds hold time and id beside the key, so the captures of one URL may
fill many ranges.

Cases: ids are integers. Null html is an empty payload; null URLs are written and sorted as empty. A null id sorts first; it is never
referred to, and is a revisit where an equal payload has an id. Rows that repeat the id and payload of a
response are responses, too. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import columns, materialise, pieces, shared_dir

LEAST = 100
_ARCHIVE, _RUN, _CHUNK, _PER_RANGE, _RANGES = 16 << 20, 50_000, 2_000, 40, 2_048
_END = "\r\n\r\n"
_EPOCH = 1_577_836_800
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "page_id bigint, url string, url_key string, captured string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, archive string, offset bigint"
_TYPES = {"bigint": pa.int64(), "string": pa.string()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ENTRY.split(", ")])
_KEY = ("url_key", "captured", "page_id", "payload_digest")


def _records(pages: DataFrame, id_col: str, url_col: str, html_col: str, captured: Column) -> DataFrame:
    """One column, ``record``: the pages' WARC records without their last line ends."""
    base = pages.select(
        pages[id_col].cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(pages[url_col], F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(pages[html_col], F.lit("")).alias("html"),
        captured.alias("captured"),
    )
    base = base.withColumns({"size": F.octet_length("html").cast("bigint"), "digest": F.sha2("html", 256)})
    firsts = base.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = materialise(firsts.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first"), "warc-firsts")
    found = base.join(firsts, F.col("digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Date: "), F.col("captured"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), urn("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
    )
    return found.select(F.concat(head, F.lit(_END), block).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None) -> None:
    """Write the pages' records below ``path``. ``captured`` is a W3C date string; by default it follows the id."""
    if captured is None:
        seconds = F.lit(_EPOCH) + F.pmod(F.coalesce(pages[id_col].cast("bigint"), F.lit(0)), F.lit(1_000_000_000))
        captured = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size = 0
        for whole in batches:
            for batch in pieces(whole, "record"):
                for record in columns(batch, "record")[0].to_pylist():
                    if held and size + len(record) > _ARCHIVE:
                        yield pa.RecordBatch.from_pydict({"value": [_END.join(held)]})
                        held, size = [], 0
                    held.append(record)
                    size += len(record)
        if held:
            yield pa.RecordBatch.from_pydict({"value": [_END.join(held)]})

    packed = _records(pages, id_col, url_col, html_col, captured).mapInArrow(run, "value string")
    packed.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def url_key(url: str) -> str:
    """Host labels from the right, then path and query, in lower case; without scheme, ``www.`` and fragment."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.lower()).split("#", 1)[0]
    host = re.match(r"[^/?]*", rest)[0]
    return ",".join(reversed(re.sub(r"^www\.", "", host).split("."))) + ")" + rest[len(host) :]


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of each record."""
    pos = 0
    while pos < len(data):
        end = data.index(b"\r\n\r\n", pos)
        first, *lines = data[pos:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {pos}")
        header = dict(line.split(": ", 1) for line in lines)
        body, size = end + 4, int(header["Content-Length"])
        yield pos, header, data[body : body + size]
        pos = body + size + 4


def _id(urn: str) -> int | None:
    text = urn[len("<urn:page:") : -1]
    return None if text == "null" else int(text)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One entry for each record of the archives below ``path``."""

    def entry(name: str, offset: int, header: dict[str, str], block: bytes) -> tuple:
        http, payload = block.split(b"\r\n\r\n", 1)
        size, digest = int(http.rsplit(b": ", 1)[1]), header["WARC-Payload-Digest"].split(":", 1)[1]
        if header["WARC-Type"] == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        to = _id(header["WARC-Refers-To"]) if "WARC-Refers-To" in header else None
        url = header["WARC-Target-URI"]
        return _id(header["WARC-Record-ID"]), url, url_key(url), header["WARC-Date"], header["WARC-Type"], to, size, digest, name, offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "content", 1):
                name, content = (x.to_pylist()[0] for x in columns(batch, "path", "content"))
                rows = [entry(name.rsplit("/", 1)[1], *r) for r in parse(zlib.decompress(content, 31))]
                if not rows:  # the file of an empty task
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ENTRY)


class LoserTree:
    """The smallest head of several sorted sequences: inner nodes keep losers, so a step replays one path."""

    def __init__(self, heads: list[tuple | None]):
        self.heads = heads
        self.n = len(heads)
        self.losers = [-1] * max(1, self.n)
        for leaf in range(self.n):
            self._replay(leaf)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.n) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._wins(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    @property
    def top(self) -> int:
        return self.losers[0]

    def replace(self, head: tuple | None) -> None:
        """The winner's sequence goes on with ``head``, or ends."""
        self.heads[self.top] = head
        self._replay(self.top)


def merged(chunks: Iterator[tuple[tuple, list[tuple]]]) -> Iterator[tuple]:
    """Merge sorted pieces of runs (first row or less, rows in order), which come ordered by their first row."""
    waiting = next(chunks, None)
    rows: list[Iterator[tuple]] = []
    tree = LoserTree([None])
    while waiting or tree.heads[tree.top] is not None:
        head = tree.heads[tree.top]
        if waiting and (head is None or waiting[0] <= head):
            live = [k for k, h in enumerate(tree.heads) if h is not None]
            now, rows = [tree.heads[k] for k in live], [rows[k] for k in live]
            while waiting and (head is None or waiting[0] <= head):
                rows.append(iter(waiting[1]))
                now.append(next(rows[-1]))
                head = min(now)
                waiting = next(chunks, None)
            tree = LoserTree(now)
        yield tree.heads[tree.top]
        tree.replace(next(rows[tree.top], None))


def _order(entry: dict) -> tuple:
    """Sorts nulls first."""
    return tuple((v is not None, v if v is not None else 0) if c == "page_id" else v for c, v in ((c, entry[c]) for c in _KEY)) + (entry["archive"], entry["offset"])


def _pack(rows: list[dict]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pylist(rows, schema=_SCHEMA)
    with pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def merge_index(entries: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """The entries with ``position``, their place in the order of URL key, time, id and digest."""
    spark = entries.sparkSession
    entries = materialise(entries, "warc-entries")
    n = entries.count()
    n_ranges = min(n_ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 200_000)), _RANGES)
    share = min(1.0, n_ranges * _PER_RANGE / max(n, 1))
    spread = F.xxhash64(*_KEY, "archive", "offset").cast("double") / 2.0**64 + 0.5
    drawn = entries.where(spread < share).select(*_KEY, "archive", "offset").limit(2 * n_ranges * _PER_RANGE).collect()
    keys = sorted(_order(r.asDict()) for r in drawn)
    bounds = [keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)] if keys else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def runs() -> Iterator[pa.RecordBatch]:
            run = sorted(((_order(r), r) for r in held), key=lambda x: x[0])
            place = [0, *(bisect.bisect_left(run, b, key=lambda x: x[0]) for b in bounds), len(run)]
            for k, (a, b) in enumerate(zip(place, place[1:], strict=False)):
                for i in range(a, b, _CHUNK):
                    rows = [r for _, r in run[i : min(b, i + _CHUNK)]]
                    first = {c: [rows[0][c]] for c in (*_KEY, "archive", "offset")}
                    yield pa.RecordBatch.from_pydict({"range": [k], **{c: pa.array(v, _SCHEMA.field(c).type) for c, v in first.items()}, "body": [_pack(rows)]})

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == _RUN:
                    yield from runs()
                    held.clear()
        if held:
            yield from runs()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple[int, tuple, bytes]]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield row["range"], _order(row), row["body"]

        def opened(first, k: int, rest: list) -> Iterator[tuple[tuple, list[tuple]]]:
            now = first
            while now is not None and now[0] == k:
                rows = pa.ipc.open_stream(now[2]).read_all().to_pylist()
                yield (now[1],), [(_order(r), tuple(r.values())) for r in rows]
                now = next(source, None)
            rest.append(now)

        source = chunks()
        now = next(source, None)
        while now is not None:
            k, rest, out, at = now[0], [], [], 0
            for _, row in merged(opened(now, k, rest)):
                out.append((k, at, *row))
                at += 1
                if len(out) == 10_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
            now = rest[0]

    pieces_ = entries.mapInArrow(cut, "range bigint, url_key string, captured string, page_id bigint, payload_digest string, archive string, offset bigint, body binary")
    dealt = pieces_.repartition(n_ranges, "range").sortWithinPartitions("range", *_KEY, "archive", "offset")
    done = materialise(dealt.mapInArrow(merge, f"range bigint, place bigint, {ENTRY}"), "warc-index")
    sizes = sorted((r["range"], r["count"]) for r in done.groupBy("range").count().collect())
    before, total = {}, 0
    for k, size in sizes:
        before[k] = total
        total += size
    starts = spark.createDataFrame(list(before.items()), "of bigint, start bigint")
    return done.join(F.broadcast(starts), F.col("range") == F.col("of")).select(*_SCHEMA.names, (F.col("start") + F.col("place") + 1).alias("position"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["range", "place", *_SCHEMA.names]
    types = [pa.int64(), pa.int64(), *_SCHEMA.types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives, with its place in the merged index."""
    from .shared import table

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    index = merge_index(read_archives(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         split_part(regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://', ''), '#', 1) AS rest
  FROM pages
),
k AS (
  SELECT *, regexp_extract(rest, '^[^/?]*') AS host,
         CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(regexp_replace(host, '^www\.', ''), '.')), ',') || ')' || substr(rest, length(host) + 1),
                          page_id % 1000000000, page_id, payload_digest) AS position
FROM k
"""
