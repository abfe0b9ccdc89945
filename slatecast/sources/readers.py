"""Readers of delimited text, XML feeds, HTML tables, and JSON that pages hold."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.scalars import parse_number


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r"""Tab-separated values with a header, compressed or not; ``\N`` and blanks are null, quotes are ordinary."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", r"\N").option("quote", "")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.select(*(F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes))


def unescaped(text: Column) -> Column:
    r"""Text as it was before ``writers.escaped``: backslashes are read from the left, so ``\\t`` is a backslash and a t."""
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit(r"\t"), F.lit("\t")), F.lit(r"\n"), F.lit("\n")), F.lit(r"\r"), F.lit("\r")), F.lit(r"\0"), F.lit("\0"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def with_names(df: DataFrame, aliases: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns under their agreed names, found by any alias whatever its case and spacing; raises for missing ones."""
    clean = {c.replace("﻿", "").strip().lower().replace(" ", "_"): c for c in df.columns}
    found = {name: clean[a] for name, spelt in aliases.items() for a in [next((a for a in (name, *spelt) if a in clean), None)] if a}
    if missing := [r for r in required if r not in found]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


class _Tables(HTMLParser):
    """Cells of every table on a page, with the first link of each cell and the heading before the table.

    Open tables are a stack, so a table in a cell doesn't take the cells after it from the outer one.
    """

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, int, str, str | None, str | None]] = []
        self.tables: list[dict] = []
        self.n = 0
        self.heading: str | None = None
        self.said: list[str] | None = None

    def _end(self) -> None:
        t = self.tables[-1] if self.tables else None
        if t and t["text"] is not None:
            self.rows.append((t["no"], t["row"], t["cell"], " ".join("".join(t["text"]).split()), t["link"], t["heading"]))
            t["text"] = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append({"no": self.n, "row": -1, "cell": -1, "text": None, "link": None, "heading": self.heading})
            self.n += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "caption"):
            self.said = []
        if not self.tables:
            return
        t = self.tables[-1]
        if tag == "tr":
            self._end()
            t["row"], t["cell"] = t["row"] + 1, -1
        elif tag in ("td", "th"):
            self._end()
            t["cell"], t["text"], t["link"] = t["cell"] + 1, [], None
        elif tag == "a" and t["text"] is not None and t["link"] is None:
            t["link"] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._end()
        elif tag == "table" and self.tables:
            self._end()
            self.tables.pop()
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "caption") and self.said is not None:
            self.heading, self.said = " ".join("".join(self.said).split()), None
            if tag == "caption" and self.tables:
                self.tables[-1]["heading"] = self.heading

    def handle_data(self, data):
        if self.said is not None:
            self.said.append(data)
        elif self.tables and self.tables[-1]["text"] is not None:
            self.tables[-1]["text"].append(data)


_CELL = {"table_no": pa.int32(), "row_no": pa.int32(), "cell_no": pa.int32(), "text": pa.string(), "link": pa.string(), "heading": pa.string()}


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, row_no, cell_no, text, link, heading) for each table cell of each page; null pages have none."""
    picked = pages.select(key, html)
    kind = picked.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of = [], []
            for k, page in enumerate(batch.column(1).to_pylist()):
                parser = _Tables()
                parser.feed(page or "")
                parser.close()
                out += parser.rows
                of += [k] * len(parser.rows)
            cells = list(zip(*out, strict=True)) or [[]] * len(_CELL)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(cells, _CELL.values(), strict=True))], [key, *_CELL])

    return picked.mapInArrow(run, f"`{key}` {kind}, table_no int, row_no int, cell_no int, text string, link string, heading string")


def tables_with(cells: DataFrame, key: str, headers: list[str]) -> DataFrame:
    """Cells of the first table of each page whose first row has all the headers, whatever their case."""
    first = cells.where("row_no = 0").groupBy(key, "table_no").agg(F.collect_set(F.lower("text")).alias("h_"))
    fit = first.where(F.size(F.array_except(F.array(*(F.lit(h.lower()) for h in headers)), "h_")) == 0)
    return cells.join(fit.groupBy(key).agg(F.min("table_no").alias("table_no")), [key, "table_no"], "left_semi")


def html_records(cells: DataFrame, key: str, columns: dict[str, int], least: int) -> DataFrame:
    """One row for each table row of at least ``least`` cells below the first, with the named cells."""
    rows = cells.where("row_no > 0").groupBy(key, "table_no", "row_no").agg(F.count("*").alias("n_"), *(F.max(F.when(F.col("cell_no") == k, F.col("text"))).alias(c) for c, k in columns.items()), F.min_by("link", F.when(F.col("link").isNotNull(), F.col("cell_no"))).alias("link"))
    return rows.where(F.col("n_") >= least).drop("n_")


def page_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title, language, first heading and number of links of each page, by patterns."""
    h = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        key,
        F.regexp_extract(h, r"(?s)<title[^>]*>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(h, r'<html[^>]*\blang="([^"]*)"', 1).alias("lang"),
        F.regexp_extract(h, r"(?s)<h1[^>]*>([^<]*)</h1>", 1).alias("heading"),
        F.regexp_count(h, F.lit(r'<a\s[^>]*href=')).cast("bigint").alias("n_links"),
    )


def read_xml(docs: DataFrame, column: str, row_tag: str, schema: str) -> DataFrame:
    """The elements called ``row_tag`` right below the root of each XML document as rows; attributes start with an underscore."""
    fields = StructType.fromDDL(schema)
    kind = StructType().add(row_tag, ArrayType(fields))
    found = docs.select(F.from_xml(F.col(column), kind.simpleString(), {"valueTag": "_text"}).alias("d_"))
    return found.select(F.explode(F.col("d_")[row_tag]).alias("e_")).select("e_.*")


def feed_items(items: DataFrame) -> DataFrame:
    """Items of a feed (title, link, pubDate): one for each address, the first by date, and none of kind other."""
    at = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    rows = items.select("title", F.regexp_replace("link", r"[?#].*$", "").alias("link"), at.alias("published"))
    kind = F.when(F.lower("title").rlike("forecast|preview"), "forecast").when(F.lower("title").rlike("review|recap"), "review").otherwise("other")
    rows = rows.withColumn("kind", kind).where("kind <> 'other'")
    return rows.groupBy("link").agg(F.min_by(F.struct("title", "kind", "published"), F.struct("published", "title")).alias("i_")).select("link", "i_.*")


def filtered_tsv(spark: SparkSession, path: str, schema: str, width: int, titles: DataFrame, ids: DataFrame, id_col: str, title_col: str, key) -> DataFrame:
    """Rows of a TSV file without header that have a wanted id or a wanted title key; rows of fewer than ``width`` fields are passed over."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= width)
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = [c.strip().split()[1] for c in schema.split(",")]
    value = lambda k: F.nullif(F.nullif(F.get("f", F.lit(k)), F.lit(r"\N")), F.lit(""))
    rows = raw.select(*(value(k).try_cast(t).alias(n) for k, (n, t) in enumerate(zip(names, kinds, strict=True))))
    by_id = rows.join(ids.select(id_col).distinct(), id_col, "left_semi")
    rest = rows.join(ids.select(id_col).distinct(), id_col, "left_anti").withColumn("key_", key(title_col))
    return by_id.unionByName(rest.join(titles.select(F.col("key").alias("key_")).distinct(), "key_", "left_semi").drop("key_"))


_PARTS = pa.schema([("archive", pa.string()), ("member", pa.string()), ("method", pa.int32()), ("crc", pa.int64()), ("flags", pa.int32()), ("size", pa.int64()), ("raw", pa.binary())])
_ZIP_LINES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line_no", pa.int32()), ("line", pa.string()), ("error", pa.string())])
_LINES = "archive string, member string, line_no int, line string, error string"


def zip_parts(archives: DataFrame) -> DataFrame:
    """(archive, member, method, crc, flags, size, raw): the members of archives (path, content) as they are stored, from their directories alone.

    Nothing is inflated; an archive without a readable directory gives one row without a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    with zipfile.ZipFile(io.BytesIO(body or b"")) as z:
                        members = [m for m in z.infolist() if not m.is_dir()]
                except zipfile.BadZipFile:
                    yield pa.RecordBatch.from_pylist([{"archive": name}], _PARTS)
                    continue
                for m in members:
                    at = m.header_offset
                    head = body[at : at + 30]
                    start = at + 30 + sum(struct.unpack("<HH", head[26:30])) if len(head) == 30 and head[:4] == b"PK\x03\x04" else len(body)
                    row = {"archive": name, "member": m.filename, "method": m.compress_type, "crc": m.CRC, "flags": m.flag_bits, "size": m.file_size, "raw": body[start : start + m.compress_size]}
                    yield pa.RecordBatch.from_pylist([row], _PARTS)

    return archives.select("path", "content").mapInArrow(run, "archive string, member string, method int, crc bigint, flags int, size bigint, raw binary")


def zip_lines(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """(archive, member, line_no, line, error) of the text files in ZIP archives (path, content).

    Members are dealt out before they are inflated, so an archive of many is read by one task but unpacked by all. A member that is broken,
    encrypted or packed by a method other than deflate gives one row that says so, and so does a broken archive.
    """

    def unpacked(row: dict) -> bytes:
        if row["flags"] & 1:
            raise ValueError("encrypted")
        if row["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError("unknown method")
        if row["method"] == zipfile.ZIP_DEFLATED:
            inflate = zlib.decompressobj(-15)
            out = inflate.decompress(row["raw"]) + inflate.flush()
        else:
            out = row["raw"]
        if len(out) != row["size"] or zlib.crc32(out) != row["crc"]:
            raise ValueError("checksum")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = {"archive": row["archive"], "member": row["member"]}
                try:
                    if row["member"] is None:
                        raise ValueError("no archive")
                    lines = unpacked(row).decode("utf-8-sig").splitlines()
                except (ValueError, zlib.error) as e:
                    reason = "inflate" if isinstance(e, zlib.error) else "encoding" if isinstance(e, UnicodeDecodeError) else str(e)
                    yield pa.RecordBatch.from_pylist([{**at, "error": reason}], _ZIP_LINES)
                    continue
                for k in range(0, len(lines), 10_000):
                    part = lines[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"archive": [at["archive"]] * len(part), "member": [at["member"]] * len(part), "line_no": pa.array(range(k, k + len(part)), pa.int32()), "line": part, "error": pa.nulls(len(part), pa.string())}, _ZIP_LINES)

    parts = zip_parts(archives)
    tasks = tasks or int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, F.xxhash64("archive", "member")).mapInArrow(run, _LINES)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, line_no, line) of the text files in the ZIP archives of a path, those that can be read."""
    return zip_lines(spark.read.format("binaryFile").load(path)).where("error IS NULL").drop("error")


def _balanced(text: str | None, mark: str) -> str | None:
    at = (text or "").find(mark)
    start = (text or "").find("{", at) if at >= 0 else -1
    if start < 0:
        return None
    try:
        return text[start : json.JSONDecoder().raw_decode(text, start)[1]]
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def balanced_json(text: pd.Series, mark: pd.Series) -> pd.Series:
    """The JSON object that starts at the first brace after ``mark``, up to the brace that ends it."""
    return pd.Series([_balanced(t, m) for t, m in zip(text, mark, strict=True)], dtype=object)


def graph_objects(pages: DataFrame, key: str, html: str, script: str = "__APOLLO_STATE__") -> DataFrame:
    """(key, id, typename, value) for each object of the JSON graph that a page's script assigns to ``script``."""
    graph = F.try_parse_json(balanced_json(F.col(html), F.lit(script)))
    found = pages.select(key, graph.alias("g_")).where("g_ IS NOT NULL")
    out = found.select(key, F.explode(F.from_json(F.to_json("g_"), "map<string,string>")).alias("id", "json"))
    return out.select(key, "id", F.get_json_object("json", "$.__typename").alias("typename"), F.col("json").alias("value"))


def resolved(objects: DataFrame, key: str, typename: str, path: str, fields: dict[str, str]) -> DataFrame:
    """Objects of a type with fields of the object that their reference at ``path`` names, null if it names none."""
    left = objects.where(F.col("typename") == typename).select(key, "id", F.col("value").alias("own"), F.get_json_object("value", f"{path}.__ref").alias("ref"))
    right = objects.select(F.col(key).alias("k_"), F.col("id").alias("ref_"), *(F.get_json_object("value", p).alias(n) for n, p in fields.items()))
    return left.join(right, (F.col(key) == F.col("k_")) & (F.col("ref") == F.col("ref_")), "left").drop("k_", "ref_")


def seat_fill(seats: Column) -> Column:
    """Seats shown of a type that is sold: total, available, filled and fill rate, null without any."""
    sold = F.filter(seats, lambda s: s["shown"] & s["type"].isin("standard", "recliner", "wheelchair"))
    total = F.size(sold)
    free = F.size(F.filter(sold, lambda s: s["available"]))
    return F.struct(total.alias("total"), free.alias("available"), (total - free).alias("filled"), F.try_divide((total - free).cast("double"), total.cast("double")).alias("fill_rate"))


def bindings(rows: DataFrame, json_col: str) -> DataFrame:
    """Knowledge-base answers: for each entity its label, its years, and the first id that is set."""
    one = "struct<value:string>"
    kind = f"struct<results:struct<bindings:array<struct<item:{one},label:{one},year:{one},imdb:{one}>>>>"
    b = rows.select(F.explode(F.from_json(json_col, kind)["results"]["bindings"]).alias("b"))
    flat = b.select(F.regexp_extract("b.item.value", r"(Q\d+)$", 1).alias("entity"), F.col("b.label.value").alias("label"), F.col("b.year.value").try_cast("int").alias("year"), F.col("b.imdb.value").alias("imdb"))
    return flat.where("entity <> ''").groupBy("entity").agg(F.min("label").alias("label"), F.sort_array(F.collect_set("year")).alias("years"), F.min("imdb").alias("imdb"))


def film_page(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Meta tags, linked data and counts beside their labels ('1.2K ratings') of film pages."""
    h = F.coalesce(F.col(html), F.lit(""))
    data = F.regexp_extract(h, r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)
    near = lambda label: parse_number(F.nullif(F.regexp_extract(h, rf"(?i)([\d.,]+\s*[kmb]?)\s+{label}", 1), F.lit("")))
    meta = lambda name: F.nullif(F.regexp_extract(h, rf'<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))
    return pages.select(key, meta("og:title").alias("title"), F.regexp_extract(h, r"imdb\.com/title/(tt\d+)", 1).alias("imdb"), F.get_json_object(data, "$.aggregateRating.ratingValue").try_cast("double").alias("rating"), near("ratings").cast("bigint").alias("n_ratings"), near("likes").cast("bigint").alias("n_likes"))


def paper_tables(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, caption, row_no, cells) of Markdown tables, captions being the last line before them that starts with Table."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    table = F.trim("line").startswith("|") & ~F.trim("line").rlike(r"^\|[\s:|-]+\|?$")
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("caption", F.last(F.when(F.trim("line").startswith("Table"), F.trim("line")), ignorenulls=True).over(w)).where(table)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return marked.select(key, "caption", (F.row_number().over(Window.partitionBy(key, "caption").orderBy("n")) - 1).alias("row_no"), cells.alias("cells"))
