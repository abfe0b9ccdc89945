"""WARC: the round trip, revisits and the merged order against plain versions."""

import gzip
import hashlib
import random

from plain import SMALL
from pyspark.sql import functions as F
from slatecast.llm.warc import LoserTree, merge_index, merged, parse, read_archives, url_key, write_archives

PAGES = "page_id bigint, url string, html string, digest string, first string"


def plain(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in payload:
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    return sorted(((i, len(p), hashlib.sha256(p).hexdigest(), *(("response", None) if first.get(p, i) == i else ("revisit", first[p]))) for i, p in payload), key=str)


def through(spark, df, tmp_path, n_ranges=None):
    write_archives(df, f"{tmp_path}/archives")
    return merge_index(read_archives(spark, f"{tmp_path}/archives"), n_ranges)


def check(spark, df, tmp_path):
    rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    out = through(spark, df, tmp_path, 5).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str) == plain(rows)
    assert [r["position"] for r in sorted(out, key=lambda r: r["position"])] == list(range(1, len(out) + 1))
    keys = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in sorted(out, key=lambda r: r["position"])]
    assert keys == sorted(keys)


def test_driver_pages(llm, tmp_path):
    pages = llm.read.parquet(f"{SMALL}/pages.parquet")
    copies = pages.withColumn("page_id", F.col("page_id") + 1000).withColumn("url", F.lit("http://WWW.One.example/a#b"))
    check(llm, pages.union(copies).repartition(6), tmp_path)
    found = {}
    for f in (tmp_path / "archives").glob("*.gz"):
        for _, header, block in parse(gzip.open(f).read()):
            found[header["WARC-Record-ID"]] = block.split(b"\r\n\r\n", 1)[1].decode()
    assert all(found[f"<urn:page:{r['page_id']}>"] == r["html"] for r in pages.collect())


def test_awkward_pages(llm, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(1, None, None, "d", "f"), (2, "http://a/\r\nx: y", "", None, None), (3, "HTTPS://www.A.b/Q?x=1#f", big, "d", "f"), (4, "u", big, "d", "f"), (None, "u", big, "d", "f"), (3, "u", big, "d", "f"), (9, "u", "z" * 99, "d", "f"), (8, "u", "z" * 99, "d", "f"), (7, "u", "y" * 3_000_000, "d", "f")]
    check(llm, llm.createDataFrame(rows, PAGES), tmp_path / "a")
    assert through(llm, llm.createDataFrame([], PAGES), tmp_path / "b").count() == 0


def test_url_keys():
    assert url_key("https://WWW.Blog.Example.com/A/b?x=1#top") == "com,example,blog)/a/b?x=1"
    assert url_key("http://a.b") == "b,a)" and url_key("") == ")"


def test_loser_tree_merges_runs():
    for seed in range(100):
        r = random.Random(seed)
        runs = [sorted((r.randint(0, 40), i) for _ in range(r.randint(1, 30))) for i in range(r.randint(1, 9))]
        cut = [(run[j : j + n][0], run[j : j + n]) for run in runs for n in (r.randint(1, 7),) for j in range(0, len(run), n)]
        assert list(merged(iter(sorted(cut, key=lambda c: c[0])))) == sorted(sum(runs, []))
    tree = LoserTree([(3,), (1,), None, (2,)])
    assert tree.top == 1
