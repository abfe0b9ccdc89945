"""Chains of pages, and members of damaged archives."""

import io
import zipfile

from pyspark.sql import functions as F
from slatecast.sources.paging import in_order, paged_items
from slatecast.sources.readers import zip_lines

PAGES = "source string, token string, next_token string, items array<int>"


def test_chains_limits_gaps_and_cycles(spark):
    chain = [("a", "" if k == 0 else f"t{k}", f"t{k + 1}" if k < 20 else None, [3 * k, 3 * k + 1, 3 * k + 2]) for k in range(21)]
    rows = [*chain[::-1], ("gap", "", "x", [1]), ("cycle", "", "c", [1]), ("cycle", "c", "", [2, 3]), ("none", "z", None, [9]), ("short", "", None, []), ("self", "", "", [5])]
    df = spark.createDataFrame(rows, PAGES)
    items, found = paged_items(df, 50)
    got: dict[str, list] = {}
    for r in sorted(items.collect(), key=lambda r: (r["source"], r["n"])):
        assert r["n"] == len(got.setdefault(r["source"], []))
        got[r["source"]].append(r["item"])
    assert got == {"a": list(range(50)), "gap": [1], "cycle": [1, 2, 3], "self": [5]}
    status = {r["source"]: (r["n_items"], r["status"]) for r in found.collect()}
    assert status == {"a": (50, "limit"), "gap": (1, "gap"), "cycle": (3, "cycle"), "none": (0, "empty"), "short": (0, "complete"), "self": (1, "cycle")}
    assert {r["page"] for r in in_order(df.where("source = 'a'"), limit=5).collect()} == set(range(5))
    assert paged_items(df.where("source = 'a'"), 63)[1].first()["status"] == "complete"
    assert paged_items(df.limit(0), 5)[1].isEmpty()


def archive(method=zipfile.ZIP_DEFLATED, **members):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", method) as z:
        z.mkdir("folder")
        for name, text in members.items():
            z.writestr(name, text)
    return body.getvalue()


def test_members_that_cannot_be_read(spark):
    good = archive(a="x\ny\n", b="﻿z", empty="")
    bad = bytearray(archive(zipfile.ZIP_STORED, c="hello", d="fine"))
    bad[bad.find(b"hello")] ^= 1
    odd = archive(zipfile.ZIP_BZIP2, e="e")
    binary = archive(f=b"\xff\xfe\xfa")
    cut = bytearray(archive(g="some words, " * 50))
    at = cut.find(b"g") + 5
    cut[at : at + 10] = b"\xff" * 10
    df = spark.createDataFrame([("/p/good.zip", bytearray(good)), ("bad.zip", bad), ("odd.zip", bytearray(odd)), ("text.zip", bytearray(binary)), ("cut.zip", cut), ("no.zip", bytearray(b"no")), ("null.zip", None)], "path string, content binary")
    rows = zip_lines(df, 3).collect()
    assert sorted((r["member"], r["line_no"], r["line"]) for r in rows if r["error"] is None) == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("d", 0, "fine")]
    errors = {(r["archive"], r["member"]): r["error"] for r in rows if r["error"]}
    assert errors.pop(("cut.zip", "g")) in ("inflate", "checksum")
    assert errors == {("bad.zip", "c"): "checksum", ("odd.zip", "e"): "unknown method", ("text.zip", "f"): "encoding", ("no.zip", None): "no archive", ("null.zip", None): "no archive"}


def test_one_archive_is_unpacked_by_many_tasks(spark):
    body = archive(**{f"m{k}": "line\n" * 20 for k in range(50)})
    lines = zip_lines(spark.createDataFrame([("a.zip", bytearray(body))], "path string, content binary"), 8)
    used = lines.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in used) == 1000 and len(used) > 4
