"""Merkle manifest against a plain tree, SQL, and forged rows."""

import zlib
from hashlib import sha256

import duckdb
from plain import AWKWARD, DOCS, SMALL
from pyspark.sql import functions as F
from slatecast.llm import manifest

FIELDS = manifest.FIELDS


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(hashes):
    """The top, and for each node the runs above it with its slot."""
    over, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, p in enumerate(at):
            over[k].append((runs[p // 8], p % 8))
        at, level = [p // 8 for p in at], [H(*r) for r in runs]
    return level[0], over


def expected(rows, text=FIELDS.index("text")):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: climb([leaf_of(r) for r in groups[g]]) for g in langs}
    root, above = climb([made[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above, strict=True):
        for r, over in zip(groups[g], made[g][1], strict=True):
            shown = list(r)
            if r[0] is not None and r[text] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                shown[text] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[text])
            cur = leaf_of(shown)
            for run, slot in over + up:
                cur = H(*run[:slot], cur, *run[slot + 1 :])
            beside = H(*(x for run, slot in over + up for i, x in enumerate(run) if i != slot))
            out.append((r[0], leaf_of(r), made[g][0], root, beside, cur, cur == root))
    return sorted(out, key=str)


def got(df):
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = manifest.leaf_digest([F.translate("text", manifest._UPPER, manifest._LOWER) if f == "text" else df[f] for f in FIELDS])
    out = manifest.manifest(df, keep={"shown": F.when(hit, changed)})
    root = manifest.fold(F.coalesce("shown", "leaf"), F.col("path"))
    return sorted((tuple(r) for r in out.select("id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256), root, root == F.col("root")).collect()), key=str)


def test_driver_rows_and_sql(llm, documents, rows):
    want = expected([tuple(r[f] if r[f] == r[f] else None for f in FIELDS) for r in rows])
    out = manifest.op13_merkle_manifest(llm, SMALL)
    assert sorted(map(tuple, out.collect()), key=str) == want and len({r[6] for r in want}) == 2
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    sql = db.sql(manifest.OP13_SQL)
    assert sorted(sql.fetchall(), key=str) == want and sql.columns == out.columns


def test_awkward_rows(awkward, no_documents):
    picked = [dict(zip([c.split()[0] for c in DOCS.split(", ")], r, strict=True)) for r in AWKWARD]
    want = expected([tuple(r[f] for f in FIELDS) for r in picked])
    assert got(awkward) == want  # a null language, repeated rows, null ids and texts
    assert got(no_documents) == []


def test_single_rows_and_many_groups(llm):
    one = [(1, "s", None, 3, "abc")]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    assert got(llm.createDataFrame(one, schema)) == expected(one)
    many = [(i, "s", f"l{i % 70}" if i % 3 else "hot", i, f"Text {i}") for i in range(900)]
    assert got(llm.createDataFrame(many, schema).repartition(13)) == expected(many)


def test_forged_rows_are_found(llm):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(100)]
    df = llm.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    out = manifest.manifest(df, keep={"same": manifest.leaf_digest([df[f] for f in FIELDS]), "forged": manifest.leaf_digest([df[f] if f != "source" else F.lit("t") for f in FIELDS])})
    r = out.select(F.bool_and(manifest.fold(F.col("same"), F.col("path")) == F.col("root")), F.bool_or(manifest.fold(F.col("forged"), F.col("path")) == F.col("root"))).first()
    assert tuple(r) == (True, False)
