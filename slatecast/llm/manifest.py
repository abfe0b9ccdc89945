"""Merkle manifest of a dataset: a tree of digests a group, a root over the groups, proofs and checks of rows (operator 13).

Every row is a leaf: sha256 of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Leaves of a
group ascend by the order column; every ``FAN`` consecutive nodes become one parent until one is left, the group's
subroot, and the subroots, by group, null first, become the root in the same way.

The method is that of parent preimages: for each parent the concatenated digests of its children are stored, once. A path
is handed down from the top: each parent passes its own preimage and those above on to its children, so a leaf needs
one join to hold all preimages over it. Siblings are a preimage without the leaf's own 64 characters; folding puts the
digest so far in their place and hashes.

Places come from one sort by ranges: rows get rising numbers within a range, ranges are added up by group, so no task
holds a group. Every task holds ranges, runs of ``FAN`` nodes or single rows only.

Cases: null fields count as ``-``, so null and empty text differ. A null order value sorts first, a null group is a group
of its own. Rows with equal order values are ordered by their digest; repeated rows are leaves of their own and share
all but their place. A lone leaf is its group's subroot, and one group's subroot is the root; a leaf without any sibling
has the digest of the empty string as proof. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, table

FAN = 8
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row: its fields in order, each with its length in bytes."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*(part(f) for f in fields)), 256)


def placed(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` (with a column tree) and their place ``pos`` in their tree, from 0, ordered by ``by``, and the tree's ``size``.

    Rows that agree in all of ``by`` and make the hottest value are still dealt out if ``by`` ends in a column that
    tells them apart.
    """
    laid = rows.repartitionByRange("tree", *by).sortWithinPartitions("tree", *by).withColumn("at", F.monotonically_increasing_id())
    laid = materialise(laid.withColumn("range", F.shiftright("at", 33)), "laid")
    ranges = laid.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ranges = ranges.selectExpr(
        "tree AS tree_",
        "range AS range_",
        "sum(n) OVER (PARTITION BY tree ORDER BY range) - n - first AS shift",
        "sum(n) OVER (PARTITION BY tree) AS size",
    )
    out = laid.join(ranges, (F.col("tree") == F.col("tree_")) & (F.col("range") == F.col("range_")))
    return out.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "tree_", "range_", "shift")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Parents (tree, pos, size, preimage, hash) of each level over ``nodes`` (tree, pos, size, hash), and the top (tree, hash) of each tree.

    ``size`` is the number of nodes that a tree has on the level.
    """
    levels, tops = [], nodes.where("size = 1").select("tree", "hash")
    while not nodes.where("size > 1").isEmpty():
        runs = nodes.where("size > 1").groupBy("tree", F.expr(f"pos DIV {FAN}").alias("pos"))
        child = F.array_sort(F.collect_list(F.struct((F.col("pos") % FAN).alias("slot"), "hash")))
        size = F.ceil(F.max("size") / FAN).alias("size")
        nodes = runs.agg(size, F.array_join(F.transform(child, lambda x: x["hash"]), "").alias("preimage"))
        nodes = materialise(nodes.withColumn("hash", F.sha2("preimage", 256)), "parents")
        levels.append(nodes)
        tops = tops.unionByName(nodes.where("size = 1").select("tree", "hash"))
    return levels, tops


def paths(nodes: DataFrame, levels: list[DataFrame], start: DataFrame) -> DataFrame:
    """``nodes`` with the columns of ``start`` (tree, path, ...), where path holds a slot and a preimage for each ancestor, nearest first.

    ``start`` says what is above the top of each tree; ``nodes`` are those under ``levels``.
    """
    more = [c for c in start.columns if c not in ("tree", "path")]
    above = None
    for level in [*reversed(levels), nodes]:
        own = level.where("size = 1").join(start, "tree")
        if above is not None:
            up = above.select(F.col("tree").alias("tree_"), F.col("pos").alias("pos_"), F.col("preimage").alias("over_"), F.col("path").alias("path_"), *more)
            under = level.where("size > 1").join(up, (F.col("tree") == F.col("tree_")) & (F.expr(f"pos DIV {FAN}") == F.col("pos_")))
            step = F.struct((F.col("pos") % FAN).cast("int").alias("slot"), F.col("over_").alias("preimage"))
            under = under.withColumn("path", F.concat(F.array(step), "path_")).drop("tree_", "pos_", "over_", "path_")
            own = own.unionByName(under)
        above = own
    return above


def _around(step: Column) -> tuple[Column, Column]:
    """The preimage of a step before and after the node's own slot."""
    pre, slot = step["preimage"], step["slot"]
    return F.substring(pre, F.lit(1), slot * DIGEST), F.substring(pre, (slot + 1) * DIGEST + 1, F.lit(FAN * DIGEST))


def siblings(path: Column) -> Column:
    """All digests beside a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(*_around(s))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to: at each step it takes its slot, and the preimage is hashed."""

    def up(digest: Column, step: Column) -> Column:
        before, after = _around(step)
        return F.sha2(F.concat(before, digest, after), 256)

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path) and the columns of ``keep`` for each row.

    ``path`` has the slot and the preimage of every ancestor up to the root; ``siblings`` and ``fold`` read it.
    """
    keep = keep or {}
    tree = F.when(docs[group].isNull(), "").otherwise(F.concat(F.lit("="), docs[group].cast("string")))
    rows = docs.select(tree.alias("tree"), docs[order].alias("id"), leaf_digest([docs[f] for f in fields]).alias("hash"), F.monotonically_increasing_id().alias("apart"), *(c.alias(n) for n, c in keep.items()))
    leaves = placed(materialise(rows, "leaves"), "id", "hash", "apart").drop("apart")
    levels, subroots = climb(leaves)
    under_root = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "hash"), "group")
    upper, root = climb(under_root)
    none = F.array().cast("array<struct<slot:int,preimage:string>>")
    start = paths(under_root, upper, root.select("tree", F.col("hash").alias("root"), none.alias("path")))
    start = materialise(start.select(F.col("group").alias("tree"), F.col("hash").alias("subroot"), "root", "path"), "groups")
    return paths(leaves, levels, start).select("id", F.col("hash").alias("leaf"), "subroot", "root", "path", *keep)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its digests and proof, and the root that a copy, tampered with for a third of the ids, leads to."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = leaf_digest([F.translate("text", _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS])
    out = manifest(docs, keep={"shown": F.when(hit, changed)})
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.coalesce("shown", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes; ``crc`` has to be the array of ``CRC_TABLE``."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::INTEGER)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]), 4294967295::BIGINT))"


#: The remainders of all bytes by the reversed polynomial of crc32, worked out by the database.
CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"


def _sql(levels: int) -> str:
    """The whole tree by levels; ``levels`` bounds it to FAN ** levels rows a group and as many groups."""

    def digest(text: str) -> str:
        def part(c: str) -> str:
            return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"

        return "sha256(" + " || ".join(part(text if f == "text" else f"d.{f}") for f in FIELDS) + ")"

    def tree(name: str, base: str) -> str:
        """Nodes by level: runs of trees with several nodes are hashed, single nodes stay."""
        out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {base})"]
        for i in range(levels):
            parent = f"CASE WHEN size > 1 THEN pos // {FAN} ELSE pos END"
            digests = f"string_agg(hash, '' ORDER BY {name}{i}.pos)"
            out.append(
                f"{name}{i + 1} AS (SELECT tree, {parent} AS pos, CASE WHEN max(size) > 1 THEN sha256({digests}) ELSE max(hash) END AS hash, "
                f"list(hash ORDER BY {name}{i}.pos) AS kids, max(size) > 1 AS real, CAST(ceil(max(size) / {FAN}) AS BIGINT) AS size FROM {name}{i} GROUP BY tree, {parent})"
            )
        return ",\n".join(out)

    def ancestors(name: str, alias: str) -> str:
        out = ""
        for i in range(1, levels + 1):
            p = f"{name}p{i}"
            out += f"\n  JOIN {name}{i} {p} ON {p}.tree IS NOT DISTINCT FROM {alias}.tree AND {p}.pos = CASE WHEN {p}.real THEN {alias}.pos // {FAN**i} ELSE 0 END"
        return out

    steps = [(n, i) for n in ("g", "r") for i in range(1, levels + 1)]
    beside, folds, last = [], [], "walk"
    for k, (n, i) in enumerate(steps):
        kids, slot = f"{n}k{i}", f"({n}pos // {FAN ** (i - 1)} % {FAN})"
        before, after = f"array_to_string({kids}[1:{slot}], '')", f"array_to_string({kids}[{slot} + 2:], '')"
        beside.append(f"CASE WHEN {kids} IS NULL THEN '' ELSE {before} || {after} END")
        folds.append(f"fold{k} AS (SELECT * REPLACE (CASE WHEN {kids} IS NULL THEN shown ELSE sha256({before} || shown || {after}) END AS shown) FROM {last})")
        last = f"fold{k}"
    kids = ", ".join(f"CASE WHEN {n}p{i}.real THEN {n}p{i}.kids END AS {n}k{i}" for n, i in steps)
    changed = digest(f"translate(d.text, '{_UPPER}', '{_LOWER}')")
    folds_sql = ",\n".join(folds)
    return f"""
WITH crcs AS (SELECT {CRC_TABLE} AS crc),
leaves AS (
  SELECT d.lang AS tree, d.doc_id, {digest('d.text')} AS hash, CASE WHEN {crc32_sql('d.doc_id::VARCHAR')} % 3 = 0 THEN {changed} END AS changed
  FROM documents d, crcs
),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos FROM leaves),
{tree('g', '(SELECT tree, pos, hash FROM placed)')},
subroots AS (SELECT NULL::VARCHAR AS tree, tree AS lang, hash, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM g{levels}),
{tree('r', '(SELECT tree, pos, hash FROM subroots)')},
walk AS (
  SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, rp{levels}.hash AS root, l.pos AS gpos, s.pos AS rpos, coalesce(l.changed, l.hash) AS shown, {kids}
  FROM placed l {ancestors('g', 'l')}
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.tree {ancestors('r', 's')}
),
{folds_sql}
SELECT doc_id, leaf, subroot, root, sha256({' || '.join(beside)}) AS proof_sha256, shown AS folded_root, shown = root AS verified FROM {last}
"""


OP13_SQL = _sql(5)
