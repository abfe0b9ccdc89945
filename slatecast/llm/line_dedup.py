"""Removal of repeated three-line windows across a corpus (operator 4), with DataFrame functions only.

Lines are split at line feeds; lines without a word stay where they are and are not counted. A window is three
consecutive counted lines of one document. Of equal windows the first, by document id and place, stays; the
lines of every later one are removed. Windows are judged on the input, and overlapping ones are merged, so a
line goes once any window that covers it goes. Windows are compared by 128 bits of hash.

Cases: null text counts as empty and stays null. Documents of fewer than three counted lines have no
window and stay whole. Rows equal in id and text are one document and get one outcome. Null ids sort first.
An empty table gives an empty result. Extra columns are kept by ``drop_repeated_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, materialise

HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _counted(lines: Column) -> Column:
    """Places and hashes of the lines that have a word."""
    placed = F.transform(lines, lambda x, i: F.when(x.rlike(HAS_WORD), F.struct(i.alias("at"), F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))))
    return F.filter(placed, lambda x: x.isNotNull())


def _windows(counted: Column) -> Column:
    def one(j: Column) -> Column:
        part = [F.get(counted, j + k) for k in range(3)]
        return F.struct(j.alias("start"), *(F.xxhash64(*(p[c] for p in part)).alias(c) for c in ("a", "b")))

    return F.when(F.size(counted) >= 3, F.transform(F.sequence(F.lit(0), F.size(counted) - 3), one))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, starts): for each document the windows that occurred before, by their first line's rank."""
    made = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("version"), let(_counted(_lines(docs[text_col])), _windows).alias("found"))
    made = made.select("id", "version", F.explode("found").alias("w")).select("id", "version", "w.start", "w.a", "w.b")
    made = materialise(made, "line-windows")
    place = F.struct("id", "version", "start")
    first = made.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.select(F.col("a").alias("first_a"), F.col("b").alias("first_b"), "first"), "first-windows")
    later = made.join(first, (F.col("a") == F.col("first_a")) & (F.col("b") == F.col("first_b"))).where(place > F.col("first"))
    return later.groupBy("id", "version").agg(F.collect_set("start").alias("starts"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """The documents, in their columns, without repeated lines; with ``counts`` also n_lines and n_removed."""
    gone = repeated_windows(docs, id_col, text_col)
    gone_id, gone_version, starts = fresh(docs, "gone_id_", "gone_version_", "gone_starts_")
    gone = gone.select(F.col("id").alias(gone_id), F.col("version").alias(gone_version), F.col("starts").alias(starts))
    text = docs[text_col]
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[gone_id]) & (F.xxhash64(text) == gone[gone_version]), "left")

    def places(counted: Column) -> Column:
        covered = F.flatten(F.transform(gone[starts], lambda s: F.array(*(F.get(counted, s + k)["at"] for k in range(3)))))
        return F.array_distinct(covered)

    def without(lines: Column) -> Column:
        covered = let(_counted(lines), places)
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.struct(F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n").alias("text"), F.size(covered).alias("n"))

    (made,) = fresh(docs, "gone_done_")
    done = F.when(gone[starts].isNotNull(), let(_lines(text), without))
    out = joined.withColumn(made, done)
    kept_text = F.when(F.col(made).isNull(), text).otherwise(F.col(f"{made}.text"))
    cols = [kept_text.alias(c) if c == text_col else docs[c] for c in docs.columns]
    if counts:
        n_lines = F.size(F.filter(_lines(text), lambda x: x.rlike(HAS_WORD)))
        cols += [n_lines.cast("bigint").alias("n_lines"), F.coalesce(f"{made}.n", F.lit(0)).cast("bigint").alias("n_removed")]
    return out.select(*cols)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: its counted lines, how many were removed, and a digest of what is left."""
    from .shared import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)
),
counted AS (
  SELECT *, row_number() OVER w AS n, lead(line) OVER w AS line2, lead(line, 2) OVER w AS line3
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
later AS (
  SELECT doc_id, n FROM counted WHERE line3 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, n) > 1
),
gone AS (
  SELECT DISTINCT c.doc_id, c.pos FROM counted c JOIN later l ON c.doc_id = l.doc_id AND c.n BETWEEN l.n AND l.n + 2
),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS n_removed,
         count(*) FILTER (WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]')) AS n_lines
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM kept
"""
