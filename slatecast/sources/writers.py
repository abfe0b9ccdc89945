"""Writers and the changes to stored tables that aren't plain upserts.

Files go through Spark's writers, so any file system that Spark knows will do.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; a session on one machine may lack the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{at.rstrip('/')}/files-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: its plan ends there, and a lost executor costs only the tasks after it."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Remove the files that this application's queries wrote; frames that read them are of no use afterwards."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder(spark, "any")).getParent()
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], one_file: bool = False) -> None:
    """Columns in a fixed order, with a header; ``one_file`` is for reports, whose size doesn't grow with the data."""
    out = df.select(*columns)
    (out.coalesce(1) if one_file else out).write.option("header", True).option("nullValue", "").csv(path)


def escaped(text: str | Column) -> Column:
    r"""Text for a field of a TSV: backslash, tab, line ends and NUL as ``\\``, ``\t``, ``\n``, ``\r`` and ``\0``, so that a row stays one line."""
    out = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\\"), F.lit(r"\\"))
    for sign, code in (("\t", r"\t"), ("\n", r"\n"), ("\r", r"\r"), ("\0", r"\0")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def write_tsv(df: DataFrame, path: str) -> None:
    r"""Tab-separated values with a header, gzipped; nulls are ``\N``, quotes are ordinary and blanks around values stay."""
    out = df.write.option("sep", "\t").option("header", True).option("nullValue", r"\N").option("quote", "").option("compression", "gzip")
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Lines of JSON, added to what is there; a write shows whole or not at all."""
    df.write.mode("append").json(path)


def pending(df: DataFrame, done: DataFrame, run: str, keys: Sequence[str]) -> DataFrame:
    """Rows that no checkpoint line of this run has."""
    return df.join(done.where(F.col("run") == run).select(*keys), list(keys), "left_anti")


def transition(base: DataFrame, changes: DataFrame, key: str, now: Column) -> DataFrame:
    """States after changes of status: ``attempts`` grows only on the way into running, ``finished_at`` is set by the end and cleared by a new start.

    ``base`` is (key, status, attempts, finished_at), ``changes`` (key, new_status), at most one for a key.
    """
    joined = base.join(changes, key, "full")
    new, starts = F.col("new_status"), F.coalesce((F.col("new_status") == "running") & (F.coalesce("status", F.lit("")) != "running"), F.lit(False))
    return joined.select(
        key,
        F.coalesce(new, "status").alias("status"),
        (F.coalesce("attempts", F.lit(0)) + starts.cast("int")).alias("attempts"),
        F.when(new.isin("done", "failed"), now).when(starts, F.lit(None)).otherwise(F.col("finished_at")).alias("finished_at"),
    )


def update_from(base: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The base with ``values`` taken from the source's row of its keys, 0 where it has none."""
    new = source.select(*keys, *(F.col(v).alias(f"{v}_new_") for v in values))
    out = base.join(new, list(keys), "left")
    return out.select(*(F.coalesce(f"{c}_new_", F.lit(0)).alias(c) if c in values else F.col(c) for c in base.columns))


def delete_counts(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> DataFrame:
    """(name, deleted, kept) for each table: how many rows a delete by ``gone`` takes and leaves."""
    out = None
    for name, (df, column) in tables.items():
        marks = gone.select(F.col(key).alias("gone_")).distinct().withColumn("hit_", F.lit(True))
        row = df.join(marks, df[column] == F.col("gone_"), "left").agg(F.count("hit_").alias("deleted"), (F.count("*") - F.count("hit_")).alias("kept")).select(F.lit(name).alias("name"), "deleted", "kept")
        out = row if out is None else out.union(row)
    return out
