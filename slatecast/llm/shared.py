"""Shared-folder tables, table reads and Arrow plumbing used by the operators of this folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but a space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver found it, once for each application; bound Arrow batches by bytes.

    Spark's own bound is far above what ``pieces`` takes at a time, and a batch is held by both the executor and
    its Python worker.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "8m")
    context = spark.sparkContext
    if getattr(context, "_slatecast_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    at = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "slatecast"), "zip", root, "slatecast")
    context.addPyFile(at)
    context._slatecast_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``, with a part for each application.

    A session on one machine (master ``local``) without that setting gets a temporary folder; on a cluster the
    setting is required, since a machine's own folders are no place for tables.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{at.rstrip('/')}/slatecast-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove the tables that this application's operators wrote; frames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: a lost executor costs only the tasks after the table, and the written rows stay
    the same however often they are read. Plans over the result start from a scan, so adaptive execution
    may split skewed join partitions on either side.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != F.lit(""))


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def texts_of(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    binary = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(binary).to_pylist()]


def pieces(batch: pa.RecordBatch, name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each piece add up to ``most`` bytes or are one text."""
    sizes = pc.fill_null(pc.binary_length(columns(batch, name)[0]), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)
