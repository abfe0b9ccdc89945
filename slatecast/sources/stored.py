"""A stored table that batches of rows are merged into: only partitions with changed keys are written again, and a batch counts once.

The table is a folder of Parquet partitions. A batch reads the partitions that its keys lie in, merges, and replaces these by dynamic
partition overwrite; other partitions keep their files. The merged rows are written aside first, so that no partition is read and
overwritten at once. The batch's name is noted last: a batch that broke off is merged again with the same result, since merging
the same rows twice changes nothing, and a batch that is noted does nothing. One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import delete_by, upsert
from .writers import written


class StoredTable:
    """``keys`` name a row, ``partition`` is a column of few values that a key's rows never change."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], partition: str):
        self.spark, self.path, self.keys, self.partition = spark, path, list(keys), partition
        self.schema = spark.createDataFrame([], schema).schema
        if partition not in self.schema.fieldNames() or not set(keys) <= set(self.schema.fieldNames()):
            raise ValueError("keys and partition have to be columns")

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def read(self) -> DataFrame:
        rows = f"{self.path}/rows"
        if not self._there(rows):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(rows).select(*self.schema.fieldNames())

    def batches(self) -> DataFrame:
        at = f"{self.path}/batches"
        return self.spark.read.schema("batch string, partitions bigint").parquet(at) if self._there(at) else self.spark.createDataFrame([], "batch string, partitions bigint")

    def _replace(self, batch: str, changed: DataFrame, new) -> bool:
        """Put ``new(old rows of the partitions in changed)`` in place of these; False if the batch was noted before."""
        if not self.batches().where(F.col("batch") == batch).isEmpty():
            return False
        hit = changed.select(F.col(self.partition).alias("hit_")).distinct()
        values = [r["hit_"] for r in hit.collect()]  # partitions, so few that each is a folder
        if values:
            known = [v for v in values if v is not None]
            within = F.col(self.partition).isin(known) | (F.col(self.partition).isNull() if None in values else F.lit(False))
            rows = written(new(self.read().where(within)), "merged")
            left = rows.select(self.partition).distinct()
            gone = [r["hit_"] for r in hit.join(left, hit["hit_"].eqNullSafe(left[self.partition]), "left_anti").collect()]
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(f"{self.path}/rows")
            for value in gone:  # partitions that lost all rows
                name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/{self.partition}={name}")
                at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        self.spark.createDataFrame([(batch, len(values))], "batch string, partitions bigint").write.mode("append").parquet(f"{self.path}/batches")
        return True

    def merge(self, batch: str, updates: DataFrame, order: Sequence[Column] = (), keep_old: Sequence[str] = (), keep_new: Sequence[str] = ()) -> bool:
        """Rows of new keys are added, others replaced; of several rows of a key the largest ``order`` counts. Whether the batch was new."""
        rows = updates.select(*self.schema.fieldNames())
        return self._replace(batch, rows, lambda old: upsert(old, rows, [*self.keys, *([self.partition] if self.partition not in self.keys else [])], order, keep_old, keep_new))

    def delete(self, batch: str, gone: DataFrame) -> bool:
        """Rows whose keys and partition are in ``gone`` go. Whether the batch was new."""
        return self._replace(batch, gone, lambda old: delete_by(old, gone.select(*self.keys).distinct(), self.keys))
