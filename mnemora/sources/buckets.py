"""A keyed Parquet table in hash buckets: a change rewrites the buckets it touches and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemora.session import scratch_dir

BUCKET = "_bucket"


class BucketedTable:
    """Rows under one folder, a subfolder for each hash bucket of the key."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int, schema: StructType):
        self.spark, self.folder, self.key, self.buckets, self.schema = spark, folder, key, buckets, schema

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: str = "id", buckets: int = 64) -> BucketedTable:
        """Write all rows; one task writes each bucket, so a bucket is about as large as a file should be."""
        made = cls(rows.sparkSession, folder, key, buckets, rows.schema)
        made._write(rows)
        return made

    def _numbered(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        numbered = self._numbered(rows).repartition(BUCKET)
        writer = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self.folder)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; the others are not listed."""
        full = StructType([*self.schema.fields, self._numbered(self.spark.createDataFrame([], self.schema)).schema[BUCKET]])
        rows = self.spark.read.schema(full).parquet(self.folder)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(buckets))
        return rows.drop(BUCKET)

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put ``merge(rows, changes)`` in the place of the rows in buckets that hold keys of ``changes``.

        The merged rows are written aside first; then Spark's commit exchanges the folders of these buckets.
        Returns their numbers, at most as many as there are buckets. Keys that the table does not hold touch a
        bucket as well, so a merge may add rows.
        """
        numbered = self._numbered(changes.select(self.key)).select(BUCKET).distinct()
        touched = sorted(r[BUCKET] for r in numbered.collect())
        if touched:
            aside = scratch_dir(self.spark, "bucket-changes")
            merge(self.read(touched), changes).select(*self.schema.names).write.parquet(aside)
            self._write(self.spark.read.schema(self.schema).parquet(aside))
        return touched
