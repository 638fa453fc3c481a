"""A stored table in buckets of its key, of which a merge rewrites only those it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.merge import upsert_last_wins

_COMMIT = "bucket int, version long"


@dataclass
class BucketedTable:
    """Rows by the hash of ``keys``, or of those of them in ``bucket_by``, in ``buckets`` folders under ``home``.

    ``home/data/version=N/bucket=B`` holds bucket B as batch N left it, ``home/commits/batch=N`` the
    record that batch N is done, with the buckets it wrote. A bucket's rows are those of its newest
    version that a record names; folders without a record are what is left of a batch that was cut off.
    Everything is written and read by Spark's own writers, so any store will do.
    """

    home: str
    schema: T.StructType
    keys: list[str]
    buckets: int = 16
    bucket_by: list[str] | None = None

    def create(self, spark: SparkSession) -> None:
        """An empty table, unless there is one."""
        spark.createDataFrame([], _COMMIT).write.mode("ignore").parquet(f"{self.home}/commits/batch=-1")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.bucket_by or self.keys)), F.lit(self.buckets)).cast("int")

    def _commits(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{_COMMIT}, batch long").parquet(f"{self.home}/commits")

    def versions(self, spark: SparkSession) -> dict[int, int]:
        """Bucket -> its newest committed version; at most ``buckets`` rows."""
        return dict(self._commits(spark).filter("bucket is not null").groupBy("bucket").agg(F.max("version")).collect())

    def committed(self, spark: SparkSession, number: int) -> bool:
        """Whether the batch is done; the record of a batch without rows has a null bucket."""
        return not self._commits(spark).filter(F.col("batch") == number).isEmpty()

    def _rows(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        folders = [f"{self.home}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows as the last committed batch left them."""
        return self._rows(spark, self.versions(spark))

    def read_beside(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that ``rows``, which have the columns of ``bucket_by``, fall into."""
        spark = rows.sparkSession
        touched = {r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()}
        return self._rows(spark, {b: v for b, v in self.versions(spark).items() if b in touched})

    def upsert(self, batch: DataFrame, number: int, order: str) -> bool:
        """Insert or replace whole rows, the last by ``order`` winning; false if the batch is done already.

        Numbers ascend. Only the buckets of the batch's keys are read and written; rows are exchanged
        by their key once. Null keys are a key of their own.
        """
        spark = batch.sparkSession
        if self.committed(spark, number):
            return False
        touched = [r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets`` rows
        if touched:
            known = {b: v for b, v in self.versions(spark).items() if b in touched}
            merged = upsert_last_wins(self._rows(spark, known), batch.select(*self.schema.names), self.keys, order)
            merged.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.home}/data/version={number}")
        record = spark.createDataFrame([(b, number) for b in touched] or [(None, number)], _COMMIT)
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.home}/commits/batch={number}")
        return True
