"""Tables in and out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.merge import newest_per_key


def shared_folder(df: DataFrame) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="lexmill-")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark.range(0))}/{name}-{uuid.uuid4().hex}"


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores: a small file of one row group would keep one task busy with its texts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def round_trip(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """Write a partitioned Parquet table and read it with the declared schema."""
    path = f"{shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: list[str], spread: list[str] | None = None, parts: int = 8) -> None:
    """Write ``df`` over those partitions of the table at ``path`` that it has rows for; others keep their files.

    ``spread`` names columns whose hash deals a partition's rows to ``parts`` tasks, so that a large one is not written by one.
    """
    dealt = [F.pmod(F.xxhash64(*spread), F.lit(parts))] if spread else []
    df.repartition(*partition_by, *dealt).write.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def replace_code_articles(batch: DataFrame, path: str, order: str) -> DataFrame:
    """All stored articles of the codes in ``batch`` are replaced by it; (code_id, n_articles) of those codes.

    The table at ``path`` is partitioned by code. Of batch rows with the same code, article and version
    date the last by ``order`` wins; base rows are current, not repealed and have an empty hash. Rows
    without a code are left out, for no partition is theirs.
    """
    keys = ["code_id", "article_number", "version_date"]
    flags = {"is_current": F.lit(True), "is_repealed": F.lit(False), "text_hash": F.lit("")}
    rows = newest_per_key(batch.filter("code_id is not null"), keys, F.desc(order)).withColumns(flags)
    write_partitions(rows, path, ["code_id"], ["article_number"])
    codes = batch.select("code_id").distinct()
    stored = batch.sparkSession.read.schema(rows.schema).parquet(path)
    return stored.join(codes, "code_id", "left_semi").groupBy("code_id").agg(F.count_distinct("article_number").alias("n_articles"))


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, parts: int = 8, fetch: int = 10_000, quote: str = '"', **options: str) -> DataFrame:
    """A table of a database, read by ranges of a numeric or date ``column`` in ``parts`` connections.

    The bounds are asked of the database first; rows outside them that come meanwhile, and rows with a
    null, are read too, for the ranges at the ends are open. Filters and chosen columns go to the database.
    ``quote`` is the database's mark around names of columns.
    """
    reader = lambda: spark.read.format("jdbc").options(url=url, fetchsize=fetch, **options)
    bounds = reader().option("query", f"SELECT min({quote}{column}{quote}) AS lo, max({quote}{column}{quote}) AS hi FROM {name}").load().first()
    if bounds is None or bounds[0] is None or parts < 2:
        return reader().option("dbtable", name).load()
    return reader().options(dbtable=name, partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=parts).load()


def write_jdbc(df: DataFrame, url: str, name: str, parts: int = 8, batch: int = 5_000, **options: str) -> None:
    """Append ``df`` to a table of a database in batches, over at most ``parts`` connections."""
    df.coalesce(parts).write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).mode("append").save()
