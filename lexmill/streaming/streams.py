"""Structured Streaming twins of the batch jobs.

Each takes a ``home`` in a folder that driver and executors share: the query's progress, its state's
checkpoints and its result live there, and a stream that is started again at its home goes on where it
stopped. Without one it gets a fresh home and ends when it has read what is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from lexmill.sources.bucketed import BucketedTable
from lexmill.sources.tables import shared_folder

#: Width of a window and where it begins, by the name of its period; weeks begin on Mondays.
PERIODS = {"day": ("1 day", "0 days"), "week": ("7 days", "4 days")}


def _home(spark: SparkSession, given: str | None, name: str) -> str:
    return given or f"{shared_folder(spark.range(0))}/{name}-{uuid.uuid4().hex}"


def _arriving(spark: SparkSession, folder: str, files: str, schema, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def stream_period_counts(
    spark: SparkSession, folder: str, files: str, schema, time_col: str, group: str, period: str = "day", delay: str = "2 days", home: str | None = None, per_batch: int | None = None
) -> DataFrame:
    """(period, group, n) of the tumbling windows that the watermark has closed, each written once.

    The watermark is ``delay`` behind the latest time seen; a row whose window was closed before its
    batch began is late and dropped, and closed windows leave the state. Windows still open are in no result: they come
    when later rows close them. Rows without a time count nowhere.
    """
    home, (width, begin) = _home(spark, home, "counts"), PERIODS[period]
    arriving = _arriving(spark, folder, files, schema, per_batch).withColumn(time_col, F.col(time_col).cast("timestamp"))
    counted = arriving.withWatermark(time_col, delay).groupBy(F.window(time_col, width, startTime=begin).alias("w"), group).agg(F.count(F.lit(1)).alias("n"))
    closed = counted.select(F.col("w.start").cast("date").alias("period"), group, "n")
    sink = closed.writeStream.outputMode("append").format("parquet").option("path", f"{home}/table").option("checkpointLocation", f"{home}/log")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{home}/table")


def stream_upsert(spark: SparkSession, folder: str, files: str, schema, keys: list[str], order: str, home: str | None = None, per_batch: int | None = None, buckets: int = 16) -> DataFrame:
    """Arriving rows merged into the :class:`BucketedTable` at ``home``, last one wins.

    A batch writes the buckets that its keys fall into and then its commit record; a batch that
    comes again after that is known by its number and skipped, and one that was cut off before it
    is done anew, so each counts once.
    """
    stored = BucketedTable(_home(spark, home, "upsert"), schema, keys, buckets)
    stored.create(spark)

    def merge_batch(batch: DataFrame, number: int) -> None:
        stored.upsert(batch, number, order)

    arriving = _arriving(spark, folder, files, schema, per_batch)
    arriving.writeStream.foreachBatch(merge_batch).option("checkpointLocation", f"{stored.home}/log").trigger(availableNow=True).start().awaitTermination()
    return stored.read(spark)


class ChangeFeed(StatefulProcessor):
    """Of each key the last hash that was seen, and the rows that wait for the watermark to pass them.

    The last four columns of its input are time in milliseconds, order, hash and value.
    """

    def __init__(self, fields: list[str], waiting: str, keep_ms: int):
        self.fields, self.waiting_schema, self.keep_ms = fields, waiting, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string, at long")
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed, arrived = timerValues.getCurrentWatermarkInMs(), []
        for part in rows:
            arrived += [r for r in part.iloc[:, -4:].itertuples(index=False, name=None) if r[0] > passed]  # others are late
        if arrived:
            self.waiting.appendList([(int(at), int(order), digest, value) for at, order, digest, value in arrived])
            self.handle.registerTimer(int(min(r[0] for r in arrived)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, later = sorted(r[:2] + (r[2] or "", r[3]) for r in held if r[0] <= passed), [r for r in held if r[0] > passed]
        before, seen = self.last.get() if self.last.exists() else (None, None)
        if seen is not None and not due and seen + self.keep_ms <= passed:
            self.last.clear()
        changed = []
        for at, order, digest, value in due:
            if before is None or digest != before or seen + self.keep_ms <= at:
                changed.append((*key, order, value))
            before, seen = digest, at
        if due:
            self.last.update((before, seen))
            self.handle.registerTimer(seen + self.keep_ms)
            self.waiting.clear()
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(min(r[0] for r in later))
        if changed:
            yield pd.DataFrame(changed, columns=self.fields)

    def close(self) -> None:
        pass


def stream_changes(
    spark: SparkSession, folder: str, files: str, schema, key: str, value: str, order: str, time_col: str, delay: str = "2 days", keep_days: int = 3650, home: str | None = None, per_batch: int | None = None
) -> DataFrame:
    """(key, order, value) of the rows whose value's hash differs from that of the row before, by time and then ``order``.

    Rows wait until the watermark, ``delay`` behind the latest time, has passed them and are then
    judged in order, so the result does not depend on how they came in batches; rows that come behind
    the watermark are dropped. A key's last hash is forgotten ``keep_days`` after its last row. The
    state is kept in RocksDB and has one hash and the waiting rows of a key. Null values are one value.
    """
    home = _home(spark, home, "changes")
    out = T.StructType([T.StructField(key, schema[key].dataType), T.StructField(order, T.LongType()), T.StructField(value, schema[value].dataType)])
    arriving = _arriving(spark, folder, files, schema, per_batch).withColumn(time_col, F.col(time_col).cast("timestamp"))
    rows = arriving.withWatermark(time_col, delay).select(
        key, time_col, F.unix_millis(time_col).alias("_at"), F.col(order).cast("long").alias("_order"), F.md5(F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("_hash"), F.col(value).alias("_value")
    )
    feed = ChangeFeed(out.names, f"at long, ord long, digest string, value {schema[value].dataType.simpleString()}", keep_days * 86_400_000)
    found = rows.filter(F.col("_at").isNotNull()).groupBy(key).transformWithStateInPandas(feed, out, "append", "EventTime")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sink = found.writeStream.format("parquet").option("checkpointLocation", f"{home}/log").option("path", f"{home}/table").outputMode("append")
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out).parquet(f"{home}/table")
