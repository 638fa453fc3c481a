"""A stored history of articles that batches of amendments carry on.

Snapshots lie in a :class:`BucketedTable` by article. A batch is folded from the newest stored
snapshot of the articles that it touches; all others keep their files. What became of each change is
kept in a log beside the table, from which reports and the amendment log are made.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.consolidation import replace_text
from lexmill.operators.merge import newest_per_key, upsert_columns
from lexmill.operators.versions import KEY, mark_superseded
from lexmill.sources.bucketed import BucketedTable

_TEXT, _DAY, _FLAG = T.StringType(), T.DateType(), T.BooleanType()
SNAPSHOT = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in {
            "code_id": _TEXT,
            "article_number": _TEXT,
            "version_date": _DAY,
            "article_text": _TEXT,
            "repealed_date": _DAY,
            "is_current": _FLAG,
            "is_repealed": _FLAG,
            "text_hash": _TEXT,
            "last_eo": T.LongType(),
            "amendment_date": _DAY,
        }.items()
    ]
)
#: What may become of a change, the worst last.
STATUSES = ("applied", "failed", "conflict")
_LOG = "code_id string, article_number string, version_date date, eo long, action string, status string, error string, snapshot boolean"
_STEPS = ["code_id", "article_number", "version_date", "eo", "is_base", "kind", "old", "new", "repealed_date"]


def snapshot_store(home: str, buckets: int = 16) -> BucketedTable:
    return BucketedTable(home, SNAPSHOT, [*KEY, "version_date"], buckets, KEY)


def _apply(text: str | None, kind: str | None, old: str | None, new: str | None) -> tuple[str | None, str | None]:
    """(text after the change, None), or (None, why it failed)."""
    if kind == "addition":
        return new or "", None
    if text is None:
        return None, "no such article"
    if kind == "repeal":
        return text, None
    if old is None:
        return f"{text}\n{new or ''}", None
    after = replace_text(text, old, new or "")
    return after, None if after is not None else "text to replace not found"


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of the log, and a snapshot for each day that leaves an article with a text: (kind of row, columns of either)."""
    for key, steps in itertools.groupby(rows, key=lambda r: r[:2]):
        text = repealed = stored = None
        for day, on_day in itertools.groupby(steps, key=lambda r: None if r[4] else r[2]):
            told, last = [], None
            for _, _, date, eo, is_base, kind, old, new, ended in on_day:
                if is_base:
                    text, repealed, stored = new or "", ended, None if date is None else (date, eo or 0)
                    continue
                if stored and (date, eo) <= stored:
                    told.append((eo, kind, "conflict", f"the article is stored as of {stored[0]}"))
                    continue
                after, error = _apply(text, kind, old, new)
                if error is None:
                    text, repealed = after, {"addition": None, "repeal": date}.get(kind, repealed)
                told.append((eo, kind, "failed" if error else "applied", error))
                last = eo
            made = last is not None and text is not None
            yield from ((*key, day, eo, kind, status, error, made and eo == last, None, None, False) for eo, kind, status, error in told)
            if made:
                yield (*key, day, last, None, None, None, None, text, repealed, True)


def fold_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Log rows and, marked ``is_snapshot``, snapshots of all changes; see :func:`consolidate_batch`."""
    steps = changes.filter("version_date is not null and eo is not null").select(
        *KEY, "version_date", F.col("eo").cast("long"), F.lit(False).alias("is_base"), F.coalesce("kind", F.lit("modification")).alias("kind"), "old", "new", F.lit(None).cast("date").alias("repealed_date")
    )
    stream = base.unionByName(steps).repartition(*KEY).sortWithinPartitions(*KEY, F.desc("is_base"), "version_date", "eo", "kind", "old", "new")
    names = [f.split()[0] for f in _LOG.split(", ")] + ["article_text", "repealed_date", "is_snapshot"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (tuple(None if v is None or v != v else v for v in r) for b in batches for r in b[_STEPS].itertuples(index=False, name=None))
        found = _fold(rows)
        while some := list(itertools.islice(found, 1000)):
            yield pd.DataFrame(some, columns=names).astype(object)

    return stream.mapInPandas(fold, f"{_LOG}, article_text string, repealed_date date, is_snapshot boolean")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def consolidate_batch(store: BucketedTable, base: DataFrame, changes: DataFrame, number: int, as_of: Column) -> DataFrame:
    """Carry the stored articles on by a batch of changes; returns the batch's log.

    ``base`` has (code_id, article_number, text), a row for each article, and serves those without a
    stored snapshot. ``changes`` has (code_id, article_number, version_date, eo, kind, old, new) as in
    ``consolidation.consolidate``; those without a date or eo are left out. They are applied by date
    and eo. A change that is not after the article's newest stored snapshot, by date and then eo, is a
    ``conflict`` and not applied, for what came after it is not kept; one that finds no place
    ``failed``. New snapshots replace stored ones of the same day but for their ``amendment_date``,
    which is ``as_of`` when a day is stored first; older ones are no longer current, and the newest
    is unless it is repealed. A batch whose number is done is not applied again.

    Only buckets of touched articles are read and written. The order inside an article is
    essential: a task reads articles as one sorted stream and holds one text.
    """
    spark = changes.sparkSession
    log = f"{store.home}/log/batch={number}"
    if store.committed(spark, number):
        return spark.read.schema(_LOG).parquet(log)
    touched = changes.select(*KEY).distinct()
    known = store.read_beside(touched).join(touched, KEY, "left_semi")
    newest = newest_per_key(known, KEY, F.desc("version_date"))
    starts = newest.select(*KEY, "version_date", F.col("last_eo").alias("eo"), F.lit(True).alias("is_base"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("old"), F.col("article_text").alias("new"), "repealed_date")
    others = base.join(touched, KEY, "left_semi").join(newest.select(*KEY), KEY, "left_anti").select(*KEY, F.col("text").alias("new"))
    folded = _written(fold_changes(starts.unionByName(others.withColumn("is_base", F.lit(True)), allowMissingColumns=True), changes), f"{store.home}/folded/batch={number}")
    is_last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("version_date"))) == 1
    made = folded.filter("is_snapshot").select(
        *KEY, "version_date", "article_text", "repealed_date", (is_last & F.col("repealed_date").isNull()).alias("is_current"), F.col("repealed_date").isNotNull().alias("is_repealed"), F.md5("article_text").alias("text_hash"), F.col("eo").alias("last_eo"), as_of.cast("date").alias("amendment_date")
    )
    merged = upsert_columns(known, made, [*KEY, "version_date"], ["article_text", "repealed_date", "is_current", "is_repealed", "text_hash", "last_eo"])
    told = folded.filter("not is_snapshot").select(*[f.split()[0] for f in _LOG.split(", ")])
    told.write.mode("overwrite").parquet(log)
    store.upsert(mark_superseded(merged, made).select(*SNAPSHOT.names), number, "last_eo")
    return spark.read.schema(_LOG).parquet(log)


def read_log(spark: SparkSession, store: BucketedTable) -> DataFrame:
    """The logs of all batches, with ``batch``."""
    return spark.read.schema(f"{_LOG}, batch long").parquet(f"{store.home}/log")


def consolidation_report(log: DataFrame) -> DataFrame:
    """(code_id, amendments, articles_updated, snapshots_saved, applied, failed, conflict), from what was done."""
    done = F.when(F.col("status") == "applied", F.struct("article_number"))
    return log.groupBy("code_id").agg(
        F.count_distinct("eo").alias("amendments"),
        F.count_distinct(done).alias("articles_updated"),
        F.count_if("snapshot").alias("snapshots_saved"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
    )


def amendment_log(log: DataFrame) -> DataFrame:
    """One row per (amendment, code): date, type, the sorted articles affected, added, modified and repealed, status, error.

    The type is mixed if the changes are of several kinds; the status is the worst of its changes, and
    the error that of the first article, by number, that has that status.
    """
    articles = lambda kind: F.array_sort(F.collect_set(F.when(F.col("action") == kind if kind else F.lit(True), F.col("article_number"))))
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    worst = F.max(F.struct(rank.alias("rank"), F.col("status")))["status"]
    error = F.min_by("error", F.when(F.col("error").isNotNull(), F.struct(-rank, F.col("article_number"), F.col("error"))))
    return log.groupBy("eo", "code_id").agg(
        F.min("version_date").alias("amendment_date"),
        F.when(F.count_distinct("action") > 1, "mixed").otherwise(F.min("action")).alias("amendment_type"),
        articles(None).alias("affected"),
        articles("addition").alias("added"),
        articles("modification").alias("modified"),
        articles("repeal").alias("repealed"),
        worst.alias("status"),
        error.alias("error"),
    )
