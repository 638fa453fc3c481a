"""Keyed merges and de-duplication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def upsert_last_wins(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace whole rows; the later batch row wins."""
    both = target.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    return newest_per_key(both, keys, F.desc("_batch"), F.desc(order)).drop("_batch")


def insert_first_wins(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing keys stay untouched; of equal keys in the batch the first is taken."""
    fresh = newest_per_key(batch.join(target.select(*keys), keys, "left_anti"), keys, F.asc(order))
    return target.unionByName(fresh)


#: What makes a row of each kind the same one; fixed values.
NATURAL_KEYS = {
    "decision": ["country_code", "court_type", "case_number", "decision_date"],
    "review": ["country_code", "court_type", "title", "publication_date"],
    "position": ["decision_id", "position_text"],
    "regional_code": ["country_code", "region_id", "code_id"],
    "regional_article": ["country_code", "region_id", "code_id", "article_number", "version_date"],
    "letter": ["country_code", "agency_id", "document_number", "document_date"],
}


def merge_by_natural_key(target: DataFrame, batch: DataFrame, kind: str, update: list[str] | None = None, order: str | None = None, set_const: Mapping[str, object] | None = None) -> DataFrame:
    """``batch`` merged into ``target``, whose rows are known by the natural key of their kind.

    On a match ``update`` is replaced, by default all columns that are no part of the key, and
    ``set_const`` is set. A row with a null in its key is never the same as another, so it comes in
    each time. Keys of the target must be unique; for those of the batch see :func:`upsert_columns`.
    """
    keys = NATURAL_KEYS[kind]
    return upsert_columns(target, batch, keys, [c for c in target.columns if c not in keys] if update is None else update, order, set_const)


def upsert_columns(target: DataFrame, batch: DataFrame, keys: list[str], update: list[str], order: str | None = None, set_const: Mapping[str, object] | None = None) -> DataFrame:
    """On a match replace only ``update`` and set ``set_const``; other columns keep their old values. Null keys never match.

    Rows of the batch that match none come in as they are. With ``order``, of several batch rows for a key the last one wins; without, keys of the batch must be unique.
    """
    if order:
        known = F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda k: k)
        batch = newest_per_key(batch.filter(known), keys, F.desc(order)).unionByName(batch.filter(~known))
    new = batch.select(*keys, F.struct(*[c for c in batch.columns if c not in keys]).alias("_new"))
    old = target.withColumn("_old", F.lit(True))
    joined = old.join(new, keys, "full_outer")
    pick = lambda c: F.when(F.col("_old").isNull() | (F.lit(c in update) & F.col("_new").isNotNull()), F.col(f"_new.{c}")).otherwise(F.col(c))
    matched = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    fixed = {c: F.when(matched, F.lit(v).cast(target.schema[c].dataType)).otherwise(pick(c)) for c, v in (set_const or {}).items()}
    return joined.select(*keys, *[fixed.get(c, pick(c)).alias(c) for c in target.columns if c not in keys])


def purge_duplicates(rows: DataFrame, keys: list[str], id_col: str, null_as: str = "") -> DataFrame:
    """Keep the largest id of each key; null key parts count as ``null_as``."""
    filled = {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit(null_as)) for i, k in enumerate(keys)}
    return newest_per_key(rows.withColumns(filled), list(filled), F.desc(id_col)).drop(*filled)


def replace_group(target: DataFrame, batch: DataFrame, group: str, keys: list[str], order: str) -> DataFrame:
    """All rows of the groups in ``batch`` are replaced by it, last one winning."""
    kept = target.join(batch.select(group).distinct(), group, "left_anti")
    return kept.unionByName(newest_per_key(batch, keys, F.desc(order)))


def resume_filter(worklist: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """What is neither done nor known to fail."""
    return worklist.join(done.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")
