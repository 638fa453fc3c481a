"""Rows for a vector store and for manifests of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.merge import newest_per_key


def build_points(rows: DataFrame, id_col: str, vector_col: str, order: str) -> DataFrame:
    """(point_id, vector, payload): the last row of each id by ``order``; payload holds all other columns.

    Rows without an id or with a null or empty vector are left out before the last one is chosen.
    """
    payload = F.struct(*[c for c in rows.columns if c not in (id_col, vector_col, order)])
    good = rows.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0))
    points = good.select(F.col(id_col).alias("point_id"), F.col(vector_col).alias("vector"), payload.alias("payload"), F.col(order).alias("_order"))
    return newest_per_key(points, ["point_id"], F.desc("_order")).drop("_order")


def build_manifest(docs: DataFrame, group: str, id_col: str, text: Column, updated: Column) -> DataFrame:
    """(group, id, hash, last_updated), a row a document: a map of a whole group would be one row of any size."""
    return docs.select(group, id_col, F.md5(text).alias("hash"), updated.alias("last_updated"))


def replace_manifest(stored: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """The manifests of the groups in ``new`` replace the stored ones."""
    return stored.join(new.select(group).distinct(), group, "left_anti").unionByName(new)
