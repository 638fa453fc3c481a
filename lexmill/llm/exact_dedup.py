"""Exact de-duplication by a tree merge of sorted digest runs.

Every input partition is one *run*: its digests in order, each with the best row seen and how many
rows it stands for. In each round ``fan_in`` neighbouring runs (two for a binomial tree) send what
they hold to their parent, cut into bands of the digest's range, so that a parent is read by as many
tasks as the data need; there the arriving runs are brought into digest order and merged, which
keeps of equal digests the verified smallest identifier and the sum of rows. A digest that a third
of all rows share is one row of a run, and reaches a task ``fan_in`` times per round at most.
What the last round knows of digests with several rows goes down the same tree, level by level,
to the runs and from there to the rows. Only digests, lengths and identifiers move; texts never do.

The digest is SHA-256 of the text without white space. It is *verified* at each level by two
independent values that travel with it and are part of the merge key: the byte length and a
64-bit xxHash of the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE_CLASS, materialize, text_or_empty

_KEY = ["_xd_band", "_xd_digest", "_xd_bytes", "_xd_check"]
#: Hexadecimal digits of a digest that name its band.
_BAND_DIGITS = 3


def normalised(text) -> F.Column:
    """The text without any white space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), f"{SPACE_CLASS}+", "")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (
        docs.select(
            F.col(id_col).alias("_xd_id"),
            F.length(text_or_empty(text_col)).alias("_xd_points"),
            normalised(text_col).alias("_xd_text"),
        )
        .select(
            "_xd_id",
            "_xd_points",
            F.sha2("_xd_text", 256).alias("_xd_digest"),
            F.octet_length("_xd_text").alias("_xd_bytes"),
            F.xxhash64("_xd_text").alias("_xd_check"),
        )
        .withColumns({"_xd_band": F.substring("_xd_digest", 1, _BAND_DIGITS), "_xd_row": F.monotonically_increasing_id()})
    )


def _merged(runs: DataFrame, best: F.Column, n: F.Column) -> DataFrame:
    """The runs (``_xd_run``) exchanged by band, in digest order, each digest once with its best row and count."""
    # The exchange by (run, band) serves the grouping, which sorts what arrives and merges it in one pass.
    sent = runs.repartition("_xd_run", "_xd_band")
    return sent.groupBy("_xd_run", *_KEY).agg(F.min(best).alias("_xd_best"), F.sum(n).alias("_xd_n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of the rows whose texts are equal without white space, the one with the most code points in
    its original text stays, then the smallest id. Null texts count as empty; a null id ranks
    after all others; repeated rows (same id and text) count one by one and exactly one of a
    group is kept. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    return _judged(docs, id_col, text_col, fan_in).select(F.col("_xd_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_xd_digest").alias("text_sha256"))


def _judged(docs: DataFrame, id_col: str, text_col: str, fan_in: int) -> DataFrame:
    """Per row its id, code points, digest, and what the tree says of it."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    rows = materialize(_digests(docs, id_col, text_col)).withColumn("_xd_run", F.shiftright("_xd_row", 33))
    best = F.struct(
        (-F.col("_xd_points")).alias("p"), F.col("_xd_id").isNull().alias("u"), F.col("_xd_id").alias("i"), F.col("_xd_row").alias("r")
    )
    levels = [materialize(_merged(rows, best, F.lit(1)))]
    last_run = rows.agg(F.max("_xd_run")).first()[0] or 0
    parent = F.floor(F.col("_xd_run") / fan_in)
    while last_run > 0:
        levels.append(materialize(_merged(levels[-1].withColumn("_xd_run", parent), F.col("_xd_best"), F.col("_xd_n"))))
        last_run //= fan_in
    known = levels[-1].filter("_xd_n > 1")
    for level in reversed(levels[:-1]):  # a parent's digest meets its fan_in children at most
        known = level.select(F.col("_xd_run").alias("_xd_child"), parent.alias("_xd_run"), *_KEY).join(known, ["_xd_run", *_KEY]).drop("_xd_run").withColumnRenamed("_xd_child", "_xd_run")
    return rows.join(known, ["_xd_run", *_KEY], "left").select(
        "_xd_id",
        "_xd_points",
        "_xd_digest",
        F.when(F.col("_xd_n").isNull(), F.col("_xd_id")).otherwise(F.col("_xd_best.i")).alias("keep_id"),
        F.coalesce("_xd_n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("_xd_row") == F.col("_xd_best.r"), F.lit(True)).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of each group of equal texts.

    Which one stays is as for :func:`exact_duplicates`; of fully repeated rows any one. Null texts
    count as empty, so one of all empty ones stays, with its text as it is. An empty table gives
    an empty one; columns of any name pass (but ``_xd_key``, ``_xd_digest``, ``_xd_points``).
    """
    key = ["_xd_key", "_xd_digest", "_xd_points"]
    kept = _judged(docs, id_col, text_col, fan_in).filter("kept").select(F.xxhash64("_xd_id").alias("_xd_key"), "_xd_digest", "_xd_points")
    # The winner of a group may itself be a repeated row, of which one stays; the join has brought them together.
    keyed = docs.withColumns({"_xd_key": F.xxhash64(F.col(id_col)), "_xd_digest": F.sha2(normalised(text_col), 256), "_xd_points": F.length(text_or_empty(text_col))})
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)
