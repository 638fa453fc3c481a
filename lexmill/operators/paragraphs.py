"""Numbered paragraphs of articles, judged line by line in the order in which they stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import content

#: A numbered line, and the note of an amendment in one; fixed values.
NUMBERED = r"^(\d+)\.\s*(.+)$"
AMENDMENT_NOTE = r"\(.*(?:дополнение|редакция|редакции|утратил|Наименование|Дополнение).+\)"
_NOT_NUMBERED, _NOTE = -1, -2
#: Stands for numbers that no long holds.
_HUGE = (1 << 63) - 1


def accepts(number: int, expected: int) -> bool:
    """Whether a paragraph may have the number: one not above the expected, or in the tens of that or of the one before."""
    return number <= expected or number // 10 == expected or (expected > 1 and number // 10 == expected - 1)


def judge_paragraphs(lines: DataFrame, keys: list[str], place: str, text: str, dealt: bool = False) -> DataFrame:
    """``lines`` with paragraph (its number or null), expected, kept and reason (null if kept).

    The lines of each article, named by ``keys``, are read by ``place``; the count starts at 1 and goes
    on when the expected number comes. A numbered line with the note of an amendment is a heading
    (``amendment_note``) whatever its number, one out of sequence is dropped (``out_of_sequence``), and
    unnumbered lines are judged by their content. Null lines are empty ones.

    A task reads its articles as one sorted stream of Arrow batches and holds a counter. With ``dealt``
    the rows of an article are together already and only sorted.
    """
    line = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\r\f\v"))
    number = F.regexp_extract(line, f"(?Ud){NUMBERED}", 1)
    told = F.when(number == "", F.lit(_NOT_NUMBERED)).when(line.rlike(f"(?iUd){AMENDMENT_NOTE}"), F.lit(_NOTE)).otherwise(F.coalesce(number.try_cast("long"), F.lit(_HUGE)))
    columns = lines.columns
    marked = lines.withColumn("_n", told.cast("long")).withColumn("_why", F.when(F.col("_n") == _NOT_NUMBERED, content.content_validity(F.col(text))["reason"]).when(F.col("_n") == _NOTE, "amendment_note"))
    together = marked if dealt else marked.repartition(*keys)
    schema = T.StructType([*lines.schema.fields, T.StructField("paragraph", T.LongType()), T.StructField("expected", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("reason", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        article, expected = None, 1
        for batch in batches:
            at = batch.schema.get_field_index
            names = list(zip(*(batch.column(at(k)).to_pylist() for k in keys)))
            numbers, reasons = batch.column(at("_n")).to_pylist(), batch.column(at("_why")).to_pylist()
            counts = np.empty(len(numbers), np.int64)
            for i, (name, n) in enumerate(zip(names, numbers)):
                if name != article:
                    article, expected = name, 1
                counts[i] = expected
                if n >= 0:
                    if not accepts(n, expected):
                        reasons[i] = "out_of_sequence"
                    expected += n == expected
            paragraph = pa.array([n if n >= 0 else None for n in numbers], pa.int64())
            kept = pa.array([r is None for r in reasons], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in columns), paragraph, pa.array(counts), kept, pa.array(reasons, pa.string())], names=schema.names)

    return together.sortWithinPartitions(*keys, place).mapInArrow(fold, schema)
