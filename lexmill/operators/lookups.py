"""Searches by fields of court decisions and official letters, and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_like(query: str | None, columns: Sequence[Column]) -> Column:
    """Whether one of ``columns`` holds ``query``, in any case; ``%`` and ``_`` in it are wildcards; null asks for nothing."""
    found = F.lit(query is None)
    for column in columns if query is not None else ():
        found = found | F.coalesce(column.ilike(f"%{query}%"), F.lit(False))
    return found


def _asked(rows: DataFrame, equal: dict[str, object], date: str, start: str | None, end: str | None) -> DataFrame:
    """Rows whose columns equal what is asked (null: anything) and whose date lies between the two, both included."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == F.lit(value))
    if start is not None:
        rows = rows.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col(date) <= F.lit(end).cast("date"))
    return rows


def _newest(rows: DataFrame, date: str, tie: str, most: int) -> DataFrame:
    """The ``most`` newest, rows without a date last, ties by ``tie``; Spark keeps as many per task."""
    return rows.orderBy(F.desc_nulls_last(date), tie).limit(most)


def search_court_decisions(
    decisions: DataFrame, court_type: str | None = None, decision_type: str | None = None, case_number: str | None = None, query: str | None = None, start: str | None = None, end: str | None = None, most: int = 10
) -> DataFrame:
    """The newest decisions with these fields; ``query`` is looked for in title, summary and the list of legal issues."""
    asked = _asked(decisions, {"court_type": court_type, "decision_type": decision_type, "case_number": case_number}, "decision_date", start, end)
    text = [F.col("title"), F.col("summary"), F.array_join("legal_issues", ",")]
    return _newest(asked.filter(any_like(query, text)), "decision_date", "id", most)


def plenary_resolutions(decisions: DataFrame, number: str | None = None, case_number: str | None = None, date: str | None = None, most: int = 5) -> DataFrame:
    """The newest plenary resolutions of the supreme court; ``number`` is a part of the case number or of the title."""
    asked = _asked(decisions, {"court_type": "supreme", "decision_type": "plenary_resolution", "case_number": case_number}, "decision_date", date, date)
    held = F.lit(True) if number is None else F.coalesce(F.col("case_number").contains(number), F.lit(False)) | F.coalesce(F.col("title").contains(number), F.lit(False))
    return _newest(asked.filter(held), "decision_date", "id", most)


def search_interpretations(
    letters: DataFrame, agencies: DataFrame, agency: str = "all", kind: str | None = None, topic: str | None = None, query: str | None = None, start: str | None = None, end: str | None = None, most: int = 10
) -> DataFrame:
    """The newest letters of known agencies; ``topic`` is a part of the letter's, ``query`` of title, question or answer.

    ``agency`` is the short name of one, or all. ``agencies`` (agency_id, agency_short, agency_name) has a row each.
    """
    asked = _asked(letters, {"interpretation_type": kind}, "document_date", start, end).filter(any_like(topic, [F.col("topic")]) & any_like(query, [F.col("title"), F.col("question"), F.col("answer")]))
    known = agencies if agency == "all" else agencies.filter(F.col("agency_short") == agency)
    return _newest(asked.join(known, "agency_id"), "document_date", "id", most)


def _counts(rows: DataFrame, what: str, keys: list[Column], good: Column) -> DataFrame:
    """(what, key_1, key_2, n, n_good): counts by two keys, either of which may be null, and the grand total with null keys."""
    named = rows.select(keys[0].cast("string").alias("key_1"), (keys[1] if len(keys) > 1 else F.lit(None)).cast("string").alias("key_2"), good.alias("good"))
    counted = named.groupBy("key_1", "key_2").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good")).select(F.lit(what).alias("what"), "key_1", "key_2", "n", "n_good")
    # Summed from the counts, whose exchange Spark makes once; zero for an empty table.
    whole = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_good")])
    none = F.lit(None).cast("string")
    return counted.unionByName(whole.select(F.lit(f"{what}, all").alias("what"), none.alias("key_1"), none.alias("key_2"), "n", "n_good"))


def court_statistics(decisions: DataFrame, reviews: DataFrame, positions: DataFrame) -> DataFrame:
    """(what, key_1, key_2, n, n_good): decisions by court and type, with active ones; reviews by type; positions, with valid ones; and totals."""
    true = F.lit(True)
    return (
        _counts(decisions, "decisions", [F.col("court_type"), F.col("decision_type")], F.col("is_active"))
        .unionByName(_counts(reviews, "reviews", [F.col("review_type")], true))
        .unionByName(_counts(positions, "positions", [F.lit(None)], F.col("is_valid")).filter("what <> 'positions'"))
    )


def interpretation_statistics(letters: DataFrame) -> DataFrame:
    """(what, key_1, key_2, n, n_good): letters by agency and type, with valid ones; by topic, if there is one; totals; and how many agencies there are."""
    valid = F.col("validity_status") == "valid"
    agencies = letters.agg(F.count_distinct("agency_id").alias("n")).select(F.lit("agencies").alias("what"), F.lit(None).cast("string").alias("key_1"), F.lit(None).cast("string").alias("key_2"), "n", F.col("n").alias("n_good"))
    topics = _counts(letters.filter("topic is not null"), "topics", [F.col("topic")], valid).filter("what = 'topics'")
    return _counts(letters, "letters", [F.col("agency_id"), F.col("interpretation_type")], valid).unionByName(topics).unionByName(agencies)
