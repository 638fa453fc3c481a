"""Court decisions with their summaries and the articles they cite, merged into stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import citations as cit
from lexmill.functions import text as tx
from lexmill.operators.merge import insert_first_wins, newest_per_key, upsert_columns

REFERENCE_KEY = ["decision_id", "code_id", "article_number"]


def decision_rows(raw: DataFrame, id_col: str = "id", text: str = "full_text") -> DataFrame:
    """``raw`` with summary, text_hash (SHA-256, of the empty text too) and references, read in one pass.

    ``references`` is the array of citations of :func:`citations.citations`; a null text is an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return raw.withColumns({"summary": tx.summary(whole), "text_hash": F.sha2(whole, 256), "references": cit.citations(whole)})


def reference_rows(decisions: DataFrame, id_col: str = "id") -> DataFrame:
    """(decision_id, code_id, article_number, reference_context, reference_type, position_in_text), each with its own decision."""
    # Before an explode Spark filters by the array's size, and would look for all citations once more for that.
    one = F.explode_outer("references").alias("r")
    return decisions.select(F.col(id_col).alias("decision_id"), one).filter("r is not null").select(
        "decision_id", F.col("r.code").alias("code_id"), F.col("r.article").alias("article_number"), F.col("r.context").alias("reference_context"), F.col("r.kind").alias("reference_type"), F.col("r.position").alias("position_in_text")
    )


def merge_decisions(stored: DataFrame, rows: DataFrame, update: list[str] | None, key: str = "case_number", order: str = "id") -> DataFrame:
    """Stored decisions with the new ones by case number.

    With ``update`` None stored cases stay as they are and of new ones with the same number the first
    by ``order`` counts; else the columns named are replaced by the last one's. A case without a
    number matches none, so each such row comes in.
    """
    fresh = rows.select(*stored.columns)
    numbered, others = fresh.filter(F.col(key).isNotNull()), fresh.filter(F.col(key).isNull())
    if update is None:
        return insert_first_wins(stored, numbered, [key], order).unionByName(others)
    return upsert_columns(stored, newest_per_key(numbered, [key], F.desc(order)), [key], update).select(*stored.columns).unionByName(others)


def merge_references(stored: DataFrame, references: DataFrame) -> DataFrame:
    """Stored references with those whose decision, code and article are new; of equal new ones the first in the text."""
    return insert_first_wins(stored, references, REFERENCE_KEY, "position_in_text")


def decisions_with_articles(decisions: DataFrame, references: DataFrame, countries: DataFrame, courts: DataFrame, id_col: str = "id") -> DataFrame:
    """Decisions with the name of their country and of their court, if known, and an array of what they cite.

    ``articles`` holds (code_id, article_number, reference_type) by code and number and is empty without
    references. References are gathered before they meet the decisions; a country must be known.
    ``countries`` (country_code, country_name) and ``courts`` (court_id, court_name) are dimensions, which
    Spark sends to the tasks if they are small.
    """
    one = F.struct("code_id", "article_number", "reference_type")
    # Sorted and then gathered decision by decision: collect_list in a groupBy holds a task's decisions in memory.
    by_decision = Window.partitionBy("decision_id").orderBy("code_id", "article_number", "reference_type")
    whole = by_decision.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gathered = references.select("decision_id", F.array_sort(F.collect_list(one).over(whole)).alias("_articles"), F.row_number().over(by_decision).alias("_place"))
    cited = gathered.filter("_place = 1").select(F.col("decision_id").alias(id_col), "_articles")
    joined = decisions.join(countries, "country_code").join(courts, "court_id", "left").join(cited, id_col, "left")
    return joined.withColumn("articles", F.coalesce("_articles", F.array().cast(cited.schema["_articles"].dataType))).drop("_articles")
