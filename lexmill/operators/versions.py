"""Article versions: history, validity and what held on a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import article_parts
from lexmill.operators.merge import newest_per_key

KEY = ["code_id", "article_number"]


def code_snapshot(versions: DataFrame, date: str) -> DataFrame:
    """The last version of every article on a date, repealed ones included."""
    return newest_per_key(versions.filter(F.col("version_date") <= F.lit(date).cast("date")), KEY, F.desc("version_date"))


def article_as_of(versions: DataFrame, requests: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """For each request (code, article, on_date) the version that held; no version, no row.

    Versions and requests are laid in one order per article and each request takes the last
    version before it, so a hot article costs its rows once and not a product.
    """
    held = F.struct("version_date", "eo", "is_repealed", "article_text").alias("held")
    v = versions.select(*keys, F.col("version_date").alias("at"), F.lit(0).alias("kind"), held, F.lit(None).cast("long").alias("event_id"))
    r = requests.select(*keys, F.col("on_date").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(v.schema["held"].dataType).alias("held"), "event_id")
    window = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return v.unionByName(r).withColumn("held", F.last("held", ignorenulls=True).over(window)).filter("kind = 1 and held is not null").select("event_id", *keys, F.col("at").alias("on_date"), "held.version_date", "held.eo")


def validity_intervals(versions: DataFrame) -> DataFrame:
    """valid_from and valid_to (the next version's date, null for the last)."""
    window = Window.partitionBy(*KEY).orderBy("version_date")
    return versions.select(*KEY, F.col("version_date").alias("valid_from"), F.lead("version_date").over(window).alias("valid_to"))


def amendment_chain(versions: DataFrame) -> DataFrame:
    """Versions numbered from the oldest, with how many there are and the last current one's date."""
    whole = Window.partitionBy(*KEY)
    return versions.select(
        *KEY, "version_date",
        F.row_number().over(whole.orderBy("version_date")).alias("version_no"),
        F.count(F.lit(1)).over(whole).alias("n_versions"),
        F.max(F.when(F.col("is_current"), F.col("version_date"))).over(whole).alias("current_date"),
    )


def mark_superseded(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Versions before the newest change of their article are no longer current."""
    newest = changes.groupBy(*KEY).agg(F.max("version_date").alias("_newest"))
    older = F.col("_newest").isNotNull() & (F.col("version_date") < F.col("_newest"))
    return versions.join(newest, KEY, "left").withColumn("is_current", F.when(older, False).otherwise(F.col("is_current"))).drop("_newest")


def natural_order(number: Column) -> tuple[Column, Column]:
    """Sort keys: whole numbers by value, all others after them, then as text."""
    return F.when(number.rlike("^[0-9]+$"), number.try_cast("int")).otherwise(999_999), number


def place_in_code(versions: DataFrame) -> DataFrame:
    """``versions`` with ``place`` (its number in natural article order, then by date) and ``total_articles`` of its code.

    Only a row per article goes through one order of a whole code; versions are numbered inside their
    article and moved by the count of the articles before. Null codes and articles count as values.
    """
    code, article = Window.partitionBy("code_id"), Window.partitionBy(*KEY)
    counts = versions.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    before = code.orderBy(*natural_order(F.col("article_number"))).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(code).alias("total_articles"))
    ranked = versions.withColumn("_own", F.row_number().over(article.orderBy("version_date")))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    placed = ranked.join(starts, same[0] & same[1]).withColumn("place", (F.col("_start") + F.col("_own")).cast("int"))
    return placed.select(*versions.columns, "place", "total_articles")


def validate_counts(articles: DataFrame, facts: DataFrame) -> DataFrame:
    """(code_id, n, expected, verdict): severe below half of what is expected, mild below it, else ok.

    ``facts`` has a row a code; a code of it without articles has null for n and is ok.
    """
    counts = articles.groupBy("code_id").agg(F.count_distinct("article_number").alias("n"))
    verdict = F.when(F.col("n") < F.floor(F.col("expected") / 2), "severe").when(F.col("n") < F.col("expected"), "mild").otherwise("ok")
    return facts.select("code_id", "expected").join(counts, "code_id", "left").select("code_id", "n", "expected", verdict.alias("verdict"))


def pick_source(articles: DataFrame, facts: DataFrame, sources: Sequence[str], most: float = 0.1) -> DataFrame:
    """(code_id, source, suspicious): the first of ``sources`` with at most that share of suspicious articles.

    An article is suspicious if its number is over ten times the code's largest. Articles are counted
    by code and source before they meet ``facts``, which has a row a code; null if no source is good.
    """
    counts = articles.select("code_id", "source", article_parts(F.col("article_number"))["base"].alias("base")).groupBy("code_id", "source", "base").agg(F.count(F.lit(1)).alias("n"))
    wrong = F.when(F.col("base") > 10 * F.col("largest"), F.col("n")).otherwise(0)
    rated = counts.join(facts.select("code_id", "largest"), "code_id").groupBy("code_id", "source").agg(F.sum("n").alias("n"), F.sum(wrong).alias("suspicious"))
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    good = F.when((F.col("suspicious") <= most * F.col("n")) & (place > 0), place)
    return rated.groupBy("code_id").agg(F.min_by("source", good).alias("source"), F.sum("suspicious").alias("suspicious"))
