"""A stored inverted index and keyword search over it.

The index is a table of postings (term, document, times, tokens of the document and whatever columns
searches filter by) in files partitioned by the hash of the term. A search reads only the files of its
terms' buckets and, inside them, the row groups that hold the terms.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Search:
    """One search: its number, its words, and values that columns of the index must equal (null: any)."""

    query: int
    text: str
    where: tuple[tuple[str, str | None], ...] = ()

    def terms(self) -> list[str]:
        return list(dict.fromkeys(_TOKEN.findall(self.text.lower())))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, id_col: str, text: Column, carry: Sequence[str] = ()) -> DataFrame:
    """(term, id, tf, n_tokens, carried columns), one row for each term of a document; null and empty texts have none.

    Terms are counted inside the row, by the borders of runs in its sorted tokens, so nothing is exchanged.
    Ids must be unique; a repeated id would have repeated postings.
    """
    held = [id_col, *carry]
    counted = docs.filter(text.isNotNull()).select(*held, F.array_sort(tokens(text)).alias("_t"))
    counted = counted.withColumn("n_tokens", F.size("_t")).filter("n_tokens > 0")
    at = lambda i: F.get("_t", i)
    starts = F.filter(F.sequence(F.lit(0), F.col("n_tokens") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    runs = counted.withColumn("_s", starts)
    found = F.transform("_s", lambda i, k: F.struct(at(i).alias("term"), (F.coalesce(F.get("_s", k + 1), F.col("n_tokens")) - i).alias("tf")))
    return runs.select(*held, "n_tokens", F.inline(found)).select("term", id_col, "tf", "n_tokens", *carry)


def write_index(docs: DataFrame, folder: str, id_col: str, text: Column, carry: Sequence[str] = (), buckets: int = 64, spread: int = 8) -> None:
    """The postings of ``docs`` as a table in ``folder``; one exchange.

    ``spread`` tasks share a bucket, so that a term of all documents is not written by one.
    """
    rows = postings(docs, id_col, text, carry).withColumn("bucket", _bucket(F.col("term"), buckets))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(id_col), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "term", id_col).write.partitionBy("bucket").mode("overwrite").parquet(folder)


def add_to_index(docs: DataFrame, folder: str, id_col: str, text: Column, carry: Sequence[str] = (), buckets: int = 64, spread: int = 8) -> None:
    """Postings of new documents, whose ids the index does not hold, in further files beside those there."""
    rows = postings(docs, id_col, text, carry).withColumn("bucket", _bucket(F.col("term"), buckets))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(id_col), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "term", id_col).write.partitionBy("bucket").mode("append").parquet(folder)


def search_index(spark: SparkSession, folder: str, searches: Sequence[Search], id_col: str, k: int = 10, fallback: bool = True, buckets: int = 64) -> DataFrame:
    """(query, id, score, all_terms): of each search the ``k`` best documents that hold all its terms.

    Where no document holds all, with ``fallback`` the best that hold any; the score is the terms' count
    over 1 + ln(tokens), at six digits, and ties go by id. Searches without terms find nothing. One scan
    serves all: the best of either kind are chosen side by side, at most ``2 k`` rows a search, and those
    that count are told from them. ``searches`` is a list of the caller, as small as its text.
    """
    columns = list(dict.fromkeys(c for s in searches for c, _ in s.where))
    rows = [(s.query, t, len(s.terms()), *(dict(s.where).get(c) for c in columns)) for s in searches for t in s.terms()]
    index = spark.read.parquet(folder)
    asked = spark.createDataFrame(rows, ", ".join(["query int, term string, n_terms int", *(f"_{c} string" for c in columns)]))
    terms = sorted({r[1] for r in rows})
    places = asked.select(_bucket(F.col("term"), buckets).alias("b")).distinct().collect()
    hits = index.filter(F.col("bucket").isin([p["b"] for p in places]) & F.col("term").isin(terms)).join(F.broadcast(asked), "term")
    for c in columns:
        hits = hits.filter(F.col(f"_{c}").isNull() | (F.col(c).cast("string") == F.col(f"_{c}")))
    scored = (
        hits.groupBy("query", id_col, "n_terms", "n_tokens")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"))
        .select("query", id_col, F.round(F.col("tf") / (1 + F.log("n_tokens")), 6).alias("score"), (F.col("n") == F.col("n_terms")).alias("all_terms"))
    )
    if not fallback:
        scored = scored.filter("all_terms")
    best = F.row_number().over(Window.partitionBy("query", "all_terms").orderBy(F.desc("score"), id_col))
    chosen = scored.withColumn("_rank", best).filter(F.col("_rank") <= k).withColumn("_any", F.max("all_terms").over(Window.partitionBy("query")))
    return chosen.filter(F.col("all_terms") | ~F.col("_any")).select("query", id_col, "score", "all_terms")


def known_values(dimension: DataFrame, column: str, codes: Sequence[str | None]) -> dict[str, str | None]:
    """Each code as ``column`` of the dimension writes it, whatever the case; unknown codes give null, that is no filter."""
    wanted = {c.lower() for c in codes if c}
    found = {r[0].lower(): r[0] for r in dimension.filter(F.lower(column).isin(sorted(wanted))).select(column).distinct().collect()} if wanted else {}
    return {c: found.get(c.lower()) for c in codes if c}
