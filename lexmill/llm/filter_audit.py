"""Audit of how filters interact, by sorted posting lists.

For every part of a corpus and every range of row ids there is one sorted list of failing rows
per filter. What a filter removes after any set of others is a difference of its list and their
union, taken by galloping through the lists: from each candidate a list is searched ahead in
doubling steps, then by bisection inside the last one. Only the sizes leave a range. They are
summed over all ranges and laid out along every order of the filters.

Ranges bound what a task holds, however many rows a part has; texts are read once, and only flags
and ids are exchanged.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import chain, combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import SPACE_CLASS, shared_table, text_or_empty

#: Rows of one range of ids.
RANGE_BITS = 13


def reach(listed: Sequence[int], value: int, at: int) -> int:
    """First place from ``at`` on whose entry is not below ``value``: doubling steps, then bisection."""
    step, n = 1, len(listed)
    if at >= n or listed[at] >= value:
        return at
    while at + step < n and listed[at + step] < value:
        at += step
        step *= 2
    return bisect_left(listed, value, at + 1, min(n, at + step))


def difference(listed: Sequence[int], others: Sequence[Sequence[int]]) -> list[int]:
    """Entries of ``listed`` that are in none of ``others``; all sorted."""
    left, places = [], [0] * len(others)
    for value in listed:
        for k, other in enumerate(others):
            places[k] = at = reach(other, value, places[k])
            if at < len(other) and other[at] == value:
                break
        else:
            left.append(value)
    return left


def common_size(listed: Sequence[int], other: Sequence[int]) -> int:
    """How many entries two sorted lists share; the shorter one leads."""
    if len(listed) > len(other):
        listed, other = other, listed
    at = n = 0
    for value in listed:
        at = reach(other, value, at)
        if at == len(other):
            break
        n += other[at] == value
    return n


def union_size(lists: Sequence[Sequence[int]]) -> int:
    """Size of the union of sorted lists: the list with the least head runs up to the next head at once."""
    live = [[listed, 0] for listed in lists if listed]
    n = 0
    while len(live) > 1:
        heads = [listed[at] for listed, at in live]
        least = min(heads)
        leading = [k for k, head in enumerate(heads) if head == least]
        if len(leading) > 1:
            n += 1
            for k in leading:
                live[k][1] += 1
        else:
            (k,) = leading
            listed, at = live[k]
            end = reach(listed, min(h for i, h in enumerate(heads) if i != k), at)
            n += end - at
            live[k][1] = end
        live = [entry for entry in live if entry[1] < len(entry[0])]
    return n + sum(len(listed) - at for listed, at in live)


def subset_sizes(lists: Sequence[Sequence[int]], good: Sequence[int], toxic: Sequence[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(filter, set of earlier filters as bits, union with the filter, removed, good removed, toxic removed), for all pairs."""
    every = range(len(lists))
    unions = {bits: union_size([lists[k] for k in every if bits >> k & 1]) for bits in range(1, 1 << len(lists))}
    for f in every:
        for size in range(len(lists)):
            for before in combinations([k for k in every if k != f], size):
                bits = sum(1 << k for k in before)
                removed = difference(lists[f], [lists[k] for k in before])
                yield f, bits, unions[bits | 1 << f], len(removed), common_size(removed, good), common_size(removed, toxic)


def _ranges(flags: Sequence[str]) -> tuple:
    """The schema of summed sizes and the function that makes them of each (part, range) of a task."""
    names = ["part", "f", "before", "failed", "removed", "good_lost", "toxic_lost"]
    schema = T.StructType([T.StructField(names[0], T.StringType()), *(T.StructField(n, T.IntegerType()) for n in names[1:3]), *(T.StructField(n, T.LongType()) for n in names[3:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # one row for each (part, range): its lists
            rows = [
                (row["part"], *sizes)
                for row in batch.to_pylist()
                for sizes in subset_sizes([sorted(row[f]) for f in flags], sorted(row["good"]), sorted(row["toxic"]))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4])], names=names)

    return schema, run


def audit_filters(judged: DataFrame, flags: Sequence[str], part: str = "part", row_id: str = "row_id", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """One row per part, order of ``flags`` and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``judged`` has one row per document with a unique non-negative ``row_id``, a part (null counts
    as the empty string), a boolean for each filter that is true where the document fails it, and
    ``good`` and ``toxic``. A null flag is false. Parts without failures have rows with zeros;
    a table without rows has no part and gives none. Flags are columns named by one letter each.
    """
    n = len(flags)
    ranged = judged.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.shiftright(row_id, RANGE_BITS).alias("_range"), F.col(row_id).alias("_id"), *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*flags, good, toxic))
    )
    # The list of a range holds the ids inside it, at most 2^RANGE_BITS.
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("_id")))).alias(c)
    lists = ranged.groupBy("part", "_range").agg(*map(listed, flags), listed(good).alias("good"), listed(toxic).alias("toxic"), F.count(F.lit(1)).alias("_rows"))
    schema, run = _ranges(flags)
    lists = shared_table(lists)
    sizes = lists.drop("_range", "_rows").mapInArrow(run, schema).groupBy("part", "f", "before").agg(*(F.sum(c).alias(c) for c in ("failed", "removed", "good_lost", "toxic_lost")))
    parts = lists.groupBy("part").agg(F.sum("_rows").alias("rows"))
    sizes = shared_table(sizes)
    # How many orders have exactly the set before the filter: its size factorial times the rest's.
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("before") + 1)
    totals = sizes.groupBy("part", "f").agg(
        F.sum(F.col("removed") * weight).cast("long").alias("shapley"),
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("alone"),
        F.max(F.when(F.bit_count("before") == n - 1, F.col("removed"))).alias("unique_fails"),
    )
    steps = _steps(judged.sparkSession, flags)
    return (
        sizes.join(totals, ["part", "f"])
        .join(parts, "part")
        .join(F.broadcast(steps), ["f", "before"])  # as many rows as there are orders and steps
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("rows") - F.col("failed")).alias("kept"),
            "removed",
            (F.col("alone") - F.col("removed")).alias("redundant"),
            "unique_fails",
            "good_lost",
            "toxic_lost",
            "shapley",
        )
    )


def _steps(spark: SparkSession, flags: Sequence[str]) -> DataFrame:
    """(filter_order, step, f, before) of every order of the filters."""
    rows = chain.from_iterable(
        (("".join(flags[k] for k in order), i + 1, f, sum(1 << k for k in order[:i])) for i, f in enumerate(order)) for order in permutations(range(len(flags)))
    )
    return spark.createDataFrame(list(rows), "filter_order string, step int, f int, before int")


def judge_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """row_id, part, A to E and the labels of every row of ``docs``.

    A: under 100 words; B: distinct words under 80 % of the words; C: capitals A-Z over 10 % of
    the code points; D: one of ``#$%&*|``; E: the same text under a smaller id. Words are maximal
    runs of no white space. A null text is an empty one (A fails; C needs more than 0 %). A null
    id is larger than none and none is larger than it, so its row never fails E, nor makes
    another fail; rows that repeat an id and a text do not fail E by one another. Several label
    rows of one id count as good or toxic if one of them says so. Columns of any other name pass.
    """
    text = text_or_empty(text_col)
    words = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    read = docs.select(F.col(id_col).alias("id"), F.col(part_col).cast("string").alias("part"), text.alias("text"), words.alias("words"))
    n_words = F.size("words")
    flagged = read.select(
        F.monotonically_increasing_id().alias("row_id"),
        "id",
        "part",
        (n_words < 100).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 80 * n_words).alias("B"),
        (100 * F.octet_length(F.regexp_replace("text", "[^A-Z]+", "")) > 10 * F.length("text")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
        F.sha2("text", 256).alias("digest"),
    )
    flagged = shared_table(flagged)
    copies = shared_table(flagged.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("digest", "least"))
    marked = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    return (
        flagged.join(copies, "digest", "left")
        .withColumn("E", F.coalesce(F.col("least") < F.col("id"), F.lit(False)))
        .join(marked, "id", "left")
        .select("row_id", "part", "A", "B", "C", "D", "E", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )
