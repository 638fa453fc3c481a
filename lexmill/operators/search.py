"""Keyword, vector and hybrid search in batch."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.tables import fresh_folder

#: Points and queries of one matrix product.
_BLOCK_POINTS, _BLOCK_QUERIES = 20_000, 1_000
#: Rounding of scores and distances that the bound of a block must leave room for.
_MARGIN = 1e-5


def keyword_scores(content: DataFrame, queries: list[tuple[int, list[str]]]) -> DataFrame:
    """(query, document_id, score): all terms must occur; where no document has all, any will do.

    One scan serves all queries. The score is the terms' count over 1 + ln(tokens).
    """
    tokens = F.filter(F.split(F.lower(F.coalesce("full_text", F.lit(""))), r"(?U)\W+"), lambda t: t != "")
    found = (
        content.select("document_id", tokens.alias("tokens"))
        .filter(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in sorted({t for _, ts in queries for t in ts})])))
        .select("document_id", "tokens", F.explode(F.array(*[F.struct(F.lit(q).alias("query"), F.array(*map(F.lit, ts)).alias("terms")) for q, ts in queries])).alias("q"))
        .filter(F.arrays_overlap("tokens", F.col("q.terms")))
        .withColumn("every", F.forall("q.terms", lambda t: F.array_contains("tokens", t)))
        .withColumn("tf", F.size(F.filter("tokens", lambda t: F.array_contains("q.terms", t))))
        .select(F.col("q.query").alias("query"), "document_id", "every", (F.col("tf") / (1 + F.log(F.size("tokens")))).alias("score"))
    )
    any_all = found.groupBy("query").agg(F.max("every").alias("has_all"))
    return found.join(any_all, "query").filter(F.col("every") | ~F.col("has_all")).select("query", "document_id", "score")


def top_k(scores: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))))
    return ranked.filter(F.col("rank") <= k)


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have a length, and those vectors at length 1."""
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    lengths = np.linalg.norm(rows, axis=1)
    good = np.flatnonzero(np.isfinite(lengths) & (lengths > 0))
    return good, rows[good] / lengths[good, None]


def _best(scores: np.ndarray, ids: np.ndarray, query: int, k: int, least: float) -> np.ndarray:
    """Places of the ``k`` best scores, ties by id, without the query itself."""
    good = np.flatnonzero((ids != query) & (scores >= least))
    if len(good) > 4 * k:  # only those at or above the k-th best can be among them
        good = good[scores[good] >= np.partition(scores[good], -k)[-k]]
    return good[np.lexsort((ids[good], -scores[good]))[:k]]


def candidate_blocks(queries: DataFrame, sample: tuple[np.ndarray, np.ndarray], centres: np.ndarray, radii: dict[int, float], k: int, least: float) -> DataFrame:
    """(query, q, block): the blocks that may hold one of the ``k`` nearest points of a query.

    The k-th best score among the sample is a lower bound of the k-th best of all. By the triangle
    inequality no point of a block is nearer than the distance to its centre less its radius; blocks
    whose best possible score is below the bound are left out.
    """
    blocks = np.asarray(sorted(radii), np.int64)
    reach, near = np.asarray([radii[b] for b in blocks.tolist()]), centres[blocks]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, known = sample
        for batch in batches:
            for first in range(0, len(batch), _BLOCK_QUERIES):
                part = batch.iloc[first : first + _BLOCK_QUERIES].reset_index(drop=True)
                good, units = _unit(part["q"])
                if not len(good):
                    continue
                scores = units @ known.T
                scores[part["query"].to_numpy()[good][:, None] == ids[None, :]] = -2.0
                bound = np.full(len(good), least) if scores.shape[1] < k else np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * units @ near.T))
                possible = 1 - np.maximum(0.0, apart - reach) ** 2 / 2
                row, column = np.nonzero(possible >= bound[:, None] - _MARGIN)
                yield pd.DataFrame({"query": part["query"].to_numpy()[good][row], "q": part["q"].to_numpy()[good][row], "block": blocks[column]})

    return queries.filter("q is not null").select("query", "q").mapInPandas(choose, "query long, q array<double>, block long")


def vector_search(points: DataFrame, queries: DataFrame, k: int, digits: int = 6, threshold: float | None = None, where: Mapping[str, object] | None = None, centres: int = 128, sample: int = 4_096) -> DataFrame:
    """(query, vec_id, score): for each query the ``k`` nearest other points by cosine, ties by the smaller id.

    ``points`` has (vec_id, embedding) and payload columns, ``queries`` (query, q). Only points whose
    columns equal all of ``where`` count, and only scores of at least ``threshold``. Null and zero
    vectors match nothing. Scores are rounded to ``digits`` before they are compared.

    The result is exact. At most ``sample`` points, chosen by a hash of their ids, are sent to the
    tasks; ``centres`` of them name the blocks that points are dealt to, the nearest to each. A query
    visits only blocks that :func:`candidate_blocks` cannot rule out. A block with many points is cut
    into parts, one with many queries is visited in turns, so a task holds one matrix of bounded size.
    """
    spark = points.sparkSession
    for column, value in (where or {}).items():
        points = points.filter(F.col(column) == F.lit(value))
    least = -1.0 if threshold is None else threshold
    good = points.filter("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    kept, units = _unit(drawn["embedding"]) if len(drawn) else ([], None)
    if not len(kept):
        return spark.createDataFrame([], "query long, vec_id long, score double")
    ids, middle = drawn["vec_id"].to_numpy()[kept], units[:centres]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                place, rows = _unit(batch["embedding"])
                closeness = rows @ middle.T
                block = closeness.argmax(axis=1)
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * closeness[np.arange(len(block)), block]))
                yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy()[place], "embedding": batch["embedding"].to_numpy()[place], "block": block, "apart": apart})

    folder = fresh_folder(spark, "blocks")
    good.mapInPandas(deal, "vec_id long, embedding array<double>, block long, apart double").write.parquet(f"{folder}/points")
    dealt = spark.read.parquet(f"{folder}/points")
    blocks = {r["block"]: r for r in dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()}  # at most ``centres`` rows
    candidate_blocks(queries, (ids, units), middle, {b: r["radius"] for b, r in blocks.items()}, k, least).write.parquet(f"{folder}/visits")
    visits = spark.read.parquet(f"{folder}/visits")
    asked = {r["block"]: r["count"] for r in visits.groupBy("block").count().collect()}
    # A block that no query visits is in no row here, and so is read by no task.
    cut = spark.createDataFrame([(b, -(-blocks[b]["n"] // _BLOCK_POINTS), -(-n // _BLOCK_QUERIES)) for b, n in asked.items()], "block long, parts int, turns int")
    some = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.join(F.broadcast(cut), "block").select("vec_id", "embedding", "block", some("vec_id", "parts").alias("part"), every("turns").alias("turn"))
    right = visits.join(F.broadcast(cut), "block").select("query", "q", "block", some("query", "turns").alias("turn"), every("parts").alias("part"))

    def nearest(own: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(visitors):
            (_, p), (_, q), names = _unit(own["embedding"]), _unit(visitors["q"]), own["vec_id"].to_numpy()
            for query, scores in zip(visitors["query"].to_numpy(), np.round(q @ p.T, digits)):
                best = _best(scores, names, query, k, least)
                out.append(pd.DataFrame({"query": query, "vec_id": names[best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "vec_id": [], "score": []})

    keys = ["block", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query long, vec_id long, score double")
    return top_k(found, "query", "score", "vec_id", k).drop("rank")
