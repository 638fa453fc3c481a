"""Sketches of sets and the disk that the join needs: small cases against brute force."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import ngram_join
from lexmill.llm.common import shared_table


def _sets():
    rng, sets = np.random.default_rng(5), []
    for size in (1, 3, 40, 64, 65, 129, 700):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for gone in (0, size // 20, size // 9, size // 5, size // 2):
            sets.append(np.unique(np.concatenate([base[gone:], rng.integers(0, 1 << 63, gone // 3, dtype=np.uint64)])))
    return [s for s in sets if len(s)]


def _similar(a, b, percent=80):
    shared = len(np.intersect1d(a, b))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def test_sketches_lose_no_similar_pair_and_rule_out_most_others(spark):
    sets = _sets()
    sketches = spark.createDataFrame([(i, len(s), ngram_join._sketch(s)) for i, s in enumerate(sets)], "node long, n long, sketch binary")
    every = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    wanted = {p for p in every if _similar(sets[p[0]], sets[p[1]])}
    kept = {tuple(r) for r in ngram_join._sieve(spark.createDataFrame(every, "a long, b long"), sketches, 80).collect()}
    members = sketches.select(F.lit(-1).cast("long").alias("a"), "node", F.col("node").alias("component"), "n", "sketch")
    met = {tuple(r) for r in ngram_join._pairs_of_groups(members, 80).collect()}
    assert wanted and wanted <= met <= kept
    assert len(kept) < len(wanted) + len(every) // 10


def test_groups_are_compared_in_pieces(spark, monkeypatch):
    sets = _sets()
    rows = [(g, i, i % 4, len(s), ngram_join._sketch(s)) for g in (7, 8) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "a long, node long, component long, n long, sketch binary")
    whole = {tuple(r) for r in ngram_join._pairs_of_groups(members, 80).collect()}
    monkeypatch.setattr(ngram_join, "_WORDS", 1)
    assert whole == {tuple(r) for r in ngram_join._pairs_of_groups(members, 80).collect()}
    assert all(a % 4 != b % 4 for a, b in whole)


def test_shuffle_files_of_a_written_table_go_with_its_write(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before = files()
    table = shared_table(spark.range(5000, numPartitions=3).repartition(7, "id"))
    for _ in range(50):  # the executors are told to remove them and not waited for
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == 5000


def test_dropping_near_copies_needs_no_shuffle_of_the_texts(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(0, 200, 40)] + [(1000 + i, " ".join([*words[i : i + 99], "other"])) for i in range(0, 200, 40)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 200, 40))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
