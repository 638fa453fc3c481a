"""Streams, bucketed tables and the token index: what is stored survives restarts, replays and late rows."""

import datetime as dt
import math
import random
import re
import shutil
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.operators import token_index
from lexmill.sources.bucketed import BucketedTable
from lexmill.streaming.streams import stream_changes, stream_period_counts, stream_upsert

EVENT = "event_id long, ts timestamp, user_id long, event_type string"


def _event(i, day, user=1, kind="a", hour=0):
    return (i, dt.datetime(2024, 1, day, hour), user, kind)


def _file(spark, folder, name, rows):
    """One Parquet file of events; streams take files by the time of their change."""
    made = Path(folder) / f"{name}-made"
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(made))
    shutil.move(next(made.glob("part-*.parquet")), Path(folder) / f"{name}.parquet")
    shutil.rmtree(made)


def _schema(spark):
    return spark.createDataFrame([], EVENT).schema


# Windows


def test_closed_windows_once_and_late_rows_dropped(spark, tmp_path):
    folder, home = str(tmp_path / "in"), str(tmp_path / "home")
    _file(spark, folder, "f1", [_event(1, 1), _event(2, 1, kind="b"), _event(3, 10)])
    count = lambda period="day": sorted((str(r.period), r.event_type, r.n) for r in stream_period_counts(spark, folder, "*.parquet", _schema(spark), "ts", "event_type", period, home=f"{home}-{period}", per_batch=1).collect())
    assert count() == [("2024-01-01", "a", 1), ("2024-01-01", "b", 1)]
    # The first day is closed, so its row is late; day 9 is still open; day 20 closes days 9 and 10.
    _file(spark, folder, "f2", [_event(4, 1), _event(5, 9), _event(6, 20), (7, None, 1, "a")])
    assert count() == [("2024-01-01", "a", 1), ("2024-01-01", "b", 1), ("2024-01-09", "a", 1), ("2024-01-10", "a", 1)]
    assert count() == count()
    # Read in one go: a window is closed to rows by the watermark of the batch before, so the row of day 1 still counts.
    assert count("week") == [("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-08", "a", 2)]


# Changes


def _changes(rows, passed):
    out, last = [], {}
    for i, ts, user, kind in sorted((r for r in rows if r[1] <= passed), key=lambda r: (r[1], r[0])):
        if user not in last or last[user] != kind:
            out.append((user, i, kind))
        last[user] = kind
    return sorted(out)


@pytest.mark.parametrize("restart", [False, True])
def test_changes_do_not_depend_on_batches(spark, tmp_path, restart):
    rng, folder, home = random.Random(8), str(tmp_path / "in"), str(tmp_path / "home")
    rows = [_event(i, 1 + i // 6, rng.randrange(3), rng.choice("aab"), rng.randrange(24)) for i in range(120)]
    files = [rows[:50], rows[50:90], rows[90:]]
    run = lambda: sorted(map(tuple, stream_changes(spark, folder, "*.parquet", _schema(spark), "user_id", "event_type", "event_id", "ts", home=home, per_batch=1).collect()))
    for k, part in enumerate(files):
        rng.shuffle(part)
        _file(spark, folder, f"f{k}", part)
        if restart:
            run()
    late = _event(999, 1, 0, "z")  # behind the watermark: dropped
    _file(spark, folder, "f9", [late])
    assert run() == _changes(rows, max(r[1] for r in rows) - dt.timedelta(days=2)) == run()


# Bucketed tables


def _versions_on_disk(home):
    return {p.parent.relative_to(home): p.stat().st_mtime_ns for p in Path(home).rglob("part-*.parquet") if "commits" not in str(p)}


def test_upsert_rewrites_touched_buckets_only_and_survives_replay(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string, seq long").schema
    rows = lambda *r: spark.createDataFrame(r, schema)
    stored = BucketedTable(str(tmp_path / "t"), schema, ["k"], 4)
    stored.create(spark)
    read = lambda: sorted((r.k if r.k is not None else -1, r.v) for r in stored.read(spark).collect())
    assert read() == [] and stored.upsert(rows(*[(k, "a", 1) for k in range(20)], (None, "n", 1)), 0, "seq")
    before = _versions_on_disk(stored.home)
    assert stored.upsert(rows((3, "b", 1), (3, "c", 2)), 1, "seq")
    want = sorted([(k, "c" if k == 3 else "a") for k in range(20)] + [(-1, "n")])
    assert read() == want
    after = _versions_on_disk(stored.home)
    assert all(after[p] == t for p, t in before.items())  # nothing old is touched
    assert len(after) == len(before) + 1 and len(stored.versions(spark)) >= 4
    # A batch that comes again is known; one that was cut off before its record is done anew.
    assert not stored.upsert(rows((3, "again", 9)), 1, "seq") and read() == want
    rows((3, "half", 9)).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{stored.home}/data/version=2")
    assert read() == want
    assert stored.upsert(rows((5, "d", 1)), 2, "seq") and dict(read())[5] == "d" and dict(read())[3] == "c"
    assert stored.upsert(rows(), 3, "seq") and not stored.upsert(rows((1, "x", 1)), 3, "seq")
    stored.create(spark)  # no harm
    assert dict(read())[5] == "d"


def test_stream_upsert_goes_on_where_it_stopped(spark, tmp_path):
    folder = str(tmp_path / "in")
    run = lambda home: sorted((r.user_id, r.event_id, r.event_type) for r in stream_upsert(spark, folder, "*.parquet", _schema(spark), ["user_id"], "event_id", home=str(tmp_path / home), per_batch=1).collect())
    _file(spark, folder, "f1", [_event(1, 1, 1, "a"), _event(2, 1, 2, "a")])
    assert run("x") == [(1, 1, "a"), (2, 2, "a")]
    _file(spark, folder, "f2", [_event(3, 2, 2, "b"), _event(4, 2, 3, "c")])
    want = [(1, 1, "a"), (2, 3, "b"), (3, 4, "c")]
    assert run("x") == want == run("x") == run("one go")
    # The progress of the last batch is lost after its commit: the batch comes again and is skipped.
    for kind in ("commits", "offsets"):
        last = max(Path(tmp_path / "x" / "log" / kind).glob("[0-9]*"), key=lambda p: int(p.name))
        if kind == "commits":
            last.unlink()
            (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run("x") == want


# Token index


def _found(docs, searches, k, fallback):
    """By brute force over all documents."""
    out = []
    for s in searches:
        terms, hits = s.terms(), []
        for i, text, country in docs:
            toks = re.findall(r"\w+", (text or "").lower())
            n = sum(t in toks for t in terms)
            if n and all(w is None or w == country for _, w in s.where):
                hits.append((n == len(terms), -round(sum(t in terms for t in toks) / (1 + math.log(len(toks))), 6), i))
        every = any(h[0] for h in hits)
        out += [(s.query, i, -score) for full, score, i in sorted((h for h in hits if h[0] or (fallback and not every)), key=lambda h: h[1:])[:k]]
    return sorted(out)


def test_index_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = ["закон", "Кодекс", "the", "of", "über", "x_1", "2024", "дом"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) if i % 9 else None, rng.choice(["ru", "by"])) for i in range(150)] + [(150, "the " * 20_000, "ru"), (151, " ,.! ", "ru"), (152, "", None)]
    df = spark.createDataFrame(docs, "id long, text string, country string")
    folder = str(tmp_path / "index")
    token_index.write_index(df.filter("id < 100"), folder, "id", F.col("text"), ["country"], buckets=8, spread=2)
    token_index.add_to_index(df.filter("id >= 100"), folder, "id", F.col("text"), ["country"], buckets=8, spread=2)
    stored = spark.read.parquet(folder)
    own = Counter((t, i) for i, text, _ in docs for t in re.findall(r"\w+", (text or "").lower()))
    assert {(r.term, r.id): r.tf for r in stored.collect()} == own
    where = lambda c: (("country", c),)
    searches = [token_index.Search(1, "The of"), token_index.Search(2, "закон кодекс über 2024 дом x_1 the of"), token_index.Search(3, "закон nowhere"), token_index.Search(4, "nowhere"), token_index.Search(5, "the the ДОМ", where("by")), token_index.Search(6, " ,"), token_index.Search(7, "дом", where("xx"))]
    for fallback in (True, False):
        found = token_index.search_index(spark, folder, searches, "id", 5, fallback, buckets=8)
        assert sorted((r.query, r.id, r.score) for r in found.collect()) == _found(docs, searches, 5, fallback)
    plan = token_index.search_index(spark, folder, searches[:1], "id", 5, buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term" in plan and plan.count("FileScan") == 1
    empty = str(tmp_path / "empty")
    token_index.write_index(df.limit(0), empty, "id", F.col("text"), ["country"])
    assert token_index.known_values(df, "country", ["RU", "zz", None]) == {"RU": "ru", "zz": None}
