"""Stored snapshots carried on by batches, and replacement with a bound."""

import datetime as dt
import difflib
import random
from pathlib import Path

from pyspark.sql import functions as F

from lexmill.operators import consolidation, snapshots

CHANGE = "code_id string, article_number string, version_date date, eo long, kind string, old string, new string"
BASE = "code_id string, article_number string, text string"


def _day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def _store(spark, path):
    store = snapshots.snapshot_store(str(path), buckets=4)
    store.create(spark)
    return store


def _rows(store, spark, *columns):
    return sorted(tuple(r[c] for c in columns) for r in store.read(spark).collect())


def test_two_batches_equal_one(spark, tmp_path):
    rng = random.Random(7)
    changes = []
    for eo in range(120):
        kind = rng.choice(["modification", "modification", None, "addition", "repeal"])
        old, new = rng.choice([("alpha", "beta"), ("beta ", None), (None, "gamma"), ("delta epsilon", "zeta"), ("nowhere to be found", "x")])
        changes.append((rng.choice("AB"), str(rng.randrange(5)), _day(eo // 3), eo, kind, old, new))
    base = spark.createDataFrame([(c, str(n), "alpha beta delta, epsilon") for c in "AB" for n in range(4)], BASE)  # articles 4 are unknown
    df = spark.createDataFrame(changes, CHANGE)
    stores = {}
    for name, cuts in (("one", [(0, 99)]), ("two", [(0, 20), (21, 99)]), ("many", [(k, k + 6) for k in range(0, 42, 7)])):
        stores[name] = store = _store(spark, tmp_path / name)
        for number, (a, b) in enumerate(cuts):
            snapshots.consolidate_batch(store, base, df.filter(F.col("version_date").between(_day(a), _day(b))), number, F.lit("2025-01-01"))
    columns = [c for c in snapshots.SNAPSHOT.names if c != "repealed_date"]
    want = _rows(stores["one"], spark, *columns)
    assert want and want == _rows(stores["two"], spark, *columns) == _rows(stores["many"], spark, *columns)
    outcome = lambda name: sorted((r.eo, r.status, r.error or "", r.snapshot) for r in snapshots.read_log(spark, stores[name]).collect())
    assert outcome("one") == outcome("two") == outcome("many") and len(outcome("one")) == 120
    assert {s for _, s, _, _ in outcome("one")} == {"applied", "failed"}
    # The library's fold of a whole history, which keeps nothing, agrees.
    whole = consolidation.consolidate(base, df)
    assert sorted((r.code_id, r.article_number, r.version_date, r.text) for r in whole.collect()) == _rows(stores["one"], spark, "code_id", "article_number", "version_date", "article_text")


def test_conflicts_replays_and_what_a_merge_keeps(spark, tmp_path):
    store = _store(spark, tmp_path / "s")
    base = spark.createDataFrame([("A", "1", "one two"), ("A", "2", "one"), ("B", "1", None)], BASE)
    batch = lambda *rows: spark.createDataFrame(rows, CHANGE)
    run = lambda df, number, day: sorted((r.eo, r.status) for r in snapshots.consolidate_batch(store, base, df, number, F.lit(day)).collect())
    first = batch(("A", "1", _day(5), 10, None, "one", "1"), ("A", "2", _day(5), 10, "repeal", None, None), ("C", "9", _day(1), 11, "repeal", None, None), ("A", "1", None, 12, None, None, "x"))
    assert run(first, 0, "2024-06-01") == [(10, "applied"), (10, "applied"), (11, "failed")]
    kept = {p: p.stat().st_mtime_ns for p in Path(store.home, "data").rglob("part-*.parquet")}
    assert run(batch(("A", "1", _day(5), 99, None, "two", "2")), 0, "2024-07-01") == [(10, "applied"), (10, "applied"), (11, "failed")]  # a number that is done
    # Before the stored day, the same step again, later on the same day, and a later day.
    second = batch(("A", "1", _day(3), 13, None, "two", "?"), ("A", "1", _day(5), 10, None, "two", "?"), ("A", "1", _day(5), 14, None, "two", "2"), ("A", "1", _day(8), 15, None, None, "end"))
    assert run(second, 1, "2024-08-01") == [(10, "conflict"), (13, "conflict"), (14, "applied"), (15, "applied")]
    rows = _rows(store, spark, "article_number", "version_date", "article_text", "is_current", "is_repealed", "last_eo", "amendment_date")
    assert rows == [
        ("1", _day(5), "1 2", False, False, 14, dt.date(2024, 6, 1)),  # replaced, with the date it was stored first
        ("1", _day(8), "1 2\nend", True, False, 15, dt.date(2024, 8, 1)),
        ("2", _day(5), "one", False, True, 10, dt.date(2024, 6, 1)),
    ]
    now = {p: p.stat().st_mtime_ns for p in Path(store.home, "data").rglob("part-*.parquet")}
    assert kept.items() <= now.items() and len(now) == len(kept) + 1
    log = snapshots.read_log(spark, store)
    assert [tuple(r) for r in snapshots.consolidation_report(log).orderBy("code_id").collect()] == [("A", 4, 2, 4, 4, 0, 2), ("C", 1, 0, 0, 0, 1, 0)]
    told = {(r.eo, r.code_id): r for r in snapshots.amendment_log(log).collect()}
    ten = told[10, "A"]
    assert (ten.amendment_type, ten.affected, ten.modified, ten.repealed, ten.status) == ("mixed", ["1", "2"], ["1"], ["2"], "conflict") and "stored as of" in ten.error
    assert (told[11, "C"].status, told[11, "C"].error, told[15, "A"].error) == ("failed", "no such article", None)
    assert run(batch(), 2, "2024-09-01") == [] and _rows(store, spark, "article_number", "version_date") == [(r[0], r[1]) for r in rows]


def _plain(text, old, new, least):
    """The rule without the bound; (result, how many runs were compared)."""
    if old in text:
        return text.replace(old, new, 1), 0
    words, size = text.split(), len(old.split())
    for i in range(len(words) - size + 1 if size else 0):
        if difflib.SequenceMatcher(None, " ".join(words[i : i + size]), old).ratio() >= least:
            return " ".join([*words[:i], new, *words[i + size :]]), i + 1
    return None, max(0, len(words) - size + 1)


def test_bounded_search_finds_what_the_plain_rule_finds(monkeypatch):
    rng, compared = random.Random(1), [0]
    real = difflib.SequenceMatcher.ratio

    def counted(self):
        compared[0] += 1
        return real(self)

    words = ["статья", "статьи", "закон", "закона", "кодекс", "the", "a", "и", "or", "срок", "сроки"]
    cases = []
    for _ in range(600):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        old = " ".join(rng.choices(words, k=rng.randint(1, 5)))
        if rng.random() < 0.5:
            k = rng.randrange(len(old))
            old = old[:k] + rng.choice("xя ,\t") + old[k + 1 :]
        cases.append((text, old, rng.choice([0.5, 0.8, 0.9])))
    cases += [("", "x", 0.8), ("a b", "\t", 0.8), ("a b", "", 0.8), ("a", "a b c", 0.8), ("ab " * 3000, "ba" * 9, 0.8)]
    plain = [_plain(text, old, "NEW", least) for text, old, least in cases]
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", counted)
    assert [consolidation.replace_text(text, old, "NEW", least) for text, old, least in cases] == [p for p, _ in plain]
    # On texts of real length few runs pass the bound.
    text = " ".join("".join(rng.choices("абвгдежзиклмнопрст", k=rng.randint(2, 9))) for _ in range(5000))
    compared[0] = 0
    assert consolidation.replace_text(text, "налог на прибыль организаций", "x") is None and compared[0] * 10 <= _plain(text, "налог на прибыль организаций", "x", 0.8)[1]
