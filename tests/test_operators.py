import datetime as dt

from pyspark.sql import functions as F

from lexmill.functions import citations as cit
from lexmill.functions import text as tx
from lexmill.operators import merge, search, versions
from lexmill.sources.api import API_COLUMNS, load_api_documents
from lexmill.sources.stores import build_manifest, build_points, replace_manifest


def test_last_write_wins_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    once = merge.upsert_last_wins(target, batch, ["k"], "seq")
    twice = merge.upsert_last_wins(once, batch, ["k"], "seq")
    expected = [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r.k, r.v) for r in once.collect()) == expected == sorted((r.k, r.v) for r in twice.collect())


def test_first_write_wins(spark):
    target = spark.createDataFrame([(1, "a", 9)], "k int, v string, seq int")
    batch = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (2, "z", 1)], "k int, v string, seq int")
    assert sorted((r.k, r.v) for r in merge.insert_first_wins(target, batch, ["k"], "seq").collect()) == [(1, "a"), (2, "z")]


def test_as_of(spark):
    day = dt.date.fromisoformat
    rows = [("C", "1", day("2025-01-01"), 1, False, "old"), ("C", "1", day("2026-01-01"), 2, False, "new")]
    v = spark.createDataFrame(rows, "code_id string, article_number string, version_date date, eo long, is_repealed boolean, article_text string")
    asked = [(1, "C", "1", day("2025-06-01")), (2, "C", "1", day("2026-01-01")), (3, "C", "1", day("2024-01-01"))]
    r = spark.createDataFrame(asked, "event_id long, code_id string, article_number string, on_date date")
    assert sorted((x.event_id, x.eo) for x in versions.article_as_of(v, r).collect()) == [(1, 1), (2, 2)]


def test_text_functions(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("x")).first().x
    assert ask(tx.clean_html_text(F.lit("<p>Hello <b>world</b></p>"))) == "Hello world"
    assert ask(tx.normalize_article(F.lit("025.01-1"))) == "25.1-1"
    assert ask(tx.article_parts(F.lit("x"))) is None
    assert ask(tx.title_date(F.lit("от 31 февраля 2020 года"))) is None
    assert ask(tx.title_date(F.lit("от 3 марта 2020 года"))) == dt.date(2020, 3, 3)
    assert ask(tx.amendment_action(F.lit(""), F.lit("Дополнить статьей 1; признать утратившим силу статью 5"))) == "mixed"
    assert [(c.article, c.code) for c in ask(cit.citations(F.lit("ст. 81 ТК РФ, статья 10.1 ГК РФ, ст. 81 ТК РФ")))] == [("81", "TK_RF"), ("10.1", "GK_RF")]
    assert ask(tx.identify_code(F.lit("О правилах"), F.lit("по нормам Семейного кодекса и ТК РФ"))) == "TK_RF"
    assert ask(tx.identify_code(F.lit("КоАП"), F.lit(None).cast("string"))) == "KoAP_RF"
    assert ask(tx.amendment_action(F.lit("Исключить статью 7"), F.lit(""))) == "repeal"
    assert ask(tx.amendment_action(F.lit(""), F.lit("дополнить список"))) == "modification"
    assert ask(tx.amended_articles(F.lit("В статье 12.3 и ст. 4-1, пункт 9; статьи 12.3"))) == ["12.3", "4-1", "9"]
    long = "слово " * 100
    assert ask(tx.summary(F.lit("Глава\n\n" + long))) == ("слово " * 83).strip() + "..."
    assert ask(tx.summary(F.lit("короткий текст"))) == "короткий текст" and ask(tx.summary(F.lit(None).cast("string"))) == ""


def test_vector_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "_BLOCK_POINTS", 7)
    monkeypatch.setattr(search, "_BLOCK_QUERIES", 2)
    points = [(i, [float((i * k) % 11 - 5) for k in range(1, 5)]) for i in range(30)] + [(30, [0.0] * 4), (31, None)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<float>")
    found = search.vector_search(df, df.filter("vec_id % 6 = 1").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 3).collect()
    norm = lambda v: sum(x * x for x in v) ** 0.5
    expected = set()
    for i, v in points:
        if i % 6 == 1 and v and norm(v):
            near = [(-round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 6), j) for j, w in points if j != i and w and norm(w)]
            expected |= {(i, j) for _, j in sorted(near)[:3]}
    assert {(r.query, r.vec_id) for r in found} == expected


def test_column_upsert_takes_the_last_of_equal_keys(spark):
    target = spark.createDataFrame([(1, "a", "x"), (None, "n", "n")], "k int, v string, w string")
    batch = spark.createDataFrame([(1, "b", "y", 1), (1, "c", "z", 2), (2, "d", "q", 1), (None, "m", "m", 1)], "k int, v string, w string, seq int")
    got = merge.upsert_columns(target, batch, ["k"], ["v"], order="seq").select("k", "v", "w")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "c", "x"), (2, "d", "q"), (None, "n", "n"), (None, "m", "m")], key=str)


def test_counts_and_sources_are_judged_by_code(spark):
    facts = spark.createDataFrame([("A", 4, 3), ("B", 4, 3), ("C", 1, 3)], "code_id string, expected int, largest int")
    rows = [("A", "1", "pravo"), ("A", "31", "kremlin"), ("A", "2", "pravo"), ("B", "2", "kremlin"), ("B", "99", "pravo"), ("B", "1", "other")]
    articles = spark.createDataFrame(rows, "code_id string, article_number string, source string")
    assert sorted((r.code_id, r.n, r.verdict) for r in versions.validate_counts(articles, facts).collect() if r.n) == [("A", 3, "mild"), ("B", 3, "mild")]
    picked = versions.pick_source(articles, facts, ("kremlin", "pravo"))
    assert sorted((r.code_id, r.source, r.suspicious) for r in picked.collect()) == [("A", "pravo", 1), ("B", "kremlin", 1)]


def test_api_pages_give_documents(spark):
    pages = ['{"items": [{"eoNumber": "1", "documentDate": "2024-02-30", "hasSvg": true, "other": 1}, {"publishDateShort": "2024-03-01T10:00:00", "pdfFileLength": 5000000000}]}', '{"items": []}', "{}", "no json", None]
    found = load_api_documents(spark.createDataFrame([(p,) for p in pages], "page string"), "page", 7, None, F.current_timestamp())
    assert len(found.columns) == len(API_COLUMNS) + 4
    rows = sorted((r.eo_number or "", r.document_date, r.publish_date, r.has_svg, r.pdf_file_size, r.country_id, r.publication_block_id) for r in found.collect())
    assert rows == [("", None, dt.date(2024, 3, 1), False, 5000000000, 7, None), ("1", None, None, True, None, 7, None)]


def test_points_keep_the_last_good_row_of_an_id(spark):
    rows = spark.createDataFrame([(1, [1.0], "a", 1), (1, [2.0], "b", 2), (1, [], "c", 3), (None, [1.0], "d", 1), (2, None, "e", 1)], "id int, v array<double>, word string, seq int")
    assert [(r.point_id, r.vector, r.payload.word) for r in build_points(rows, "id", "v", "seq").collect()] == [(1, [2.0], "b")]
    assert build_points(rows.limit(0), "id", "v", "seq").count() == 0


def test_a_manifest_replaces_that_of_its_group(spark):
    docs = spark.createDataFrame([("ru", 1, "a"), ("ru", 2, "b"), ("by", 3, "c")], "country string, id int, text string")
    stored = build_manifest(docs, "country", "id", F.col("text"), F.lit("2024-01-01"))
    new = build_manifest(docs.filter("id = 2"), "country", "id", F.lit("z"), F.lit("2024-01-02"))
    assert sorted((r.country, r.id, r.last_updated) for r in replace_manifest(stored, new, "country").collect()) == [("by", 3, "2024-01-01"), ("ru", 2, "2024-01-02")]


def test_places_in_a_code(spark):
    rows = [("A", "10", "2020"), ("A", "2", "2021"), ("A", "2", "2020"), ("A", "2.1", "2020"), ("B", "1", "2020"), (None, None, "2020"), (None, "1", "2020")]
    placed = versions.place_in_code(spark.createDataFrame(rows, "code_id string, article_number string, version_date string"))
    want = [("A", "2", "2020", 1, 4), ("A", "2", "2021", 2, 4), ("A", "10", "2020", 3, 4), ("A", "2.1", "2020", 4, 4), ("B", "1", "2020", 1, 1), (None, "1", "2020", 1, 2), (None, None, "2020", 2, 2)]
    assert sorted(map(tuple, placed.collect()), key=str) == sorted(want, key=str)


def test_vector_search_skips_blocks_and_stays_exact(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(2)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    points = [(i, [m + rng.gauss(0, 0.05) for m in middles[i % 12]], i % 3) for i in range(600)] + [(1000 + i, middles[0], 0) for i in range(80)]  # a third of one block is one vector
    df = spark.createDataFrame(points, "vec_id long, embedding array<float>, label int")
    asked = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    visited = []
    real = search.candidate_blocks

    def counted(queries, sample, centres, radii, *rest):
        found = real(queries, sample, centres, radii, *rest).cache()
        visited.append((found.count(), queries.count() * len(radii)))
        return found

    monkeypatch.setattr(search, "candidate_blocks", counted)
    monkeypatch.setattr(search, "_BLOCK_POINTS", 40)
    monkeypatch.setattr(search, "_BLOCK_QUERIES", 6)
    ids, raw, labels = np.array([p[0] for p in points]), np.array([p[1] for p in points], np.float32).astype(float), np.array([p[2] for p in points])
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    for threshold, where in ((None, None), (0.95, None), (0.2, {"label": 1}), (0.999, {"label": 2}), (None, {"label": 9})):
        want = set()
        for i in np.flatnonzero(ids % 20 == 0):
            scores = np.round(unit @ unit[i], 6)
            good = [(-scores[j], ids[j]) for j in range(len(ids)) if j != i and (threshold is None or scores[j] >= threshold) and (not where or labels[j] == where["label"])]
            want |= {(ids[i], j) for _, j in sorted(good)[:4]}
        found = search.vector_search(df, asked, 4, threshold=threshold, where=where, centres=16, sample=60).collect()
        assert {(r.query, r.vec_id) for r in found} == want
        assert all(r.score >= (threshold or -1) for r in found)
    assert visited[0][0] < 0.5 * visited[0][1] and visited[3][0] < visited[0][0]


def test_natural_keys_and_forced_values(spark):
    day = dt.date(2024, 1, 1)
    schema = "country_code string, agency_id int, document_number string, document_date date, title string, answer string, validity_status string"
    stored = spark.createDataFrame([("RU", 1, "N1", day, "old", "a", "stale"), ("RU", 1, None, day, "old", "b", "stale"), ("RU", 2, "N1", day, "old", "c", "stale")], schema)
    batch = spark.createDataFrame([("RU", 1, "N1", day, "new", "A", "x"), ("RU", 1, None, day, "new", "B", "x"), ("BY", 1, "N1", day, "new", "C", "x")], schema)
    once = merge.merge_by_natural_key(stored, batch, "letter", ["answer"], set_const={"validity_status": "valid"})
    show = lambda df: sorted((r.country_code, r.agency_id, r.document_number or "", r.title, r.answer, r.validity_status) for r in df.collect())
    want = [("BY", 1, "N1", "new", "C", "x"), ("RU", 1, "", "new", "B", "x"), ("RU", 1, "", "old", "b", "stale"), ("RU", 1, "N1", "old", "A", "valid"), ("RU", 2, "N1", "old", "c", "stale")]
    assert show(once) == want
    again = merge.merge_by_natural_key(once, batch, "letter", ["answer"], set_const={"validity_status": "valid"})
    assert len(show(again)) == 6 and again.filter("document_number is null").count() == 3  # a null key comes in again
    whole = merge.merge_by_natural_key(stored, batch.unionByName(batch.withColumn("title", F.lit("zz"))), "letter", order="title")
    assert [r[3] for r in show(whole) if r[:3] == ("RU", 1, "N1")] == ["zz"]
    assert all(len(keys) == len(set(keys)) for keys in merge.NATURAL_KEYS.values())
