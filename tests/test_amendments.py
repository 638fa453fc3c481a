"""Amendments, court rows, dates and numbers in the forms in which they are written."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import amendments, courts


def _ask(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "title", "letter", "dotted", "generic"),
    [
        ("от 27 января 2026 года", "2026-01-27", "2026-01-27", None, None),
        ("Постановление от 23 декабря 2025 го", "2025-12-23", "2025-12-23", None, None),
        ("от 3 мар 2024 года", "2024-03-03", None, None, None),
        ("от 30 февраля 2024 года", None, None, None, None),
        ("Письмо от 27 Октября 2025", None, "2025-10-27", None, None),
        ("Письмо от 7.1.2025", None, "2025-01-07", None, None),
        ("от 40 мая 2025, от 28.07.2025", None, "2025-07-28", "2025-07-28", "2025-07-28"),
        ("7 ноября 2025", None, None, None, "2025-11-07"),
        ("28 июля 2025 г.", None, None, None, None),
        ("28.07.2025", None, None, "2025-07-28", "2025-07-28"),
        ("31.02.2025", None, None, None, None),
        ("мая", None, None, None, None),
        ("5 мая и 2020", None, None, None, "2020-05-05"),
        ("", None, None, None, None),
        (None, None, None, None, None),
    ],
)
def test_dates(spark, text, title, letter, dotted, generic):
    line = F.lit(text).cast("string")
    found = _ask(spark, F.struct(tx.title_date(line).alias("a"), tx.letter_date(line).alias("b"), tx.dotted_date(line).alias("c"), tx.any_date(line).alias("d")))
    assert [None if d is None else str(d) for d in found] == [title, letter, dotted, generic]


def test_numbers(spark):
    number = lambda text, form: _ask(spark, tx.document_number(F.lit(text), form))
    assert number("Письмо № БС-4-21/9645@ о налоге", "letter") == "БС-4-21/9645@" and number("№12", "letter") == "12" and number("номер 12", "letter") is None
    assert number("исх. 03-04-06/12345 от", "dashed") == "03-04-06/12345" and number("3-04-06/1", "dashed") is None


TEXTS = [
    'В тексте слово «старый» заменить «новый», ФРАЗУ "а б" заменить "в г". Дополнить статьей 145: новый текст. Признать утратившим силу статью 7',
    "дополнить статью 12 частью: первое. И дополнить статьей 13\nбез текста",
    "абзац «x» заменить словом «y»; признать утратившим силу статьи 8 и 9; Признать утратившим силу  статья 10",
    "пункт «1»\nзаменить «2». дополнить статьей 5 (новой): одно; другое\nдополнить статьей 6:\nтекст",
    "",
]


def test_changes_against_regular_expressions(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(9, None)], "i int, t string").select("i", amendments.change_details(F.col("t")).alias("c")).collect()
    for row in rows:
        if row.i == 9:
            assert not row.c
            continue
        want, text = [], TEXTS[row.i]
        for kind, form in amendments.CHANGE_FORMS.items():
            for m in re.finditer(form, text, re.IGNORECASE):
                want.append({"replacement": (kind, None, m[1], m[2] if m.re.groups > 1 else None, m[0]), "addition": (kind, m[1], None, (m[2] if m.re.groups > 1 else "").strip(), m[0]), "repeal": (kind, m[1], None, None, m[0])}[kind])
        assert [tuple(c) for c in row.c] == want


def test_parsed_amendments_keep_bad_rows(spark):
    day = dt.date(2024, 5, 1)
    rows = [
        (1, "О внесении изменений в Трудовой кодекс", "В статье 5 слово «а» заменить «б»", day),
        (2, "Без кодекса", "В статье 5 изменения", day),
        (3, "ТК РФ", None, day),
        (4, "ТК РФ", " ", None),
        (5, "ТК РФ", "Федеральный закон от 02.03.2023: признать утратившим силу статью 9", None),
        (6, "ТК РФ", "В статье 5", None),
        (7, "ТК РФ", "Ничего", day),
        (8, None, "Трудовой кодекс: дополнить статьей 3: текст", day),
    ]
    docs = spark.createDataFrame(rows, "id int, title string, full_text string, document_date date")
    found = {r.id: r for r in amendments.parse_amendments(docs).collect()}
    assert {i: r.error for i, r in found.items()} == {1: None, 2: "unknown code", 3: "no text", 4: "no text", 5: None, 6: "no date", 7: "nothing changed", 8: None}
    assert found[5].effective == dt.date(2023, 3, 2) and [c.type for c in found[5].changes] == ["repeal"] and (found[1].effective, found[1].articles) == (day, ["5"])
    assert amendments.parse_amendments(docs.limit(0)).isEmpty()
    # The name must stand in the text as it is written, and the text must tell that code first.
    named = spark.createDataFrame([(1, "", "Трудовой кодекс", day), (2, "", "трудовой кодекс", day), (3, "ТК РФ", "Налоговый кодекс", day), (4, "", None, day), (5, "", "Налоговый кодекс", dt.date(2020, 1, 1)), (6, "", "Налоговый кодекс", None), (7, "", "Семейный кодекс", day)], docs.schema)
    select = lambda **k: sorted((r.id, r.code_id) for r in amendments.select_amendments(named, "full_text", "document_date", **k).collect())
    assert select() == [(1, "TK_RF"), (5, "NK_RF"), (6, "NK_RF")] and select(start="2024-01-01") == [(1, "TK_RF")] and select(codes=(("SK_RF", "Семейный кодекс"),)) == [(7, "SK_RF")]


def test_court_rows_and_their_merges(spark):
    text = "Суд применил ст. 81 ТК РФ. " + "слово " * 200 + "\n\nТакже ст. 81 ТК РФ и ст. 5 УК РФ"
    raw = spark.createDataFrame([(1, "A-1", text, "one"), (2, "A-2", "", "two"), (3, None, None, "three"), (4, "A-1", "ст. 7 ТК РФ", "again"), (5, None, "ст. 7 ТК РФ", "five")], "id long, case_number string, full_text string, title string")
    rows = courts.decision_rows(raw).cache()
    by_id = {r.id: r for r in rows.collect()}
    assert by_id[1].text_hash == hashlib.sha256(text.encode()).hexdigest() and by_id[2].text_hash == by_id[3].text_hash == hashlib.sha256(b"").hexdigest()
    assert len(by_id[1].summary) <= 503 and by_id[3].references == []
    references = courts.reference_rows(rows)
    assert sorted((r.decision_id, r.code_id, r.article_number, r.reference_type, r.position_in_text) for r in references.collect()) == [
        (1, "TK_RF", "81", "applied", 13), (1, "UK_RF", "5", "cited", text.index("ст. 5")), (4, "TK_RF", "7", "cited", 0), (5, "TK_RF", "7", "cited", 0)]
    stored = spark.createDataFrame([(9, "A-1", "old", "stored", "s", "h")], "id long, case_number string, full_text string, title string, summary string, text_hash string")
    first = courts.merge_decisions(stored, rows, None)
    assert sorted((r.id, r.title) for r in first.collect()) == [(2, "two"), (3, "three"), (5, "five"), (9, "stored")]
    update = courts.merge_decisions(stored, rows, ["full_text", "text_hash"])
    assert sorted((r.id, r.title, r.full_text) for r in update.collect() if r.id == 9) == [(9, "stored", "ст. 7 ТК РФ")] and update.count() == 4
    known = references.filter("decision_id = 1 and code_id = 'TK_RF'").withColumn("reference_type", F.lit("stored"))
    merged = courts.merge_references(known, references.unionByName(references))
    assert merged.count() == 4 and merged.filter("reference_type = 'stored'").count() == 1
    countries = spark.createDataFrame([(7, "Land")], "country_code int, country_name string")
    sites = spark.createDataFrame([(1, "Court")], "court_id int, court_name string")
    cases = raw.select("id", F.when(F.col("id") == 2, 8).otherwise(7).alias("country_code"), F.when(F.col("id") < 4, 1).alias("court_id"))
    found = {r.id: r for r in courts.decisions_with_articles(cases, references, countries, sites).collect()}
    assert sorted(found) == [1, 3, 4, 5] and [(a.code_id, a.article_number) for a in found[1].articles] == [("TK_RF", "81"), ("UK_RF", "5")] and found[3].articles == []
    assert (found[1].court_name, found[4].court_name) == ("Court", None)
    assert courts.reference_rows(courts.decision_rows(raw.limit(0))).isEmpty()
