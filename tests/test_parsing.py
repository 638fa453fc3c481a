import datetime as dt

from pyspark.sql import functions as F

from lexmill.functions import citations as cit
from lexmill.functions import content, html
from lexmill.operators import consolidation as co
from lexmill.operators import numbering as nb


def _ask(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_citations_of_all_forms(spark):
    text = "По п. 2 ст. 7 Водный кодекс, суд применил ст. 81 ТК РФ; ч. 1.1 ст. 12.8 КоАП РФ, СТАТЬЯ 5 НК, ст. 9 кодекса, ст. 81 ТК РФ"
    found = _ask(spark, cit.citations(F.lit(text)))
    assert [(c.code, c.article) for c in found] == [("VDK_RF", "7"), ("TK_RF", "81"), ("KoAP_RF", "12.8"), ("NK_RF", "5"), ("GK_RF", "9")]  # "кодекс" alone is held in the first name
    assert [text[c.position :].split(" ")[1] for c in found] == ["7", "81", "12.8", "5", "9"]
    assert found[1].kind == "applied" and all(c.context in text for c in found)
    assert _ask(spark, cit.citations(F.lit(None).cast("string"))) == [] and _ask(spark, cit.citations(F.lit(""))) == []


def test_code_names_as_columns_and_in_batches(spark):
    names = ["ТК РФ", " вк рф ", "Воздушный кодекс", "кодекса", "гк", "Конституция РФ и право", "трудового кодекса"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", cit.code_of_name(F.col("n")).alias("c")).orderBy("i")
    found = [r.c for r in rows.collect()]
    assert found == ["TK_RF", "VDK_RF", "VZK_RF", None, "GK_RF", "KONST_RF", None] == [cit._code(n) for n in names]


def test_content_validity(spark):
    cases = {
        "": "empty_text",
        "  коротко ": "too_short_7_chars",
        "х" * 5001: "too_long_5001_chars",
        "Глава 3. Общие": "section_header",
        "§ 7. Унитарные": "section_symbol_header",
        "1. Понятия и термины (в редакции закона)": "subsection_title_with_amendment",
        "Поделиться Подписаться": "cleaned_too_short",
        "https://example.com/a": "ui_pattern_^https?://\\S+$",
        "12345678 знак": "high_digit_ratio_0.62",
        "Обычный текст статьи о договоре": None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", content.content_validity(F.col("t")).alias("v")).collect()
    assert {r.t: r.v.reason for r in rows} == cases and all(r.v.ok == (r.v.reason is None) for r in rows)
    assert _ask(spark, content.content_validity(F.lit(None).cast("string"))["reason"]) == "empty_text"


def test_main_text(spark):
    ask = lambda page: _ask(spark, html.main_text(F.lit(page)))
    assert ask("<body><p>out</p><div class='big card'><h1>Head</h1><p>One<br>two</p><ul><li>three</li></ul><script>x</script></div></body>") == "One two - three"
    assert ask("<body><main>a<p>b</main>c</body>") == "a b" and ask("<body>c&amp;d") == "c&d" and ask("plain") == "plain"
    assert ask("") == "" and ask(None) is None


def test_articles_of_a_page(spark):
    page = "<p>Статья 9. Вне</p><div class='act'><h4>Статья 1. О <b>сделках</b></h4><p>Первый абзац статьи</p><p>Поделиться</p><div>Второй <i>абзац</i> статьи</div><h4>Статья 2.1 О залоге</h4><h4>Статья 1. Снова</h4><p>Третий абзац статьи</p></div>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>нет статей</p>")], "page_id int, html string")
    rows = co.split_articles(pages, "kremlin", "act").orderBy("article_no").collect()
    assert [(r.article_number, r.article_title, r.article_text) for r in rows] == [("1", "Статья 1. О сделках", "Первый абзац статьи\n\nВторой абзац статьи"), ("1", "Статья 1. Снова", "Третий абзац статьи")]
    assert [r.article_title for r in co.split_articles(pages, "government", "act").collect()] == ["Статья 1. О сделках"]
    law = spark.createDataFrame([(1, "<h3>Статья 5. А*</h3><p>* да *</p><p>Слова основного закона*</p><h4>Статья 6. Б</h4><h3>Статья 138. В</h3>")], "page_id int, html string")
    assert [(r.article_number, r.article_text) for r in co.split_articles(law, "constitution").collect()] == [("5", "Слова основного закона\n\nСтатья 6. Б\n\nСтатья 138. В")]
    assert co.split_articles(pages.limit(0), "pravo").isEmpty()


def test_additions_and_repeals(spark):
    day = dt.date
    base = spark.createDataFrame([("C", "1", "one two"), ("C", "9", "quiet")], "code_id string, article_number string, text string")
    rows = [
        ("C", "1", day(2020, 1, 1), 1, "modification", "two", "2"),
        ("C", "1", day(2021, 1, 1), 2, "repeal", None, None),
        ("C", "2", day(2020, 1, 1), 3, "repeal", None, None),
        ("C", "2", day(2020, 6, 1), 4, "modification", "a", "b"),
        ("C", "2", day(2021, 1, 1), 5, "addition", None, "new one"),
        ("C", "2", None, 6, "addition", None, "no date"),
    ]
    changes = spark.createDataFrame(rows, "code_id string, article_number string, version_date date, eo long, kind string, old string, new string")
    found = [(r.article_number, r.version_date.year, r.text, r.is_repealed, r.is_current, r.n_failed) for r in co.consolidate(base, changes).orderBy("article_number", "version_date").collect()]
    assert found == [("1", 2020, "one 2", False, False, 0), ("1", 2021, "one 2", True, False, 0), ("2", 2021, "new one", False, True, 0)]


def test_compare_versions(spark):
    row = lambda number, text, gone: F.struct(F.lit(number).alias("article_number"), F.lit(text).alias("text"), F.lit(gone).alias("is_repealed"), F.when(F.lit(gone), F.lit("2020-01-02").cast("date")).alias("repealed_date"))
    ask = lambda a, b: tuple(_ask(spark, co.compare_versions(row(*a), row(*b))))
    assert ask(("1", "abc", False), ("1", "abc", False)) == (False, [], 1.0)
    assert ask(("1", "abc", False), ("1", "abc", True))[1] == ["Article repealed on 2020-01-02"]
    assert ask(("1", "ab", True), ("1", "abc", False)) == (True, ["Article reinstated", "Inserted: 'c...'"], 0.8)
    assert ask(("1", "a", False), ("2", "a", False)) == (True, ["Different articles: 1 vs 2"], 0.0)
    assert co.compare_texts("a" * 99 + "x", "a" * 99)[1] == ["Deleted: 'x...'"]


def test_correct_number():
    ask = lambda *a, **k: nb.correct_number(*a, **k)[0]
    assert ask("1201", "120", "121") == "120.1" and ask("601", "60", "602") == "601" and ask("232", "23.1", "233") == "232"
    assert ask("12.9.1", None, None) == "129.1" and ask("12.9.7-1", None, None) == "129.7-1" and ask("12.9.1", None, None, "kremlin") == "12.9.1"
    assert ask("52.1-1", "5", "6") == "52.1-1" and ask("12316-1", "123.16", "124") == "123.16-1" and ask("521-1", "52", "53") == "52.1-1"
    assert ask("1051", None, None, known=frozenset({"105.1"})) == "105.1" and ask("231", "230", "232", known=frozenset({"23.1"})) == "231"
    assert ask("1061", "105", None, "pravo", (1, 307)) == "106.1" and ask("71", None, None, "pravo", (1, 85)) == "71"
    assert nb.correct_number("9999999", None, None, "pravo", (1, 85)) == ("9999999", True)


def test_correct_article_numbers_in_order(spark):
    rows = [("TK_RF", "kremlin", i, n, f"Статья {n}. О труде") for i, n in enumerate(["120", "1201", None, "1202", "121"])] + [("XX", "kremlin", 0, "5", None)]
    found = nb.correct_article_numbers(spark.createDataFrame(rows, "code_id string, source string, place int, article_number string, article_title string"), ["place"])
    got = {(r.code_id, r.place): (r.article_number, r.article_title) for r in found.collect()}
    assert got["TK_RF", 3] == ("120.2", "Статья 120.2. О труде") and got["TK_RF", 2][0] is None and got["XX", 0] == ("5", None)
    assert nb.correct_article_numbers(spark.createDataFrame([], "code_id string, source string, place int, article_number string, article_title string"), ["place"]).isEmpty()
