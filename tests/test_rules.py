"""Rule tables: the library's patterns as rows, other countries' beside them, long menus as data."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import content, rules
from lexmill.functions import text as tx

MENU = " ".join(["События", "Структура", "Видео и фото", "Документы", "Контакты"] * 12)


def _table(spark, *more):
    return rules.read_rules(rules.default_rules(spark).unionByName(spark.createDataFrame(more, rules.RULES)) if more else rules.default_rules(spark))


def test_default_rules_say_what_the_functions_say(spark):
    texts = ["В статье 5 ТК РФ слово «а» заменить", "дополнить статьей 1; признать утратившим силу статью 5", "Исключить статью 7 УК РФ", "по нормам Семейного кодекса", "ничего", "", None, "Показать еще Поделиться", "Поделиться", "https://x.ru/a", "Обычная строка статьи закона", "1999 год"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table, text, none = _table(spark), F.col("t"), F.lit(None).cast("string")
    ru = F.lit("RU")
    found = df.select(
        "t", table.code(none, text, ru).alias("code"), tx.identify_code(none, text).alias("code2"), table.action(none, text, ru).alias("action"), tx.amendment_action(none, text).alias("action2"),
        table.content_validity(text, ru).alias("ok"), content.content_validity(text).alias("ok2"), table.code(none, text, F.lit("xx")).alias("other"), table.code(none, text, none).alias("null"),
    ).collect()
    for r in found:
        assert (r.code, r.action, r.ok) == (r.code2, r.action2, r.ok2), r.t
        assert r.other == r.null == "UNKNOWN"


def test_countries_have_rules_of_their_own(spark):
    more = [("BY", "code", 2, "трудовой", "LATE"), ("by", "code", 1, "кодекс", "TK_BY"), ("by", "code", 1, "кодекс", "TK_BY"), ("by", "action", 1, "исключить", "repeal"), ("by", "action", 2, "выключить", "repeal"), ("ru", "embedded", 90, r"(?:(?:События|Структура|Видео и фото|Документы|Контакты)\s*){10,}", None), ("by", "standalone", 1, "^Меню", None)]
    table = _table(spark, *more)
    rows = [("ru", "Трудовой кодекс"), ("By", "Трудовой кодекс"), ("by", "трудовой"), ("by", "исключить, выключить"), ("ru", MENU), ("by", MENU), ("by", "Меню и поиск на сайте"), ("ru", "Меню и поиск на сайте"), (None, "Меню и поиск на сайте"), ("zz", "кодекс")]
    df = spark.createDataFrame(rows, "country string, t string")
    none = F.lit(None).cast("string")
    found = df.select(table.code(none, F.col("t"), F.col("country")).alias("code"), table.action(none, F.col("t"), F.col("country")).alias("action"), table.content_validity(F.col("t"), F.col("country"))["reason"].alias("reason")).collect()
    assert [r.code for r in found] == ["TK_RF", "TK_BY", "LATE"] + ["UNKNOWN"] * 7
    assert found[3].action == "repeal"
    assert found[4].reason == "cleaned_too_short" and found[5].reason is None  # a long menu is dropped where a row tells it
    assert [r.reason for r in found[6:9]] == ["ui_pattern_^Меню", None, None]
    plan = df.select(table.code(none, F.col("t"), F.col("country")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_faulty_tables_are_refused(spark):
    make = lambda *rows: spark.createDataFrame(rows, rules.RULES)
    for row in (("ru", "code", 1, None, "X"), (None, "code", 1, "x", "X"), ("ru", None, 1, "x", "X"), ("ru", "code", 1, "(", "X")):
        with pytest.raises(ValueError, match="rule lacks|no pattern"):
            rules.read_rules(make(row))
    with pytest.raises(ValueError, match="more than 1"):
        rules.read_rules(make(("a", "b", 1, "c", "d"), ("a", "b", 2, "c", "d")), most=1)
    empty = rules.read_rules(make())
    assert empty.rules == {} and spark.range(1).select(empty.code(F.lit("a"), F.lit("b"), F.lit("ru")).alias("c")).first().c == "UNKNOWN"
