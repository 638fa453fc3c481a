"""Decisions with what they cite: gathered without holding a task's decisions in memory."""

from lexmill.operators import courts


def test_articles_are_gathered_by_sorting_and_texts_read_once(spark):
    texts = ["ст. 5 ТК РФ применяется; ст. 3 УК РФ и ст. 12 ТК РФ", "", None, "ст. 7 ГК РФ"]
    cases = spark.createDataFrame([(i, t, 1, i % 2) for i, t in enumerate(texts)], "id long, full_text string, country_code int, court_id int")
    countries = spark.createDataFrame([(1, "X")], "country_code int, country_name string")
    sites = spark.createDataFrame([(1, "Y")], "court_id int, court_name string")
    found = courts.decisions_with_articles(cases.drop("full_text"), courts.reference_rows(courts.decision_rows(cases)), countries, sites)
    got = {r["id"]: ([(a["code_id"], a["article_number"]) for a in r["articles"]], r["country_name"], r["court_name"]) for r in found.collect()}
    assert got == {0: ([("TK_RF", "12"), ("TK_RF", "5"), ("UK_RF", "3")], "X", None), 1: ([], "X", "Y"), 2: ([], "X", None), 3: ([("GK_RF", "7")], "X", "Y")}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ObjectHashAggregate" not in plan and plan.count("ArrowEvalPython") == 1
