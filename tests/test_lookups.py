"""Searches by fields, each argument by itself and together, and counts with their totals."""

import datetime as dt


from lexmill.operators import lookups

CASE = "id int, court_type string, decision_type string, case_number string, title string, summary string, legal_issues array<string>, decision_date date, is_active boolean"


def _day(n):
    return dt.date(2024, 1, n)


def _cases(spark):
    rows = [
        (1, "supreme", "plenary_resolution", "A-12", "О труде № 7", "кратко", ["Отпуск", "Труд"], _day(1), True),
        (2, "supreme", "plenary_resolution", "B-3", "№ 12 о праве", None, None, _day(2), False),
        (3, "supreme", "ruling", "C-12", "Налог", "о ТРУДЕ", [], _day(3), True),
        (4, "general", "ruling", None, None, None, ["труд"], None, None),
        (5, "general", None, "A-12", "100% права", "", None, _day(2), True),
    ]
    return spark.createDataFrame(rows, CASE)


def _ids(found):
    return [r.id for r in found.collect()]


def test_court_decisions_by_field(spark):
    cases = _cases(spark)
    ask = lambda **k: _ids(lookups.search_court_decisions(cases, **k))
    assert ask() == [3, 2, 5, 1, 4] and ask(most=2) == [3, 2]
    assert ask(query="труд") == [3, 1, 4] and ask(query="отпуск,тр_д") == [1] and ask(query="100%прав") == [5] and ask(query="") == [3, 2, 5, 1, 4]
    assert ask(court_type="general") == [5, 4] and ask(decision_type="ruling", query="труд") == [3, 4] and ask(case_number="A-12") == [5, 1]
    assert ask(start="2024-01-02", end="2024-01-02") == [2, 5] and ask(start="2024-01-03") == [3] and ask(court_type="none") == []
    plenary = lambda *a, **k: _ids(lookups.plenary_resolutions(cases, *a, **k))
    assert plenary() == [2, 1] and plenary("12") == [2, 1] and plenary("7") == [1] and plenary(case_number="B-3") == [2] and plenary(date="2024-01-01") == [1] and plenary("12", most=1) == [2]
    assert _ids(lookups.search_court_decisions(cases.limit(0), query="x")) == []


def test_letters_by_field_and_their_statistics(spark):
    letters = spark.createDataFrame(
        [(1, 1, "letter", "Налог на доход", "Письмо", "вопрос", "ответ", _day(1), "valid"), (2, 2, "letter", None, None, "О НАЛОГЕ", None, _day(2), "revoked"), (3, 9, "letter", "x", "налог", "", "", _day(3), "valid"), (4, 1, None, "x", "y", "z", "налоги", None, None)],
        "id int, agency_id int, interpretation_type string, topic string, title string, question string, answer string, document_date date, validity_status string",
    )
    agencies = spark.createDataFrame([(1, "fns", "Tax"), (2, "rt", "Work")], "agency_id int, agency_short string, agency_name string")
    ask = lambda *a, **k: _ids(lookups.search_interpretations(letters, agencies, *a, **k))
    assert ask() == [2, 1, 4] and ask("fns") == [1, 4] and ask(query="налог") == [2, 4] and ask(topic="ДОХОД") == [1] and ask(kind="letter", end="2024-01-01") == [1] and ask("none") == []
    told = {(r.what, r.key_1, r.key_2): (r.n, r.n_good) for r in lookups.interpretation_statistics(letters).collect()}
    assert told == {("letters", "1", "letter"): (1, 1), ("letters", "1", None): (1, 0), ("letters", "2", "letter"): (1, 0), ("letters", "9", "letter"): (1, 1), ("letters, all", None, None): (4, 2), ("topics", "Налог на доход", None): (1, 1), ("topics", "x", None): (2, 1), ("agencies", None, None): (3, 3)}


def test_court_statistics(spark):
    reviews = spark.createDataFrame([("annual",), ("annual",), (None,)], "review_type string")
    positions = spark.createDataFrame([(True,), (False,), (None,)], "is_valid boolean")
    rows = lookups.court_statistics(_cases(spark), reviews, positions).collect()
    told = {(r.what, r.key_1, r.key_2): (r.n, r.n_good) for r in rows}
    assert len(told) == len(rows) and told["decisions", "supreme", "plenary_resolution"] == (2, 1) and told["decisions", "general", None] == (1, 1) and told["decisions, all", None, None] == (5, 3)
    assert (told["reviews", "annual", None], told["reviews", None, None], told["reviews, all", None, None], told["positions, all", None, None]) == ((2, 2), (1, 1), (3, 3), (3, 1))
    empty = lookups.court_statistics(_cases(spark).limit(0), reviews.limit(0), positions.limit(0)).collect()
    assert sorted((r.what, r.n, r.n_good) for r in empty) == [("decisions, all", 0, 0), ("positions, all", 0, 0), ("reviews, all", 0, 0)]
