import datetime as dt
import hashlib
import uuid

from pyspark.sql import functions as F

from lexmill.functions import legal as lg
from lexmill.functions import text as tx
from lexmill.operators import consolidation as co


def _ask(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_replace_text():
    assert co.replace_text("The quick brown fox", "quick", "slow") == "The slow brown fox"
    assert co.replace_text("the cat and the dog", "the", "a") == "a cat and the dog"
    assert co.replace_text("The quick brown fox", "elephant", "giraffe") is None
    assert co.replace_text("The quick  brown fox", "quick browns", "slow") == "The slow fox"
    assert co.replace_text("text", "", "new ") == "new text"
    assert co.replace_text("grey cats sleep, great cats sleep", "great cat sleep", "dogs run") == "dogs run great cats sleep"  # the first, not the best


def test_replaced_column_equals_the_function(spark):
    texts = ["The quick brown fox", "The quikc brown", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", co.replaced(F.col("t"), "quick", "slow").alias("x")).orderBy("i").collect()
    assert [r.x for r in found] == [None if t is None else co.replace_text(t, "quick", "slow") for t in texts]


def test_chunks_cover_the_text():
    text = " ".join(f"Word{i} is here." for i in range(400))
    chunks = co.cut_chunks(text, 512, 50)
    assert co.cut_chunks("", 512, 50) == [] and co.cut_chunks("short") == ["short"]
    assert all(c in text and len(c) <= 512 for c in chunks)
    covered = 0
    for c in chunks:
        at = text.index(c, max(0, covered - 60))
        assert at <= covered + 1
        covered = at + len(c)
    assert covered == len(text)
    assert all(len(c) <= 10 for c in co.cut_chunks("x" * 95, 10, 9))


def test_chunk_ids_are_version_5_names(spark):
    digest = hashlib.md5(b"a").hexdigest() + "_0"
    assert _ask(spark, lg.name_uuid5(F.lit(digest), co.X500)) == str(uuid.uuid5(uuid.NAMESPACE_X500, digest))


def test_consolidate_is_a_fold_by_date(spark):
    base = spark.createDataFrame([("C", "1", "The quick brown fox")], "code_id string, article_number string, text string")
    day = dt.date
    rows = [("C", "1", day(2021, 1, 1), 2, None, "line"), ("C", "1", day(2020, 1, 1), 1, "quick", "slow"), ("C", "1", day(2021, 1, 1), 3, "brown ", None), ("C", "1", day(2021, 1, 1), 4, "zzzz", "y"), ("C", "2", day(2021, 1, 1), 5, "a", "b")]
    changes = spark.createDataFrame(rows, "code_id string, article_number string, version_date date, eo long, old string, new string")
    found = co.consolidate(base, changes).orderBy("version_date").collect()
    assert [(r.version_date.year, r.text, r.n_applied, r.n_failed) for r in found] == [(2020, "The slow brown fox", 1, 0), (2021, "The slow fox\nline", 2, 1)]
    assert co.consolidate(base, changes.limit(0)).isEmpty()


def test_paragraph_numbers(spark):
    ask = lambda ns: _ask(spark, co.accepted_numbers(F.array(*[F.lit(n).cast("long") for n in ns])))
    assert ask([1, 2, 3]) == [1, 2, 3]
    assert ask([1, 5, 2, 1, 20, 31]) == [1, 2, 1, 20, 31]


def test_embedding_encodes_each_text_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "")], "i int, t string")
    found = co.embed(rows, "t", lambda ts: [[float(len(t))] for t in ts]).collect()
    assert sorted((r.i, r.embedding) for r in found) == [(1, [1.0]), (2, [1.0]), (3, [0.0])]


def test_text_functions(spark):
    ask = lambda c: _ask(spark, c)
    assert [c.new for c in ask(lg.amendment_changes(F.lit("дополнить статьей 145: новый текст статьи")))] == ["новый текст статьи"]
    assert ask(lg.amendment_changes(F.lit('слово "abc" заменить словом "xyz"'))) == []
    assert ask(lg.effective_date(F.lit("с 5 мая 2020 года"))) == dt.date(2020, 5, 5)
    assert ask(lg.effective_date(F.lit("Дата опубликования: 31.02.2020"))) is None
    broken = "Статья 5".encode("cp1251").decode("latin-1")
    assert ask(lg.repair_mojibake(F.lit(broken))) == "Статья 5"
    assert ask(lg.repair_mojibake(F.lit("Ж" + broken))) == "Ж" + broken
    assert ask(lg.repair_mojibake(F.lit("\x98é"))) == "\x98é"
    less = lambda a, b: ask(lg.article_less(tx.article_parts(F.lit(a)), tx.article_parts(F.lit(b))))
    assert less("25.2", "25.12") and less("25", "25.1") and less("25.12", "26") and not less("26", "25.12")
    assert ask(lg.valid_reference_number(F.lit("12.99"))) and not ask(lg.valid_reference_number(F.lit("12.100"))) and not ask(lg.valid_reference_number(F.lit("12a")))
    assert ask(lg.compose_full_text(F.lit("A"), F.lit("A"), F.lit("<b>B</b>"))) == "A\n\nB"
    assert ask(lg.compose_full_text(F.lit(None).cast("string"), F.lit(""), F.lit(""))) == ""


def test_chunks_follow_the_sql_of_their_rule(spark):
    import random

    import duckdb

    from lexmill.plans import legal

    rng = random.Random(12)
    bits = ["слово", "word ", ". ", "! ", "? ", "\n", ".\n", " ", "ab", "x" * 130, "y" * 400]
    texts = ["".join(rng.choices(bits, weights=[9, 9, 1, 1, 1, 1, 1, 5, 5, 1, k % 3], k=rng.randint(0, 700))) for k in range(150)]
    texts += ["a. " + "b" * 3000, ". " * 900, "\n" * 2000, "c" * 512, "d" * 513, "e. " * 10 + "f" * 2000 + ". g"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {}
    for i, k, chunk in con.sql(f"{legal._CHUNKS} SELECT document_id, chunk_index, chunk_text FROM r ORDER BY 1, 2").fetchall():
        want.setdefault(i, []).append(chunk)
    assert {i: c for i, t in enumerate(texts) if (c := co.cut_chunks(t))} == want


def test_paragraphs_follow_each_other(spark):
    import random
    import re

    from lexmill.operators.paragraphs import judge_paragraphs

    rng = random.Random(4)
    lines = []
    for article in range(40):
        for pos in range(rng.randint(0, 25)):
            n = rng.choice([1 + pos // 2, 1 + pos // 2, rng.randint(1, 12), 10 * rng.randint(1, 6) + rng.randint(0, 9), 10**25])
            lines.append((article % 7, article, pos, rng.choice([f"{n}. Абзац статьи", f" {n}.Абзац\n", f"{n}. Сроки (НАИМЕНОВАНИЕ в новой редакции закона)", "Обычный текст статьи без номера", "Поделиться", "", None, f"{n}) не номер абзаца", "1.\nперенос строки"])))
    want = {}
    for code, article, pos, text in sorted(lines, key=lambda r: r[:3]):
        expected = want.get((code, article, "next"), 1)
        m = re.match(r"^(\d+)\.\s*(.+)$", (text or "").strip())
        if not m:
            reason = None if text in ("Обычный текст статьи без номера",) or (text or "").endswith(") не номер абзаца") else "content"
            if (text or "").endswith(") не номер абзаца"):
                reason = "content" if sum(c.isdigit() for c in text) / len(text) > 0.4 else None
        elif re.search(r"\(.*(?:дополнение|редакция|редакции|утратил|Наименование|Дополнение).+\)", text, re.IGNORECASE):
            reason = "amendment_note"
        else:
            n = int(m[1])
            fits = n <= expected or n in range(10 * expected, 10 * expected + 10) or (expected > 1 and n in range(10 * expected - 10, 10 * expected))
            reason = None if fits else "out_of_sequence"
            want[code, article, "next"] = expected + (n == expected)
        want[code, article, pos] = (expected, reason)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # articles span batches
    try:
        df = spark.createDataFrame(lines, "code int, article int, pos int, line string").repartition(3)
        found = judge_paragraphs(df, ["code", "article"], "pos", "line").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(lines) and all(r.kept == (r.reason is None) for r in found)
    named = ("amendment_note", "out_of_sequence", None)
    assert {(r.code, r.article, r.pos): (r.expected, r.reason if r.reason in named else "content") for r in found} == {k: v for k, v in want.items() if k[2] != "next"}
    assert judge_paragraphs(df.limit(0), ["code"], "pos", "line").isEmpty()


def test_reference_numbers_are_matched_and_merged(spark):
    from lexmill.operators import numbering as nb

    ours = spark.createDataFrame([("A", "1"), ("A", "1.31"), ("A", "5.1"), ("B", "2"), ("A", "1.31")], "code_id string, article_number string")
    theirs = spark.createDataFrame([("A", "1", "t"), ("A", "1.3.1", "t"), ("A", "1.31.1", "Lost"), ("A", "1.2.3.4", None), ("A", "5.1", "t"), ("A", "9", "Nine"), ("B", "1", "One"), ("A", "9", "Nine")], "code_id string, article_number string, title string")
    found = nb.reconcile_numbers(ours, theirs)
    note = "Missing from official sources - Title: "
    want = [
        ("A", "1", "1", True, "Auto-matched: 1 -> 1"), ("A", "1.31", "1.3.1", True, "Auto-matched: 1.31 -> 1.3.1"), ("A", None, "1.31.1", False, note + "Lost"), ("A", None, "1.2.3.4", False, note + "Unknown title"),
        ("A", "5.1", "5.1", True, "Auto-matched: 5.1 -> 5.1"), ("A", None, "9", False, note + "Nine"), ("B", None, "1", False, note + "One"),
    ]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert [(r.number_source, r.number_reference) for r in nb.format_differences(found).collect()] == [("1.31", "1.3.1")]
    stored = spark.createDataFrame([("A", None, "9", False, "kept"), ("A", "1", "1", True, "kept"), ("Z", "1", "1", True, "kept")], found.schema)
    merged = nb.merge_reference(stored, found).collect()
    assert len(merged) == 8 and sum(r.verification_notes == "kept" for r in merged) == 3


def test_known_numbers_come_as_a_table(spark):
    from lexmill.operators import numbering as nb

    schema = "code_id string, source string, place int, article_number string, article_title string"
    rows = [("K", "kremlin", 1, "1051", "Статья 1051. О сроках"), ("K", "gov", 1, "1051", None), ("L", "kremlin", 1, "1051", None), (None, "gov", 1, "231", None)]
    known = spark.createDataFrame([("K", "105.1"), ("K", "7"), ("M", "105.1"), (None, "23.1"), ("L", None)], "code_id string, article_number string")
    found = {(r.code_id, r.source): (r.article_number, r.raw_number, r.article_title) for r in nb.correct_article_numbers(spark.createDataFrame(rows, schema).repartition(3), ["place"], known=known).collect()}
    assert found == {("K", "kremlin"): ("105.1", "1051", "Статья 105.1. О сроках"), ("K", "gov"): ("105.1", "1051", None), ("L", "kremlin"): ("1051", "1051", None), (None, "gov"): ("23.1", "231", None)}
    assert nb.correct_article_numbers(spark.createDataFrame([], schema), ["place"], known=known).isEmpty()


def test_each_text_is_encoded_once_and_blanks_never(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def encode(texts):
        with open(seen, "a") as file:
            file.writelines(t + "\n" for t in texts)
        assert len(texts) <= 3
        return [[float(len(t)), 0.1] for t in texts]

    rows = [(i, t, p) for i, (t, p) in enumerate([("abc", "q: "), ("abc", "q: "), ("abc", ""), (" \t", "q: "), (None, None), ("", ""), ("defg", None)] + [(f"t{k}", "") for k in range(10)])]
    df = spark.createDataFrame(rows, "i int, t string, p string").repartition(2)
    found = {r.i: [round(x, 3) for x in r.embedding] for r in co.embed(df, "t", encode, batch=3, size=2, prompt=F.col("p")).collect()}
    assert found == {i: [0.0, 0.0] if not (t or "").strip() else [float(len((p or "") + t)), 0.1] for i, t, p in rows}
    told = open(seen).read().split("\n")[:-1]
    assert sorted(told) == sorted({(p or "") + t for _, t, p in rows if (t or "").strip()})
    assert co.embed(df.limit(0), "t", encode, size=2).isEmpty()
