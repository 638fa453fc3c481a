"""Amendment documents parsed to the end: code, articles, action, single changes, dates, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions.legal import effective_date

#: Codes whose amendments are asked for, with the names by which they are found; fixed values.
CODE_TITLES = (("TK_RF", "Трудовой кодекс"), ("GK_RF", "Гражданский кодекс"), ("UK_RF", "Уголовный кодекс"), ("NK_RF", "Налоговый кодекс"))
#: How single changes are written, by kind; groups are old and new text, article and new text, article; fixed values.
CHANGE_FORMS = {
    "replacement": r'(?:слово|фразу|абзац|пункт)\s+["«]([^"»]+)["»]\s+заменить\s+["«]([^"»]+)["»]',
    "addition": r"дополнить\s+стать(?:е|ей|ю)\s+(\d+).*?:\s*([^.\n]+)",
    "repeal": r"признать\s+утратившим\s+силу\s+стать(?:я|ю|и)\s+(\d+)",
}


def select_amendments(docs: DataFrame, text: str, date: str, codes: tuple[tuple[str, str], ...] = CODE_TITLES, title: str = "title", start: str | None = None) -> DataFrame:
    """Rows of ``docs`` whose text holds the name of one of ``codes``, as it is written, with ``code_id``.

    All codes are asked in one pass. A row counts for the code that its title and text tell first, so
    it comes at most once; those of an earlier date than ``start``, or of none then, are left out.
    """
    told = tx.identify_code(F.col(title), F.col(text))
    named = F.coalesce(*[F.when((told == code) & F.contains(F.col(text), F.lit(name)), code) for code, name in codes])
    dated = docs if start is None else docs.filter(F.col(date) >= start)
    return dated.withColumn("code_id", named).filter("code_id is not null")


def change_details(text: Column) -> Column:
    """array of (type, article, old_text, new_text, context): replacements, then additions, then repeals, each in order."""
    every = lambda kind, i: F.regexp_extract_all(text, F.lit(f"(?iUd){CHANGE_FORMS[kind]}"), F.lit(i))
    none = F.lit(None).cast("string")

    def row(kind: str, article: Column, old: Column, new: Column, context: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), article.alias("article"), old.alias("old_text"), new.alias("new_text"), context.alias("context"))

    def of(kind: str, made) -> Column:
        return F.transform(F.arrays_zip(every(kind, 1).alias("a"), (every(kind, 2) if kind != "repeal" else every(kind, 1)).alias("b"), every(kind, 0).alias("c")), made)

    return F.concat(
        of("replacement", lambda m: row("replacement", none, m["a"], m["b"], m["c"])),
        of("addition", lambda m: row("addition", m["a"], none, F.btrim(m["b"]), m["c"])),
        of("repeal", lambda m: row("repeal", m["a"], none, none, m["c"])),
    )


def parse_amendments(docs: DataFrame, title: str = "title", text: str = "full_text", date: str = "document_date") -> DataFrame:
    """``docs`` with code_id, action, articles, changes, effective and error; no row is dropped.

    The effective date is that of the document, else the one its text names. ``error`` tells why a row
    cannot be applied: no text, no code that is known, no date, or nothing that it changes; it is null
    for good rows. One pass, all in columns.
    """
    whole, head = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(title), F.lit(""))
    parsed = docs.withColumns(
        {
            "code_id": tx.identify_code(head, whole),
            "action": tx.amendment_action(head, whole),
            "articles": tx.amended_articles(whole),
            "changes": change_details(whole),
            "effective": F.coalesce(F.col(date).cast("date"), effective_date(whole)),
        }
    )
    error = F.when(F.btrim(whole) == "", "no text").when(F.col("code_id") == "UNKNOWN", "unknown code").when(F.col("effective").isNull(), "no date")
    return parsed.withColumn("error", error.when((F.size("articles") == 0) & (F.size("changes") == 0), "nothing changed"))
