"""Text functions on columns: cleaning, dates, numbers, article numbers, citations, amendments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spaces of Unicode's category Zs.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Months in the genitive, January first; fixed values.
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
#: Phrases that tell a code, in the order in which they are tried; fixed values.
CODE_PHRASES = (
    ("TK_RF", ("трудовой кодекс", "тк рф", "трудового кодекса")),
    ("GK_RF", ("гражданский кодекс", "гк рф", "гражданского кодекса")),
    ("UK_RF", ("уголовный кодекс", "ук рф", "уголовного кодекса")),
    ("NK_RF", ("налоговый кодекс", "нк рф", "налогового кодекса")),
    ("KoAP_RF", ("коап", "кодекс об административных", "административных правонарушениях")),
    ("SK_RF", ("семейный кодекс", "ск рф", "семейного кодекса")),
    ("ZhK_RF", ("жилищный кодекс", "жк рф", "жилищного кодекса")),
    ("ZK_RF", ("земельный кодекс", "зк рф", "земельного кодекса")),
)
#: Patterns of lower-cased title and text that tell what an amendment does; fixed values.
ACTION_PATTERNS = {
    "addition": ("дополнить.*стать(?:е|ей|ю) [0-9]+", "признать.*утратившим силу.*дополнить"),
    "modification": ("в стать(?:е|и|ю|ей) [0-9]+.*(?:заменить|изложить)", "признать.*утратившим силу.*(?:абзац|пункт)"),
    "repeal": ("признать.*утратившим силу.*стать(?:я|ю|и)", "исключить.*стать(?:я|ю|и)"),
}
#: Patterns of lower-cased text that name an amended article, in the order in which they are tried; fixed values.
ARTICLE_PATTERNS = (r"стать(?:и|ью|ей|е|я) ([0-9]+(?:[.\-][0-9]+)*)", r"ст\. ([0-9]+(?:[.\-][0-9]+)*)", "пункт ([0-9]+)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def normalize_text(text: Column) -> Column:
    """Runs of white space become one space; null stays null; no trim."""
    return F.regexp_replace(text, r"\s+", " ")


def clean_html_text(text: Column) -> Column:
    breaks = F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)<br */?>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(breaks, "<[^>]+>", ""), r"\s+", " "))


def text_hash(text: Column, kind: str) -> Column:
    """md5: empty for empty or null; sha256: null for empty or null."""
    full = F.length(F.coalesce(text, F.lit(""))) > 0
    return F.when(full, F.md5(text)).otherwise("") if kind == "md5" else F.when(full, F.sha2(text, 256))


def parse_api_date(text: Column) -> Column:
    """ISO dates with or without a time; anything else is null."""
    return F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:T.*)?$", 1), "yyyy-MM-dd")


#: Dates and numbers as titles and letters write them; fixed values.
DATE_FORMS = {
    "title": r"от\s+(\d{1,2})\s+([а-яё]+)\s+(\d{4})\s+(?:года|го)",
    "letter": r"от\s+(\d{1,2})\s+([а-яёА-ЯЁ]+)\s+(\d{4})",
    "letter dotted": r"от\s+(\d{1,2})\.(\d{1,2})\.(\d{4})",
    "dotted": r"(\d{2})\.(\d{2})\.(\d{4})",
}
NUMBER_FORMS = {"letter": r"№\s*([А-Яа-яЁёA-Za-z0-9\-/]+@?)", "dashed": r"(\d{2}-\d{2}-\d{2}/\d+)"}


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _month(test) -> Column:
    """Number of the first month for which ``test`` holds, null if none."""
    return F.nullif(F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), test), True), F.lit(0))


def title_date(text: Column) -> Column:
    """The date of "от D месяц YYYY года" or "го"; the month may be a part of its name; invalid days are null."""
    part = lambda i: F.regexp_extract(text, DATE_FORMS["title"], i)
    return F.when(part(1) != "", _day(part(3), _month(lambda m: m.contains(part(2))), part(1)))


def letter_date(text: Column) -> Column:
    """The date of "от D месяц YYYY", or if that is none, of "от D.M.YYYY"."""
    named = lambda i: F.regexp_extract(text, DATE_FORMS["letter"], i)
    plain = lambda i: F.regexp_extract(text, DATE_FORMS["letter dotted"], i)
    return F.coalesce(_day(named(3), _month(lambda m: m == F.lower(named(2))), named(1)), _day(plain(3), plain(2), plain(1)))


def dotted_date(text: Column) -> Column:
    """The date of the first "DD.MM.YYYY"."""
    part = lambda i: F.regexp_extract(text, DATE_FORMS["dotted"], i)
    return _day(part(3), part(2), part(1))


def any_date(text: Column) -> Column:
    """With the name of a month: day and year are the first and the last word around it; else as :func:`dotted_date`.

    Of several months the first of the year that gives a date counts.
    """
    low = F.lower(text)

    def read(month: Column, place: Column) -> Column:
        words = F.filter(F.split(F.replace(low, month, F.lit(" ")), r"\s+"), lambda w: w != "")
        ends = [F.get(words, i) for i in (F.lit(0), F.size(words) - 1)]
        numbers = (F.size(words) >= 2) & ends[0].rlike("^[0-9]{1,2}$") & ends[1].rlike("^[0-9]{4}$")
        return F.when(low.contains(month) & numbers, _day(ends[1], place + 1, ends[0]))

    found = F.get(F.filter(F.transform(F.array(*map(F.lit, MONTHS)), read), lambda d: d.isNotNull()), 0)
    return F.coalesce(found, dotted_date(text))


def document_number(text: Column, form: str) -> Column:
    """The number after "№" of a letter, or one of the form NN-NN-NN/N; null if there is none."""
    return F.nullif(F.regexp_extract(text, NUMBER_FORMS[form], 1), F.lit(""))


def article_parts(number: Column) -> Column:
    """base, insertion and subdivision of "25.12-1"; null if it is none."""
    pattern = r"^(\d+)(?:\.(\d+))?(?:-(\d+))?$"
    part = lambda i: F.regexp_extract(number, pattern, i).try_cast("int")
    return F.when(number.rlike(pattern), F.struct(part(1).alias("base"), part(2).alias("insertion"), part(3).alias("subdivision")))


def normalize_article(number: Column) -> Column:
    """Without leading zeros."""
    parts = article_parts(number)
    dot = F.when(parts["insertion"].isNotNull(), F.concat(F.lit("."), parts["insertion"].cast("string"))).otherwise("")
    dash = F.when(parts["subdivision"].isNotNull(), F.concat(F.lit("-"), parts["subdivision"].cast("string"))).otherwise("")
    return F.concat(parts["base"].cast("string"), dot, dash)


def identify_code(title: Column, text: Column) -> Column:
    """The first code whose phrase occurs, else UNKNOWN."""
    low = F.lower(F.concat_ws(" ", title, text))
    found = F.lit("UNKNOWN")
    for code, phrases in reversed(CODE_PHRASES):
        found = F.when(low.rlike("|".join(phrases)), code).otherwise(found)
    return found


def amendment_action(title: Column, text: Column) -> Column:
    """addition, modification or repeal; mixed if several; modification if none."""
    low = F.lower(F.concat_ws(" ", title, text))
    tells = {kind: low.rlike("|".join(patterns)) for kind, patterns in ACTION_PATTERNS.items()}
    n = sum((found.cast("int") for found in tells.values()), F.lit(0))
    return F.when(n > 1, "mixed").when(tells["addition"], "addition").when(tells["repeal"], "repeal").otherwise("modification")


def amended_articles(text: Column) -> Column:
    """Article numbers in first-seen order of three patterns."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)) for p in ARTICLE_PATTERNS]))


def summary(text: Column, most: int = 500, least: int = 50) -> Column:
    """The first paragraph of more than ``least`` characters, else the whole text; beyond ``most`` cut at the last space, with dots.

    Paragraphs end at blank lines. A null text gives an empty summary.
    """
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.transform(F.split(text, "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\r\f\v")))
    chosen = F.coalesce(F.get(F.filter(paragraphs, lambda p: F.length(p) > least), 0), text)
    head = F.regexp_replace(F.substring(chosen, 1, most), " [^ ]*\\z", "")
    return F.when(F.length(chosen) > most, F.concat(head, F.lit("..."))).otherwise(chosen)


def clean_lines(text: Column, least: int = 1) -> Column:
    """Lines of at least ``least`` characters, trimmed of spaces (Unicode's Zs; tabs stay)."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)))  # a plain F.trim would take the line's place for what to trim
    return F.array_join(F.filter(lines, lambda line: F.length(line) >= least), "\n")
