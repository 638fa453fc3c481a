"""More text functions on columns: composed texts, numbers, metadata, changes, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import MONTHS, clean_html_text

#: Words that tell how a court uses an article, in the order tried; fixed values.
REFERENCE_WORDS = (
    ("applied", ("применил", "применить", "применяя", "согласно")),
    ("interpreted", ("разъяснил", "толкование", "толкует", "суд считает")),
    ("distinguished", ("отличается", "не применяется", "иное")),
)
#: Publication notes that are not part of a text; fixed values.
METADATA = (r"Номер опубликования:\s*\d+", r"Дата опубликования:\s*[\d.]+", r"Страница\s+\d+\s+из\s+\d+")


def compose_full_text(complex_name: Column, name: Column, title: Column) -> Column:
    """The parts that say something new, joined by blank lines; null counts as empty."""
    first, second, third = F.coalesce(complex_name, F.lit("")), F.coalesce(name, F.lit("")), clean_html_text(title)
    second = F.when(second != first, second).otherwise("")
    known = F.trim(F.concat_ws(" ", first, second))
    parts = F.array(first, second, F.when(known.contains(third), "").otherwise(third))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def document_urls(eo_number: Column, base: str) -> Column:
    return F.struct(F.concat(F.lit(f"{base}/file/pdf?eoNumber="), eo_number).alias("pdf"), F.concat(F.lit(f"{base}/Document/View/"), eo_number).alias("view"))


def case_id(url: Column) -> Column:
    """The case number in a url, else the first 8 digits of the url's md5."""
    patterns = (r"[?&]case_id=(\d+)", r"/(?:sf-|ms/|gs/|vs/)(\d+)", r"[?&]id_4=(\d+)")
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.substring(F.md5(url), 1, 8))


def eo_number(nd: Column, bank_id: Column) -> Column:
    """``nd`` if there is one, else a number made of the bank's id."""
    return F.coalesce(F.nullif(nd, F.lit("")), F.concat(F.lit("KREMLIN_"), bank_id.cast("string")))


def article_less(a: Column, b: Column) -> Column:
    """Whether article ``a`` (as parts) comes before ``b``. No total order: not a sort key.

    Different bases with any insertion compare as decimals, else base, insertion and subdivision
    count in turn, none before any.
    """
    value = lambda p: F.concat_ws(".", p["base"].cast("string"), p["insertion"].cast("string")).cast("double")
    decimal = (a["base"] != b["base"]) & (a["insertion"].isNotNull() | b["insertion"].isNotNull())
    key = lambda p: F.struct(p["base"], F.coalesce(p["insertion"], F.lit(-1)), F.coalesce(p["subdivision"], F.lit(-1)))
    return F.when(decimal, value(a) < value(b)).otherwise(key(a) < key(b))


def valid_reference_number(number: Column) -> Column:
    """Dot-separated digits, parts after the first at most 99."""
    parts = F.split(number, r"\.")
    return F.forall(parts, lambda p: p.rlike("^[0-9]+$")) & F.forall(F.slice(parts, 2, 1000), lambda p: F.coalesce(p.try_cast("int"), F.lit(100)) <= 99)


def amendment_changes(text: Column) -> Column:
    """array of (type, article, old, new): replacements first, then additions."""
    low = F.lower(text)
    replaced = r'(?:слово|фразу|абзац|пункт)\s+["«]([^"»]+)["»]\s+заменить\s+["«]([^"»]+)["»]'
    added = r"дополнить\s+стать(?:е|ей)\s+(\d+)[^\n]*?:\s*([^.\n]+)"
    every = lambda p, i: F.regexp_extract_all(low, F.lit(p), F.lit(i))
    none = F.lit(None).cast("string")
    row = lambda kind, article, old, new: F.struct(F.lit(kind).alias("type"), article.alias("article"), old.alias("old"), new.alias("new"))
    first = F.zip_with(every(replaced, 1), every(replaced, 2), lambda old, new: row("modification", none, old, new))
    return F.concat(first, F.zip_with(every(added, 1), every(added, 2), lambda article, new: row("addition", article, none, new)))


def effective_date(text: Column) -> Column:
    """The first date of three notes; the month of the third may be a name. Invalid dates are null."""
    numeric = [rf"{p}(\d+)\.(\d+)\.(\d{{4}})" for p in (r"Федеральный\s+закон\s+от\s+", r"Дата\s+опубликования:\s*")]
    named = rf"с\s+(\d+)\s+({'|'.join(MONTHS)})\s+(\d{{4}})\s+года"
    day = lambda p, month: F.try_to_date(F.concat_ws("-", F.regexp_extract(text, p, 3), F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(text, p, 1), 2, "0")), "yyyy-MM-dd")
    last = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, named, 2)).cast("string")
    choice = F.when(text.rlike(numeric[0]), day(numeric[0], F.regexp_extract(text, numeric[0], 2)))
    return choice.when(text.rlike(numeric[1]), day(numeric[1], F.regexp_extract(text, numeric[1], 2))).when(text.rlike(named), day(named, last))


def strip_metadata(text: Column) -> Column:
    for pattern in METADATA:
        text = F.regexp_replace(text, f"(?iu){pattern}", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def classify_reference(context: Column) -> Column:
    """applied, interpreted or distinguished by the first list with a hit, else cited."""
    low, kind = F.lower(context), F.lit("cited")
    for name, words in reversed(REFERENCE_WORDS):
        kind = F.when(low.rlike("|".join(words)), name).otherwise(kind)
    return kind


def question_answer(text: Column, most_question: int = 500, most_answer: int = 5000) -> Column:
    """(question, answer) after their marks, cut with dots; null where a mark is missing."""
    pattern = r"(?s)(?:Вопрос|Question)[:\s]+(.*?)\s*(?:Ответ|Answer)[:\s]+(.*)"
    cut = lambda c, most: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
    part = lambda i: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i))
    return F.struct(cut(part(1), most_question).alias("question"), cut(part(2), most_answer).alias("answer"))


def repair_mojibake(text: Column) -> Column:
    """Text of characters up to U+00FF is read as windows-1251; what that page lacks leaves it unchanged."""
    pairs = [(chr(b), bytes([b]).decode("cp1251")) for b in range(128, 256) if b != 0x98]
    repaired = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.when(text.rlike("^[\\x00-\\x97\\x99-\\xff]*$"), repaired).otherwise(text)


def links(html: Column) -> Column:
    """array of (href, label) of plain links, in order."""
    pattern = r'<a href="([^"]*)">([^<]*)</a>'
    every = lambda i: F.regexp_extract_all(html, F.lit(pattern), F.lit(i))
    return F.zip_with(every(1), every(2), lambda h, t: F.struct(h.alias("href"), t.alias("label")))


def letter_validity(html: Column) -> Column:
    """What the tooltip says of a letter; null if it says nothing."""
    said = F.trim(F.regexp_extract(html, r'class="tooltip[^"]*"[^>]*>([^<]*)<', 1))
    return F.when(said == "Актуально", True).when(said == "Не актуально", False)


def download_urls(html: Column) -> Column:
    """Map of pdf and docx to their links."""
    every = lambda ext: F.regexp_extract_all(html, F.lit(rf'href="([^"]+\.{ext})"'), F.lit(1))
    return F.create_map(F.lit("pdf"), every("pdf"), F.lit("docx"), every("docx"))


def replace_first(text: Column, old: str, new: str) -> Column:
    """``text`` with the first ``old`` replaced; unchanged without one."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), F.lit(new), text.substr(at + len(old), F.length(text)))).otherwise(text)


def name_uuid5(name: Column, namespace_hex: str) -> Column:
    """The version 5 identifier of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), digit + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
