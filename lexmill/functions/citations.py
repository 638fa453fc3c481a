"""Citations of articles of codes in court texts, as columns."""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.legal import REFERENCE_WORDS
from lexmill.functions.text import let

#: Names of codes in lower case, in the order in which they are tried; fixed values.
CODE_NAMES = (
    ("гражданский кодекс российской федерации", "GK_RF"),
    ("гражданский кодекс", "GK_RF"),
    ("гк рф", "GK_RF"),
    ("гк российской федерации", "GK_RF"),
    ("уголовный кодекс российской федерации", "UK_RF"),
    ("уголовный кодекс", "UK_RF"),
    ("ук рф", "UK_RF"),
    ("ук российской федерации", "UK_RF"),
    ("трудовой кодекс российской федерации", "TK_RF"),
    ("трудовой кодекс", "TK_RF"),
    ("тк рф", "TK_RF"),
    ("тк российской федерации", "TK_RF"),
    ("налоговый кодекс российской федерации", "NK_RF"),
    ("налоговый кодекс", "NK_RF"),
    ("нк рф", "NK_RF"),
    ("нк российской федерации", "NK_RF"),
    ("кодекс об административных правонарушениях", "KoAP_RF"),
    ("коап рф", "KoAP_RF"),
    ("кодекс российской федерации об административных правонарушениях", "KoAP_RF"),
    ("семейный кодекс российской федерации", "SK_RF"),
    ("семейный кодекс", "SK_RF"),
    ("ск рф", "SK_RF"),
    ("жилищный кодекс российской федерации", "ZhK_RF"),
    ("жилищный кодекс", "ZhK_RF"),
    ("жк рф", "ZhK_RF"),
    ("земельный кодекс российской федерации", "ZK_RF"),
    ("земельный кодекс", "ZK_RF"),
    ("зк рф", "ZK_RF"),
    ("арбитражный процессуальный кодекс российской федерации", "APK_RF"),
    ("арбитражный процессуальный кодекс", "APK_RF"),
    ("апк рф", "APK_RF"),
    ("гражданский процессуальный кодекс российской федерации", "GPK_RF"),
    ("гражданский процессуальный кодекс", "GPK_RF"),
    ("гпк рф", "GPK_RF"),
    ("уголовно-процессуальный кодекс российской федерации", "UPK_RF"),
    ("уголовно-процессуальный кодекс", "UPK_RF"),
    ("упк рф", "UPK_RF"),
    ("бюджетный кодекс российской федерации", "BK_RF"),
    ("бюджетный кодекс", "BK_RF"),
    ("бк рф", "BK_RF"),
    ("градостроительный кодекс российской федерации", "GRK_RF"),
    ("градостроительный кодекс", "GRK_RF"),
    ("грк рф", "GRK_RF"),
    ("уголовно-исполнительный кодекс российской федерации", "UIK_RF"),
    ("уголовно-исполнительный кодекс", "UIK_RF"),
    ("уик рф", "UIK_RF"),
    ("воздушный кодекс российской федерации", "VZK_RF"),
    ("воздушный кодекс", "VZK_RF"),
    ("вк рф", "VDK_RF"),
    ("водный кодекс российской федерации", "VDK_RF"),
    ("водный кодекс", "VDK_RF"),
    ("лесной кодекс российской федерации", "LK_RF"),
    ("лесной кодекс", "LK_RF"),
    ("лк рф", "LK_RF"),
    ("кодекс административного судопроизводства российской федерации", "KAS_RF"),
    ("кодекс административного судопроизводства", "KAS_RF"),
    ("кас рф", "KAS_RF"),
    ("конституция российской федерации", "KONST_RF"),
    ("конституция рф", "KONST_RF"),
    ("конституция", "KONST_RF"),
)
_ARTICLE = r"(?:ст\.?\s*|статья\s+)(\d+(?:\.\d+)?)\s+"
_NAME = r"([А-ЯЁA-Zа-яёa-z][А-ЯЁA-Zа-яёa-z\s\.]*(?:РФ|России)?)"
#: Forms of a citation, in the order in which they are tried, with the groups of article and name; fixed values.
CITATION_PATTERNS = (
    (_ARTICLE + _NAME, 1, 2),
    (r"(?:п\.?\s*|пункт\s+)(\d+(?:\.\d+)?)\s*" + _ARTICLE + _NAME, 2, 3),
    (r"(?:ч\.?\s*|часть\s+)(\d+(?:\.\d+)?)\s*" + _ARTICLE + _NAME, 2, 3),
    (_ARTICLE + r"([А-ЯЁA-Z]{2,6})\s?", 1, 2),
)
#: Characters of context on either side of a citation.
CONTEXT = 100
_FORMS = [(re.compile(pattern, re.IGNORECASE), (article, name)) for pattern, article, name in CITATION_PATTERNS]
_SPACE = " \t\n\r\f\v "


def code_of_name(name: Column) -> Column:
    """The code of a name: exact, else the first known name that holds it or is held in it; null if none."""
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("code")) for n, c in CODE_NAMES])
    first = lambda test: F.get(F.filter(known, test), 0)["code"]
    return let(F.btrim(F.lower(name), F.lit(_SPACE)), lambda low: F.coalesce(first(lambda k: k["name"] == low), first(lambda k: low.contains(k["name"]) | k["name"].contains(low))))


@functools.lru_cache(100_000)
def _code(name: str) -> str | None:
    low = name.lower().strip()
    return dict(CODE_NAMES).get(low) or next((code for known, code in CODE_NAMES if known in low or low in known), None)


def _kind(context: str) -> str:
    low = context.lower()
    return next((kind for kind, words in REFERENCE_WORDS if any(w in low for w in words)), "cited")


def _cited(text: str) -> list[tuple[str, str, str, int, str]]:
    """(article, code, context, position, kind) of one text."""
    found: dict[tuple[str, str], tuple[str, str, str, int, str]] = {}
    for form, (article, name) in _FORMS:
        for m in form.finditer(text):
            key = (_code(m[name]), m[article])
            if key[0] and key not in found:
                around = text[max(0, m.start() - CONTEXT) : m.end() + CONTEXT].strip()
                found[key] = (key[1], key[0], around, m.start(), _kind(around))
    return list(found.values())


_CITATION = [("article", pa.string()), ("code", pa.string()), ("context", pa.string()), ("position", pa.int32()), ("kind", pa.string())]


def citations(text: Column) -> Column:
    """array of (article, code, context, position, kind): the first of each (code, article) by form and place.

    Names that resolve to no code are skipped. ``position`` counts characters from 0; the kind is told
    by the context. Null and empty texts give an empty array. The matches run in Arrow batches whose
    result is built column by column: nested functions on columns took 37 s for 15,000 short texts.
    """

    @F.arrow_udf("array<struct<article:string,code:string,context:string,position:int,kind:string>>")
    def found(texts: pa.Array) -> pa.Array:
        lists = [_cited(t) if t else [] for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        columns = list(zip(*itertools.chain.from_iterable(lists))) or [()] * len(_CITATION)
        rows = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _CITATION)], names=[name for name, _ in _CITATION])
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    return found(text)


def cited_names(text: Column) -> Column:
    """The names as written after article numbers, of the first form."""
    return F.regexp_extract_all(text, F.lit(f"(?iUd){CITATION_PATTERNS[0][0]}"), F.lit(2))


def code_sql(name: str) -> str:
    """SQL of ``code_of_name``."""
    known = "[" + ", ".join(f"{{'n': '{n}', 'c': '{c}'}}" for n, c in CODE_NAMES) + "]"
    low = f"trim(lower({name}))"
    return f"coalesce(list_filter({known}, lambda k: k.n = {low})[1].c, list_filter({known}, lambda k: contains({low}, k.n) OR contains(k.n, {low}))[1].c)"


def citations_sql(source: str, key: str, text: str) -> str:
    """SQL of ``citations``, one row for each: (key, article, code, context, kind, position)."""
    forms = " UNION ALL ".join(
        f"""SELECT {key}, t, {no} AS form, unnest(range(1, len(m) + 1)) AS i, m, p, a, n FROM (SELECT {key}, coalesce({text}, '') AS t, regexp_extract_all(t, '(?i){pattern}') AS m,
 string_split_regex(t, '(?i){pattern}') AS p, regexp_extract_all(t, '(?i){pattern}', {article}) AS a, regexp_extract_all(t, '(?i){pattern}', {name}) AS n FROM {source}) f{no}"""
        for no, (pattern, article, name) in enumerate(CITATION_PATTERNS)
    )
    kinds = " ".join(f"WHEN regexp_matches(lower(context), '{'|'.join(words)}') THEN '{kind}'" for kind, words in REFERENCE_WORDS)
    return f"""SELECT {key}, article, code, context, CASE {kinds} ELSE 'cited' END AS kind, CAST(position AS INTEGER) AS position FROM (
 SELECT *, trim(substr(t, greatest(position - {CONTEXT}, 0) + 1, position + size + {CONTEXT} - greatest(position - {CONTEXT}, 0)), ' ' || chr(9) || chr(10) || chr(13)) AS context FROM (
 SELECT *, row_number() OVER (PARTITION BY {key}, code, article ORDER BY form, position) AS rk FROM (
 SELECT *, CAST(place AS BIGINT) AS position FROM (SELECT {key}, t, form, a[i] AS article, {code_sql('n[i]')} AS code, length(m[i]) AS size, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS place
 FROM ({forms}) e) z) r WHERE code IS NOT NULL) k WHERE rk = 1) c"""
