"""Numbers of articles that lost their dots on the way, put right by their neighbours."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First and last article of each code; fixed values.
RANGES = {
    "KONST_RF": (1, 137),
    "GK_RF": (1, 453),
    "GK_RF_2": (454, 1109),
    "GK_RF_3": (1110, 1224),
    "GK_RF_4": (1225, 1551),
    "UK_RF": (1, 361),
    "TK_RF": (1, 424),
    "NK_RF": (1, 142),
    "NK_RF_2": (143, 432),
    "KoAP_RF": (1, 890),
    "SK_RF": (1, 170),
    "ZhK_RF": (1, 165),
    "ZK_RF": (1, 85),
    "APK_RF": (1, 418),
    "GPK_RF": (1, 494),
    "UPK_RF": (1, 553),
    "BK_RF": (1, 307),
    "GRK_RF": (1, 120),
    "UIK_RF": (1, 200),
    "VZK_RF": (1, 150),
    "VDK_RF": (1, 100),
    "LK_RF": (1, 120),
    "KAS_RF": (1, 350),
}
#: Where dots may go into a number of so many digits, likeliest first; fixed values.
CUTS = {2: [(1,)], 3: [(2,), (1, 2)], 4: [(2, 3), (2,), (3,)], 5: [(2, 3), (3, 4), (3,)], 6: [(2, 4), (3, 4), (4,)]}


def _parts(number: str) -> tuple[int, int, int] | None:
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?(?:-(\d+))?", number)
    return (int(m[1]), int(m[2] or -1), int(m[3] or -1)) if m else None


def _less(a: str | None, b: str | None) -> bool:
    """By decimals if bases differ and one has an insertion, else part by part; false if one is no number."""
    x, y = _parts(a or ""), _parts(b or "")
    if not x or not y:
        return False
    if x[0] != y[0] and max(x[1], y[1]) >= 0:
        decimal = lambda p: float(f"{p[0]}.{p[1]}" if p[1] >= 0 else p[0])
        return decimal(x) < decimal(y)
    return x < y


def _dotted(number: str) -> list[str]:
    """The number with dots at every likely place, then as it is."""
    base, dash, tail = number.partition("-")
    cuts = [] if "." in number or not base.isdigit() or (len(base) == 2 and base[0] == "0") else CUTS.get(len(base), [])
    return [".".join(base[a:b] for a, b in itertools.pairwise((0, *cut, len(base)))) + dash + tail for cut in cuts] + [number]


def _by_neighbours(number: str, before: str, after: str, limits: tuple[int, int] | None) -> str:
    fits = lambda n: _less(before, n) and _less(n, after)
    joined = number.replace(".", "")
    if number.count(".") > 1 and joined.isdigit() and 2 < len(joined) < 7:
        number = joined
    base, dash, tail = number.partition("-")
    if dash and "." in number:
        return number
    first = before.split(".")[0]
    if dash and base.isdigit() and len(base) > 2:
        if before.isdigit() and int(before) == int(base) and limits and limits[0] <= int(base) <= limits[1] * 10:
            return number
        if "." in before and first.isdigit() and re.fullmatch(rf"{first}\d{{1,2}}", base):
            return f"{before.split('-')[0]}-{tail}"
        low, high = ((int(m[0]) if (m := re.match(r"\d+(?=[.\-]|$)", n)) else 0) for n in (before, after))
        inside = [c for c in _dotted(base) if low <= int(c.split(".")[0]) <= high]
        if inside:
            return next((c for c in inside if "." in before and c.split(".")[0] == first), inside[0]) + f"-{tail}"
    if fits(number):
        return number
    tries = [f"{first}.{number[len(first) :]}"] if number.isdigit() and len(number) > max(2, len(first)) and number.startswith(first) else []
    tries += [f"{number[:-n]}.{number[-n:]}" for n in (1, 2) if len(number) > n]
    return next((t for t in tries if fits(t)), number)


def correct_number(raw: str, before: str | None, after: str | None, source: str = "pravo", limits: tuple[int, int] | None = None, known: frozenset[str] = frozenset()) -> tuple[str, bool]:
    """(number, suspicious) from the corrected number before and the raw number after.

    In order: dots that only show a hierarchy (pravo), the neighbours, the ``known`` numbers of the
    code, its ``limits``. Suspicious is what fits in no way.
    """
    number, steps = raw, raw.split(".")
    if source == "pravo" and len(steps) > 2:
        joined = "".join(steps)
        if len(steps) == 3 and all(s.isdigit() for s in (*steps[:2], steps[2] if "-" not in steps[2] else "0")):
            number = f"{steps[0]}{steps[1]}.{steps[2]}"
        elif len(steps) > 3 and joined.isdigit() and 2 < len(joined) < 7:
            number = joined
    if "-" in number and "." in number:
        return number, False
    if before and after:
        moved = _by_neighbours(number, before, after, limits)
        if moved != raw:
            return moved, False
    if number.isdigit() and not (before and after and _less(before, number) and _less(number, after)):
        there = [c for c in _dotted(number) if c in known]
        if there:
            return max(there, key=lambda c: c.count(".")), False
    if not limits or "." in number:
        return number, False
    least, most = limits
    inside = lambda n: (p := _parts(n)) is not None and least <= p[0] <= most
    base, dash, tail = number.partition("-")
    if dash and base.isdigit() and len(base) in (4, 5):
        found = next((c for c in _dotted(base) if inside(c)), None)
        if found:
            return f"{found}-{tail}", False
    if inside(number):
        return number, False
    valid = [c for c in _dotted(number) if inside(c)]
    later = [c for c in valid if _less(before, c)]
    if later:
        return later[0], False
    return (min(valid, key=lambda c: abs(_parts(c)[0] - (least + most) / 2)), False) if valid else (number, True)


def reconcile_numbers(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """(code_id, number_source, number_reference, is_verified, verification_notes): a row for each number of the reference.

    ``ours`` has (code_id, article_number), ``reference`` those and title. A reference number with two
    dots is ours without the second, if its middle part has one character; with more or other dots it
    is none of ours; any other is itself. A number that we lack has a null source.
    """
    number, parts = F.col("article_number"), F.split("article_number", r"\.")
    part = lambda i: F.get(parts, F.lit(i))
    form = F.when(F.size(parts) < 3, number).when((F.size(parts) == 3) & (F.length(part(1)) == 1), F.concat(part(0), F.lit("."), part(1), part(2)))
    asked = reference.groupBy("code_id", "article_number").agg(F.min("title").alias("title")).select("code_id", number.alias("number_reference"), form.alias("_form"), "title")
    held = ours.select("code_id", number.alias("_form"), number.alias("number_source")).distinct()
    found = asked.join(held, ["code_id", "_form"], "left")
    known = F.col("number_source").isNotNull()
    note = F.when(known, F.concat(F.lit("Auto-matched: "), "number_source", F.lit(" -> "), "number_reference")).otherwise(F.concat(F.lit("Missing from official sources - Title: "), F.coalesce("title", F.lit("Unknown title"))))
    return found.select("code_id", "number_source", "number_reference", known.alias("is_verified"), note.alias("verification_notes"))


def format_differences(reconciled: DataFrame) -> DataFrame:
    """The pairs that are written in different ways."""
    return reconciled.filter("number_source <> number_reference")


def merge_reference(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored rows stay as they are; of ``found`` come those whose code and numbers, nulls included, are not stored."""
    keys = ["code_id", "number_source", "number_reference"]
    there = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return stored.unionByName(found.join(there, same[0] & same[1] & same[2], "left_anti"))


def correct_article_numbers(articles: DataFrame, order: list[str], ranges: Mapping[str, tuple[int, int]] = RANGES, known: DataFrame | None = None) -> DataFrame:
    """``articles`` (code_id, source, article_number, article_title, and ``order``) with the number corrected, the title
    made again from it, and raw_number and suspicious added.

    Each number needs the corrected one before it, so a code of a source is read in order; a task
    streams its sorted rows and holds two of them. Null numbers stay null and are no neighbours.
    ``known`` has (code_id, article_number), the reference numbers of codes: they are sorted in before
    the articles of their code, and a task holds those of one code at a time.
    """
    keys = ["code_id", "source"]
    picked = articles.select(*articles.columns, F.col("article_number").alias("raw_number"), F.lit(False).alias("suspicious"))
    names, schema = picked.columns, picked.schema
    at = {c: names.index(c) for c in (*keys, "article_number", "article_title", "suspicious")}
    picked = picked.withColumn("_reference", F.lit(False))
    if known is not None:
        told = known.filter("article_number is not null").select("code_id", F.col("article_number").cast("string")).distinct()
        picked = picked.unionByName(told.withColumn("_reference", F.lit(True)), allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (list(r) for b in batches for r in b.astype(object).where(b.notna(), None).itertuples(index=False, name=None))
        out: list[list] = []
        there, code_there = set(), None
        for (code, reference, source), group in itertools.groupby(rows, key=lambda r: (r[at["code_id"]], r[-1], r[at["source"]])):
            if reference:
                there, code_there = {r[at["article_number"]] for r in group}, code
                continue
            before = None
            numbers = frozenset(there) if code == code_there else frozenset()
            for row, following in itertools.pairwise(itertools.chain(group, [None])):
                raw = row[at["article_number"]]
                if raw is not None:
                    after = following[at["article_number"]] if following else None
                    number, row[at["suspicious"]] = correct_number(raw, before, after, source or "", ranges.get(code), numbers)
                    title = row[at["article_title"]]
                    if title is not None and number != raw:
                        row[at["article_title"]] = re.sub(rf"^Статья\s+{re.escape(raw)}(?!\d)", f"Статья {number}", title)
                    row[at["article_number"]] = before = number
                out.append(row[:-1])
                if len(out) == 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    # Known numbers belong to all sources of a code, so then a code is dealt as one.
    dealt = picked.repartition(*keys) if known is None else picked.repartition("code_id")
    return dealt.sortWithinPartitions("code_id", F.desc("_reference"), "source", *order, "article_number").mapInPandas(run, schema)
