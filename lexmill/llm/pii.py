"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

All of it is built-in SQL functions. The place of a match comes from cutting the text at the
matches: a match starts where the pieces and matches before it end, counted in code points.
Repetitions are possessive and a candidate may start only where the previous match ended or no
longer run could have started, so a long run of digits or letters is read once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import text_or_empty


@dataclass(frozen=True)
class Kind:
    """A kind of span: how it is proposed, confirmed and scored."""

    name: str
    pattern: str
    needs: str  # a pattern that a text must contain for the kind to be looked for at all
    base: bool
    prior: float
    context: str  # words nearby that raise the score


#: Patterns and context words, fixed values.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.85, "mail|contact|write to|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True, 0.6, "ip|host|server|address|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", True, 0.8, "card|visa|credit|pay|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True, 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", False, 0.9, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-", False, 0.3, "ssn|social security"),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)

#: Matches that are worked on together: arrays grow and texts are cut within a block.
_BLOCK = 256
_SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Luhn's sum over a string of digits is a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97_valid(value: Column) -> Column:
    """The check of international account numbers: the rearranged number is 1 modulo 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(bare(p)) <= 3, F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        digits = digits_of(value)
        return F.when(F.length(digits).between(16, 19), luhn_valid(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(value)).between(8, 15)
    if kind == "iban":
        return mod97_valid(value)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` worked out once; a lambda would work out what it refers to for every item."""
    return F.get(F.transform(F.array(value), body), 0)


def _in_blocks(items: Column, width: Callable[[Column], Column], work: Callable[[Column, Column], Column]) -> Column:
    """``work(block, first)`` over blocks of ``_BLOCK`` items, joined to one array.

    ``first`` is what ``width`` gives for the blocks before, added up; so work that appends to an
    array or cuts a text does so within a block, and its cost follows the number of items.
    """

    def joined(blocks: Column) -> Column:
        # Running sums of the widths: one append for each block.
        sums = F.aggregate(F.transform(blocks, width), F.array(F.lit(0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + w))
        return _let(sums, lambda known: F.flatten(F.transform(blocks, lambda block, b: work(block, F.get(known, b)))))

    return _let(items, lambda known: _let(_blocks(known), joined))


def _blocks(items: Column) -> Column:
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))
    return F.transform(numbers, lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))


def _spans_of(kind: Kind, text: Column, reach: int, accept: float) -> Column:
    matches, pieces = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    # The matches and the pieces between them; the last piece has no match.
    pairs = _let(pieces, lambda known: F.arrays_zip(known.alias("gap"), matches.alias("value"), F.slice(known, 2, F.size(known)).alias("next")))
    empty = F.from_json(F.lit("[]"), f"array<{_SPAN}>")
    length = lambda pair: F.length(pair["gap"]) + F.coalesce(F.length(pair["value"]), F.lit(0))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = acc["at"] + length(pair)
        around = F.lower(F.concat(F.right(pair["gap"], F.lit(reach)), pair["value"], F.substring(F.coalesce(pair["next"], F.lit("")), 1, reach)))
        near = around.rlike(rf"(?:^|[^a-z])(?:{kind.context})")
        score = F.when(near, F.least(F.lit(1.0), F.lit(kind.prior) + 0.3)).otherwise(F.lit(kind.prior))
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value"), score.alias("score"))
        good = F.when(pair["value"].isNull(), False).otherwise(_confirmed(kind.name, pair["value"]))
        if not kind.base:
            good = good & (score >= accept)
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = _in_blocks(
        pairs,
        lambda block: F.aggregate(block, F.lit(0), lambda total, pair: total + length(pair)),
        lambda block, first: F.aggregate(block, F.struct(first.alias("at"), empty.alias("out")), step, lambda acc: acc["out"]),
    )
    return F.when(text.rlike(kind.needs), found).otherwise(empty)


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans", reach: int = 40, accept: float = 0.5) -> DataFrame:
    """``docs`` plus ``spans_col``: array of (kind, start, end, value, score), by kind, then start.

    Starts and ends are code points from 0, the end exclusive. Kinds with ``base`` are reported
    whenever they are confirmed; the others need a score of ``accept`` after context: words
    within ``reach`` code points, up to the next match of the kind on either side. A null or empty
    text has no spans (an empty array). Rows map one to one, an empty table gives an empty
    one. Other columns pass through; one named like ``spans_col`` is replaced. The work follows
    the length of the text and the number of its matches.
    """
    text = text_or_empty(text_col)
    return docs.withColumn(spans_col, F.concat(*[_spans_of(kind, text, reach, accept) for kind in KINDS]))


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    Texts without spans, nulls included, are unchanged. Columns other than ``text_col`` pass, of
    any name.
    """
    spans_col = "_pii_found"
    while spans_col in docs.columns:
        spans_col += "_"
    found = find_pii(docs, text_col, spans_col, **options)
    ordered = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    last_end = lambda spans: F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))

    def filled(local: Column, spans: Column, first: Column) -> Column:
        """``local``, the text from ``first`` on, with kinds in the place of spans."""

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(local, acc["at"] - first + 1, s["start"] - acc["at"])
            parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["parts"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

        return F.aggregate(spans, F.struct(first.alias("at"), F.array().cast("array<string>").alias("parts")), step, lambda acc: F.array_join(acc["parts"], ""))

    def rebuilt(text: Column, blocks: Column) -> Column:
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, spans: F.array_append(acc, F.greatest(F.element_at(acc, -1), last_end(spans))))
        cut = lambda known, b: F.substring(text, F.get(known, b) + 1, F.get(known, b + 1) - F.get(known, b))
        parts = lambda known: F.transform(blocks, lambda spans, b: _let(cut(known, b), lambda local: filled(local, spans, F.get(known, b))))
        return _let(ends, lambda known: F.concat(F.array_join(parts(known), ""), F.substr(text, F.element_at(known, -1) + 1)))

    done = _let(text_or_empty(text_col), lambda text: _let(ordered, lambda spans: _let(_blocks(spans), lambda blocks: rebuilt(text, blocks))))
    return found.withColumn(text_col, F.when(F.size(spans_col) > 0, done).otherwise(F.col(text_col))).select(*docs.columns)
