"""Patterns of a country as rows of a table: what tells codes, actions and a page's controls there.

A rule table has (country, purpose, place, pattern, value). It is configuration, written by people:
its rows are read once and become columns, so that each task compiles one pattern for a country's
whole list, which most texts do not match, and the single ones behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import content
from lexmill.functions import text as tx

RULES = "country string, purpose string, place int, pattern string, value string"
#: Purposes that the library itself asks for.
CODE, ACTION, EMBEDDED, STANDALONE = "code", "action", "embedded", "standalone"


@dataclass(frozen=True)
class RuleTable:
    """Rules by country and purpose, in order; countries are compared in lower case."""

    rules: dict[tuple[str, str], list[tuple[str, str | None]]] = field(default_factory=dict)

    def countries(self, purpose: str) -> list[str]:
        return sorted({c for c, p in self.rules if p == purpose})

    def patterns(self, country: str, purpose: str) -> tuple[str, ...]:
        return tuple(p for p, _ in self.rules.get((country, purpose), ()))

    def by_country(self, country: Column, purpose: str, made, otherwise: Column) -> Column:
        """``made(country's name)`` for rows of each country that has rules, ``otherwise`` for all others and for null."""
        chosen = F.when(F.lit(False), otherwise)
        for name in self.countries(purpose):
            chosen = chosen.when(F.lower(country) == name, made(name))
        return chosen.otherwise(otherwise)

    def first_value(self, text: Column, country: Column, purpose: str, otherwise: Column | None = None) -> Column:
        """The value of the country's first rule, by place, whose pattern the lower-cased text holds anywhere."""
        none = F.lit(None).cast("string") if otherwise is None else otherwise
        low = F.lower(F.coalesce(text, F.lit("")))

        def first(name: str) -> Column:
            rules = self.rules[name, purpose]
            found = F.when(~low.rlike(_any_of(p for p, _ in rules)), none)
            for pattern, value in rules:
                found = found.when(low.rlike(f"(?Ud){pattern}"), F.lit(value).cast("string"))
            return found.otherwise(none)

        return self.by_country(country, purpose, first, none)

    def all_values(self, text: Column, country: Column, purpose: str) -> Column:
        """The different values of the country's rules whose patterns the lower-cased text holds, in order."""
        low, nothing = F.lower(F.coalesce(text, F.lit(""))), F.array().cast("array<string>")

        def every(name: str) -> Column:
            values = list(dict.fromkeys(v for _, v in self.rules[name, purpose]))
            told = [F.when(low.rlike(_any_of(p for p, v in self.rules[name, purpose] if v == value)), F.lit(value)) for value in values]
            return F.array_compact(F.array(*told))

        return self.by_country(country, purpose, every, nothing)

    def code(self, title: Column, text: Column, country: Column) -> Column:
        """The code that title and text tell first by the country's rules, else UNKNOWN."""
        return self.first_value(F.concat_ws(" ", title, text), country, CODE, F.lit("UNKNOWN"))

    def action(self, title: Column, text: Column, country: Column) -> Column:
        """The one action that the country's rules find, mixed if several, modification if none."""
        found = self.all_values(F.concat_ws(" ", title, text), country, ACTION)
        return F.when(F.size(found) > 1, "mixed").otherwise(F.coalesce(F.get(found, 0), F.lit("modification")))

    def content_validity(self, text: Column, country: Column) -> Column:
        """(ok, reason) of a line by the controls of the country's pages; other countries know none."""
        judged = lambda name: content.content_validity(text, self.patterns(name, EMBEDDED), self.patterns(name, STANDALONE))
        chosen = F.when(F.lit(False), content.content_validity(text, (), ()))
        for name in sorted({*self.countries(EMBEDDED), *self.countries(STANDALONE)}):
            chosen = chosen.when(F.lower(country) == name, judged(name))
        return chosen.otherwise(content.content_validity(text, (), ()))


def _any_of(patterns: Iterable[str]) -> str:
    return "(?Ud)" + "|".join(f"(?:{p})" for p in patterns)


def read_rules(table: DataFrame, most: int = 10_000) -> RuleTable:
    """The rules of a table; at most ``most`` rows, more are refused and not cut off.

    Rules come by place, then pattern; repeated rows count once. Rows without a country, purpose or
    pattern are refused, and so is a pattern that is none: a rule that is silently lost would be missed late.
    """
    rows = table.select("country", "purpose", "place", "pattern", "value").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    found: dict[tuple[str, str], list[tuple[str, str | None]]] = {}
    for row in sorted(rows, key=lambda r: (r["place"] is None, r["place"] or 0, r["pattern"] or "")):
        if not (row["country"] and row["purpose"] and row["pattern"]):
            raise ValueError(f"a rule lacks its country, purpose or pattern: {row}")
        try:
            re.compile(row["pattern"])
        except re.error as fault:
            raise ValueError(f"no pattern: {row['pattern']}") from fault
        found.setdefault((row["country"].lower(), row["purpose"]), []).append((row["pattern"], row["value"]))
    return RuleTable(found)


def default_rules(spark: SparkSession, country: str = "ru") -> DataFrame:
    """The library's own patterns as such a table."""
    rows = [(country, CODE, i, phrase, code) for i, (code, phrases) in enumerate(tx.CODE_PHRASES) for phrase in phrases]
    rows += [(country, ACTION, i, pattern, kind) for i, (kind, patterns) in enumerate(tx.ACTION_PATTERNS.items()) for pattern in patterns]
    rows += [(country, purpose, i, pattern, None) for purpose, patterns in ((EMBEDDED, content.EMBEDDED), (STANDALONE, content.STANDALONE)) for i, pattern in enumerate(patterns)]
    return spark.createDataFrame(rows, RULES)
