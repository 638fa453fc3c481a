"""Main text and lines of web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.legal import strip_metadata

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "title"}
_BLOCKS = {"h3", "h4", "p", "div"}


class _Walk(HTMLParser):
    """Keeps the open tags; an end tag closes what was left open inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []

    def inside(self, tags: set[str]) -> bool:
        return any(tag in tags for tag, _ in self.open)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = next((value or "" for key, value in attrs if key == "class"), "")
        self.begin(tag)
        if tag not in _VOID:
            self.open.append((tag, classes))

    def handle_endtag(self, tag: str) -> None:
        if any(tag == t for t, _ in self.open):
            self.end(tag)
            while self.open.pop()[0] != tag:
                pass

    def begin(self, tag: str) -> None: ...

    def end(self, tag: str) -> None: ...


class _Main(_Walk):
    """Text by the container that it stands in."""

    def __init__(self) -> None:
        super().__init__()
        self.parts: dict[str, list[str]] = {"card": [], "main": [], "body": [], "page": []}

    def add(self, text: str) -> None:
        for kind, parts in self.parts.items():
            if kind == "page" or any(tag == kind or (kind == "card" and tag == "div" and "card" in c.split()) for tag, c in self.open):
                parts.append(text)

    def begin(self, tag: str) -> None:
        self.add({"p": "\n", "br": "\n", "li": "\n- ", "tr": "\n- "}.get(tag, " "))

    def end(self, tag: str) -> None:
        self.add(" ")

    def handle_data(self, data: str) -> None:
        if not self.inside(_SILENT | _HEADINGS):
            self.add(data)


class _Lines(_Walk):
    """Runs of text between the borders of blocks, inside divisions of a class (the whole page without a class)."""

    def __init__(self, body_class: str | None) -> None:
        super().__init__()
        self.body_class, self.lines, self.run = body_class, [], ""

    def flush(self) -> None:
        text = self.run.strip()
        if text:
            block = next((tag for tag, _ in reversed(self.open) if tag in _BLOCKS), "div")
            self.lines.append({"tag": block, "text": text, "pos": len(self.lines)})
        self.run = ""

    def begin(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()

    end = begin

    def handle_data(self, data: str) -> None:
        wanted = self.body_class is None or any(tag == "div" and self.body_class in c.split() for tag, c in self.open)
        if wanted and not self.inside(_SILENT):
            self.run += data


def _main_text(html: str | None) -> str | None:
    if html is None:
        return None
    walk = _Main()
    walk.feed(html)
    walk.close()
    return next(("".join(p) for p in walk.parts.values() if "".join(p).strip()), "")


def _lines(html: str | None, body_class: str | None) -> list[dict]:
    walk = _Lines(body_class)
    walk.feed(html or "")
    walk.close()
    walk.flush()
    return walk.lines


def main_text(html: Column) -> Column:
    """The text of a page's card, else its main part, else its body, in one line without publication notes.

    Scripts, styles and headings are left out; entries of lists and rows of tables start with "- ".
    Text that stands directly in a paragraph counts. Null stays null.
    """

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([_main_text(p) for p in pages], dtype=object)

    return strip_metadata(text(html))


def page_lines(html: Column, body_class: str | None = None) -> Column:
    """array of (tag, text, pos): the lines of a page's blocks in order; null gives none."""

    @F.pandas_udf("array<struct<tag:string,text:string,pos:int>>")
    def lines(pages: pd.Series) -> pd.Series:
        return pd.Series([_lines(p, body_class) for p in pages], dtype=object)

    return lines(html)
