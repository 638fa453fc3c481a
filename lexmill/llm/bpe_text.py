"""Byte-level BPE vocabularies and the split of text before the merges."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import regex

#: Unicode white space as the tokenizer libraries take it (Python's own class has more characters).
_S = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The split of the rank files, with white space spelt out; groups nothing.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
SPLIT = regex.compile(PATTERN)
#: A whole run of two or more white space characters before another character; each run is tried once, from its start.
SPACE_RUN = regex.compile(rf"(?<![{_S}])[{_S}]{{2,}}+(?=[^{_S}])")

#: White space beside a space: there a space is no safe place to cut.
_UNSAFE = regex.compile(rf"\x20[{_S}]|[{_S}]\x20")


def space_parts(text: str) -> list[str] | None:
    """The text cut at its spaces, if every space is a safe boundary; a space starts each later part.

    A space between characters that are no white space always starts a match of the split.
    """
    return None if _UNSAFE.search(text) else text.split(" ")


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def load_json(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], dict[str, int]]:
    """Tokens with ids, merges with ranks, and added tokens with ids, of a tokenizers .json file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return vocab, {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}, added


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a .tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class TwoAgeCache(dict):
    """A dict of bounded size: when the young half is full it becomes the old half."""

    def __init__(self, make, size: int = 300_000):
        super().__init__()
        self.make, self.half, self.old = make, size // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
