"""Token counts at every prefix of a text, by dynamic programming.

For each prefix of a piece of text the table keeps its last token and its token count. The last
token of a prefix is the longest token ending there that is compatible with the last token of
what remains before it: the merges of the two together give just the two. So one pass gives the
exact count of every prefix, and questions like "how many tokens are the first n characters" or
"how much fits into a budget" are look-ups.

Merges never cross the pieces of the split, so counts add up over pieces; a piece's own table is
made once and kept. Where a prefix ends within white space before a word its split differs from
the whole text's, and that place is corrected.
"""

from __future__ import annotations

import sys
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.bpe_text import SPACE_RUN, SPLIT, TwoAgeCache, load_json, space_parts
from lexmill.llm.common import text_or_empty


class PrefixCounter:
    """Exact counts at every prefix for one vocabulary."""

    def __init__(self, path: str):
        self.vocab, merges, self.added = load_json(path)
        # Finds all tokens that end at a place in one pass over the bytes (a letter for each byte), the longest first.
        self.endings = ahocorasick.Automaton()
        for token, number in self.vocab.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), number))
        self.endings.make_automaton()
        self.parts = {self.vocab[a + b]: (self.vocab[a], self.vocab[b]) for a, b in merges}
        self.made = {pair: token for token, pair in self.parts.items()}
        # When a token comes into being: single bytes first, then by the rank of its merge.
        self.age = {token: -1 for token in self.vocab.values()} | {self.vocab[a + b]: rank for (a, b), rank in merges.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.table = TwoAgeCache(self._piece_table)
        self.part = TwoAgeCache(self._part_total)
        self.total = TwoAgeCache(lambda piece: int.from_bytes(self.table[piece][-4:], sys.byteorder))

    def _part_total(self, part: str) -> int:
        """Tokens of a space and what follows it up to the next one."""
        if part.isascii() and part.isalpha():  # one piece
            return self.total[" " + part]
        return sum(map(self.total.__getitem__, SPLIT.findall(" " + part)))

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging ``left`` and ``right`` side by side gives just the two.

        Their merges are undone youngest first; a merge across the border that is older than
        what was undone so far would have come before it.
        """
        age, parts, made = self.age, self.parts, self.made
        bound_left = bound_right = 1 << 60  # a crossing merge counts if older than the youngest undone merge
        while True:
            crossing = made.get((left, right))
            # On equal age the merge further left comes first, so a crossing pair wins over the right side's own.
            if crossing is not None and age[crossing] < bound_left and age[crossing] <= bound_right:
                return False
            if age[left] < 0 and age[right] < 0:
                return True
            if age[left] > age[right]:
                bound_left, left = age[left], parts[left][1]
            else:
                bound_right, right = age[right], parts[right][0]

    def _follows(self, before: int, token: int) -> bool:
        key = (before, token)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 500_000:
                self.compatible.clear()
            known = self.compatible[key] = self._stays(before, token)
        return known

    def byte_counts(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of one piece, from the empty one on."""
        last, count = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        known, follows, done = self.compatible, self._follows, -1
        for at, (size, token) in self.endings.iter(piece.decode("latin-1")):
            if at == done:
                continue
            start = at + 1 - size
            fits = start == 0 or known.get((last[start], token))
            if fits is None:
                fits = follows(last[start], token)
            if fits:
                last[at + 1], count[at + 1], done = token, count[start] + 1, at
        return count

    def _piece_table(self, piece: str) -> bytes:
        """Counts after each character of a piece, as unsigned 32-bit integers."""
        raw = piece.encode("utf-8", "surrogatepass")
        counts = self.byte_counts(raw)
        if len(raw) == len(piece):
            ends = counts[1:]
        else:
            ends, at = [], 0
            for c in piece:
                at += len(c.encode("utf-8", "surrogatepass"))
                ends.append(counts[at])
        if piece[0] == "'" and len(piece) > 1:  # an unfinished contraction is split in another way
            for n in range(1, len(piece)):
                ends[n - 1] = sum(self.byte_counts(p.encode())[-1] for p in SPLIT.findall(piece[:n]))
        return array("I", ends).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        pieces = SPLIT.findall(text)
        tables = [self.table[p] for p in pieces]
        relative = np.frombuffer(b"".join(tables), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        totals = np.cumsum(relative[ends - 1]) if len(pieces) else ends
        counts = np.zeros(len(text) + 1, np.int64)
        counts[1:] = relative + np.repeat(totals - relative[ends - 1] if len(pieces) else totals, lengths)
        for run in SPACE_RUN.finditer(text):
            whole = np.frombuffer(self.table[run[0]], np.uint32)
            counts[run.end()] = counts[run.start()] + int(whole[-1])
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Token count of every prefix ``text[:n]``, n from 0 to its length; added tokens count one."""
        marks = [m for m in self.added if m in text]
        if not marks:
            return self._plain(text)
        mark = marks[0]  # byte-level vocabularies of this kind have one
        out, at = [np.zeros(1, np.int64)], 0
        while True:
            found = text.find(mark, at)
            segment = text[at : found if found >= 0 else len(text)]
            base = out[-1][-1]
            own = base + self._plain(segment)
            out.append(own[1:])
            if found < 0:
                return np.concatenate(out)
            # Inside an unfinished mark the prefix is ordinary text after the last piece boundary.
            pieces = SPLIT.findall(segment)
            tail = pieces[-1] if pieces else ""
            before = own[-1] - (np.frombuffer(self.table[tail], np.uint32)[-1] if tail else 0)
            partial = before + self._plain(tail + mark[:-1])[len(tail) + 1 :]
            out.append(np.append(partial, own[-1] + 1))
            at = found + len(mark)


    def summary(self, text: str, budgets: Sequence[int]) -> tuple[int, ...]:
        """Tokens of the whole text; for each budget the characters of the longest prefix within it."""
        if any(m in text for m in self.added):
            counts = self.counts(text)
            return int(counts[-1]), *(int(np.flatnonzero(counts <= b)[-1]) for b in budgets)
        parts, joint = space_parts(text), " "
        if parts is None:
            parts, joint = SPLIT.findall(text), ""
            counts = list(map(self.total.__getitem__, parts))
        else:
            counts = list(map(self.part.__getitem__, parts))
            counts[0] = sum(map(self.total.__getitem__, SPLIT.findall(parts[0])))
        whole = sum(counts)
        fits = []
        for budget in budgets:
            if whole <= budget:
                fits.append(len(text))
                continue
            # Every prefix past a part has more tokens than that part's end, but for white space
            # before a word; so only the text up to three parts past the budget can hold the cut.
            past = bisect_right(list(accumulate(counts[: budget + 1])), budget)
            head = self._plain(joint.join(parts[: past + 4]))
            fits.append(int(np.flatnonzero(head <= budget)[-1]))
        return whole, *fits


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_prefixes(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", budgets: Sequence[int] = (512,), keep_prefixes: bool = False
) -> DataFrame:
    """Per row: id, n_bytes, n_chars, n_tokens, ``fits_<budget>`` for each budget.

    ``fits_b`` is the number of characters of the longest prefix that has at most b tokens.
    ``keep_prefixes`` adds ``prefix_tokens``: array of counts for prefixes of 0, 1, ... characters
    (see :func:`tokens_of_prefix`, :func:`longest_within`). Whole texts are read; a null text is
    an empty one with 0 tokens; rows map one to one, so repeated rows, ties and empty tables need
    no rule; other columns of ``docs`` are not read.
    """
    fields = [T.StructField("_id", docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_chars", "n_tokens", *(f"fits_{b}" for b in budgets))]
    if keep_prefixes:
        fields.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(tokenizer_path)
        for batch in batches:
            step = max(1, min(batch.num_rows, int(4_000_000 * batch.num_rows / max(1, batch.nbytes))))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                texts = part.column(1).to_pylist()
                answers = [table.summary(text, budgets) for text in texts]
                columns = [part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pc.utf8_length(part.column(1)).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*answers))]
                if keep_prefixes:
                    columns.append(pa.array([table.counts(text).astype(np.int32) for text in texts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    counted = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, schema)
    return counted.withColumnRenamed("_id", id_col)


def tokens_of_prefix(prefix_tokens: Column, n_chars: Column | int) -> Column:
    """Tokens of the first ``n_chars`` characters, by look-up."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.get(prefix_tokens, F.least(n, F.size(prefix_tokens) - 1))


def longest_within(prefix_tokens: Column, budget: int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, by look-up."""
    return F.size(prefix_tokens) - 1 - F.array_position(F.transform(F.reverse(prefix_tokens), lambda n: n <= budget), True).cast("int") + 1
