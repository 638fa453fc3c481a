"""Language identification by cross-parsing.

Labelled text of each language becomes a suffix automaton, which accepts just the substrings of
that text. A new text is parsed against it from left to right: each phrase is the longest match
that starts where the last one ended. The number of phrases times the logarithm of the training
length is the cross entropy that the language leaves (Ziv and Merhav); the language with the
fewest normalised phrases wins.

Texts are lower-cased, every run of characters that are no letters becomes one space, and the
automata read UTF-8 bytes, so that the tables stay narrow in any script. Long texts are parsed
in blocks; a block border ends a phrase in every language alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import text_or_empty

#: What is predicted for a text without a letter, or when nothing was learned.
UNDETERMINED = "und"
#: Bytes of a block: all lanes of a batch are about as long, whatever the texts.
_BLOCK = 1024
#: Bytes of text that are parsed side by side.
_BATCH_BYTES = 4_000_000
#: Ended phrases are counted above the bits of a table's address.
_COUNT_AT = 28
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class LanguageModel:
    """Training text of each language, in order of the names: all that is sent to the tasks."""

    samples: tuple[tuple[str, str], ...]


def _letter_mask() -> np.ndarray:
    """Whether a code point is a letter (Unicode category L)."""
    if not _letters:
        mask = np.zeros(0x110000, bool)
        mask[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _letters.append(mask)
    return _letters[0]


def letter_streams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all normalised texts one after the other, and where each ends.

    Words are parted by single spaces; a text with a letter may end with one.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letter_mask()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of a run of other characters, if a letter stands before it
    clean = np.where(letter, points, 32)[kept]
    width = 1 + (clean > 0x7F) + (clean > 0x7FF) + (clean > 0xFFFF)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(texts)))
    ends = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(kept))[ends]]
    return np.frombuffer(clean.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8), ends


class SuffixAutomaton:
    """The smallest automaton of all substrings of ``text``, as a table for many parses at once.

    A table entry is the address of the next state's row; where the match cannot go on, it is
    the state after the byte that starts the next phrase, with the phrases that end there
    counted from bit 28 on: one, or two if the byte itself does not occur in the training text.
    """

    def __init__(self, text: bytes):
        self.length = max(2, len(text))
        seen = sorted(set(text))
        self.code = np.full(256, len(seen), np.uint8)
        self.code[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        follow, link, size = [{}], [-1], [0]
        last = 0
        for c in self.code[np.frombuffer(text, np.uint8)].tolist():
            new = len(follow)
            follow.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    copy = len(follow)
                    follow.append(dict(follow[q]))
                    link.append(link[q])
                    size.append(size[p] + 1)
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        if len(follow) * self.width >> _COUNT_AT:
            raise ValueError("the training text of one language is too long")
        root = np.full(self.width, 1 << _COUNT_AT, np.int32)  # a byte of no language is a phrase of its own
        for c, target in follow[0].items():
            root[c] = target * self.width
        table = np.tile(root + (1 << _COUNT_AT), (len(follow), 1))
        table[0] = root
        rows = np.repeat(np.arange(len(follow)), [len(f) for f in follow])
        table[rows, [c for f in follow for c in f]] = np.asarray([t * self.width for f in follow for t in f.values()], np.int32)
        self.table = table.ravel()

    def phrases(self, stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each lane ``stream[start : start + length]``; lanes come longest first."""
        codes = self.code[stream]
        state = np.zeros(len(starts), np.int32)
        count = np.zeros(len(starts), np.int32)
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for step, n in enumerate(active.tolist()):
            found = self.table[state[:n] + codes[starts[:n] + step]]
            count[:n] += found >> _COUNT_AT
            state[:n] = found & ((1 << _COUNT_AT) - 1)
        return count + (state > 0)


class CrossParser:
    """The automata of all languages."""

    def __init__(self, model: LanguageModel):
        self.names = [name for name, _ in model.samples]
        self.automata = [SuffixAutomaton(letter_streams([sample])[0].tobytes()) for _, sample in model.samples]

    def identify(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        stream, ends = letter_streams(texts)
        begins = np.append(0, ends[:-1])
        blocks = -(-(ends - begins) // _BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        starts = begins[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * _BLOCK
        lengths = np.minimum(_BLOCK, ends[owner] - starts)
        order = np.argsort(-lengths, kind="stable")
        owner, starts, lengths = owner[order], starts[order], lengths[order]
        bits = np.stack([np.bincount(owner, a.phrases(stream, starts, lengths), len(texts)) * math.log2(a.length) for a in self.automata])
        best = bits.argmin(axis=0)
        score = 1 / np.exp2(bits.min(axis=0) - bits).sum(axis=0)
        known = ends > begins
        return [self.names[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0).tolist()


_parsers: dict[LanguageModel, CrossParser] = {}


def parser(model: LanguageModel) -> CrossParser:
    """The automata, built once for each worker process."""
    if model not in _parsers:
        _parsers.clear()
        _parsers[model] = CrossParser(model)
    return _parsers[model]


def fit_languages(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", passages: int = 96, passage_chars: int = 512) -> LanguageModel:
    """Training text of every language among the rows where ``train`` holds.

    Each row offers one passage of ``passage_chars`` characters, at a place that the hash of its
    text chooses; of each language at most ``passages`` of them are taken, the least by hash in
    each of as many buckets. So the sample is bounded, copies of a text count once, and a
    language with a third of all rows meets no task as a group: minima are taken before the
    exchange. Rows with a null language or text, or a passage without a letter, offer none; an
    empty table gives a model without languages.
    """
    text, drawn = F.col(text_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))
    place = F.pmod(F.shiftright(drawn, 20), F.greatest(F.length(text) - passage_chars + 1, F.lit(1))).cast("int") + 1
    offered = docs.filter(train & F.col(lang_col).isNotNull() & text.isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), drawn.alias("drawn"), F.substr(text, place, F.lit(passage_chars)).alias("passage")
    )
    taken = (
        offered.filter(F.col("passage").rlike(r"\p{L}"))
        .groupBy("lang", F.pmod("drawn", F.lit(passages)).alias("bucket"))
        .agg(F.min(F.struct("drawn", "passage")).alias("least"))
        .collect()  # at most ``passages`` rows a language
    )
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for row in taken:
        by_lang.setdefault(row["lang"], []).append((row["least"]["drawn"], row["least"]["passage"]))
    return LanguageModel(tuple((lang, "\n".join(p for _, p in sorted(own))) for lang, own in sorted(by_lang.items())))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score.

    The score is the winner's share of 2^-bits over all languages (0.5 or less on a tie, where
    the first name wins). A text that is null or has no letter is ``und`` with score 0, and so is
    every text if the model has no language. Whole texts of any length are parsed; rows map one
    to one, so repeated rows, null ids and empty tables need no rule; other columns are not read.
    """
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if not model.samples:
        return docs.select(F.col(id_col), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = parser(model)
        for batch in batches:
            step = max(1, int(_BATCH_BYTES * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                names, scores = languages.identify(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
