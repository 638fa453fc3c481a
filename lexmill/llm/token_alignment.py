"""Alignment of two tokenizations of the same texts.

Each tokenization of a text is the sorted list of its tokens' end offsets in bytes. The shorter
list drives a galloping search into the longer one: doubling steps from the last place, then
bisection inside the last step. The common ends cut both tokenizations into groups; the ranks of
two neighbouring common ends give the range of tokens of either side that covers the same bytes.

Neither vocabulary has a token that crosses from a character into a space after it, so a text may
be cut at every space between two characters that are no white space, and what is known of a
word holds wherever it stands. Links are pairs of tokens that end together. How often a pair is
linked corpus-wide is counted from packed links; the counts of the most frequent pairs, as many
as a parameter says, go to the tasks, the rest meet their links in a join.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.bpe_codec import encode_text
from lexmill.llm.bpe_text import space_parts
from lexmill.llm.common import shared_table, text_or_empty
from lexmill.llm.packing import id_encoder

#: A space between two characters that are no white space.
_SAFE_SPACE = regex.compile(r"(?<=\S)\x20(?=\S)")
#: The space of piece vocabularies.
_MARK = "▁"
#: Longest word that is remembered, in characters, and how many words are until the older half goes.
_REMEMBERED, _WORDS_HELD = 64, 100_000
#: Characters that are encoded at once, where a word ends.
_CHUNK = 32_768
#: Numbers between two that gallop one after the other.
_STRIDE = 64
_BATCH_BYTES = 1_000_000
#: Pairs that a task counts before it sends them on.
_PAIRS_HELD = 1_000_000


def overlaps(left: Sequence[int], right: Sequence[int]) -> list[tuple[int, int]]:
    """For each left token, first and stop of the right tokens that share a byte with it."""
    found, begin = [], 0
    for end in left:
        first = bisect_left(right, begin + 1)
        found.append((first, bisect_left(right, end, first) + 1))
        begin = end
    return found


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Places in ``long`` of the first number not below each of ``short``; both ascend, ``short`` ends with ``long`` or before.

    Every 64th number is found by a galloping search from the place of the one before it; the
    others gallop from there, all at once: doubling steps, then bisection.
    """
    pivots, at = [], 0
    for value in short[::_STRIDE].tolist():
        step, n = 1, len(long)
        while at + step < n and long[at + step] < value:
            at += step
            step *= 2
        at += int(np.searchsorted(long[at : at + step], value))
        pivots.append(at)
    low = np.repeat(np.asarray(pivots, np.int64), _STRIDE)[: len(short)]
    last, step, moving = len(long) - 1, 1, np.flatnonzero(long[low] < short)
    high = low.copy()
    while len(moving):  # the answer is in (low, high] once long[high] is not below the number
        high[moving] = np.minimum(low[moving] + step, last)
        moving = moving[long[high[moving]] < short[moving]]
        low[moving] = high[moving]
        step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = long[middle] < short[open_]
        low[open_[below]] = middle[below]
        high[open_[~below]] = middle[~below]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


#: What is known of a word: tokens of A, tokens of B, groups, groups as text, links.
Aligned = tuple[int, int, int, bytes, bytes]
_NOTHING: Aligned = (0, 0, 0, b"", b"")


class TokenAligner:
    """Both vocabularies, and what is known of the words met so far."""

    def __init__(self, path_a: str, path_b: str):
        encoder = id_encoder(path_a)
        self.codec = encoder.codec
        size_a = self.codec.n_vocab
        self.bytes_a = [b"" if i in encoder.marks.values() else self.codec.decode_single_token_bytes(i) for i in range(size_a)]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.pieces.vocab_size()
        names = [self.pieces.id_to_piece(i) for i in range(self.size_b)]
        if any(_MARK in name.lstrip(_MARK) for name in names):
            raise ValueError("a piece may hold the mark of a space at its beginning only")
        self.bytes_b = [bytes([int(name[3:-1], 16)]) if self.pieces.is_byte(i) else name.replace(_MARK, " ").encode() for i, name in enumerate(names)]
        self.lengths_a, self.lengths_b = (np.asarray([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # Decimal digits of every id and a place for what follows it, filled up with zero bytes.
        most = max(size_a, self.size_b)
        self.digits = np.frombuffer(np.asarray([str(i).encode() for i in range(most)], f"S{len(str(most)) + 1}").tobytes(), np.uint8).reshape(most, -1)
        self.n_digits = np.asarray([len(str(i)) for i in range(most)])
        self.words: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def align(self, part: str) -> Aligned | None:
        """What is known of a space and ``part``; None if a vocabulary does not give its bytes back."""
        return self.align_words([part])[0] if part else _NOTHING

    def align_words(self, parts: list[str]) -> list[Aligned | None]:
        """The same for each of several words, read as one text with a space before each."""
        text = " ".join(parts)
        raw = (" " + text).encode("utf-8", "surrogatepass")
        a, b = self._encoded(parts)
        if self.codec.decode_bytes(a.tolist()) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return [None] if len(parts) == 1 else [known for part in parts for known in self.align_words([part])]
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        swap = len(ends_a) > len(ends_b)
        short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
        place = gallop(short, long)
        common = np.flatnonzero(long[place] == short)
        last_b, last_a = (common, place[common]) if swap else (place[common], common)
        links = (a[last_a] * self.size_b + b[last_b]).astype("<u4").tobytes()
        text_bytes, text_ends = self._written(a, b, last_a, last_b)
        # Words end with groups: the ranks of their ends say where.
        word_ends = np.cumsum(np.fromiter((len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts), np.int64, len(parts)))
        group = np.searchsorted(ends_a[last_a], word_ends) + 1
        ranks_a, ranks_b = np.append(-1, last_a)[group] + 1, np.append(-1, last_b)[group] + 1
        stops = text_ends[group - 1]
        known, before = [], (0, 0, 0, 0)
        for now in zip(ranks_a.tolist(), ranks_b.tolist(), group.tolist(), stops.tolist()):
            known.append((now[0] - before[0], now[1] - before[1], now[2] - before[2], text_bytes[before[3] : now[3] - 1], links[4 * before[2] : 4 * now[2]]))
            before = now
        return known

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B, read in runs of words; an overlong word is read by itself, cut where that is safe."""
        a, b, run, size = [], [], [], 0
        for i, part in enumerate(parts):
            run.append(part)
            size += len(part) + 1
            if size >= _CHUNK or i + 1 == len(parts):
                text = " ".join(run)
                a.append(encode_text(self.codec, " " + text, 2 * _CHUNK))
                b += self.pieces.encode(text)
                run, size = [], 0
        return np.concatenate(a).astype(np.int64), np.asarray(b, np.int64)

    def _written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as text, each followed by ``;``, and where each ends."""
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # A token stands after the tokens of its own side and those of the other side in earlier groups (B: in its own too).
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(sizes_a), sizes_b)
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        after[place_a[last_a]], after[place_b[last_b]] = ord("|"), ord(";")
        letters = self.digits[ids]
        letters[np.arange(len(ids)), self.n_digits[ids]] = after
        return letters[letters != 0].tobytes(), np.cumsum(self.n_digits[ids] + 1)[place_b[last_b]]

    def texts(self, texts: list[str]) -> list[Aligned]:
        """What is known of each whole text; zeros if it has no tokens."""
        split = [None if not t or _MARK in t else t.split(" ") if t[-1] != " " != t[0] and space_parts(t) is not None else _SAFE_SPACE.split(t) for t in texts]
        if len(self.words) > _WORDS_HELD:
            self.words, self.older = {}, self.words
        words, new = self.words, []
        for part in set(chain.from_iterable(p for p in split if p is not None)):
            if part not in words:
                if part in self.older:
                    words[part] = self.older[part]
                else:
                    new.append(part)
        edged = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]  # the space before the next word would not be safe
        plain = list(set(new).difference(edged))
        words.update(zip(plain, self.align_words(plain) if plain else []))
        words.update((p, self.align(p)) for p in edged)
        done = []
        for parts in split:
            found = None if parts is None else list(map(words.__getitem__, parts))
            if found is None or None in found:
                done.append(_NOTHING)
            else:
                n_a, n_b, n_groups, groups, links = zip(*found)
                done.append((sum(n_a), sum(n_b), sum(n_groups), b";".join(groups), b"".join(links)))
        for part in new:
            if len(part) > _REMEMBERED:
                del words[part]
        return done


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> TokenAligner:
    return TokenAligner(path_a, path_b)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups, links.

    A is a byte-level vocabulary of the tokenizers library and reads a space and the text, B one
    of sentencepiece, which adds that space. ``groups`` is ``a1,a2|b1;a3|b2``: ids between common
    ends. ``links`` packs one number a link, id of A times the size of B's vocabulary plus id of
    B, as little-endian unsigned 32-bit integers. A text that is null or empty, or that either
    vocabulary does not give back byte by byte, has no tokens: zeros and empty columns. Strings
    of special tokens are plain text. Whole texts of any length are read; rows map one to one, so
    repeated rows, null ids and empty tables need no rule; other columns are not read.
    """
    names = ["_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    kinds = [docs.schema[id_col].dataType, *[T.LongType()] * 4, T.StringType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            step = max(1, int(_BATCH_BYTES * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                n_a, n_b, n_groups, groups, links = zip(*both.texts(part.column(1).to_pylist()))
                counts = [pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_groups)]  # a group ends with its one link
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(groups, pa.binary()).cast(pa.string()), pa.array(links, pa.binary())], names=names)

    return docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def count_pairs(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether no pair of its B id has more.

    Tasks send sums, one row a pair, so that a frequent pair is no hot key; a B id meets at most
    one row for each id of A.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def summed() -> pa.RecordBatch:
            nonlocal held, total
            pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([c for _, c in held]), len(pairs)).astype(np.int64)
            held, total = [(pairs, counts)], len(pairs)
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            for links in batch.column(0).to_pylist():
                held.append((own := np.frombuffer(links, "<u4"), np.ones(len(own), np.int64)))
                total += len(own)
                if total > 4 * _PAIRS_HELD:
                    out = summed()
                    if total > _PAIRS_HELD:
                        held, total = [], 0
                        yield out
        if held:
            yield summed()

    pairs = aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = shared_table(pairs)
    id_b = (F.col("pair") % size_b).cast("int").alias("id_b")
    most = pairs.groupBy(id_b).agg(F.max("n").alias("most"))
    # One row for each id of B's vocabulary at most.
    return pairs.join(F.broadcast(most), F.col("pair") % size_b == F.col("id_b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, pairs: DataFrame, broadcast_pairs: int = 1 << 21) -> DataFrame:
    """``aligned`` with n_best (links whose pair is the best of its B id) and count_sum (of the counts over its links).

    ``aligned`` must be a written table. At most ``broadcast_pairs`` pairs, the most frequent
    ones, are sent to the tasks; links of all others go through a join, so the result is the
    same for any value. Rows without links have zeros.
    """
    pairs = shared_table(pairs)
    sizes = dict(pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).count().collect())  # at most 63 rows
    least, room = 63, broadcast_pairs
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    frequent = pairs.filter(F.col("n") >= 1 << least) if least < 63 else pairs.limit(0)
    table = frequent.select("pair", "n", "best").orderBy("pair").toArrow()
    spark = aligned.sparkSession
    sent = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in (table["pair"], table["n"], table["best"])))
    names = ["_row", "n_best", "count_sum", "rare"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names[:3]] + [T.StructField("rare", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = sent.value
        for batch in batches:
            rows = []
            for links in batch.column(1).to_pylist():
                own = np.frombuffer(links, "<u4").astype(np.int64)
                place = np.searchsorted(known, own)
                place[place == len(known)] = 0
                hit = known[place] == own if len(known) else np.zeros(len(own), bool)
                rows.append((int(best[place[hit]].sum()), int(counts[place[hit]].sum()), own[~hit]))
            n_best, count_sum, rare = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), pa.array(rare, pa.list_(pa.int64()))], names=names)

    if least == 0:  # every pair is sent, so no link is left and the rows need no number to meet them
        kept = [c for c in aligned.columns if c != "links"]
        whole = T.StructType([*(aligned.schema[c] for c in kept), *schema.fields[1:3]])

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (scored,) = run(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.num_columns - 1)], names=["_row", "links"])]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *scored.columns[1:3]], names=whole.names)

        return aligned.select(*kept, "links").mapInArrow(beside, whole)
    rows = shared_table(aligned.withColumn("_row", F.monotonically_increasing_id()))
    scored = shared_table(rows.select("_row", "links").mapInArrow(run, schema))
    rare = scored.select("_row", F.explode("rare").alias("pair")).groupBy("_row", "pair").agg(F.count(F.lit(1)).alias("times"))
    more = rare.join(pairs.filter(F.col("n") < 1 << least), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    joined = rows.drop("links").join(scored.select("_row", "n_best", "count_sum"), "_row").join(more, "_row", "left")
    return joined.select(
        *[c for c in aligned.columns if c != "links"],
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
