"""Removal of repeated passages by recompression.

Two rounds of pair naming parse every text the same way wherever it occurs: symbols get names
that depend on their words alone (hashes, so that all tasks agree without a dictionary), the
names are dealt into a left and a right half, and a left symbol followed by a right one becomes
one symbol. Equal neighbours are in one half and never pair, so a run of one word stays a run of
equal symbols and is named once per document. Whether a border between two symbols survives both
rounds depends on two words on either side, and no symbol is longer than four words; so equal
windows of 13 words have the same borders inside, at least two of them. The border with the least
name (a hash of the four words around it) is the window's *anchor*.

Anchors that occur in one document only reveal nothing; they are about one for six words. Where an
anchor is shared, the windows that have it are compared by their own hash, and a window is a
repeat if it also starts in a document with a smaller id. Tasks settle what they can among
their own documents and send on one entry for each anchor or window, so what a third of all
documents share reaches a task once per sending task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import text_or_empty
from lexmill.llm.word_hash import mix, run_hashes, word_hashes

#: Entries that a task gathers before it settles and sends them.
_CHUNK = 2_000_000
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words on either side of a border that decide whether it survives.
_REACH = 2


def border_names(words: np.ndarray) -> np.ndarray:
    """For the border before word ``i``, i from 2 to n - 2: its name, or the largest number if it vanished."""
    n = len(words)
    if n < 2 * _REACH:
        return np.zeros(0, np.uint64)
    one = np.uint64(1)
    right = (words & one).astype(bool)
    joined = ~right[:-1] & right[1:]  # first round: words i and i + 1 become one symbol
    single = mix(words + one)
    pair = mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + mix(words[1:]))
    at = np.arange(_REACH, n - 1)
    before = np.where(joined[at - 2], pair[at - 2], single[at - 1])
    after = np.where(joined[at], pair[at], single[at])
    second = ~(before & one).astype(bool) & (after & one).astype(bool)
    alive = ~joined[at - 1] & ~second
    return np.where(alive, run_hashes(words, 2 * _REACH), _LAST)


def window_anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The anchor of every window of ``window`` words."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    return sliding_window_view(border_names(words), window - 2 * _REACH + 1).min(axis=1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        rest = [batch.column(i) for i in range(3, batch.num_columns)]
        for i, (key, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield key, doc, texts[i].as_py(), *(c[i].as_py() for c in rest)


def _groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and for every value the number of its run."""
    new = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


_SENT = T.StructType(
    [T.StructField("block", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("values", T.BinaryType()), T.StructField("keys", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("places", T.BinaryType())]
)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_SENT.names)


def _dictionary(ids: np.ndarray) -> bytes:
    """Ids come many times: each one once, then a number for every entry."""
    each, number = np.unique(ids, return_inverse=True)
    return len(each).to_bytes(4, "little") + each.tobytes() + number.astype(np.uint32).tobytes()


def _settled(keys: np.ndarray, values: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """What is known, packed into one row for each block that the keys fall in."""
    if not len(keys):
        return
    which = keys % blocks
    order = np.argsort(which, kind="stable")
    begins, _ = _groups(which[order])
    ends = np.append(begins[1:], len(order))
    for first in range(0, len(begins), 64):
        parts = [order[b:e] for b, e in zip(begins[first : first + 64], ends[first : first + 64])]
        yield _sent([(int(which[own[0]]), 1, values[own].tobytes(), _dictionary(keys[own]), None, None) for own in parts])


def _blocks(values: np.ndarray, blocks: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of packed entries, one per block; the block follows from the value."""
    which = ((values >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    begins, _ = _groups(which[order])
    ends = np.append(begins[1:], len(order))
    for first in range(0, len(begins), 64):
        rows = []
        for b, e in zip(begins[first : first + 64], ends[first : first + 64]):
            own = order[b:e]
            packed = [_dictionary(c[own]) for c in columns[:2]]
            packed += [c[own].astype(np.uint32).tobytes() for c in columns[2:]]
            rows.append((int(which[own[0]]), None, values[own].tobytes(), *packed, *[None] * (3 - len(columns))))
        yield _sent(rows)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, np.int64, n, 4)[np.frombuffer(raw, np.uint32, -1, 4 + 8 * n)]


def _shared_anchors(source: DataFrame, window: int, blocks: int) -> DataFrame:
    """(key, values): for each document its anchors that another one has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, owners, size = [], [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            values = np.concatenate(found)
            keys = np.repeat(np.array(owners, np.int64), [len(f) for f in found])
            order = np.argsort(values, kind="stable")
            values, keys = values[order], keys[order]
            begins, group = _groups(values)
            shared = np.diff(np.append(begins, len(values)))[group] > 1
            yield from _settled(keys[shared], values[shared], blocks)
            first = np.zeros(len(values), bool)
            first[begins] = True
            yield from _blocks(values[first], blocks, keys[first])

        for key, _, text in _rows(batches):
            anchors = np.unique(window_anchors(word_hashes(text, False), window))
            if len(anchors):
                found.append(anchors)
                owners.append(key)
                size += len(anchors)
            if size >= _CHUNK:
                yield from settle()
                found, owners, size = [], [], 0
        if size:
            yield from settle()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, keys = [], []
        for batch in batches:
            for v, k in zip(batch.column(2), batch.column(3)):
                values.append(np.frombuffer(v.as_py(), np.uint64))
                keys.append(_unpacked(k.as_py()))
        if values:
            value, key = np.concatenate(values), np.concatenate(keys)
            order = np.argsort(value, kind="stable")
            value, key = value[order], key[order]
            begins, group = _groups(value)
            shared = np.diff(np.append(begins, len(value)))[group] > 1
            yield from _settled(key[shared], value[shared], blocks)

    return _meet(source.mapInArrow(send, _SENT), meet, blocks, np.uint64)


def _meet(sent: DataFrame, meet, blocks: int, kind: type) -> DataFrame:
    """(key, values): packed entries meet by block, settled ones pass; then all of a key come together."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            settled = batch.filter(batch.column(1).is_valid())
            if settled.num_rows:
                yield settled
            parts.append(batch.filter(batch.column(1).is_null()))
        yield from meet(iter(parts))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = [], []
        for batch in batches:
            for v, k in zip(batch.column(2), batch.column(3)):
                values.append(np.frombuffer(v.as_py(), kind))
                keys.append(_unpacked(k.as_py()))
        if not keys:
            return
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        begins, _ = _groups(key)
        ends = np.append(begins[1:], len(key))
        for first in range(0, len(begins), 5000):
            own = slice(first, first + 5000)
            lists = [[value[b:e].tobytes()] for b, e in zip(begins[own], ends[own])]
            yield pa.RecordBatch.from_arrays([pa.array(key[begins[own]]), pa.array(lists, pa.list_(pa.binary()))], names=["key", "values"])

    met = sent.repartition(blocks, "block").mapInArrow(both, _SENT)
    return met.repartition(blocks, "block").mapInArrow(gather, "key long, values array<binary>")


def _repeated_windows(source: DataFrame, window: int, blocks: int) -> DataFrame:
    """(key, values): for each document the places (32 bits each) of windows that start in a document with a smaller id.

    ``source``: key, id, text, values (the shared anchors).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, places, owners, docs, size = [], [], [], [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            value, place = np.concatenate(found), np.concatenate(places)
            lengths = [len(f) for f in found]
            key, doc = np.repeat(np.array(owners, np.int64), lengths), np.repeat(np.array(docs, np.int64), lengths)
            order = np.lexsort((doc, value))
            value, place, key, doc = value[order], place[order], key[order], doc[order]
            begins, group = _groups(value)
            later = doc > doc[begins][group]
            yield from _settled(key[later], place[later], blocks)
            yield from _blocks(value[~later], blocks, key[~later], doc[~later], place[~later])

        for key, doc, text, values, _ in _rows(batches):
            words = word_hashes(text, False)
            anchors = window_anchors(words, window)
            wanted = np.unique(np.concatenate([np.frombuffer(v, np.uint64) for v in values]))
            at = np.searchsorted(wanted, anchors)
            mine = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == anchors)
            found.append(run_hashes(words, window)[mine])
            places.append(mine.astype(np.uint32))
            owners.append(key)
            docs.append(doc)
            size += len(mine)
            if size >= _CHUNK:
                yield from settle()
                found, places, owners, docs, size = [], [], [], [], 0
        if size:
            yield from settle()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in (2, 3, 4, 5))):
                value, key, doc, place = (c.as_py() for c in row)
                parts.append([np.frombuffer(value, np.uint64), _unpacked(key), _unpacked(doc), np.frombuffer(place, np.uint32)])
        if parts:
            value, key, doc, place = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((doc, value))
            value, key, doc, place = value[order], key[order], doc[order], place[order]
            begins, group = _groups(value)
            later = doc > doc[begins][group]
            yield from _settled(key[later], place[later], blocks)

    return _meet(source.mapInArrow(send, _SENT), meet, blocks, np.uint32)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, blocks: int | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the kept words joined by one space).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller
    id; windows are judged on the input. Null or empty texts have no words. Ids are integers; a
    null id ranks after all others; rows with one id never remove each other's words. Repeated
    rows get equal results, an empty table gives an empty result, other columns are not read.
    """
    if window < 4 * _REACH + 1:
        raise ValueError(f"windows need {4 * _REACH + 1} words")
    blocks = blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = text_or_empty(text_col)
    source = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), text.alias("text"), F.col(id_col).alias("_id"))
    anchors = _shared_anchors(source.select("key", "doc", "text"), window, blocks)
    # Both joins read all columns of ``source``, so that its exchange is made once and reused.
    places = _repeated_windows(source.join(anchors, "key").select("key", "doc", "text", "values", "_id"), window, blocks)
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(8_000_000 * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                counts, removed, kept = [], [], []
                for text, values in zip(part.column(1).cast(pa.binary()), part.column(2).to_pylist()):
                    words = text.as_py().split()
                    gone = 0
                    counts.append(len(words))
                    if values:
                        starts = np.concatenate([np.frombuffer(v, np.uint32) for v in values]).astype(np.int64)
                        edges = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + window, minlength=len(words) + 1)
                        covered = np.cumsum(edges)[: len(words)] > 0
                        gone = int(covered.sum())
                        words = [w for w, c in zip(words, covered.tolist()) if not c]
                    removed.append(gone)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    joined = source.join(places, "key", "left").select("_id", "text", "values", "key", "doc")
    return joined.mapInArrow(remove, schema).withColumnRenamed("_id", id_col)
