"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, only at safe boundaries: where a match of the split pattern
starts after something else than white space. The pattern looks back at nothing, so what starts
there is split as in the whole text. Decoding joins the tokens' raw bytes, with no detour through text.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.bpe_text import PATTERN, SPLIT, load_ranks
from lexmill.llm.common import text_or_empty

#: Spellings of the split that :data:`SPLIT` stands for; texts are cut for no other pattern.
KNOWN_SPLITS = (PATTERN, public_tokenizers.PATTERN)
#: Bytes of ids and text in one batch that leaves a task.
_BATCH_BYTES = 4_000_000


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def safe_cuts(text: str, chunk_chars: int) -> Iterator[tuple[str, bool]]:
    """``text`` in chunks of about ``chunk_chars``, and whether a chunk is one long match.

    A cut is safe where a match starts after something else than white space: the split of white
    space depends on what follows it, so white space stays with what comes next.
    """
    first = 0
    for match in SPLIT.finditer(text):
        start, end = match.span()
        if end - first < chunk_chars or start and text[start - 1].isspace():
            continue
        if start > first:
            yield text[first:start], False
            first = start
        if end - start >= chunk_chars and not text[end - 1].isspace():
            yield text[start:end], True
            first = end
    if first < len(text):
        yield text[first:], False


def encode_text(codec: tiktoken.Encoding, text: str, chunk_chars: int) -> np.ndarray:
    """Ids of a whole text; a chunk that is one overlong match is merged without the splitter."""
    if len(text) <= chunk_chars:
        return np.asarray(codec.encode_ordinary(text), "<u4")
    ids: list[int] = []
    for chunk, single in safe_cuts(text, chunk_chars):
        ids += codec._encode_single_piece(chunk) if single else codec.encode_ordinary(chunk)
    return np.asarray(ids, "<u4")


def _batches(columns: list[pa.Array], sizes: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Cut rows into batches of bounded size."""
    first = size = 0
    for i, n in enumerate(sizes):
        if i > first and size + n > _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([c[first:i] for c in columns], names=names)
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield pa.RecordBatch.from_arrays([c[first:] for c in columns], names=names)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, min(batch.num_rows or 1, int(_BATCH_BYTES * batch.num_rows / max(1, batch.nbytes))))
    for first in range(0, batch.num_rows, step):
        yield batch.slice(first, step)


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 65_536, decode: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ``ids`` (binary: little-endian unsigned 32-bit), and with ``decode`` also ``decoded`` (binary).

    ``pattern`` is the split of the rank file. If it is one of :data:`KNOWN_SPLITS`, texts over
    ``chunk_chars`` are cut at its safe boundaries; with any other pattern they are encoded whole. A null text encodes as an empty one (0 tokens, empty binary);
    special tokens' strings are ordinary text; rows map one to one, so repeated rows and empty
    tables need no rule; other columns of ``docs`` are not read. See :func:`ids_as_array`.
    """
    names = ["_id", "n_tokens", "ids", *(["decoded"] if decode else [])]
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in names[2:])])

    longest = chunk_chars if pattern in KNOWN_SPLITS else sys.maxsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(ranks_path, pattern)
        for batch in batches:
            for part in _pieces(batch):
                ids = [encode_text(codec, text, longest) for text in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if decode:
                    columns.append(pa.array([codec.decode_bytes(x.tolist()) for x in ids], pa.binary()))
                yield from _batches(columns, [8 * len(x) + 16 for x in ids], names)

    coded = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, schema)
    return coded.withColumnRenamed("_id", id_col)


def decode_bpe(coded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``decoded`` (binary), the raw bytes of the tokens; null ids give null."""
    schema = T.StructType([T.StructField("_id", coded.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(ranks_path, pattern)
        for batch in batches:
            for part in _pieces(batch):
                raw = [None if x is None else codec.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in part.column(1).to_pylist()]
                yield from _batches([part.column(0), pa.array(raw, pa.binary())], [len(x or b"") + 16 for x in raw], ["_id", "decoded"])

    plain = coded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, schema)
    return plain.withColumnRenamed("_id", id_col)


def ids_as_array(ids: str = "ids") -> F.Column:
    """The packed ids of column ``ids`` as an array of integers."""
    byte = lambda at: F.conv(F.hex(F.substr(F.col(ids), at, F.lit(1))), 16, 10).cast("int")
    number = lambda i: byte(i * 4 + 1) + byte(i * 4 + 2) * 256 + byte(i * 4 + 3) * 65_536 + byte(i * 4 + 4) * 16_777_216
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), number))
