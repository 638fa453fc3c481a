"""Packing documents into sequences: dominance reduction, then best fit.

Documents are tokenized in parallel and cut into pieces of at most one sequence. What decides
the packing is how many pieces there are of each length, a table of at most ``capacity`` numbers
for any corpus. On it the driver fixes sets that provably dominate all alternatives (the
reduction of Martello and Toth, for whole multiplicities at once), shrinks the instance, and
packs the rest best fit, longest first. Pieces then take their places by their rank among the
pieces of the same length; ranks come from two-level counts, so a length that a third of all
pieces share is spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.bpe_codec import encode_text
from lexmill.llm.bpe_text import PATTERN, load_json
from lexmill.llm.common import materialize, text_or_empty

#: A way to fill sequences: how many of them, and (length, how many of it) in each, in order.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


class IdEncoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level .json vocabulary.

    The merges run in the tiktoken library, several times faster on the same vocabulary: there a
    token's id is also the rank of its merge.
    """

    def __init__(self, path: str):
        vocab, merges, self.marks = load_json(path)
        ids = [vocab[a + b] for a, b in merges]
        if ids != sorted(ids) or any(vocab[bytes([b])] > ids[0] for b in range(256)):
            raise ValueError("ids must follow the order of the merges")
        self.codec = tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without added begin or end; an added token in the text is one id."""
        for mark, own in self.marks.items():
            if mark in text:
                return np.asarray([own], "<u4").tobytes().join(self.ids(part) for part in text.split(mark))
        return encode_text(self.codec, text, 65_536).tobytes()


@lru_cache(maxsize=2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids). All but a first piece are full."""
    names = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = [docs.schema[id_col].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), *([T.BinaryType()] if keep_ids else [])]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer_path)
        for batch in batches:
            step = max(1, int(4_000_000 * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                rows, owner = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = encoder.ids(text) + end
                    n = len(ids) // 4
                    stop, piece = n % capacity or capacity, 0
                    begin = 0
                    while begin < n:
                        own = ids[4 * begin : 4 * stop]
                        owner.append(i)
                        rows.append((piece, begin, stop - begin, zlib.crc32(own), *([own] if keep_ids else [])))
                        begin, stop, piece = stop, stop + capacity, piece + 1
                columns = [part.column(0).take(pa.array(owner, pa.int64()))]
                for values, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())):
                    columns.append(pa.array(values, kind))
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, schema)


class _Stock:
    """How many pieces are left of each length."""

    def __init__(self, counts: dict[int, int]):
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)

    def take(self, pattern: Counter, times: int) -> None:
        for length, n in pattern.items():
            self.left[length] -= n * times
            if not self.left[length]:
                del self.left[length]
                self.lengths.remove(length)

    def times(self, pattern: Counter) -> int:
        return min(self.left.get(length, 0) // n for length, n in pattern.items())

    def besides(self, length: int, *used: int) -> int:
        """Pieces of ``length`` when one piece of each of ``used`` is set aside."""
        return self.left.get(length, 0) - used.count(length)

    def smallest(self, *used: int) -> list[int]:
        """The three smallest lengths, with multiplicity."""
        found: list[int] = []
        for length in self.lengths:
            found += [length] * min(3, self.besides(length, *used))
            if len(found) >= 3:
                break
        return found[:3]

    def largest(self, most: int, *used: int) -> int:
        """The largest length up to ``most``, or 0."""
        at = bisect_right(self.lengths, most) - 1
        while at >= 0 and self.besides(self.lengths[at], *used) <= 0:
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def best_pair(self, room: int, used: int) -> int:
        """The largest sum of two pieces within ``room``."""
        low, high, best = 0, bisect_right(self.lengths, room) - 1, 0
        while low <= high:
            a, b = self.lengths[low], self.lengths[high]
            enough = self.besides(a, used) > (a == b) and self.besides(b, used) > 0
            if a + b > room:
                high -= 1
                continue
            if enough:
                best = max(best, a + b)
            if self.besides(b, used) <= 0:
                high -= 1
            else:
                low += 1
        return best

    def longest_second(self, room: int, used: int) -> int:
        """The largest that the smaller piece of a pair within ``room`` can be."""
        at = bisect_right(self.lengths, room // 2) - 1
        while at >= 0:
            y = self.lengths[at]
            if self.besides(y, used) >= 2:
                return y
            if self.besides(y, used) == 1:
                for x in self.lengths[at + 1 :]:
                    if x + y > room:
                        break
                    if self.besides(x, used) > 0:
                        return y
            at -= 1
        return 0


def _dominating(stock: _Stock, length: int, capacity: int) -> Counter | None:
    """A set with ``length`` that dominates every other set with it, if one is found."""
    room = capacity - length
    small = stock.smallest(length)
    if not small or small[0] > room:
        return Counter([length])  # nothing fits beside it
    one = stock.largest(room, length)
    if one == room:
        return Counter([length, one])  # fills the sequence; any other partners would fit in its place
    if len(small) < 2 or small[0] + small[1] > room:
        return Counter([length, one])  # only one partner fits, and this is the largest
    if len(small) < 3 or sum(small) > room:  # at most two partners fit
        if one >= stock.best_pair(room, length):
            return Counter([length, one])
        two = stock.largest(room - one, length, one)
        if two and stock.longest_second(room, length) <= two:
            return Counter([length, one, two])  # each partner at least as long as any rival's
    return None


def plan_packing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fill sequences of ``capacity`` with ``counts`` pieces of each length."""
    if counts and not (0 < min(counts) and max(counts) <= capacity):
        raise ValueError("lengths must be between 1 and the capacity")
    stock, patterns = _Stock(counts), []
    fixed = True
    while fixed and stock.lengths:
        fixed = False
        for length in reversed(list(stock.lengths)):
            while length in stock.left and (found := _dominating(stock, length, capacity)):
                times = stock.times(found)
                if not times:
                    break
                patterns.append((times, tuple(sorted(found.items(), reverse=True))))
                stock.take(found, times)
                fixed = True
    # Best fit, longest first; equal sequences are handled together.
    room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    rooms: list[int] = []

    def put(left: int, times: int, content: tuple[tuple[int, int], ...]) -> None:
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append((times, content))

    for length in reversed(stock.lengths):
        n = stock.left[length]
        while n:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, n // each, ((length, each),))
                if n % each:
                    put(capacity - n % each * length, 1, ((length, n % each),))
                break
            left = rooms[at]
            times, content = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
            used = min(n, times)
            if times > used:
                put(left, times - used, content)
            content = (*content[:-1], (length, content[-1][1] + 1)) if content[-1][0] == length else (*content, (length, 1))
            put(left - length, used, content)
            n -= used
    return patterns + [group for groups in room.values() for group in groups]


def _places(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For look-up by (length, rank): where a block of ranks begins, how many of it share a sequence, the first sequence, the first offset."""
    taken: Counter = Counter()
    blocks, sequence = [], 0
    for times, content in patterns:
        offset = 0
        for length, each in content:
            blocks.append(((length << 48) + taken[length], each, sequence, offset))
            taken[length] += each * times
            offset += each * length
        sequence += times
    return tuple(np.asarray(c, np.int64) for c in zip(*sorted(blocks)))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", salts: int = 256, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is just that one. Only documents
    longer than ``capacity`` are cut; then the first piece may be shorter and all others are
    full. Pieces of equal length are interchangeable, so ties and repeated rows need no rule. An
    empty table gives an empty result; other columns of ``docs`` are not read.
    """
    pieces = materialize(cut_documents(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids).withColumn("_row", F.monotonically_increasing_id()))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = {row["length"]: row["n"] for row in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    schema = T.StructType([*(f for f in pieces.schema.fields if f.name != "_row"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if not counts:
        return pieces.drop("_row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).withColumnRenamed("_id", id_col)
    begins, each, first, at = _places(plan_packing(counts, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = (
        salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1)
        .join(starts, ["length", "_salt"])
        .select(*[c for c in pieces.columns if c != "_row"], (F.col("_first") + F.col("_rank")).alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            block = np.searchsorted(begins, (length << 48) + rank, side="right") - 1
            within = (length << 48) + rank - begins[block]
            columns = [*batch.columns[:-1], pa.array(first[block] + within // each[block]), pa.array(at[block] + within % each[block] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.mapInArrow(place, schema).withColumnRenamed("_id", id_col)
