"""Similarity join on word shingles: Jaccard 0.8 or more, exact, without all pairs.

Documents with the same shingle set are one class and only classes are joined. Shingles have a
global order, rare first: by the size of their bucket in a count over all documents (2^20
buckets), then by hash. Two sets that are similar share a shingle among the first few of each (the
prefix), so classes meet in the lists of their prefix shingles, subject to length and positional
filters and to the number of lists they have in common; a suffix filter and the exact count follow
once per pair.

A list of eight members at most gives the pairs that pass the filters. A longer list is not
expanded into pairs. The class that shares most of its prefix is its centre, and every other member
is compared with that: a class of thousands of near copies costs thousands of comparisons and is one
component then. Members that are still in different components are compared with one another: those
of a centre that a task can hold by their sketches, all with all. A larger group is split further:
each member is written as its *difference* from the centre, the shingles that only one of the two
has. The difference of two differences is the difference of the two sets, so two members are similar
if and only if their differences have enough in common, and the same prefix filter applies to them:
they must share one of the rarest shingles of their differences. What all members share with the
centre is in no difference and so in no list any more. The new lists go through the same again.

A *sketch* has about a bit for each shingle of its set: whether an odd number of shingles falls there.
Each shingle that only one of two sets has turns one bit, so two sets differ in at least as many
shingles as their sketches do in bits, and pairs whose sketches differ too much need no texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.llm.common import shared_table, text_or_empty
from lexmill.llm.components import connected_components
from lexmill.llm.word_hash import mix, shingle_set

#: Buckets of the shingle counts, and of one row of them on their way.
_BUCKETS, _ROW = 1 << 20, 1 << 14
#: A member of a list: its class, the sizes of its set and of its difference, the shingle's place in that, its component.
_MEMBER = ("node", "n", "d", "pos", "component")
#: Rounds by centres at most, and the size of lists that need none: their members meet where the list is made.
_ROUNDS, _SMALL_LIST = 2, 8
#: Members of a centre, and bytes of their sketches, that a task compares with one another; larger groups are split by lists.
_GROUP, _GROUP_BYTES = 8192, 16_000_000
#: 64-bit words of sketches that are compared at once.
_WORDS = 1_000_000
#: Lists in buckets of more documents than this (and 16 times the mean) are not read by one window.
_HEAVY = 20_000
#: Pairs of two longs that are broadcast to the texts rather than joined by a shuffle.
_BROADCAST_PAIRS = 100_000
#: Ids that are broadcast to find their texts or to drop them; for more all texts go through a shuffle.
_BROADCAST_CLASSES = 1_000_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set."""
    a, b = mix(shingles), mix(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    return int(_signed(mix(a.sum(dtype=np.uint64, keepdims=True)))[0]), int(_signed(mix(b.sum(dtype=np.uint64, keepdims=True)))[0])


def _class_of(shingles: np.ndarray, renamed: dict[tuple[int, int], int]) -> int:
    """The class of a set: its first sum, or the name given to it where different sets have that in common."""
    node, check = _fingerprint(shingles)
    return renamed.get((node, check), node) if renamed else node


def _sketch(shingles: np.ndarray) -> bytes:
    """The parities of a set over the next power of two of buckets, 64 at least."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: bytes, words: int) -> np.ndarray:
    """The sketch that its set has over ``words`` times 64 buckets."""
    bits = np.frombuffer(sketch, np.uint64)
    return bits if len(bits) == words else np.bitwise_xor.reduce(bits.reshape(-1, words))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for i in range(batch.num_rows):
            yield ids[i].as_py(), texts[i].as_py()


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _scan_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("_id", id_type), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("check", T.LongType()), T.StructField("sketch", T.BinaryType())]
        + [T.StructField("row", T.IntegerType()), T.StructField("counts", T.BinaryType())]
    )


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Per document its set's size, fingerprint and sketch, and per task the counts of all its shingles."""
    schema = _scan_schema(docs.schema["_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_BUCKETS, np.int64)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), arrow)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        arrow = [to_arrow_type(schema["_id"].dataType), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        for id_, text in _texts(batches):
            shingles = shingle_set(text, width)
            np.add.at(counts, _bucket(shingles), 1)
            rows.append((id_, len(shingles), *((*_fingerprint(shingles), _sketch(shingles)) if len(shingles) else (None, None, None)), None, None))
            if len(rows) >= 5000:
                yield flush()
        for row in range(_BUCKETS // _ROW):
            part = counts[row * _ROW : (row + 1) * _ROW]
            if part.any():
                rows.append((None, None, None, None, None, row, zlib.compress(part.tobytes(), 1)))
        if rows:
            yield flush()

    return docs.mapInArrow(run, schema)


def _renamed(documents: DataFrame) -> dict[tuple[int, int], int]:
    """New names of the sets whose first sum is that of another set: chance gives n^2 / 2^65 of them for n sets."""
    shared = documents.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("last")).filter("least <> last")
    found = documents.select("node", "check").join(shared, "node").filter("check <> least").distinct().collect()
    return {(row["node"], row["check"]): row["check"] for row in found}


def _rarity(spark: SparkSession, scanned: DataFrame) -> tuple[np.ndarray, int]:
    """Class of frequency of every bucket, a byte each, and the class from which a bucket is heavy; all documents are counted."""
    schema = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
                sums[row] = sums[row] + part if row in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], names=schema.names)

    rows = _BUCKETS // _ROW
    merged = scanned.filter("row is not null").select("row", "counts").repartition(rows, "row").mapInArrow(add, schema)
    out, total = np.zeros(_BUCKETS, np.uint8), 0
    classes = lambda counts: np.minimum(255, np.log2(counts + 1) * 4).astype(np.uint8)
    for found in merged.collect():  # at most 64 rows of 16,384 counts
        counts = np.frombuffer(zlib.decompress(bytes(found["counts"])), np.int64)
        total += int(counts.sum())
        out[found["row"] * _ROW : (found["row"] + 1) * _ROW] = classes(counts)
    return out, int(classes(np.array([max(_HEAVY, 16 * total // _BUCKETS)]))[0]) + 1


def _rare_first(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return np.lexsort((shingles, classes[_bucket(shingles)]))


def _postings(docs: DataFrame, width: int, percent: int, rarity, heavy: int, renamed) -> DataFrame:
    """(key, node, n, pos, heavy) for the prefix of every class, once per task at most; the key is the shingle."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("heavy", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = rarity.value
        seen: set[int] = set()
        parts: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
            parts.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for _, text in _texts(batches):
            shingles = shingle_set(text, width)
            n = len(shingles)
            node = _class_of(shingles, renamed.value) if n else 0
            if not n or node in seen:
                continue
            seen.add(node)
            prefix = n - -(-percent * n // 100) + 1
            first = shingles[_rare_first(shingles, classes)[:prefix]]
            parts.append((_signed(first), np.full(prefix, node), np.full(prefix, n, np.int32), np.arange(prefix, dtype=np.int32), classes[_bucket(first)] >= heavy))
            size += prefix
            if size >= 200_000:
                yield flush()
                size = 0
        if parts:
            yield flush()

    return docs.mapInArrow(run, schema)


def _suffix_allows(a: np.ndarray, b: np.ndarray, need: int, depth: int = 2) -> bool:
    """Whether two sorted sets can still share ``need`` values, by halving at a pivot."""
    if min(len(a), len(b)) < need:
        return False
    if depth == 0 or not len(a) or not len(b):
        return True
    pivot = a[len(a) // 2]
    i, j = len(a) // 2, int(np.searchsorted(b, pivot))
    most = min(i, j) + min(len(a) - i, len(b) - j)
    if most < need:
        return False
    left = min(i, j)
    right = min(len(a) - i, len(b) - j)
    return _suffix_allows(a[:i], b[:j], need - right, depth - 1) and _suffix_allows(a[i:], b[j:], need - left, depth - 1)


def _beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of the pairs and their other columns; the pairs of one ``a`` come together."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    left, asked = side("a"), pairs
    if pairs.count() <= _BROADCAST_PAIRS:  # else both joins shuffle
        left, asked = left.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi"), F.broadcast(pairs)
    return side("b").join(asked, "b").join(left, "a").select("a", "b", "text_a", "text_b", *pairs.columns[2:])


def _set_pairs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Each batch of (a, b, text_a, text_b) with the sets of its pairs."""
    known, known_set = None, None

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal known, known_set
        left, right = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
        for i, a in enumerate(batch.column(0).to_pylist()):
            if a != known:
                known, known_set = a, shingle_set(left[i].as_py(), width)
            yield known_set, shingle_set(right[i].as_py(), width)

    for batch in batches:
        step = max(1, int(8_000_000 * batch.num_rows / max(1, batch.nbytes)))
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            yield part, sets(part)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    merged = np.concatenate([a, b])
    merged.sort()
    return int(np.count_nonzero(merged[1:] == merged[:-1]))


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, shared, total) of the pairs, counted exactly on the texts; of pairs that the suffix filter rules out, no counts (null)."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "shared", "total")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _set_pairs(batches, width):
            shared, total = [], []
            for one, other in sets:
                both = len(one) + len(other)
                common = _common(one, other) if _suffix_allows(one, other, -(-percent * both // (100 + percent))) else None
                shared.append(common)
                total.append(None if common is None else both - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=schema.names)

    return _beside(pairs, texts).mapInArrow(run, schema).dropDuplicates(["a", "b"])


def _sieve(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that can be similar by their sizes and sketches."""
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            good = []
            for most, one, other in zip((100 - percent) * both // (100 + percent), batch.column(4), batch.column(5)):
                one, other = one.as_py(), other.as_py()
                words = min(len(one), len(other)) // 8
                good.append(np.bitwise_count(_folded(one, words) ^ _folded(other, words)).sum() <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    known = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return known.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _recode(pairs: DataFrame, texts: DataFrame, width: int, percent: int, rarity) -> DataFrame:
    """(a, b, n, d, prefix) of centres a and members b: b written as its difference from a.

    n is the size of b's set, d that of the difference. Its order is by how many differences from
    the same centre a shingle is likely to be in: of b's own shingles the number of documents that
    have it, of those it lacks the number of members (``pairs.size``) less that. The prefix has as
    many as a similar member's difference can miss and one more.
    """
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("a", "b")] + [T.StructField(n, T.IntegerType()) for n in ("n", "d")] + [T.StructField("prefix", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _set_pairs(batches, width):
            rows = []
            for (one, other), size in zip(sets, batch.column(4).to_pylist()):
                n = len(other)
                most = (100 - percent) * (n + 100 * n // percent) // (100 + percent)
                apart = [np.setdiff1d(other, one, assume_unique=True), np.setdiff1d(one, other, assume_unique=True)]
                own, lacked = (2.0 ** (rarity.value[_bucket(x)] / 4.0) for x in apart)
                order = np.lexsort((np.concatenate(apart), np.concatenate([own, np.maximum(size - lacked, size / 8)])))
                first = np.concatenate(apart)[order[: most + 1]]
                rows.append((n, len(apart[0]) + len(apart[1]), _signed(first)))
            types = (pa.int32(), pa.int32(), pa.list_(pa.int64()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return _beside(pairs, texts).mapInArrow(run, schema).dropDuplicates(["a", "b"])


def _least_shared(n_a: str, n_b: str, percent: int) -> F.Column:
    """How many shingles the prefixes of two similar sets share at least.

    Of the two, the set whose prefix ends first in the global order shares with the other only what
    the prefixes share and, at most, all that follows its own prefix.
    """
    n_a, n_b = F.col(n_a), F.col(n_b)
    overlap = F.ceil(percent * (n_a + n_b) / (100 + percent))
    return overlap - F.ceil(percent * F.greatest(n_a, n_b) / 100) + 1


def _fits(x: dict[str, F.Column], y: dict[str, F.Column], percent: int, every: bool = False) -> F.Column:
    """The length, prefix and positional filters for two members of one list.

    Similar sets differ in at most h shingles, so their differences from one centre (at first the
    empty set) have at least ``need`` in common, and the first of those is in both prefixes that
    are due for the two; with ``every``, all lists that they have in common pass.
    """
    h = F.floor((100 - percent) * (x["n"] + y["n"]) / (100 + percent))
    need = F.ceil((x["d"] + y["d"] - h) / 2)
    most = F.least(x["pos"], y["pos"]) + F.least(x["d"] - x["pos"], y["d"] - y["pos"])
    lengths = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    first = F.lit(True) if every else (x["pos"] <= x["d"] - need) & (y["pos"] <= y["d"] - need)
    return lengths & first & (most >= need)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The join: (documents, links, components).

    documents: one row per input row with its id, n (set size) and node (its class; null without
    words). links: pairs of classes a < b that were found similar, with shared and total counts.
    They connect every two similar classes, though not each such pair is listed: members of one
    component are not compared with one another. components: (node, component) of every class
    with a link.
    """
    return _join(docs, id_col, text_col, width, percent)[:3]


def _join(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, dict[tuple[int, int], int]]:
    """What :func:`similar_classes` gives, and the new names of classes."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    scanned = shared_table(_scan(source, width))
    classes, heavy = _rarity(spark, scanned)
    rarity = spark.sparkContext.broadcast(classes)  # 2^20 bytes
    documents = scanned.filter("row is null").select("_id", "n", "node", "check")
    names = _renamed(documents.filter("node is not null"))
    renamed = spark.sparkContext.broadcast(names)  # clashes of 64-bit sums: hardly ever any
    documents = _with_names(documents, names)
    empty_links = spark.createDataFrame([], "a long, b long, shared long, total long")
    close_by, lists = _met_first(_postings(source, width, percent, rarity, heavy, renamed), percent)
    held = lists.groupBy("node").agg(F.count(F.lit(1)).alias("held"))  # in how many long lists a class is
    counts = [held.select(F.col("node").alias(c), F.col("held").alias(f"held_{c}")) for c in "ab"]
    in_long = F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0)))
    close_by = shared_table(close_by.join(counts[0], "a", "left").join(counts[1], "b", "left").filter(F.col("lists") + in_long >= _least_shared("na", "nb", percent)).select("a", "b", "lists"))
    if lists.isEmpty() and close_by.isEmpty():
        return documents, empty_links, spark.createDataFrame([], "node long, component long"), names
    named = lists.select("node").unionByName(close_by.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    owners = documents.join(named, "node").groupBy("node").agg(F.min("_id").alias("_id"))
    texts = shared_table(_texts_of(source, shared_table(owners), width, renamed))
    sketches = _with_names(scanned.filter("node is not null").select("node", "check", "n", "sketch"), names).join(named, "node")
    sketches = shared_table(sketches.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def verified(pairs: DataFrame) -> DataFrame:
        return shared_table(_verify(shared_table(_sieve(pairs, sketches, percent)), texts, width, percent))

    # First every class with one partner only, that of most of its lists; this joins most copies.
    star = _star(lists)
    first = star.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists")).unionByName(close_by)
    first = first.groupBy("b").agg(F.max(F.struct("lists", "a")).alias("best")).select(F.least("best.a", "b").alias("a"), F.greatest("best.a", "b").alias("b")).distinct()
    checked = verified(first)
    components = _components(checked, percent)
    lists, more = _mixed(_with_component(lists.drop("component"), components)), []
    for _ in range(_ROUNDS):
        if lists.isEmpty():
            break
        pairs = shared_table(_star(lists).select("a", "b").distinct())
        asked = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        checked = shared_table(checked.unionByName(verified(asked.join(checked.select("a", "b"), ["a", "b"], "left_anti"))))
        components = _components(checked, percent)
        members = _with_component(pairs.select("a", F.col("b").alias("node")), components).join(sketches, "node")
        few, many = _by_size(shared_table(members))
        more.append(shared_table(_pairs_of_groups(few, percent)))
        if many.isEmpty():
            lists = lists.filter("false")  # each list was that of a small group
            break
        coded = shared_table(_recode(many.select("a", F.col("node").alias("b"), "size"), texts, width, percent, rarity))
        small, lists = _met(_split(_with_component(coded.select("a", F.col("b").alias("node"), "n", "d", "prefix"), components), percent), percent)
        more.append(small.select("a", "b"))
        lists = _mixed(lists)
    rest = _member_pairs(lists, percent)  # what the rounds leave of long lists
    for pairs in (close_by.select("a", "b"), *more):
        rest = rest.unionByName(pairs)
    ends = [components.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}")) for c in "ab"]
    apart = F.coalesce("in_a", "a") != F.coalesce("in_b", "b")
    rest = rest.distinct().join(ends[0], "a", "left").join(ends[1], "b", "left").filter(apart).select("a", "b").join(checked.select("a", "b"), ["a", "b"], "left_anti")
    fresh = verified(rest)
    similar = checked.unionByName(fresh).filter(F.col("shared") * 100 >= percent * F.col("total"))
    if not fresh.filter(F.col("shared") * 100 >= percent * F.col("total")).isEmpty():
        components = _components(similar, percent)
    return documents, similar, components, names


def _by_size(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the centres' members in several components: those of small groups, which a task can hold, and the others, each with its group's size."""
    sizes = members.groupBy("a").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("sketch")).alias("bytes"), F.min("component").alias("l"), F.max("component").alias("h"))
    small = (F.col("size") <= _GROUP) & (F.col("bytes") <= _GROUP_BYTES)
    sized = shared_table(sizes.filter("l <> h").select("a", "size", small.alias("small")))
    return members.join(sized.filter("small").select("a"), "a"), members.join(sized.filter("not small").select("a", "size"), "a")


def _pairs_of_groups(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each centre's members the pairs in different components that can be similar by their sketches."""

    def pairs(group: list[tuple]) -> np.ndarray:
        group.sort(key=lambda row: row[2])
        node, component, n = (np.array(c, np.int64) for c in list(zip(*group))[:3])
        words = np.array([len(row[3]) // 8 for row in group])  # grows with n
        found = [np.zeros((2, 0), np.int64)]
        for w in np.unique(words):
            start, end = np.searchsorted(words, w), np.searchsorted(words, w, "right")
            last = np.searchsorted(n, 100 * n[end - 1] // percent, "right")
            sketch = np.stack([_folded(row[3], w) for row in group[start:last]])
            while start < end:
                step = int(min(end - start, max(1, _WORDS // sketch.size)))
                stop = int(np.searchsorted(n, 100 * n[start + step - 1] // percent, "right"))
                base = last - len(sketch)
                apart = np.bitwise_count(sketch[start - base : start - base + step, None] ^ sketch[None, start - base : stop - base]).sum(2)
                x, y = np.arange(start, start + step)[:, None], np.arange(start, stop)
                fits = (apart <= (100 - percent) * (n[x] + n[y]) // (100 + percent)) & (100 * n[x] >= percent * n[y]) & (x < y) & (component[x] != component[y])
                x, y = (np.nonzero(fits)[i] + start for i in (0, 1))
                found.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]))
                start += step
        return np.concatenate(found, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        centre = None
        for batch in batches:
            for a, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if a != centre and group:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs(group)], names=["a", "b"])
                    group = []
                centre = a
                group.append(row)
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs(group)], names=["a", "b"])

    together = members.select("a", "node", "component", "n", "sketch").repartition("a").sortWithinPartitions("a")
    return together.mapInArrow(run, "a long, b long").distinct()


def _split(members: DataFrame, percent: int) -> DataFrame:
    """(key and member) of the lists by (centre, shingle of the difference).

    ``members``: a, node, n, d, prefix, component. Only shingles early enough for the least
    difference of any member of another component are due; a centre with one component has none.
    """
    least = members.groupBy("a", "component").agg(F.min("d").alias("d"))
    first = least.groupBy("a").agg(F.min(F.struct("d", "component")).alias("first"))
    second = least.join(first, "a").filter("component <> first.component").groupBy("a", "first").agg(F.min("d").alias("second"))
    other = F.when(F.col("component") == F.col("first.component"), F.col("second")).otherwise(F.col("first.d"))
    h = F.floor((100 - percent) * (F.col("n") + F.floor(100 * F.col("n") / percent)) / (100 + percent))
    due = members.join(second, "a").withColumn("due", F.col("d") - F.ceil((F.col("d") + other - h) / 2))
    placed = due.select("a", "node", "n", "d", "component", "due", F.posexplode("prefix").alias("pos", "shingle")).filter("pos <= due")
    return placed.select(F.xxhash64("a", "shingle").alias("key"), *_MEMBER)


def _with_names(documents: DataFrame, names: dict[tuple[int, int], int]) -> DataFrame:
    """The documents' classes, where different sets had one name with their new names."""
    node = F.col("node")
    for (first, check), name in names.items():
        node = F.when((F.col("node") == first) & (F.col("check") == check), F.lit(name)).otherwise(node)
    return documents.withColumn("node", node).drop("check")


def _met_first(postings: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the postings: pairs (a, b, na, nb, lists) that met in short lists, and the members of long lists."""
    postings = postings.select("key", "node", "n", F.col("n").alias("d"), "pos", F.col("node").alias("component"), "heavy")
    small, long_lists = _met(postings.filter("not heavy").drop("heavy"), percent, every=True)
    # A list that may be very long is spread by member, and counted with partial sums; its members are never in one task.
    members = shared_table(postings.filter("heavy").drop("heavy").distinct())
    several = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    lists = shared_table(long_lists.unionByName(members.join(several, "key")))
    return small.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("lists")), lists


def _met(postings: DataFrame, percent: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of lists of at most ``_SMALL_LIST`` members the pairs a < b in different components that pass the filters; the members of longer ones."""
    by_node, whole = Window.partitionBy("key").orderBy("node"), Window.partitionBy("key")
    # Each task has named a class once; a class that several tasks have named stands next to itself.
    several = (
        postings.withColumns({"before": F.lag("node").over(by_node), "after": F.lead("node").over(by_node)})
        .filter("(before is not null or after is not null) and (before is null or before <> node)")
        .select("key", *_MEMBER)
    )
    following = [F.lead(F.struct(*_MEMBER), k).over(by_node) for k in range(1, _SMALL_LIST)]
    sized = several.withColumns({"size": F.count(F.lit(1)).over(whole), "following": F.array(*following)}).filter("size > 1")
    own = {c: F.col(c) for c in _MEMBER}

    def fits(other: F.Column) -> F.Column:
        return other.isNotNull() & (other["component"] != own["component"]) & _fits(own, {c: other[c] for c in _MEMBER}, percent, every)

    partners = F.when(F.col("size") <= _SMALL_LIST, F.transform(F.filter("following", fits), lambda other: F.struct(other["node"].alias("node"), other["n"].alias("n"))))
    met = shared_table(sized.withColumn("partners", partners).filter("partners is null or size(partners) > 0").select("key", *_MEMBER, "partners"))
    pairs = met.filter("partners is not null").select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode("partners").alias("other"))
    return pairs.select("a", F.col("other.node").alias("b"), "na", F.col("other.n").alias("nb")), met.filter("partners is null").select("key", *_MEMBER)


def _star(lists: DataFrame) -> DataFrame:
    """Each member of a list beside the list's centre: (key, a, b).

    The centre shares most of its set: edits make rare shingles of one's own.
    """
    central = lists.groupBy("node").agg((-F.count(F.lit(1)) / F.max("n")).alias("prio"))
    named = lists.select("key", "node").join(central, "node")
    centre = named.groupBy("key").agg(F.min(F.struct("prio", "node")).alias("c"))
    return lists.select("key", "node").join(centre, "key").filter("node <> c.node").select("key", F.col("c.node").alias("a"), F.col("node").alias("b"))


def _mixed(lists: DataFrame) -> DataFrame:
    """The lists with members in different components."""
    mixed = lists.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h").select("key")
    return shared_table(lists.join(mixed, "key"))


def _member_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of one list in different components that pass the filters."""
    side = lambda s: lists.select("key", *[F.col(c).alias(f"{c}_{s}") for c in _MEMBER])
    x, y = ({c: F.col(f"{c}_{s}") for c in _MEMBER} for s in "xy")
    met = side("x").join(side("y"), "key").filter((x["component"] < y["component"]) & _fits(x, y, percent))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def _components(checked: DataFrame, percent: int) -> DataFrame:
    return connected_components(checked.filter(F.col("shared") * 100 >= percent * F.col("total")))


def _with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    return rows.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _texts_of(source: DataFrame, owners: DataFrame, width: int, renamed) -> DataFrame:
    """(node, text): one document of each class; a repeated id with another text is told by its set.

    A task names a class once. Where a repeated row's copies fall to several tasks, a class may come
    more than once, and what is asked of it is answered more than once.
    """
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: set[int] = set()
        for batch in batches:
            step = max(1, int(8_000_000 * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                nodes = part.column(0).to_pylist()
                good = []
                for node, t in zip(nodes, part.column(1).cast(pa.binary())):
                    good.append(node not in named and _class_of(shingle_set(t.as_py(), width), renamed.value) == node)
                    if good[-1]:
                        named.add(node)
                yield part.filter(pa.array(good, pa.bool_()))

    # Ids are compared by hash, so that null ids meet too; the set decides in the end.
    key = F.xxhash64("_id").alias("_key")
    keyed = owners.select(key, "node")
    if owners.count() <= _BROADCAST_CLASSES:
        keyed = F.broadcast(keyed)
    return source.select(key, "text").join(keyed, "_key").select("node", "text").mapInArrow(run, schema)


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, n_connecting.

    ``component_id`` is the smallest id reachable by links. ``n_connecting`` is the number of
    verified links to other sets that connect its set to the component: every set with a link has
    one, but sets of one component are not all compared, so it is no count of all links. A
    document without words (null, empty or blank text) is linked with nothing. Documents with
    equal sets are linked; repeated rows are ordinary rows; a null id ranks after all others. An
    empty table gives an empty result; other columns are not read.
    """
    documents, links, components = similar_classes(docs, id_col, text_col, width, percent)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_connecting"))
    named = _winners(documents, components).join(ends, "node", "left").select("node", "best", F.coalesce("n_connecting", F.lit(0)).alias("n_connecting"))
    return documents.join(named, "node", "left").select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("best.id")).alias("component_id"),
        F.coalesce("n_connecting", F.lit(0)).alias("n_connecting"),
    )


def _winners(documents: DataFrame, components: DataFrame) -> DataFrame:
    """(node, best): for every class the smallest id of its component (null last) and that document's class."""
    own = F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id").alias("id"), F.col("node").alias("of"))
    classes = _with_component(documents.filter("node is not null").groupBy("node").agg(F.min(own).alias("own")), components)
    best = classes.groupBy("component").agg(F.min("own").alias("best"))
    return classes.join(best, "component").select("node", "best")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: exactly one of each component, that with the smallest id.

    A null id ranks after all others. Of rows with one id and equal sets any one stays; rows with
    one id and different texts are judged each by its own component. Documents without words all
    stay. An empty table gives an empty one; columns of any name pass (but ``_nj_key``, ``_nj_node``).
    """
    documents, _, components, names = _join(docs, id_col, text_col, width, percent)
    judged = documents.join(_winners(documents, components), "node", "left")
    stays = F.col("node").isNull() | ((F.col("best.of") == F.col("node")) & F.col("best.id").eqNullSafe(F.col("_id")))
    judged = shared_table(judged.select(F.xxhash64("_id").alias("_nj_key"), F.col("node").alias("_nj_node"), stays.alias("stays")))
    # Ids that stand for one row alone decide by themselves; rows that share an id are told apart by their sets.
    by_id = judged.groupBy("_nj_key").agg(F.count(F.lit(1)).alias("rows"), F.min("stays").alias("stays"))
    several = shared_table(by_id.filter("rows > 1").select("_nj_key"))
    keyed = docs.withColumn("_nj_key", F.xxhash64(F.col(id_col)))
    gone = shared_table(by_id.filter("rows > 1 or not stays").select("_nj_key"))
    kept = keyed.join(F.broadcast(gone) if gone.count() <= _BROADCAST_CLASSES else gone, "_nj_key", "left_anti")
    if not several.isEmpty():
        schema = T.StructType([*keyed.schema.fields, T.StructField("_nj_node", T.LongType())])

        def add_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).cast(pa.binary())
                sets = (shingle_set(t.as_py() or b"", width) for t in texts)
                nodes = pa.array([_class_of(s, names) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=schema.names)

        shared = keyed.join(several, "_nj_key", "left_semi").select(*keyed.columns).mapInArrow(add_class, schema)
        winners = judged.filter("stays and _nj_node is not null").select("_nj_key", "_nj_node").distinct()
        one = F.row_number().over(Window.partitionBy("_nj_key", "_nj_node").orderBy("_nj_key"))
        chosen = shared.join(winners, ["_nj_key", "_nj_node"], "left_semi").withColumn("_nj_one", one).filter("_nj_one = 1")
        kept = kept.unionByName(chosen.select(*keyed.columns)).unionByName(shared.filter("_nj_node is null").select(*keyed.columns))
    return kept.select(*docs.columns)
