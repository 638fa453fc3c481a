"""Chroma fingerprints of audio columns, and alignment of recordings.

Samples are cut into overlapping frames; each frame's spectrum is folded into twelve pitch
classes. Rectangle filters over the (frame, pitch class) image, read from its integral image,
are quantized to two bits each; sixteen of them make a packed 32-bit integer per frame.

Equal recordings are one class by a digest of their samples, however short, and equal print
arrays one group. Of any two groups all frames with equal integers vote for the offset between
them: groups are dealt to blocks, each pair of blocks meets in one task, and no partner, place or
frequent integer is left out. The bits that differ are counted along the overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import materialize

#: Frames that a filter spans at most, and filters of one packed integer.
SPAN, FILTERS = 16, 16

#: Frames of a block at most, and of one when there are no more than ``_FEW_BLOCKS``.
_BLOCK, _SMALL_BLOCK, _FEW_BLOCKS = 4_000_000, 250_000, 5
#: Votes that are counted at once, and votes of one recording from which on its partners are taken in parts.
_VOTES, _MANY = 1 << 18, 1 << 22


@lru_cache(maxsize=4)
def _pitch_classes(rate: int, frame: int) -> np.ndarray:
    """(spectrum bin, pitch class) weights; bins below 60 Hz count for nothing."""
    hz = np.fft.rfftfreq(frame, 1 / rate)
    weights = np.zeros((len(hz), 12), np.float32)
    heard = hz >= 60
    classes = np.round(12 * np.log2(hz[heard] / 440)).astype(int) % 12
    weights[np.flatnonzero(heard), classes] = 1
    return weights


def _filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, pitch classes, frames) of every filter, by rule."""
    return [(i % 4, (5 * i) % 9, 3 + i % 2, 4 * (1 + i % 4)) for i in range(FILTERS)]


def chroma(samples: np.ndarray, rate: int, frame: int, hop: int) -> np.ndarray:
    """Pitch classes of every frame, each frame scaled to length one."""
    count = (len(samples) - frame) // hop + 1
    if count <= 0:
        return np.zeros((0, 12), np.float32)
    out = np.empty((count, 12), np.float32)
    hann = np.hanning(frame).astype(np.float32)
    for first in range(0, count, 8192):  # bounds memory for long recordings
        n = min(8192, count - first)
        rows = np.lib.stride_tricks.sliding_window_view(samples[first * hop : (first + n - 1) * hop + frame], frame)[::hop].astype(np.float32)
        rows -= rows.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(rows * hann, axis=1).astype(np.complex64))
        own = power @ _pitch_classes(rate, frame)
        out[first : first + n] = own / (np.linalg.norm(own, axis=1, keepdims=True) + 1e-6)
    return out


def packed_prints(image: np.ndarray) -> np.ndarray:
    """One packed integer for every position at which all filters fit."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    area = lambda t, w, y, h: integral[t + w : t + w + n, y + h] - integral[t : t + n, y + h] - integral[t + w : t + w + n, y] + integral[t : t + n, y]
    out = np.zeros(n, np.uint32)
    for shape, y, h, w in _filters():
        whole = area(0, w, y, h)
        if shape == 0:  # earlier against later
            part = area(0, w // 2, y, h)
        elif shape == 1:  # lower against higher
            part = area(0, w, y, h // 2 + h % 2)
        elif shape == 2:  # middle against both ends in time
            part = area(w // 4, w // 2, y, h)
        else:  # checkered
            part = area(0, w // 2, y, h // 2) + area(w // 2, w - w // 2, y + h // 2, h - h // 2)
        level = np.log((part + 0.01) / (whole - part + 0.01))
        bits = np.digitize(np.round(level, 6), (-0.3, 0.0, 0.3)).astype(np.uint32)
        out = (out << np.uint32(2)) | (bits ^ (bits >> np.uint32(1)))  # neighbours differ in one bit
    return out


def fingerprint_audio(recordings: DataFrame, id_col: str, audio_col: str, rate: int = 8000, frame: int = 256, hop: int = 64) -> DataFrame:
    """Per row: id, n_frames, prints (array of packed integers, as signed 32 bits), digest of the samples.

    ``audio_col`` is binary, unsigned 8-bit mono samples. A null or too short recording has no
    prints (an empty array), one without samples no digest. Rows map one to one; other columns are not read.
    """
    schema = T.StructType([T.StructField("_id", recordings.schema[id_col].dataType), T.StructField("n_frames", T.LongType()), T.StructField("prints", T.ArrayType(T.IntegerType())), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(4_000_000 * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                frames, prints, digests = [], [], []
                for raw in part.column(1):
                    samples = raw.as_py() or b""
                    digests.append(hashlib.sha256(samples).digest() if samples else None)
                    image = chroma(np.frombuffer(samples, np.uint8), rate, frame, hop)
                    frames.append(len(image))
                    prints.append(packed_prints(image).view(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(frames, pa.int64()), pa.array(prints, pa.list_(pa.int32())), pa.array(digests, pa.binary())], names=schema.names)

    return recordings.select(F.col(id_col).alias("_id"), F.col(audio_col).cast("binary").alias("_audio")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


class _Recordings(NamedTuple):
    """Print arrays laid end to end: all integers, where each recording starts (and the last ends), whose each frame is."""

    values: np.ndarray
    starts: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, lengths: np.ndarray) -> _Recordings:
        return cls(values, np.concatenate([[0], np.cumsum(lengths)]), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths))

    def part(self, first: int, last: int) -> _Recordings:
        lo, hi = self.starts[first], self.starts[last]
        return _Recordings(self.values[lo:hi], self.starts[first : last + 1] - lo, self.owner[lo:hi] - first)

    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)


#: Places in both sets, offset, equal frames and different integers among these, as columns.
_Agreements = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _agree_pair(x: np.ndarray, y: np.ndarray, least: int) -> _Agreements:
    """All offsets of two recordings; integers frequent in both are correlated by Fourier transform."""
    span = len(x) + len(y) - 1
    votes, different = np.zeros(span, np.int64), np.zeros(span, np.int64)
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    low = np.searchsorted(y[by_y], x[by_x], "left")
    n = np.searchsorted(y[by_y], x[by_x], "right") - low
    heads = np.flatnonzero(np.diff(x[by_x].astype(np.int64), prepend=-1))
    frames = np.diff(heads, append=len(x))
    total = np.add.reduceat(n, heads)
    size = 1 << (span - 1).bit_length()
    for value in x[by_x][heads[total > 8 * span]]:
        marks = np.fft.rfft((x == value).astype(float), size) * np.fft.rfft((y[::-1] == value).astype(float), size)
        count = np.rint(np.fft.irfft(marks, size)[:span]).astype(np.int64)
        votes += count
        different += count > 0
    n[np.repeat(total > 8 * span, frames)] = 0
    ends, heads, first = np.cumsum(np.add.reduceat(n, heads)), np.append(heads, len(x)), 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _MANY, "right")))
        part = slice(heads[first], heads[last])
        m = n[part]
        there = by_y[np.arange(m.sum()) + np.repeat(low[part] - (np.cumsum(m) - m), m)]
        offset = np.repeat(by_x[part], m) - there + len(y) - 1
        votes += np.bincount(offset, minlength=span)
        value = np.repeat(np.repeat(np.arange(first, last), frames[first:last]), m)
        different += np.bincount(np.unique(value * span + offset) % span, minlength=span)
        first = last
    at = np.flatnonzero(votes >= least)
    return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at - (len(y) - 1), votes[at], different[at]


def _agree(a: _Recordings, b: _Recordings, least: int) -> Iterator[_Agreements]:
    """Every offset of a recording of ``a`` and one of ``b`` with ``least`` equal frames; those of one pair come together."""
    if not len(a.values) or not len(b.values):
        return
    order = np.argsort(b.values, kind="stable").astype(np.int32)
    ordered = b.values[order]
    low = np.searchsorted(ordered, a.values, "left")
    count = np.searchsorted(ordered, a.values, "right") - low
    ends = np.cumsum(np.add.reduceat(count, a.starts[:-1]))
    span = int(max(a.lengths().max(), b.lengths().max()))
    slots, first = 4 * _VOTES, 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _VOTES, "right")))
        if ends[last - 1] - done > _MANY:  # of one recording only
            for own, other, *rest in _agree_long(a.part(first, last), b, order, ordered, least):
                yield own + first, other, *rest
            first = last
            continue
        lo, hi = int(a.starts[first]), int(a.starts[last])
        n = count[lo:hi]
        upto = np.cumsum(n)
        there = order[np.arange(upto[-1]) + np.repeat(low[lo:hi] - (upto - n), n)]
        if least > 1:  # votes for one offset share a slot, so slots with few votes hold no link
            slot = (np.repeat(np.arange(lo, hi) + a.owner[lo:hi].astype(np.int64) * 0x9E3779B1, n) - there) & (slots - 1)
            kept = np.flatnonzero(np.bincount(slot, minlength=slots)[slot] >= least)
            there = there[kept]
        else:
            kept = np.arange(upto[-1])
        here = lo + np.searchsorted(upto, kept, "right")
        own, other = a.owner[here].astype(np.int64), b.owner[there]
        offset = (here - a.starts[own]) - (there - b.starts[other])
        key = ((own - first) * len(b.starts) + other) * (2 * span) + offset + span
        by = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.diff(key[by], prepend=-1))
        votes = np.diff(head, append=len(by))
        enough = np.flatnonzero(votes >= least)
        if len(enough):
            group = np.repeat(np.arange(len(head)), votes)
            mine = np.flatnonzero(votes[group] >= least)
            seen = np.unique((group[mine] << 32) | a.values[here[by[mine]]].astype(np.int64)) >> 32
            at = by[head[enough]]
            yield own[at], other[at], offset[at], votes[enough], np.bincount(seen, minlength=len(head))[enough]
        first = last


def _agree_long(a: _Recordings, b: _Recordings, order: np.ndarray, ordered: np.ndarray, least: int) -> Iterator[_Agreements]:
    """`_agree` for one recording with many votes: its partners in parts, one with too many alone by `_agree_pair`."""
    values, times = np.unique(a.values, return_counts=True)
    low = np.searchsorted(ordered, values, "left")
    n = np.searchsorted(ordered, values, "right") - low
    found = order[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)]
    ends = np.cumsum(np.bincount(b.owner[found], np.repeat(times, n), len(b.starts) - 1).astype(np.int64))
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _MANY, "right")))
        part = b.part(first, last)
        if ends[last - 1] - done > _MANY:
            parts = iter([_agree_pair(a.values, part.values, least)])
        else:
            parts = _agree(a, part, least) if ends[last - 1] > done else iter(())
        for own, other, *rest in parts:
            yield own, other + first, *rest
        first = last


def _differing_bits(a: _Recordings, b: _Recordings, own: np.ndarray, other: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Share of differing bits along the overlap of each pair at its offset."""
    n = np.minimum(a.lengths()[own] - np.maximum(offset, 0), b.lengths()[other] - np.maximum(-offset, 0))
    here, there = a.starts[own] + np.maximum(offset, 0), b.starts[other] + np.maximum(-offset, 0)
    out, ends, first = np.empty(len(own)), np.cumsum(n), 0
    while first < len(own):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + (1 << 20), "right")))
        m = n[first:last]
        begin = np.cumsum(m) - m
        at = np.arange(m.sum())
        bits = np.bitwise_count(a.values[at + np.repeat(here[first:last] - begin, m)] ^ b.values[at + np.repeat(there[first:last] - begin, m)])
        out[first:last] = np.add.reduceat(bits.astype(np.int64), begin) / (32 * m)
        first = last
    return out


def _link_groups(groups: DataFrame, least_votes: int) -> DataFrame:
    """Links of groups (g, id, n, prints), summed by block pair and group: g, linked (members of the others), and its best match there.

    A match has a smaller id, and not too few integers where the group itself has enough; without one
    match_id, votes, offset and bit_error_rate are null.
    """
    frames = groups.agg(F.sum(F.size("prints"))).first()[0] or 0
    blocks = max(1, min(_FEW_BLOCKS, -(-frames // _SMALL_BLOCK)), -(-frames // _BLOCK))
    block = F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int")
    tile = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.greatest(block, k) * blocks + F.least(block, k))
    few = F.size(F.array_distinct("prints")) < least_votes
    schema = T.StructType([*[T.StructField(x, T.LongType()) for x in ("g", "linked", "match_id", "votes")], T.StructField("offset", T.IntegerType()), T.StructField("bit_error_rate", T.DoubleType())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        high, low = divmod(table["tile"][0].as_py(), blocks)
        lists = table["prints"].combine_chunks()
        every = _Recordings.of(lists.flatten().to_numpy().view(np.uint32), lists.value_lengths().to_numpy().astype(np.int64))
        ids, g, n, few, dealt = (table[x].to_numpy() for x in ("id", "g", "n", "few", "block"))
        lengths = every.lengths()
        tiny, linked = lengths < least_votes, np.zeros(len(ids), np.int64)

        def chosen(rows: np.ndarray) -> tuple[np.ndarray, _Recordings]:
            return np.flatnonzero(rows), _Recordings.of(every.values[rows[every.owner]], lengths[rows])

        def best(found: np.ndarray) -> np.ndarray:  # rows of later side, earlier side, offset, votes
            later, earlier, offset, votes = found.T
            found = found[np.lexsort((offset, np.abs(offset), ids[earlier], -votes, later))]
            return found[np.diff(found[:, 0], prepend=-1) != 0]

        # a recording with fewer frames than votes are asked for can agree in all of them
        sides = [(dealt == high, (dealt == low) & tiny, 1), ((dealt == high) & ~tiny, (dealt == low) & ~tiny, least_votes)]
        if high != low:
            sides.append(((dealt == high) & tiny, (dealt == low) & ~tiny, 1))
        matches, waiting = np.zeros((0, 4), np.int64), []
        for mine, theirs, least in sides:
            (at_a, a), (at_b, b) = chosen(mine), chosen(theirs)
            for own, other, offset, votes, different in _agree(a, b, least):
                x, y = at_a[own], at_b[other]
                good = np.where(few[x] | few[y], votes == np.minimum(lengths[x], lengths[y]), different >= least_votes)
                if high == low:  # two tiny ones or two others are seen in both orders
                    good &= (x > y) | (tiny[x] != tiny[y])
                x, y, offset, votes = x[good], y[good], offset[good], votes[good]
                pair = np.unique(x * len(ids) + y)
                np.add.at(linked, pair // len(ids), n[pair % len(ids)])
                np.add.at(linked, pair % len(ids), n[pair // len(ids)])
                swap = ids[x] < ids[y]
                x, y, offset = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, -offset, offset)
                fits = (ids[x] > ids[y]) & (few[x] | ~few[y])
                waiting.append(best(np.stack([x, y, offset, votes], axis=1)[fits]))
                if sum(map(len, waiting)) > _VOTES:
                    matches, waiting = best(np.concatenate([matches, *waiting])), []
        later, earlier, offset, votes = best(np.concatenate([matches, *waiting])).T
        none = np.ones(len(ids), bool)
        none[later] = False

        def column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            spread = np.zeros(len(ids), values.dtype)
            spread[later] = values
            return pa.array(spread, kind, mask=none)

        columns = [pa.array(g), pa.array(linked), column(ids[earlier], pa.int64()), column(votes, pa.int64()), column(offset, pa.int32()), column(_differing_bits(every, every, later, earlier, offset), pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(linked > 0))

    return groups.withColumn("few", few).withColumn("block", block).withColumn("tile", F.explode(tile)).groupBy("tile").applyInArrow(link, schema)


def align_recordings(prints: DataFrame, id_col: str, least_votes: int = 4) -> DataFrame:
    """Per row: id, n_frames, n_prints, match_id, offset, votes, bit_error_rate, class_id, n_links.

    A class is all rows with the same samples, named by its smallest id. Two classes link when at one
    offset their frames have equal integers at ``least_votes`` different integers; if either has fewer,
    when all frames of the shorter one equal the other's at one offset. ``n_links`` is the number of
    classes that a class links with, ``votes`` the number of equal frames.

    The match of an exact copy is its class: offset 0, a vote for each print, no errors. Else it is the
    linked recording with a smaller id and most votes at one offset (its frame minus the match's), ties by
    the smaller id, then the smaller shift either way, then offset; a recording with enough integers
    does not match one with fewer. The error rate is the share of differing bits along the overlap. Ids
    are integers. Rows without samples are classes of their own, rows with a null id are in none;
    classes whose smallest id is the same do not match one another.

    All pairs that share an integer are counted, so time grows with the square of the rows, by some 50 ns
    for two equal frames, and the shuffle with the number of blocks of 4,000,000 frames.
    """
    stored = materialize(prints.select(F.col(id_col).cast("long").alias("_id"), "n_frames", "prints", "digest"))
    known = "_id is not null and digest is not null"
    classes = materialize(stored.filter(known).groupBy("digest").agg(F.min("_id").alias("class_id"), F.min("prints").alias("prints")))
    groups = classes.filter("size(prints) > 0").groupBy("prints").agg(F.min("class_id").alias("id"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.withColumn("g", F.monotonically_increasing_id()))
    match = F.when(F.col("votes").isNotNull(), F.struct("votes", (-F.col("match_id")).alias("m"), (-F.abs("offset")).alias("s"), (-F.col("offset")).alias("o"), "bit_error_rate"))
    links = _link_groups(groups, least_votes).groupBy("g").agg(F.sum("linked").alias("linked"), F.max(match).alias("best"))
    grouped = classes.filter("size(prints) > 0").join(groups.withColumnRenamed("id", "first_id"), "prints").join(links, "g", "left")
    own = (F.col("class_id") == F.col("first_id")) | (F.col("best.votes") == F.size("prints"))  # else an equal array of an earlier class
    pick = lambda found, equal: F.when(own, found).otherwise(equal)
    of_class = grouped.select(
        "digest",
        "class_id",
        (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        pick(-F.col("best.m"), F.col("first_id")).alias("match_id"),
        pick(-F.col("best.o"), F.lit(0)).alias("offset"),
        pick(F.col("best.votes"), F.size("prints").cast("long")).alias("votes"),
        pick(F.col("best.bit_error_rate"), F.lit(0.0)).alias("bit_error_rate"),
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("match_id", "long"), ("offset", "int"), ("votes", "long"), ("bit_error_rate", "double"))]
    of_class = of_class.unionByName(classes.filter("size(prints) = 0").select("digest", "class_id", F.lit(0).cast("long").alias("n_links"), *none))
    rows = stored.select("_id", "n_frames", F.size("prints").cast("long").alias("n_prints"), "digest")
    first = F.col("_id") == F.col("class_id")
    of_row = lambda name, copy: F.when(first, F.col(name)).otherwise(copy).alias(name)
    found = rows.filter(known).join(of_class, "digest")
    found = found.select("_id", "n_frames", "n_prints", of_row("match_id", F.col("class_id")), of_row("offset", F.lit(0)), of_row("votes", F.col("n_prints")), of_row("bit_error_rate", F.lit(0.0)), "class_id", "n_links")
    alone = rows.filter(f"not ({known})").select("_id", "n_frames", "n_prints", *none, F.col("_id").alias("class_id"), F.when(F.col("_id").isNotNull(), F.lit(0)).cast("long").alias("n_links"))
    return found.unionByName(alone).withColumnRenamed("_id", id_col)
