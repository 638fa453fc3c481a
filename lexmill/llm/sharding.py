"""Sharding by histogram sort: equal bytes per shard after one exchange.

Rows are ordered by a composite key: a hash of the group (equal texts), a hash of the id, the row
number. Splitters are found by rounds: each round counts, in one distributed aggregation, the
exact bytes between candidate boundaries (probes), keeps the probe interval that holds each
target, and probes inside it. A splitter is final when the bytes below it are within the
tolerance. The driver sees at most (shards x probes) counts a round. Only when all splitters are
known do rows move, once.

A boundary prefers the edge of a group; a group that is larger than the tolerance allows (a text
that a third of all rows share) is cut by the second part of the key, so it can't unbalance a
shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import materialize

#: Keys are hashes cut to 62 bits, so that differences and steps stay within a long.
_TOP = (1 << 62) - 1
_LEVELS = ("_hs_k0", "_hs_k1", "_hs_k2")


@dataclass(frozen=True)
class _Open:
    """An interval that still holds a target: keys ``lo``..``hi`` at the level after ``prefix``."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    below: int


def _inside(interval: _Open) -> Column:
    level = len(interval.prefix)
    condition = F.col(_LEVELS[level]).between(interval.lo, interval.hi)
    for name, value in zip(_LEVELS, interval.prefix):
        condition = condition & (F.col(name) == F.lit(value))
    return condition


def _probe(rows: DataFrame, intervals: list[_Open], probes: int) -> dict[int, list]:
    """Exact bytes, smallest and largest key of every non-empty bin of every interval."""
    which, bin_, key = None, None, None
    for i, interval in enumerate(intervals):
        step = (interval.hi - interval.lo) // probes + 1
        level = F.col(_LEVELS[len(interval.prefix)])
        inside, bin_of = _inside(interval), F.floor((level - F.lit(interval.lo)) / F.lit(step)) if step == 1 else F.expr(f"({_LEVELS[len(interval.prefix)]} - {interval.lo}L) div {step}L")
        which = F.when(inside, i) if which is None else which.when(inside, i)
        bin_ = F.when(inside, bin_of.cast("long")) if bin_ is None else bin_.when(inside, bin_of.cast("long"))
        key = F.when(inside, level) if key is None else key.when(inside, level)
    found = (
        rows.select(which.alias("i"), bin_.alias("b"), key.alias("k"), "_hs_size")
        .filter("i is not null")
        .groupBy("i", "b")
        .agg(F.sum("_hs_size").alias("bytes"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        .collect()  # at most len(intervals) * probes rows
    )
    bins: dict[int, list] = {i: [] for i in range(len(intervals))}
    for row in sorted(found, key=lambda r: (r["i"], r["b"])):
        bins[row["i"]].append(row)
    return bins


def find_splitters(rows: DataFrame, total: int, shards: int, tolerance: float, probes: int) -> list[tuple[int, ...]]:
    """Composite keys; the rows of shard ``s`` are those with exactly ``s`` splitters at or below."""
    targets = {s: total * s // shards for s in range(1, shards)}
    allowed = max(1, int(tolerance * total / shards))
    waiting: dict[int, _Open] = dict.fromkeys(targets, _Open((), 0, _TOP, 0))
    splitters: dict[int, tuple[int, ...]] = {}
    while waiting:
        intervals = list(dict.fromkeys(waiting.values()))
        bins = _probe(rows, intervals, probes)
        for s, interval in list(waiting.items()):
            below, edge = interval.below, None
            for found in bins[intervals.index(interval)]:
                left, right = targets[s] - below, below + found["bytes"] - targets[s]
                if right < 0:
                    below += found["bytes"]
                    continue
                single = found["lo"] == found["hi"]
                last = single and len(interval.prefix) == len(_LEVELS) - 1
                if min(left, right) <= allowed or last:
                    edge = (*interval.prefix, found["lo"] if left <= right else found["hi"] + 1)
                elif single:
                    waiting[s] = _Open((*interval.prefix, found["lo"]), 0, _TOP, below)
                else:
                    waiting[s] = _Open(interval.prefix, found["lo"], found["hi"], below)
                break
            else:
                edge = (*interval.prefix, interval.hi + 1)
            if edge is not None:
                splitters[s] = edge
                del waiting[s]
    return [splitters[s] for s in sorted(splitters)]


def _at_or_above(splitter: tuple[int, ...]) -> Column:
    """Whether a row's composite key is at or above ``splitter`` (missing parts: the lowest)."""
    condition = F.lit(True)
    for name, value in reversed(list(zip(_LEVELS, splitter))):
        equal = (F.col(name) == F.lit(value)) & condition
        condition = (F.col(name) > F.lit(value)) | equal
    return condition


def shard_by_bytes(
    df: DataFrame,
    size_col: str,
    group_col: str,
    id_col: str,
    shards: int,
    tolerance: float = 0.005,
    probes: int = 64,
    lanes: int = 64,
) -> DataFrame:
    """``df`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``size_col`` holds each row's bytes (null or negative: 0), ``group_col`` what keeps rows
    together where balance allows, ``id_col`` the order inside a group. Each boundary is within
    ``tolerance`` of a mean shard, or at the nearest single row when one row is larger than
    that. ``lanes`` tasks number the slots of a shard in parallel. Nulls are ordinary values,
    repeated rows count one by one, an empty table gives an empty result and columns of any
    other name (also ``shard`` or ``slot``, which are replaced) pass through, but for names that
    begin with ``_hs_``, which are the operator's own.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    columns = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    cut = lambda c: F.shiftrightunsigned(c, 2)
    rows = materialize(
        df.select(
            *[F.col(f"`{c}`") for c in columns],
            cut(F.xxhash64(F.col(group_col))).alias("_hs_k0"),
            cut(F.xxhash64(F.lit(7), F.col(id_col))).alias("_hs_k1"),
            F.monotonically_increasing_id().alias("_hs_k2"),
            F.greatest(F.lit(0), F.coalesce(F.col(size_col), F.lit(0))).cast("long").alias("_hs_size"),
        )
    )
    total = rows.agg(F.sum("_hs_size")).first()[0] or 0
    splitters = find_splitters(rows, total, shards, tolerance, probes) if total else []
    shard = sum((_at_or_above(s).cast("int") for s in splitters), F.lit(0)).alias("shard")
    placed = rows.withColumn("shard", shard).withColumn("_hs_lane", F.pmod(F.xxhash64("_hs_k2"), F.lit(lanes)).cast("int"))
    # At most shards * lanes rows: how many rows of the shard are in the lanes before.
    before = Window.partitionBy("shard").orderBy("_hs_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_hs_lane")
        .agg(F.count(F.lit(1)).alias("_hs_n"))
        .select("shard", "_hs_lane", F.coalesce(F.sum("_hs_n").over(before), F.lit(0)).alias("_hs_first"))
    )
    within = F.row_number().over(Window.partitionBy("shard", "_hs_lane").orderBy(*_LEVELS))
    numbered = placed.withColumn("_hs_in", within)
    return numbered.join(F.broadcast(offsets), ["shard", "_hs_lane"]).select(
        *[F.col(f"`{c}`") for c in columns], F.col("shard").cast("int").alias("shard"), (F.col("_hs_first") + F.col("_hs_in") - 1).cast("long").alias("slot")
    )
