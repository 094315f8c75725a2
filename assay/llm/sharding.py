"""Sharding by histogram sort: shards of near-equal bytes, equal texts together.

Rows are ordered by a 63-bit key: 40 bits of the text's hash, then 23 bits of the row's hash.
Equal texts (groups) are neighbours.  The splitters between shards are found by counting, never by
sampling: each round broadcasts probes (candidate keys), every task counts the exact bytes and rows
between them, and the probes of the next round are spread over the intervals that still hold a
splitter, until all are settled.  Then the rows are exchanged once.

A splitter falls between groups.  A group of up to a shard's bytes is never cut: where it lies
across a splitter, and neither of its ends is within ``group_tolerance`` of the target, it is taken
out of the order and given to the shard with most room; the other rows of that shard get less room,
and all targets move accordingly.  This goes on until no splitter hurts; at most ``FLOATS`` groups a
shard are moved so (a few numbers each, on the driver), after that the nearer end of the group is
the splitter.  A single text is moved in the same way if the gap is ``SINGLE`` times as large.  Only a
group larger than a shard is cut, within ``tolerance`` of the target.

Law: ``bytes`` - each shard has its share of all bytes, up to 2 * SINGLE * ``group_tolerance``, more
only where a table has so few texts that most of them are larger than that.
Shards are built from ``fine`` slices each, so that a shard larger than a task's memory is sorted
by several tasks; slots are numbered through the slices with one row count per slice.  A group that is
moved has slices of its own, about ``SLICE_ROWS`` rows each, by the row's bits of the key.

Defined cases: a null text is the empty text (16 bytes); very long texts are one row like any other,
and may make a shard larger than its share; an empty table gives no rows; fewer rows than shards
leave shards empty; rows with equal ids and texts are interchangeable and follow each other in any
order (ties of the key go by doc_id); null ids are ids like others; only doc_id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise
from .common import table

SHARDS = 40
OVERHEAD = 16
#: Bits of the key that tell rows of one text apart.
ROW_BITS = 23
GROUP = 1 << ROW_BITS
TOP = 1 << 63
FIRST_PROBES, NEXT_PROBES = 8192, 32
#: Groups of equal texts that may be moved, for each shard.
FLOATS = 16
SINGLE = 3
#: Bytes that one slice of a shard should hold, and the most slices of a shard.
SLICE_BYTES, MOST_SLICES = 256 << 20, 512
#: Rows of one slice of a group that is moved.
SLICE_ROWS = 1_000_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of each row."""
    text = F.coalesce("text", F.lit(""))
    group = F.xxhash64(text).bitwiseAND(F.lit((1 << 40) - 1))
    row = F.xxhash64("doc_id", text, F.lit("row")).bitwiseAND(F.lit(GROUP - 1))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.shiftleft(group, ROW_BITS).bitwiseOR(row).alias("key"))


class Counts(NamedTuple):
    """What lies below each probe, and the first and last key of each interval between probes (one more)."""

    size: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    last: np.ndarray


def count_below(keys: DataFrame, probes: np.ndarray, moved: np.ndarray) -> Counts:
    """Exact bytes and rows with a key below each probe, without the groups that are moved."""
    sent = keys.sparkSession.sparkContext.broadcast((probes, moved))
    most = len(probes) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, out = sent.value
        size, rows = np.zeros(most, np.int64), np.zeros(most, np.int64)
        first, last = np.full(most, TOP - 1), np.full(most, -1)
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(out):
                stays = ~np.isin(key >> ROW_BITS, out)
                key, n = key[stays], n[stays]
            at = np.searchsorted(edges, key, "right")
            rows += np.bincount(at, minlength=most)
            size += np.bincount(at, n, most).astype(np.int64)
            np.minimum.at(first, at, key)
            np.maximum.at(last, at, key)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, size[some], rows[some], first[some], last[some])], ["at", "size", "n", "first", "last"])

    size, rows = np.zeros(most, np.int64), np.zeros(most, np.int64)
    first, last = np.full(most, TOP - 1), np.full(most, -1)
    found = keys.select("key", "size").mapInArrow(run, "at long, size long, n long, first long, last long").groupBy("at").agg(F.sum("size"), F.sum("n"), F.min("first"), F.max("last"))
    for at, *facts in found.collect():  # at most a row for each probe
        size[at], rows[at], first[at], last[at] = facts
    return Counts(np.cumsum(size)[:-1], np.cumsum(rows)[:-1], first, last)


class Group(NamedTuple):
    """A group of equal texts that lies across a splitter."""

    number: int
    size: int
    rows: int


class _Search:
    """The interval that holds one splitter: keys, bytes and rows below either end."""

    def __init__(self, target: float, total: int, rows: int, whole: float):
        self.target, self.whole = target, whole
        self.low, self.high = (0, 0, 0), (TOP, total, rows)

    def narrow(self, key: int, size: int, rows: int) -> None:
        if size <= self.target and key > self.low[0]:
            self.low = (key, size, rows)
        if size >= self.target and key < self.high[0]:
            self.high = (key, size, rows)

    def across(self) -> Group | None:
        """The group between the ends, if it is one that must not be cut."""
        number = self.low[0] // GROUP
        size, rows = self.high[1] - self.low[1], self.high[2] - self.low[2]
        if self.low[0] % GROUP == 0 and self.high[0] == self.low[0] + GROUP and (size <= self.whole or rows == 1):
            return Group(number, size, rows)
        return None

    def gap(self) -> tuple[float, int]:
        """How far the nearer end is from the target, and its key: rows with a key below it come before."""
        return min((abs(e[1] - self.target), e[0]) for e in (self.low, self.high))

    def settled(self, tolerance: float) -> bool:
        """Whether the nearer end will do as the splitter."""
        gap, key = self.gap()
        inside = self.high[0] - self.low[0] <= GROUP
        last = self.high[0] - self.low[0] <= 1 or self.high[2] - self.low[2] <= 1 and inside
        return gap == 0 or last or self.across() is not None or (gap <= tolerance and (inside or key % GROUP == 0))

    def probes(self, n: int) -> set[int]:
        low, high = self.low[0], self.high[0]
        unit = GROUP if high - low > GROUP else 1
        steps = {low + (high - low) * i // (n + 1) // unit * unit for i in range(1, n + 1)} | {low + unit}
        return {s for s in steps if low < s < high}


def search(keys: DataFrame, targets: list[float], wholes: list[float], total: int, rows: int, tolerance: float, moved: np.ndarray) -> list[_Search]:
    """A settled search for each target: rising numbers of bytes below a splitter.  wholes: the largest group that stays whole there."""
    every = [_Search(t, total, rows, w) for t, w in zip(targets, wholes, strict=True)]
    probes = np.unique((np.arange(1, FIRST_PROBES, dtype=np.int64) * (TOP // FIRST_PROBES)) // GROUP * GROUP)
    while True:
        size, n, first, last = count_below(keys, probes, moved)
        for s in every:
            at = int(np.searchsorted(size, s.target, "left"))
            for k in {at - 1, at, int(np.searchsorted(size, s.target, "right")) - 1}:
                if 0 <= k < len(probes):
                    s.narrow(int(probes[k]), int(size[k]), int(n[k]))
            if last[at] >= 0:  # nothing lies between the probes and the outer groups of their interval
                s.narrow(max(int(first[at]) // GROUP * GROUP, int(probes[at - 1]) if at else 0), *((int(size[at - 1]), int(n[at - 1])) if at else (0, 0)))
                s.narrow(min((int(last[at]) // GROUP + 1) * GROUP, int(probes[at]) if at < len(probes) else TOP), *((int(size[at]), int(n[at])) if at < len(probes) else (total, rows)))
        pending = [s for s in every if not s.settled(tolerance)]
        if not pending:
            return every
        probes = np.array(sorted(set().union(*(s.probes(NEXT_PROBES) for s in pending))), np.int64)


class Cuts(NamedTuple):
    edges: list[int]  # rows with a key below edges[i] come before slice i + 1
    moved: dict[int, tuple[int, int]]  # groups out of the order: number to (shard, rows)


def cuts(keys: DataFrame, shards: int, fine: int, tolerance: float, group_tolerance: float) -> Cuts:
    """Splitters of shards * fine slices, and the groups that are moved."""
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not rows or shards * fine == 1:
        return Cuts([TOP - 1] * (shards * fine - 1), {})
    share = total / shards
    room = [share] * shards
    moved: dict[int, tuple[int, int]] = {}
    while True:
        ends = np.r_[0, np.cumsum(room)]
        targets = [ends[i // fine] + room[i // fine] * (i % fine) / fine for i in range(1, shards * fine)]
        wholes = [share if i % fine == 0 else share / fine for i in range(1, shards * fine)]
        found = search(keys, targets, wholes, total, rows, tolerance * share, np.array(sorted(moved), np.int64))
        bound = lambda g: group_tolerance * share * (1 if g.rows > 1 else SINGLE)
        hurt = {g for s in found[fine - 1 :: fine] if (g := s.across()) and s.gap()[0] > bound(g)}
        before = len(moved)
        for g in sorted(hurt, key=lambda g: (-g.size, g.number)):
            to = max(range(shards), key=lambda s: (room[s], -s))
            if len(moved) < FLOATS * shards and room[to] >= g.size:
                moved[g.number] = (to, g.rows)
                room[to] -= g.size
                total, rows = total - g.size, rows - g.rows
        if len(moved) == before:
            return Cuts([int(e) for e in np.maximum.accumulate([min(s.gap()[1], TOP - 1) for s in found])], moved)


def _piece(key: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Which slice of its group a row is in, by the row's bits of the key."""
    return ((key & (GROUP - 1)) * pieces) >> ROW_BITS


def _moved_rows(keys: DataFrame, numbers: np.ndarray, pieces: np.ndarray) -> dict[tuple[int, int], int]:
    """Rows of each slice of the groups that are moved."""
    if not len(numbers):
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            number = np.minimum(np.searchsorted(numbers, key >> ROW_BITS), len(numbers) - 1)
            own = numbers[number] == key >> ROW_BITS
            found, n = np.unique(np.stack([numbers[number[own]], _piece(key[own], pieces[number[own]])]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(n)], ["number", "piece", "n"])

    rows = keys.select("key").mapInArrow(run, "number long, piece long, n long").groupBy("number", "piece").agg(F.sum("n").alias("n"))
    return {(r.number, r.piece): r.n for r in rows.collect()}  # a row for each slice


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.002, group_tolerance: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = sized(docs)
    keys = materialise(rows.select("key", "size"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    fine = int(min(MOST_SLICES, max(1, -(-total // (shards * SLICE_BYTES)))))
    found = cuts(keys, shards, fine, tolerance, group_tolerance)
    edges, numbers = np.array(found.edges, np.int64), np.array(sorted(found.moved), np.int64)
    marks = np.unique(edges)
    below = count_below(keys, marks, numbers).rows if len(marks) else np.empty(0, np.int64)
    pieces = np.array([-(-found.moved[g][1] // SLICE_ROWS) for g in numbers.tolist()], np.int64)
    counted = _moved_rows(keys, numbers, pieces)
    discard(keys)
    starts = [0, *below[np.searchsorted(marks, edges)].tolist()]
    # the groups that were moved to a shard come first, each in slices of its own, and then the shard's slices
    ahead, moved = [0] * shards, []
    for i, number in enumerate(numbers.tolist()):
        shard = found.moved[number][0]
        for piece in range(pieces[i]):
            moved.append((len(starts) + len(moved), shard, ahead[shard]))
            ahead[shard] += counted.get((number, piece), 0)
    slices = [(i, i // fine, ahead[i // fine] + starts[i] - starts[i // fine * fine]) for i in range(len(starts))] + moved
    slices = docs.sparkSession.createDataFrame(slices, "slice int, shard int, before long")
    first = len(edges) + 1 + np.cumsum(pieces) - pieces  # the first slice of each moved group
    sent = docs.sparkSession.sparkContext.broadcast((edges, numbers))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, numbers = sent.value
        for batch in batches:
            key = batch.column(3).to_numpy()
            at = np.searchsorted(edges, key, "right")
            if len(numbers):
                group = key >> ROW_BITS
                number = np.minimum(np.searchsorted(numbers, group), len(numbers) - 1)
                at = np.where(numbers[number] == group, first[number] + _piece(key, pieces[number]), at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "slice"])

    placed = rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(place, "doc_id long, size long, text_crc32 long, key long, slice int")
    placed = placed.withColumn("_n", F.expr("row_number() OVER (PARTITION BY slice ORDER BY key, doc_id)")).join(F.broadcast(slices), "slice")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("_n") - 1).alias("slot"))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_histogram_sort": op5_histogram_sort}
ORACLES: dict[str, str] = {}
