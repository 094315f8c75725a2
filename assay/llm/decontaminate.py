"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters, digits and bytes above 127, with A-Z folded.  A document and a
benchmark item that share a seed (``least`` words in a row; a shorter item is one seed as a whole) and whose shared seeds could cover
enough of the item become a candidate.  Greedy string tiling then marks the longest common word
runs that overlap no marked run, longest first, down to ``least`` words; the windows of each
length are found by Karp-Rabin hashes over prefix sums and confirmed word by word.  Tiles may come
in any order in the document, so reordered passages count in full.  A document is contaminated by
an item if its tiles cover at least ``share`` of the item's words.

The benchmark is cut into words and seeds by the executors.  If it has at most BROADCAST_WORDS words
(8 bytes each, counted first), it is broadcast with an index of its seeds, and the documents are
only mapped: no shuffle, and a hot document or passage stays in its own row.  A larger benchmark is
never broadcast: the documents' distinct seeds are joined with each item's rarest ones,
and only the candidate pairs are tiled.

Defined cases: null and empty texts have no tiles; very long texts are searched whole; an item of
fewer than ``least`` words contaminates what has all of it in a row, one without words nothing; of equally long runs the
one that begins first in the item, then in the text, is marked first; items and documents that
repeat each report; rows are never dropped by ``find``; ``clean`` keeps a row with a null id unless
it is itself contaminated; an empty benchmark or table gives no matches; other columns of either
table are not read, and stay in ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise
from .common import buffers, hash_words, ngram_hashes, table

LEAST, SHARE = 5, 0.5
#: Words of a benchmark that is broadcast: 8 bytes each, and about 30 for its index on an executor.
BROADCAST_WORDS = 1_000_000

#: Bytes between words: all of ASCII but letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
for _range in ((48, 58), (65, 91), (97, 123)):
    PUNCTUATION[slice(*_range)] = False

_KR = 0xD1342543DE82EF95


def _windows(words: np.ndarray, length: int, prefix: np.ndarray, down: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes and starts of the windows without marked words."""
    at = np.flatnonzero(used[length:] == used[: len(used) - length]) if len(words) >= length else np.empty(0, np.int64)
    return (prefix[at + length] - prefix[at]) * down[at], at


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length) of two arrays of word hashes, longest first."""
    size = max(len(item), len(text)) + 1
    up = np.cumprod(np.r_[np.uint64(1), np.full(size, _KR, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(_KR, -1, 1 << 64), np.uint64)])
    taken = [np.zeros(len(x), bool) for x in (item, text)]
    prefix = [np.r_[np.uint64(0), np.cumsum(x * up[: len(x)])] for x in (item, text)]

    def windows(length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        used = [np.r_[0, np.cumsum(x)] for x in taken]
        return [_windows(x, length, p, down, u) for x, p, u in zip((item, text), prefix, used, strict=True)]

    def mark(length: int) -> list[tuple[int, int, int]]:
        """Mark runs of a length, each window of the item with the first free one of the text; no pairs are listed."""
        (hi, si), (ht, st) = windows(length)
        order = np.argsort(ht, kind="stable")
        low, high = np.searchsorted(ht[order], hi, "left"), np.searchsorted(ht[order], hi, "right")
        at: dict[int, int] = {}  # by the first place of a hash: the first place that may be free
        out = []
        for k in np.flatnonzero(high > low).tolist():
            i, first, end = int(si[k]), int(low[k]), int(high[k])
            own = slice(i, i + length)
            if taken[0][own].any():
                continue
            place = at.get(first, first)
            while place < end and taken[1][(j := int(st[order[place]])) : j + length].any():
                place += 1
            at[first] = place
            if place < end and (item[own] == text[j : j + length]).all():
                taken[0][own] = taken[1][j : j + length] = True
                out.append((i, j, length))
        return out

    tiles, longest = [], min(len(item), len(text))
    while longest >= least:
        low, high = least - 1, longest  # the longest common unmarked run lies in [low, high]
        while low < high:
            mid = (low + high + 1) // 2
            (hi, _), (ht, _) = windows(mid)
            low, high = (mid, high) if np.isin(hi, ht).any() else (low, mid - 1)
        if low < least:
            break
        found = mark(low)
        tiles += found
        longest = low if found else low - 1
    return tiles


class Items:
    """Benchmark items with an index of their seeds, which have ``least`` words."""

    def __init__(self, rows: list[tuple[object, np.ndarray]], least: int):
        self.rows, self.least = rows, least
        grams = [ngram_hashes(w, least) for _, w in rows]
        every = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.seed, self.item, self.place = every[order], item[order], place[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[every & np.uint64((1 << 22) - 1)] = True

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Positions of ``grams`` that are seeds."""
        at = np.flatnonzero(self.maybe[grams & np.uint64((1 << 22) - 1)])
        if not len(at) or not len(self.seed):
            return at[:0]
        found = np.minimum(np.searchsorted(self.seed, grams[at]), len(self.seed) - 1)
        return at[self.seed[found] == grams[at]]

    def judge(self, words: np.ndarray, grams: np.ndarray, hits: np.ndarray, share: float) -> Iterator[tuple[int, int, int]]:
        """(item, tiles, covered words) of each item that reaches the share in one text."""
        seeds = np.unique(grams[hits])
        low, high = np.searchsorted(self.seed, seeds, "left"), np.searchsorted(self.seed, seeds, "right")
        entry = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, hits, 1)
        np.add.at(inside, hits + self.least, -1)
        near = np.cumsum(inside)[:-1] > 0  # words of the text that some seed covers
        edge = np.flatnonzero(np.diff(np.r_[False, near, False].astype(np.int8)))
        rng = mixed_gaps(len(edge))
        parts = []
        for k in range(0, len(edge), 2):
            parts += [words[edge[k] : edge[k + 1]], rng[k : k + 1]]
        text = np.concatenate(parts)
        for i in np.unique(self.item[entry]):
            item = self.rows[i][1]
            cover = np.zeros(len(item), bool)
            for p in self.place[entry[self.item[entry] == i]]:
                cover[p : p + self.least] = True
            if cover.sum() < share * len(item):
                continue
            tiles = tile(item, text, self.least)
            covered = sum(t[2] for t in tiles)
            if covered >= share * len(item):  # of a short item, all
                yield int(i), len(tiles), covered


def mixed_gaps(n: int) -> np.ndarray:
    """Values that stand for the words left out between two stretches; no word hash equals them in practice."""
    return np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, words) of the items that have words, as 64-bit hashes."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in buffers(batch.column(2)):
                words, starts = hash_words(data, offsets, separator=PUNCTUATION)
                own = [words[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
                keep = pa.array([len(w) > 0 for w in own])
                part = batch.slice(first, len(own))
                made = [part.column(0), part.column(1), pa.array([len(w) for w in own], pa.int64()), pa.array([w.tobytes() for w in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["item", "item_id", "n", "words"]).filter(keep)

    return rows.mapInArrow(run, "item long, item_id long, n long, words binary")


_FOUND = "row long, item_id long, n_tiles int, covered int, coverage double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "item_id", "n_tiles", "covered", "coverage"])


def _by_seed(rows: list[tuple[object, np.ndarray]], least: int) -> list[Items]:
    """An index for each length of seeds: ``least``, and what shorter items have."""
    lengths = sorted({min(least, len(w)) for _, w in rows})
    return [Items([r for r in rows if min(least, len(r[1])) == n], n) for n in lengths]


def _small(benchmark: DataFrame, least: int) -> tuple[DataFrame, list[Items] | None]:
    """The items' words as a table, and their indexes if they are few enough to be broadcast."""
    items = materialise(item_words(benchmark), "items")
    if items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] > BROADCAST_WORDS:
        return items, None
    rows = items.select("item_id", "words").collect()  # BROADCAST_WORDS words at most
    discard(items)
    return items, _by_seed([(r["item_id"], np.frombuffer(r["words"], np.uint64)) for r in rows], least)


def _by_join(docs: DataFrame, items: DataFrame, share: float, least: int) -> DataFrame:
    """Matches of (row, text) with the items by a join of their seeds.

    A match needs ``share`` of an item's words under its seeds, so at least q of its T seed places; then it has one of the
    T - q + 1 places whose seeds are rarest among the documents.  Only these are joined into pairs, so
    a seed that most documents and items have makes pairs only where an item has nothing rarer.
    Each candidate document's text is fetched once, with all its candidate items.
    """
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(least))).distinct().collect())  # least rows at most

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in buffers(batch.column(1)):
                words, starts = hash_words(data, offsets, separator=PUNCTUATION)
                for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    own = np.unique(np.concatenate([ngram_hashes(words[a:b], n) for n in lengths])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(0)[first + k].as_py())), pa.array(own)], ["row", "seed"])

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own, times = np.unique(ngram_hashes(np.frombuffer(words, np.uint64), min(least, n)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), item)), pa.array(np.full(len(own), n)), pa.array(times)], ["seed", "item", "n", "times"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row, held = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                for one in _by_seed([(h["item_id"], np.frombuffer(h["words"], np.uint64)) for h in held], least):
                    found = matches([one], batch.column(1).slice(k, 1), share)
                    out += [(row, item[0], tiles, covered, covered / len(item[1])) for _, item, tiles, covered in found]
            yield _found(out)

    known = materialise(items.select("item", "n", "words").mapInArrow(of_items, "seed long, item long, n long, times long"), "item-seeds")
    wanted = known.select("seed").distinct()
    met = materialise(docs.mapInArrow(seeds, "row long, seed long").join(wanted, "seed", "left_semi"), "met-seeds")
    often = met.groupBy("seed").agg(F.count("*").alias("m"))
    rarest = Window.partitionBy("item").orderBy("m", "seed")  # the seeds of one item
    ranked = known.join(often, "seed").withColumn("before", F.sum("times").over(rarest) - F.col("times")).withColumn("total", F.sum("times").over(Window.partitionBy("item")))
    # seeds that no document has are not in ``ranked``: the places that are left must still hold q
    need = F.ceil(F.col("n") * share / F.least("n", F.lit(least)) - 1e-9)
    prefix = ranked.where(F.col("before") <= F.col("total") - need).select("seed", "item")
    pairs = met.join(prefix, "seed").select("row", "item").distinct()  # Spark's skew join splits what is still hot
    gathered = pairs.join(items.select("item", "item_id", "words"), "item").groupBy("row").agg(F.collect_list(F.struct("item_id", "words")).alias("held"))  # the candidates of one text
    return docs.join(gathered, "row").select("row", "text", "held").mapInArrow(tiled, _FOUND)


def find(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, n_tiles, covered, coverage."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, index = _small(benchmark, least)
    if index is None:
        keyed = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "clean-keyed")
        found = _by_join(keyed.select("row", "text"), items, share, least)
        return keyed.select("row", "doc_id").join(found, "row").drop("row")
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, item, tiles, covered in matches(sent.value, batch.column(1), share):
                out.append((batch.column(0)[row].as_py(), item[0], tiles, covered, covered / len(item[1])))
            yield _found(out).rename_columns(["doc_id", "item_id", "n_tiles", "covered", "coverage"])

    return docs.mapInArrow(run, _FOUND.replace("row", "doc_id"))


def matches(indexes: list[Items], texts: pa.Array, share: float) -> Iterator[tuple[int, tuple, int, int]]:
    """(row, item, tiles, covered) of every contaminated text of a column; an item is (item_id, words)."""
    for first, data, offsets in buffers(texts):
        words, starts = hash_words(data, offsets, separator=PUNCTUATION)
        for items in indexes:
            grams = ngram_hashes(words, items.least)
            hits = items.hits(grams)
            if not len(hits):
                continue
            row = np.searchsorted(starts, hits, "right") - 1
            whole = hits + items.least <= starts[row + 1]  # the seed ends in the text where it begins
            hits, row = hits[whole], row[whole]
            for r in np.unique(row):
                a, b = int(starts[r]), int(starts[r + 1])
                for i, tiles, covered in items.judge(words[a:b], grams[a : b - items.least + 1], hits[row == r] - a, share):
                    yield first + int(r), items.rows[i], tiles, covered


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns; judged row by row."""
    items, index = _small(benchmark, least)
    if index is None:
        keyed = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "clean-keyed")
        found = _by_join(keyed.select(F.col("_row").alias("row"), "text"), items, share, least)
        return keyed.join(found.select(F.col("row").alias("_row")).distinct(), "_row", "left_anti").select(docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[m[0] for m in matches(sent.value, batch.column(at), share)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least half of a benchmark item in runs of five words or more."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES: dict[str, str] = {}
