"""Substring dedup: passages that a smaller doc_id has too, found by compressed FM-indexes, one for each shard.

A window is ``window`` consecutive words of a document.  A word goes if a window that covers it also starts in a
document with a smaller doc_id.  Steps, all distributed:

1. One pass over the texts gives each text's digest and its anchors.  The anchor of a window is the smallest
   hash of its runs of six words, so equal windows have equal anchors, and neighbouring windows mostly
   share one.  Equal texts are one class from here on (grouped by SHA-256, combined on the map side): only
   its smallest id has to be judged, all words of the other copies that have a window go.
2. Anchors that texts of one id alone hold can not matter.  For the others the texts are fetched, one of
   each class, and cut into passages: up to eight consecutive windows with one anchor.  Passages of equal words are
   one, with the smallest and largest id that holds them.
3. Passages are dealt to shards by their anchor, so windows that are equal meet in a shard, whatever documents
   they are in.  An anchor with very many passages is dealt to many shards by the hash of each window.
4. A shard becomes an FM-index: the last column of its sorted suffixes (by their first 16 words, which is
   all that patterns of 13 words look at) in a wavelet matrix of bit vectors with rank directories, and a
   second one over the suffixes' smallest ids.  Its passages are streamed through it: backward search from
   each word gives the matching statistic, how many words back the shard has more than once (up to the window);
   where that reaches the window, a range minimum of the second matrix gives the smallest id that has it.
5. These minima go back to the passages of each document (a passage that many documents hold is joined
   apart, ``common.join_by_key``), and the words that windows with smaller ids cover are taken out.

Defined cases: null and empty texts have no words; texts below ``window`` words lose nothing; very long
texts are worked on whole; rows that repeat an id are documents of one id, so that none of
them is smaller than another; rows without an id count as the largest id; windows are judged on the
input; an empty table gives no rows.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise
from .common import buffers, hash_words, join_by_key, measured, ngram_hashes, table

WINDOW = 13
#: Words of an anchor, and windows of a passage at most.
GRAM, RUN = 6, 8
#: Words of a shard about; an anchor with more than a quarter of a shard is dealt to several.
SHARD_WORDS, LEAST_WORDS = 400_000, 4096
#: Digests that may be broadcast to pick texts (32 bytes each), and anchors and numbers of texts (8 bytes each);
#: beyond that the joins shuffle.
BROADCAST_DIGESTS, BROADCAST_ANCHORS = 500_000, 2_000_000
_LAST = (1 << 63) - 1
_GAPS = re.compile(rb"[ \t\n\r\x0b\x0c]+")
_EMPTY = hashlib.sha256(b"").hexdigest()


class Wavelet:
    """A wavelet matrix: one bit vector with a rank directory for each bit of the values."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint32)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels = []
        for b in reversed(range(self.bits)):
            bit = (values >> np.uint32(b) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.pad(packed, (0, 8 + -len(packed) % 8)).view("<u8")
            self.levels.append((b, words, np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)], len(values) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])
        every = np.arange(1 << self.bits) if self.bits <= 20 else None
        self.first = self._down(every, np.zeros(len(every), np.int64)) if every is not None else None

    @staticmethod
    def _ones(words: np.ndarray, rank: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Set bits before place i."""
        w = i >> 6
        return rank[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, words, rank, zeros in self.levels:
            one = self._ones(words, rank, i)
            i = np.where(c >> b & 1, zeros + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i values are c."""
        first = self.first[c] if self.first is not None else self._down(c, np.zeros(len(c), np.int64))
        return self._down(c, i) - first

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest value in places lo to hi (not included); no range is empty."""
        value = np.zeros(len(lo), np.int64)
        for b, words, rank, zeros in self.levels:
            one_lo, one_hi = self._ones(words, rank, lo), self._ones(words, rank, hi)
            low = hi - one_hi > lo - one_lo
            value |= np.where(low, 0, 1 << b)
            lo, hi = np.where(low, lo - one_lo, zeros + one_lo), np.where(low, hi - one_hi, zeros + one_hi)
        return value


class FMIndex:
    """Backward search over passages: ``words`` are ids from 1, ``sizes`` their numbers, ``owner`` a number for each passage."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, owner: np.ndarray):
        n = len(words) + len(sizes)
        self.begin = np.cumsum(sizes + 1) - sizes - 1  # a zero stands behind each passage
        self.text = np.zeros(n, np.int64)
        self.text[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = words
        rank, length = self.text, 1
        while length < 16:  # prefix doubling
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - length)] = rank[length:] + 1
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1]
            length *= 2
        suffix = np.argsort(rank, kind="stable")
        self.last = Wavelet(self.text[suffix - 1])
        self.below = np.r_[0, np.cumsum(np.bincount(self.text))]
        self.owners, of = np.unique(owner, return_inverse=True)
        self.holders = Wavelet(of[np.repeat(np.arange(len(sizes)), sizes + 1)[suffix]])

    def statistics(self, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place, how many of the ``most`` words that end there the index has more than once, and their suffixes (lo, hi)."""
        c = self.text[ends - 1]
        lo, hi = self.below[c], self.below[c + 1]
        length, out_lo, out_hi = np.zeros(len(ends), np.int64), lo.copy(), hi.copy()
        open_ = np.flatnonzero(hi - lo > 1)
        lo, hi = lo[open_], hi[open_]
        for k in range(1, most + 1):
            length[open_], out_lo[open_], out_hi[open_] = k, lo, hi
            if k == most or not len(open_):
                break
            c = self.text[ends[open_] - 1 - k]
            lo, hi = self.below[c] + self.last.rank(c, lo), self.below[c] + self.last.rank(c, hi)
            on = hi - lo > 1
            open_, lo, hi = open_[on], lo[on], hi[on]
        return length, out_lo, out_hi

    def smallest_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.owners[self.holders.smallest(lo, hi)]


def _plain(text: bytes) -> bytes:
    """Words joined by one space."""
    return b" ".join(text.split()) if len(text) < 1 << 20 else _GAPS.sub(b" ", text).strip(b" \t\n\r\x0b\x0c")


def _anchors(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, anchor) of each window of some texts; text i has the words first[i] to first[i + 1]."""
    low = ngram_hashes(words, gram)
    width, have = window - gram + 1, 1  # runs of a window, and those that ``low`` is the smallest of
    while have < width and len(low) > have:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    windows = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    return text, place, low[first[text] + place].view(np.int64)


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts of a buffer with their words joined by one space, and where each begins and ends."""
    plain = [_plain(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return b"".join(plain), np.cumsum([0, *map(len, plain)])


def _order(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(_LAST))


def _read(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def _scan(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, digest, n_words, the digest of all words, and the distinct anchors of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in buffers(batch.column(2)):
                words, first = hash_words(data, offsets, lower=False)
                n = len(offsets) - 1
                plain, edge = _joined(data, offsets)
                sha = [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                text, _, anchor = _anchors(words, first, window, gram)
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])][: len(text)]
                text, anchor = text[new], anchor[new]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.array(anchor))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(first).astype(np.int64)), pa.array(sha), lists], ["doc_id", "digest", "n_words", "sha", "anchors"])

    return _read(docs).mapInArrow(run, "doc_id long, digest binary, n_words long, sha string, anchors array<long>")


def _passages(near: DataFrame, window: int, gram: int) -> DataFrame:
    """c, o, start, windows, h, content: the passages of texts at the anchors that other ids hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in buffers(batch.column(2)):
                n = len(offsets) - 1
                c, o = (batch.column(i).to_numpy()[row : row + n] for i in (0, 1))
                plain, edge = _joined(data, offsets)
                whole = np.frombuffer(plain, np.uint8)
                words, first = hash_words(whole, edge, lower=False)
                starts = np.flatnonzero(whole == 32) + 1
                starts = np.insert(starts, np.searchsorted(starts, edge[:-1][np.diff(first) > 0]), edge[:-1][np.diff(first) > 0])
                ends = np.r_[starts[1:], len(whole) + 1] - 1  # the space behind, which the last word of a text has not
                ends[first[1:][np.diff(first) > 0] - 1] += 1
                ends[-1:] = len(whole)
                text, place, anchor = _anchors(words, first, window, gram)
                # an anchor that one of the texts shares, all share
                shared = np.isin(anchor, pc.list_flatten(batch.column(3).slice(row, n)).to_numpy(zero_copy_only=False))
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])][: len(text)]
                begin = np.flatnonzero(new)
                new |= (np.arange(len(anchor)) - np.repeat(begin, np.diff(np.r_[begin, len(anchor)]))) % RUN == 0
                begin = np.flatnonzero(new)
                size = np.diff(np.r_[begin, len(anchor)])
                keep = shared[begin]
                begin, size = begin[keep], size[keep]
                for k in range(0, len(begin), 1 << 16):
                    s, m = begin[k : k + (1 << 16)], size[k : k + (1 << 16)]
                    head = first[text[s]] + place[s]
                    content = [plain[a:b] for a, b in zip(starts[head].tolist(), ends[head + m + window - 2].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[text[s]]), pa.array(o[text[s]]), pa.array(place[s]), pa.array(m.astype(np.int32)), pa.array(anchor[s]), pa.array(content, pa.binary()).cast(pa.string())],
                        ["c", "o", "start", "windows", "h", "content"],
                    )

    return near.select("c", "o", "text", "hs").mapInArrow(run, "c long, o long, start long, windows int, h long, content string")


def _dealt(contents: DataFrame, words: int, window: int, scratch: list[DataFrame]) -> DataFrame:
    """Passages with their shard, and the windows to look at there as bits."""
    spark = contents.sparkSession
    shards = max(-(-words // SHARD_WORDS), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = max(LEAST_WORDS, words // shards // 4)
    sizes = contents.groupBy("h").agg(F.sum(F.col("windows") + (window - 1)).alias("words")).where(F.col("words") > most)  # at most 4 a shard, by counting
    large, some = measured(sizes, "repeat-large")
    scratch.append(large)
    large = F.broadcast(large) if some.n <= BROADCAST_ANCHORS else large
    contents = contents.withColumnRenamed("m", "rows")
    columns = ["h", "k", "lo", "hi", "rows", "content"]
    one = contents.join(large, "h", "left_anti").select(*columns, F.lit((1 << RUN) - 1).alias("look"), F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    # lo, hi and the keys stay as they are; part numbers go through a hash with h, so the parts of an anchor lie anywhere
    many = contents.join(large, "h").select(*columns, F.ceil(F.col("words") * RUN / most).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(6).to_numpy()
            for first, data, offsets in buffers(batch.column(5)):
                words, at = hash_words(data, offsets, lower=False)
                every = ngram_hashes(words, window)
                rows, part, look = [], [], []
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), first):
                    own = (every[a : b - window + 1] % np.uint64(parts[r])).astype(np.int64)
                    for p in np.unique(own).tolist():
                        rows.append(r)
                        part.append(p)
                        look.append(int((1 << np.flatnonzero(own == p)).sum()))
                chosen = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(chosen) for i in range(6)), pa.array(look, pa.int32()), pa.array(part, pa.int64())], [*columns, "look", "part"])

    spread = many.mapInArrow(run, "h long, k long, lo long, hi long, rows long, content string, look int, part long")
    return one.unionByName(spread.withColumn("shard", F.pmod(F.xxhash64("h", "part"), F.lit(shards))).drop("part"))


def _searched(dealt: DataFrame, window: int) -> DataFrame:
    """(h, k, m, minima): the smallest id that has each window of a passage, where that is below the largest that has the passage."""

    def run(shard: pa.Table) -> pa.Table:
        words = pc.split_pattern(shard.column("content").combine_chunks(), " ")
        sizes = pc.list_value_length(words).to_numpy().astype(np.int64)
        lo, hi, look = (shard.column(c).to_numpy() for c in ("lo", "hi", "look"))
        index = FMIndex(words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1, sizes, lo)
        windows = sizes - window + 1
        passage = np.repeat(np.arange(len(sizes)), windows)
        place = np.arange(len(passage)) - np.repeat(np.cumsum(windows) - windows, windows)
        own = (look[passage] >> place & 1).astype(bool)
        passage, place = passage[own], place[own]
        length, a, b = index.statistics(index.begin[passage] + place + window, window)
        low = lo[passage].copy()
        hit = length == window
        low[hit] = index.smallest_owner(a[hit], b[hit])
        useful = low < hi[passage]
        minima = np.full((len(sizes), RUN), _LAST)
        minima[passage[useful], place[useful]] = low[useful]
        rows = np.unique(passage[useful])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, RUN * len(rows) + 1, RUN, dtype=np.int32)), pa.array(minima[rows].ravel()))
        some = shard.take(pa.array(rows))
        return pa.table({"h": some.column("h"), "k": some.column("k"), "m": some.column("rows"), "minima": lists})

    return dealt.groupBy("shard").applyInArrow(run, "h long, k long, m long, minima array<long>")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(c, n_removed, kept) from the windows that go: c, text, found (start of a passage, its windows as bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for c, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                plain = _plain(text.as_buffer().to_pybytes())
                data = np.frombuffer(plain, np.uint8)
                edge = np.r_[0, np.flatnonzero(data == 32) + 1, len(data) + 1]
                start, bits = (found.values.field(i).to_numpy() for i in (0, 1))
                step = np.zeros(len(edge), np.int64)
                for i in range(RUN):
                    at = start[bits >> i & 1 == 1] + i
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                stays = np.repeat(~gone, np.diff(edge))[: len(data)]  # a word with the space behind it
                kept = data[stays].tobytes()
                out.append((c, int(gone.sum()), hashlib.sha256(kept.rstrip(b" ")).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["c", "n_removed", "kept"])

    return texts.mapInArrow(run, "c long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    if not GRAM <= window <= 16:
        raise ValueError("a window has 6 to 16 words")
    scanned = _scan(docs, window, GRAM).groupBy("digest").agg(F.min(_order("doc_id")).alias("o"), F.count("*").alias("m"), F.first("n_words").alias("n_words"), F.first("sha").alias("sha"), F.first("anchors").alias("anchors"))
    scanned = scanned.withColumn("c", F.monotonically_increasing_id())
    classes, all_ = measured(scanned, "repeat-classes", F.sum(F.size("anchors")).alias("anchors"), F.sum("m").alias("rows"))
    held = classes.select("c", "o", F.explode("anchors").alias("h"))
    shared = held.groupBy("h").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("h", "m")
    shared, anchors = measured(shared, "repeat-anchors")
    mine = held.select("c", "h")
    mine = mine.join(F.broadcast(shared.select("h")), "h") if anchors.n <= BROADCAST_ANCHORS else join_by_key(mine, shared, ["h"], all_.anchors or 0)
    wanted = mine.groupBy("c").agg(F.collect_list("h").alias("hs"))
    wanted, some = measured(wanted.join(classes.select("c", "o", "digest"), "c"), "repeat-wanted")
    digests = wanted.select("digest")
    texts = _read(docs).select("digest", "text").join(F.broadcast(digests) if some.n <= BROADCAST_DIGESTS else digests, "digest", "left_semi")
    near = materialise(texts.groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest").select("c", "o", "text", "hs"), "repeat-texts")
    for old in (shared, wanted):
        discard(old)
    passages = _passages(near, window, GRAM).withColumn("k", F.xxhash64("content"))  # cut twice, rather than written
    contents = passages.groupBy("h", "k").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.count("*").alias("m"), F.first("windows").alias("windows"), F.first("content").alias("content"))
    contents, size = measured(contents, "repeat-contents", F.sum(F.col("windows") + (window - 1)).alias("words"), F.sum("m").alias("rows"))
    scratch = [contents]
    found = materialise(_searched(_dealt(contents, size.words or 0, window, scratch), window), "repeat-found")
    for old in scratch:
        discard(old)
    bits = sum((F.when(F.get("minima", F.lit(i)) < F.col("o"), 1 << i).otherwise(0) for i in range(RUN)), F.lit(0))
    gone = join_by_key(passages.select("c", "o", "start", "h", "k"), found, ["h", "k"], size["rows"] or 0).select("c", "start", bits.alias("bits")).where("bits > 0")
    gone, touched = measured(gone.groupBy("c").agg(F.collect_list(F.struct("start", "bits")).alias("found")), "repeat-gone")
    texts = near.select("c", "text")
    if touched.n <= BROADCAST_ANCHORS:
        texts = texts.join(F.broadcast(gone.select("c")), "c", "left_semi")
    cut = materialise(_cut(texts.join(gone, "c"), window), "repeat-cut")
    for old in (near, found, gone):
        discard(old)
    facts = classes.select("c", "digest", "o", "m", "n_words", "sha").join(cut, "c", "left").drop("c")
    rows = join_by_key(_read(docs).select("doc_id", "digest"), facts, ["digest"], all_.rows or 0)
    copy = (F.col("n_words") >= window) & (_order("doc_id") > F.col("o"))
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op11_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without the windows of 13 words that smaller ids have."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op11_fm_index": op11_fm_index}
ORACLES: dict[str, str] = {}
