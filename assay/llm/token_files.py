"""Token-id files with directly addressable codes.

File format.  The ids of all documents, in ascending doc_id order, are cut into segments of whole
documents (a segment closes once it has ``SEGMENT`` ids).  Segments are rows of a Parquet dataset
(bucket, part, first_token, n_docs, n_tokens, body), so that any store Spark can write works.
``body`` is little-endian:

    "DAC1" | u32 documents | u64 ids | u32 levels
    i64 doc_id per document | u8 null mark per document | u64 first id per document, and the end
    per level: u64 entries | u8 chunk per entry | continuation bitmap | u32 rank directory

An id is split into 8-bit chunks.  Level 0 has the lowest chunk of every id; a set bit in its
continuation bitmap says that the id goes on in level 1, at the position that the rank (set bits
before it) gives, and so on.  The rank directory holds the rank of every 512th bit, so reading an
id or a range of ids costs a popcount of at most 512 bits per level, and decodes nothing else.

Ids come from the tokenizers library.  Texts are cut where every match of the byte-level split
pattern ends, into words that a space may lead; a bounded memory maps a word to the ids the library
gives for it.  For a tokenizer with other splitting texts go to the library whole.

Defined cases: the string of a special token in a text is that token, as the library has it, and such texts
go to the library whole; null and empty texts have only the end id; very long texts are cut into words window by
window; rows without doc_id come first; rows that repeat an id follow in the order of their texts'
hash (ties are equal texts); every row is written; an empty table gives files without rows; only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path
from .common import mix, table
from .ordered import unsigned, with_buckets

END = 0
SEGMENT = 1 << 18
RANK_BITS = 512
#: Texts that are encoded together, and bytes of them that are cut into words at a time.
BATCH, WINDOW = 2048, 1 << 22
#: Words and ids that a worker remembers, and the bytes of a word that it will not keep.
CACHE_WORDS, CACHE_IDS, LONG_WORD = 1_000_000, 6_000_000, 64


def _levels(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continuation flags) of each level."""
    while True:
        rest = ids >> np.uint32(8)
        more = rest > 0
        yield (ids & np.uint32(255)).astype(np.uint8), more
        if not more.any():
            return
        ids = rest[more]


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The body of a segment."""
    levels = list(_levels(np.asarray(ids, np.uint32)))
    out = [b"DAC1", struct.pack("<IQI", len(doc_ids), len(ids), len(levels))]
    out.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes())
    for chunks, more in levels:
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (RANK_BITS // 8)))
        per = np.bitwise_count(bitmap).reshape(-1, RANK_BITS // 8).sum(axis=1)
        rank = np.concatenate([[0], np.cumsum(per)]).astype("<u4")
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), rank.tobytes()]
    return b"".join(out)


class Segment:
    """Random access to the ids of a packed segment."""

    def __init__(self, body: bytes):
        if body[:4] != b"DAC1":
            raise ValueError("not a token segment")
        docs, self.n_tokens, levels = struct.unpack_from("<IQI", body, 4)
        at = 20
        ids = np.frombuffer(body, "<i8", docs, at)
        null = np.frombuffer(body, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        at += 9 * docs
        self.offsets = np.frombuffer(body, "<u8", docs + 1, at)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", body, at)
            blocks = -(-n // RANK_BITS)
            chunks = np.frombuffer(body, np.uint8, n, at + 8)
            bitmap = np.frombuffer(body, np.uint8, blocks * RANK_BITS // 8, at + 8 + n)
            rank = np.frombuffer(body, "<u4", blocks + 1, at + 8 + n + len(bitmap))
            self.levels.append((chunks, bitmap, rank))
            at += 8 + n + len(bitmap) + 4 * (blocks + 1)

    def _rank(self, level: int, i: int) -> int:
        """Continuation bits before entry i."""
        _, bitmap, rank = self.levels[level]
        block, bits = divmod(i, RANK_BITS)
        from_byte = block * RANK_BITS // 8
        full, odd = divmod(bits, 8)
        n = int(rank[block]) + int(np.bitwise_count(bitmap[from_byte : from_byte + full]).sum())
        return n + (int(bitmap[from_byte + full] & ((1 << odd) - 1)).bit_count() if odd else 0)

    def token(self, i: int) -> int:
        """The i-th id."""
        value = shift = level = 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def tokens(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids from start to stop (not included)."""
        chunks, bitmap, _ = self.levels[level]
        out = chunks[start:stop].astype(np.uint32)
        byte = start // 8
        more = np.flatnonzero(np.unpackbits(bitmap[byte : -(-stop // 8)], bitorder="little")[start - 8 * byte : stop - 8 * byte])
        if len(more):
            first = self._rank(level, start)
            out[more] |= self.tokens(first, first + len(more), level + 1) << np.uint32(8)
        return out


class Words:
    """A bounded memory of words and the ids that stand for them, in numpy and Arrow arrays.

    Words are found by a 64-bit hash in a sorted array, and the text is compared, so an equal hash
    misleads nobody.  Above its bounds the half that was asked for least is forgotten, and long words.
    """

    def __init__(self) -> None:
        self.text = pa.array([], pa.string())
        self.edge = np.zeros(1, np.int64)  # entry i has the ids pool[edge[i] : edge[i + 1]]
        self.pool = np.empty(0, np.uint32)
        self.uses = np.empty(0, np.int32)
        self._index()

    def __len__(self) -> int:
        return len(self.text)

    def _index(self) -> None:
        h = word_hashes(self.text)
        self.order = np.argsort(h, kind="stable").astype(np.int32)
        self.hash = h[self.order]

    def find(self, words: pa.StringArray) -> np.ndarray:
        """The entry of each word, or -1."""
        out = np.full(len(words), -1, np.int64)
        if not len(self) or not len(words):
            return out
        h = word_hashes(words)
        rising = np.argsort(h)
        at = np.searchsorted(self.hash, h[rising])
        at[at == len(self.hash)] = 0
        same = self.hash[at] == h[rising]
        hit, place = rising[same], self.order[at[same]]
        same = pc.equal(self.text.take(pa.array(place)), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        out[hit[same]] = place[same]
        self.uses[place[same]] += 1
        return out

    def add(self, words: pa.StringArray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Append words with ``sizes`` ids each; their entries."""
        h, n = word_hashes(words), len(self)
        self.text = pa.concat_arrays([self.text, words])
        self.edge = np.r_[self.edge, self.edge[-1] + np.cumsum(sizes)]
        self.pool = np.r_[self.pool, ids]
        self.uses = np.r_[self.uses, np.ones(len(words), np.int32)]
        by_hash = np.argsort(h, kind="stable")
        at = np.searchsorted(self.hash, h[by_hash], "right")
        self.hash = np.insert(self.hash, at, h[by_hash])
        self.order = np.insert(self.order, at, (n + by_hash).astype(np.int32))
        return np.arange(n, len(self))

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some entries one after the other, and where each entry's begin and the last one's end."""
        lists = pa.LargeListArray.from_arrays(pa.array(self.edge), pa.array(self.pool)).take(pa.array(entries))
        return lists.flatten().to_numpy(), lists.offsets.to_numpy()

    def trim(self) -> None:
        """Keep to the bounds."""
        if len(self) <= CACHE_WORDS and len(self.pool) <= CACHE_IDS:
            return
        short = np.flatnonzero(pc.binary_length(self.text).to_numpy() <= LONG_WORD)
        keep = np.sort(short[np.argsort(-self.uses[short], kind="stable")[: min(CACHE_WORDS, len(self)) // 2]])
        self.pool, self.edge = (np.array(x) for x in self.ids(keep))
        self.text, self.uses = self.text.take(pa.array(keep)), self.uses[keep] // 2
        self._index()


_POWER = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each of some non-empty strings."""
    if not len(words):
        return np.empty(0, np.uint64)
    _, where, raw = words.buffers()
    edge = np.frombuffer(where, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(edge)
    place = np.arange(edge[0], edge[-1]) - np.repeat(edge[:-1], size)
    byte = np.frombuffer(raw, np.uint8)[edge[0] : edge[-1]].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(byte * _POWER[place & 63], edge[:-1] - edge[0]) + size.astype(np.uint64))


#: White space of the split pattern in ASCII; the control characters 28 to 31 only to be on the safe side.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_CUT = np.zeros(256, bool)
_CUT[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of white space beyond ASCII.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def word_edges(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where the words of a UTF-8 buffer begin: places that no match of the split pattern spans.

    These are the starts of texts (``marks``), white space behind a character that is none, and a
    character that is no white space behind a line feed that is alone: a space is part of the match
    of the word behind it, and such a line feed is a match of its own.
    """
    white = _WHITE[data]
    begin = marks.copy()
    space = np.flatnonzero(_CUT[data[1:]] & ~white[:-1]) + 1
    last = data[space - 1]
    far = np.flatnonzero(last >= 0x80)
    if len(far):  # the character before may be white space beyond ASCII
        p = space[far]
        one, two, three = data[p - 1], data[p - 2], data[np.maximum(p - 3, 0)]
        general = (three == 0xE2) & (((two == 0x80) & ((one <= 0x8B) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))
        odd = general | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
        space = np.delete(space, far[odd])
    begin[space] = True
    feed = np.flatnonzero((data[:-1] == 10) & begin[:-1]) + 1
    begin[feed[~white[feed] & ~_LEAD[data[feed]]]] = True
    return np.flatnonzero(begin)


class PieceEncoder:
    """Ids of texts by the tokenizers library, with a bounded memory of words.

    A window of the texts' bytes is cut into words by numpy; Arrow numbers the distinct ones, so
    the library only sees words that the memory does not hold, some dozens at a time with a line
    feed between them: there it is a match of the split pattern of its own, and its id, which no
    word contains, tells the words' ids apart.  A word of Latin letters with punctuation behind it is two
    matches, so only its letters may be new.  Words with other white space than a leading space,
    and texts for a tokenizer that does not split like this, go to the library whole.
    """

    _space = " \n\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000"
    _plain = f"^ ?[^{_space}]+$"
    _behind = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
    _split = r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[" + re.escape(_behind) + "]+$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        self.added = [t["content"] for t in made["added_tokens"] if t["content"]]
        cut = made["pre_tokenizer"] or {}
        self.by_words = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not any(made[k] for k in ("normalizer", "post_processor", "truncation", "padding")) and not any("\n" in t for t in self.added)
        feed = self._whole(["\n"])[0]
        self.feed = feed[0] if len(feed) == 1 else None
        self.words = Words()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words without white space inside."""
        if self.feed is not None:
            joined = ["\n".join(words[k : k + 32]) for k in range(0, len(words), 32)]
            ids = np.fromiter(chain.from_iterable(x + [self.feed] for x in self._whole(joined)), np.uint32)
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) == len(words):
                return np.diff(ends, prepend=-1) - 1, ids[ids != self.feed]
        found = self._whole(words)
        return np.array([len(x) for x in found], np.int64), np.fromiter(chain.from_iterable(found), np.uint32)

    def _learn(self, new: pa.StringArray) -> np.ndarray:
        """Entries of words that the memory does not hold."""
        place = np.empty(len(new), np.int64)
        plain = pc.match_substring_regex(new, self._plain).to_numpy(zero_copy_only=False)
        split = pc.match_substring_regex(new, self._split).to_numpy(zero_copy_only=False)
        odd, cut, whole = np.flatnonzero(~plain), np.flatnonzero(split), np.flatnonzero(plain & ~split)
        parts = new.take(pa.array(cut))
        base = pc.utf8_rtrim(parts, characters=self._behind)
        tail = _after(parts, base) if len(parts) else base
        asked = pa.concat_arrays([new.take(pa.array(whole)), base, tail]).dictionary_encode()
        have = self.words.find(asked.dictionary)
        gone = np.flatnonzero(have < 0)
        if len(gone):
            some = asked.dictionary.take(pa.array(gone))
            have[gone] = self.words.add(some, *self._ask(some.to_pylist()))
        got = have[asked.indices.to_numpy()]
        place[whole] = got[: len(whole)]
        if len(cut):
            pairs = np.stack([got[len(whole) : len(whole) + len(cut)], got[len(whole) + len(cut) :]], 1).ravel()
            ids, edge = self.words.ids(pairs)
            place[cut] = self.words.add(parts, np.diff(edge[::2]), ids)
        if len(odd):
            some = new.take(pa.array(odd))
            found = self._whole(some.to_pylist())
            place[odd] = self.words.add(some, np.array([len(x) for x in found], np.int64), np.fromiter(chain.from_iterable(found), np.uint32))
        return place

    def _window(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that begin at ``edge[:-1]``, and where each word's begin."""
        words = pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer((edge - edge[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[edge[0] : edge[-1]])))
        numbered = words.dictionary_encode()
        self.words.trim()
        place = self.words.find(numbered.dictionary)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn(numbered.dictionary.take(pa.array(new)))
        return self.words.ids(place[numbered.indices.to_numpy()])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a large_string array without nulls."""
        if not self.by_words:
            return [np.array(x, np.uint32) for x in self._whole(texts.to_pylist())]
        special = np.zeros(len(texts), bool)
        for t in self.added:
            special |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if special.any():  # the library looks for these strings before it splits
            whole = iter(self._whole(texts.filter(pa.array(special)).to_pylist()))
            words = iter(self.encode(texts.filter(pa.array(~special))))
            return [np.array(next(whole), np.uint32) if z else next(words) for z in special.tolist()]
        _, where, raw = texts.buffers()
        offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        at, end, done = 0, len(data), 0
        parts, starts = [], np.zeros(len(offsets), np.int64)
        while at < end:
            size = WINDOW
            while True:  # up to the last word that begins in the window; longer words widen it
                stop = min(at + size, end)
                marks = np.zeros(stop - at, bool)
                inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)]
                marks[inside - at] = True
                marks[0] = True
                edge = word_edges(data[at:stop], marks)
                if stop == end or len(edge) > 1:
                    break
                size *= 2
            edge = np.r_[edge, stop - at] if stop == end else edge
            ids, begin = self._window(data[at:stop], edge)
            own = slice(np.searchsorted(offsets, at), np.searchsorted(offsets, at + edge[-1]))
            starts[own] = done + begin[np.searchsorted(edge, offsets[own] - at)]
            parts.append(ids)
            done += len(ids)
            at += int(edge[-1])
        starts[np.searchsorted(offsets, end) :] = done
        every = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        return [every[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _after(words: pa.StringArray, base: pa.StringArray) -> pa.StringArray:
    """What follows ``base`` in each word."""
    size, all_sizes = pc.binary_length(base).to_numpy(), pc.binary_length(words).to_numpy()
    first = np.cumsum(all_sizes) - all_sizes
    inside = np.arange(all_sizes.sum()) - np.repeat(first, all_sizes) >= np.repeat(size, all_sizes)
    _, where, raw = words.buffers()
    begin = int(np.frombuffer(where, np.int32)[words.offset])
    left = np.frombuffer(raw, np.uint8)[begin : begin + int(all_sizes.sum())][inside]
    edge = np.r_[0, np.cumsum(all_sizes - size)].astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(left)))


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process."""
    return PieceEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SEGMENTS = "bucket int, part int, first_token long, n_docs long, n_tokens long, body binary"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, segment: int = SEGMENT) -> None:
    """Encode every text, append ``end``, and write the segments under ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows, _ = with_buckets(rows, "doc_id", "_tie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("doc_id", "text", "_bucket", unsigned("_tie").alias("_u")).repartition(parts, "_bucket")
    rows = rows.sortWithinPartitions("_bucket", F.col("doc_id").asc_nulls_first(), "_u").select("doc_id", "text", "_bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(tokenizer or default_tokenizer())
        tail = np.array([end], "<u4")
        at = {"bucket": None, "part": 0, "first": 0}
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            ids = np.concatenate([y for _, x in held for y in (x, tail)])
            row = [at["bucket"], at["part"], at["first"], len(held), len(ids), pack([d for d, _ in held], [len(x) + 1 for _, x in held], ids)]
            at["part"], at["first"] = at["part"] + 1, at["first"] + len(ids)
            held, size = [], 0
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["bucket", "part", "first_token", "n_docs", "n_tokens", "body"])

        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                ids, texts, buckets = (batch.column(i).slice(k, BATCH) for i in range(3))
                for doc_id, code, bucket in zip(ids.to_pylist(), pieces.encode(texts.cast(pa.large_string())), buckets.to_pylist(), strict=True):
                    if bucket != at["bucket"]:
                        if held:
                            yield close()
                        at.update(bucket=bucket, part=0, first=0)
                    held.append((doc_id, code))
                    size += len(code) + 1
                    if size >= segment:
                        yield close()
        if held:
            yield close()

    rows.mapInArrow(run, _SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens and its ids, as little-endian u32 bytes.

    digest: the unsigned crc32 of these bytes (``ids_crc32``) in their place.
    """
    files = spark.read.schema(_SEGMENTS).parquet(path)
    sums = sorted(files.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each bucket
    before, starts = 0, []
    for bucket, n in sums:
        starts.append((bucket, before))
        before += n
    starts = spark.createDataFrame(starts, "bucket int, before long")
    placed = files.join(F.broadcast(starts), "bucket").select((F.col("before") + F.col("first_token")).alias("start"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seg = Segment(body.as_buffer().to_pybytes())
                at = seg.offsets.astype(np.int64)
                ids = (seg.tokens(a, b).astype("<u4") for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
                last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array([x.tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def op8_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and write all documents, then read every document's ids from the files."""
    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, digest=True)


QUERIES = {"op8_addressable_codes": op8_addressable_codes}
ORACLES: dict[str, str] = {}
