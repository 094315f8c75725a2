"""Helpers that the corpus operators share: shared scratch tables and vectorised word hashing.

Word hashing works on the UTF-8 buffer of an Arrow string column, so a batch of texts costs a
handful of numpy passes instead of a Python loop over words.  Pieces of the buffer are handled
one after another (``PIECE`` bytes, cut at white space), which keeps memory flat for very long
texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialise

PIECE = 1 << 19
#: Texts that one Arrow batch hands to numpy at most; the rest of the batch follows.
BATCH_TEXTS = 512

_MUL1, _MUL2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: White space of the word contracts: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def measured(df: DataFrame, tag: str, *extra: Column) -> tuple[DataFrame, Row]:
    """``materialise``, with the row count ``n`` and further aggregates taken while the rows are written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), *extra), tag)
    return out, Row(**seen.get)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(columns: Iterable[str], *names: str) -> list[str]:
    """The columns that have none of the names, in any case: two that differ in case alone can not be told apart."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


#: Rows from which a key is joined apart, and the most keys that can have more rows than that.
HOT_ROWS, HOT_KEYS = 256, 100_000


def join_by_key(rows: DataFrame, facts: DataFrame, key: list[str], n: int) -> DataFrame:
    """Inner join of n rows with the facts of their keys, without one task for all rows of a key.

    facts: one row per key, with ``m``, the number of rows that have it.  At most n / t keys have t
    rows or more, so with t = n / HOT_KEYS at least the facts of these keys are few enough to be
    broadcast, and their rows stay where they are; all other keys meet in a shuffle.
    """
    t = max(HOT_ROWS, n // HOT_KEYS)
    hot = F.broadcast(facts.where(F.col("m") >= t))
    cold = rows.join(F.broadcast(facts.where(F.col("m") >= t).select(*key)), key, "left_anti").join(facts.where(F.col("m") < t), key)
    return rows.join(hot, key).unionByName(cold)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on a uint64 array."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MUL1
    x = x ^ (x >> np.uint64(33))
    x = x * _MUL2
    return x ^ (x >> np.uint64(33))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.empty(max(n, PIECE + 4096), np.uint64)
        out[0] = 1
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[name] = have = out
    return have[:n]


def _words_of_piece(data: np.ndarray, begins: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word; ``begins`` marks bytes at which a text begins."""
    gap = separator[data]
    head = ~gap
    head[1:] &= gap[:-1] | begins[1:]
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    tail = ~gap
    tail[:-1] &= gap[1:] | begins[1:]
    ends = np.flatnonzero(tail) + 1
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", _INV, len(data))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MIX[63]), starts


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts in a UTF-8 buffer: their 64-bit hashes, and the word index at which each text begins.

    data: the bytes; offsets: where text i begins and ends (offsets[i], offsets[i + 1]).
    A word is a run of bytes that ``separator`` does not mark; ``lower`` folds A-Z first.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    hashes, places, at = [], [], base
    marks = np.zeros(end - base + 1, bool)
    marks[offsets - base] = True
    while at < end:
        stop = min(end, at + PIECE)
        while stop < end:  # cut where no word goes on: after a separator or where a text begins
            window = slice(at, stop)
            cuts = np.flatnonzero(separator[data[window]] | marks[at - base + 1 : stop - base + 1])
            if len(cuts):
                stop = at + int(cuts[-1]) + 1
                break
            stop = min(end, stop + PIECE)
        piece = data[at:stop]
        h, s = _words_of_piece(_LOWER[piece] if lower else piece, marks[at - base : stop - base], separator)
        hashes.append(h)
        places.append(s + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    s = np.concatenate(places) if places else np.empty(0, np.int64)
    return h, np.searchsorted(s, offsets)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = words[:m] * _MIX[0]
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) + words[k : k + m] * _MIX[k]
    return mix(out + np.uint64(n))


def buffers(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column as (first row, UTF-8 bytes, offsets); nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    for first in range(0, len(column), BATCH_TEXTS):
        part = column.slice(first, BATCH_TEXTS)
        _, where, raw = part.buffers()
        offsets = np.frombuffer(where, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        yield first, data, offsets
