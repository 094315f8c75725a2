"""Cross-tokenizer alignment by interval coalescing.

Tokenizer A (tokenizers library, byte-level) and tokenizer B (sentencepiece) cut the same bytes, a space and
the text.  All A and B tokens are sorted by their first byte (lexsort); a running maximum of their
ends (maximum.accumulate) tells where a group breaks: where a start reaches it, both tokenizers
have ended.  Within a group every A token is linked with every B token.

Both tokenizers begin a token at each space that follows a character which is no white space (A's split pattern
never spans it, and no piece of B has a space behind another character; this is looked up in
the model).  So a text is cut into segments there, a group never crosses a cut, and a segment's
tokens do not depend on its neighbours.  A bounded memory holds the groups of segments already
seen; new ones are encoded and coalesced together, vectorised.  For tokenizers without this property a text is
one segment.

Corpus-wide counts: each task adds up, for each id pair, the documents that hold it linked, and
one shuffle adds up the tasks.  The commonest pairs (``hot_pairs`` at most, whatever the corpus) are
broadcast and scored in place, in a second pass over the texts; links of rarer pairs, the long
tail, are joined with their counts and added up by row.

Defined cases: null and empty texts, and texts whose bytes either tokenizer does not give back, have zeros and
an empty digest; very long texts are worked on window by window; rows that repeat an id or a text
are documents of their own; rows without an id stay; an empty table gives no rows.  Strings
of special tokens are plain text.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise
from .common import join_by_key, measured, table
from .token_files import Words, word_edges

#: Pairs whose counts every task holds: 16 bytes each.
HOT_PAIRS = 2_000_000
#: Bytes of texts that are cut at a time; segments, and links of segments, that a worker remembers.
WINDOW = 1 << 21
MEMORY_SEGMENTS, MEMORY_PAIRS = 400_000, 3_000_000
#: Distinct pairs that a task counts before it hands them on.
COUNTED = 1_000_000


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _binary(values: list[bytes]) -> pa.LargeBinaryArray:
    return pa.array(values, pa.large_binary())


def _joined(entries: pa.LargeBinaryArray, which: np.ndarray, starts: np.ndarray) -> pa.LargeBinaryArray:
    """One value for each run of ``which`` that begins at ``starts[:-1]``: its entries put together."""
    taken = entries.take(pa.array(which))
    _, where, raw = taken.buffers()
    edge = np.frombuffer(where, np.int64)[: len(taken) + 1][starts]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(edge)), raw or pa.py_buffer(b"")])


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all tokens by start, and the group of each in that order; side breaks ties."""
    order = np.lexsort((side, starts))
    top = np.maximum.accumulate(ends[order])
    breaks = np.r_[True, starts[order][1:] >= top[:-1]]
    return order, np.cumsum(breaks) - 1


@dataclass
class Links:
    """What is known of some segments: counts of each, and flat arrays with an edge for each segment."""

    counts: np.ndarray  # n_a, n_b, n_groups, n_links, and 1 if the bytes did not come back
    written: pa.LargeBinaryArray  # the groups as text, each with a semicolon behind
    edge: np.ndarray
    code: np.ndarray  # distinct pairs of each segment
    times: np.ndarray  # and their links


class Aligner:
    """Aligns segments of texts under two tokenizers."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        made = json.loads(self.a.to_str())
        cut = made["pre_tokenizer"] or {}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        safe = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not any(made[k] for k in ("normalizer", "post_processor", "truncation", "padding"))
        self.by_segments = safe and "".join(self.b.encode("x  y", out_type=str)) == "▁x▁▁y" and not any("▁" in p.lstrip("▁") for p in pieces)
        of = _byte_level()
        names = [None] * self.a.get_vocab_size()
        for name, i in self.a.get_vocab().items():
            names[i] = bytes(of[c] for c in name) if all(c in of for c in name) else name.encode()
        self.bytes_a = _binary([n or b"" for n in names])
        self.bytes_b = _binary([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.size_a, self.size_b = (pc.binary_length(x).to_numpy() for x in (self.bytes_a, self.bytes_b))
        self.n_a, self.n_b = len(names), len(pieces)
        ids = range(max(self.n_a, self.n_b))
        self.decimals = _binary([b"%d%c" % (i, c) for c in b",|;" for i in ids])
        self.space = self.b.piece_to_id("▁")
        self.forgotten = 0
        self.forget()

    def forget(self) -> None:
        self.forgotten += 1
        self.words = Words()
        self.links = Links(np.empty((5, 0), np.int64), _binary([]), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def align(self, segments: list[str]) -> Links:
        """Segments begin with a space."""
        n = len(segments)
        ids = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)], [x if s != " " else [self.space] for s, x in zip(segments, self.b.encode([s[1:] for s in segments], num_threads=1), strict=True)]
        count = [np.fromiter(map(len, x), np.int64, n) for x in ids]
        flat = [np.fromiter(chain.from_iterable(x), np.int64, int(c.sum())) for x, c in zip(ids, count, strict=True)]
        raw = _binary([s.encode() for s in segments])
        back = [pc.equal(_joined(t, f, np.r_[0, np.cumsum(c)]), raw).to_numpy(zero_copy_only=False) for t, f, c in zip((self.bytes_a, self.bytes_b), flat, count, strict=True)]
        good = back[0] & back[1]
        flat = [f[np.repeat(good, c)] for f, c in zip(flat, count, strict=True)]
        count = [np.where(good, c, 0) for c in count]
        sizes = [t[f] for t, f in zip((self.size_a, self.size_b), flat, strict=True)]
        ends = np.concatenate([np.cumsum(s) for s in sizes])  # segments follow each other, so offsets go on
        every, side = np.concatenate(flat), np.repeat([0, 1], [len(f) for f in flat])
        owner = np.concatenate([np.repeat(np.arange(n), c) for c in count])
        if not len(every):
            return Links(np.vstack([np.zeros((4, n), np.int64), ~good]), _binary([b""] * n), np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        order, group = coalesce(ends - np.concatenate(sizes), ends, side)
        by_side = np.lexsort((side[order], group))  # within a group the A tokens first; stable
        every, side, owner, group = every[order][by_side], side[order][by_side], owner[order][by_side], group[by_side]
        groups = int(group[-1]) + 1
        in_group = [np.bincount(group[side == k], minlength=groups) for k in (0, 1)]
        of_group = owner[np.searchsorted(group, np.arange(groups))]
        links = np.bincount(of_group, in_group[0] * in_group[1], n).astype(np.int64)
        mark = np.where(np.r_[group[1:] != group[:-1], True], 2, np.where(np.r_[side[1:] != side[:-1], True], 1, 0))
        text = _joined(self.decimals, mark * (len(self.decimals) // 3) + every, np.searchsorted(owner, np.arange(n + 1)))
        code, times, whose = self._pairs(every, side, group, of_group)
        counts = np.vstack([*count, np.bincount(of_group, minlength=n), links, ~good])
        return Links(counts, text, np.searchsorted(whose, np.arange(n + 1)), code, times)

    def _pairs(self, every: np.ndarray, side: np.ndarray, group: np.ndarray, of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each segment, by segment: code, links, segment.  Repeats of an id within a group count and are not expanded."""
        token, times = np.unique((group * 2 + side) * max(self.n_a, self.n_b) + every, return_counts=True)
        where, token = np.divmod(token, max(self.n_a, self.n_b))
        first = np.searchsorted(where, np.arange(2 * len(of_group) + 1))
        partners = np.diff(first)[1::2]
        is_a = np.flatnonzero(where % 2 == 0)
        many = partners[where[is_a] // 2]
        left = np.repeat(is_a, many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[where[is_a] + 1], many)
        code, whose = token[left] * self.n_b + token[right], of_group[where[left] // 2]
        order = np.lexsort((code, whose))
        code, whose, times = code[order], whose[order], (times[left] * times[right])[order]
        new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (whose[1:] != whose[:-1])])
        return code[new], np.add.reduceat(times, new), whose[new]

    def entries(self, segments: pa.StringArray) -> np.ndarray:
        """The place of each segment in the memory, after learning new ones."""
        numbered = segments.dictionary_encode()
        if len(self.words) > MEMORY_SEGMENTS or len(self.links.code) > MEMORY_PAIRS:
            self.forget()
        place = self.words.find(numbered.dictionary)
        new = np.flatnonzero(place < 0)
        if len(new):
            some = numbered.dictionary.take(pa.array(new))
            place[new] = self.words.add(some, np.zeros(len(new), np.int64), np.empty(0, np.uint32))
            old, got = self.links, self.align(some.to_pylist())
            self.links = Links(np.hstack([old.counts, got.counts]), pa.concat_arrays([old.written, got.written]), np.r_[old.edge, got.edge[1:] + old.edge[-1]], np.r_[old.code, got.code], np.r_[old.times, got.times])
        return place[numbered.indices.to_numpy()]

    def windows(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(texts' numbers, entries of their segments, where each text's begin and the end), a window at a time.

        A text longer than a window is alone in several of them; other texts are whole in one.
        """
        raw = [b" " + t.encode() for t in texts]
        at = 0
        while at < len(raw):
            stop, size = at + 1, len(raw[at])
            while stop < len(raw) and size + len(raw[stop]) <= WINDOW:
                size += len(raw[stop])
                stop += 1
            starts = np.cumsum([0, *(len(x) for x in raw[at:stop])])
            data = np.frombuffer(b"".join(raw[at:stop]), np.uint8)
            if self.by_segments:
                done = 0
                while done < len(data):
                    width = WINDOW if stop == at + 1 else len(data)
                    while True:
                        part = data[done : done + width]
                        marks = np.zeros(len(part), bool)
                        marks[(starts[:-1] if not done else starts[:1])] = True
                        edge = word_edges(part, marks)
                        edge = edge[(part[edge] == 32) | marks[edge]]
                        if done + width >= len(data) or len(edge) > 1:
                            break
                        width *= 2
                    if done + width >= len(data):
                        edge = np.r_[edge, len(part)]
                    first = np.searchsorted(edge, starts) if not done and stop > at + 1 else np.array([0, len(edge) - 1])
                    yield np.arange(at, stop), self._of(part, edge), first
                    done += int(edge[-1])
            else:
                yield np.arange(at, stop), self._of(data, starts), np.arange(len(starts))
            at = stop

    def _of(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        return self.entries(pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[: edge[-1]]))))


@lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    """One for each worker process."""
    return Aligner(a, b)


def _spread(edge: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the flat values of some entries, and for each the position of its entry in ``which``."""
    size = edge[which + 1] - edge[which]
    back = np.repeat(np.arange(len(which)), size)
    return np.arange(len(back)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edge[which], size), back


def _held(tool: Aligner, entries: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, pair) of a window without texts whose bytes did not come back."""
    bad = np.add.reduceat(np.r_[tool.links.counts[4][entries], 0], first[:-1]) > 0
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    seen = np.unique((text << 32 | entries)[~bad[text]])
    at, back = _spread(tool.links.edge, seen & 0xFFFFFFFF)
    both = np.unique((seen[back] >> 32) << 40 | tool.links.code[at])
    return both >> 40, both & ((1 << 40) - 1)


def _usable(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, list[str]]:
    """Places and texts of the rows that have a text."""
    texts = batch.column(column)
    at = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    return at, texts.take(pa.array(at)).to_pylist()


def pair_counts(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(code, n): for each linked id pair, as code = A id * B ids + B id, the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a, b)
        code, n = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []

        def merge() -> None:
            nonlocal code, n, waiting
            every, times = np.concatenate([code, *waiting]), np.r_[n, np.ones(sum(map(len, waiting)), np.int64)]
            order = np.argsort(every, kind="stable")
            every, times = every[order], times[order]
            new = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
            code, n, waiting = every[new], np.add.reduceat(times, new) if len(new) else n, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

        for batch in batches:
            whole, pieces, bad = None, [], False  # of a text that takes several windows
            for which, entries, first in tool.windows(_usable(batch, 0)[1]):
                if len(which) == 1:
                    if which[0] != whole:
                        waiting += [np.unique(np.concatenate(pieces))] if pieces and not bad else []
                        whole, pieces, bad = which[0], [], False
                    bad |= bool(tool.links.counts[4][entries].any())
                    pieces = [np.unique(np.concatenate([*pieces, _held(tool, entries, first)[1]]))]
                else:
                    waiting.append(_held(tool, entries, first)[1])
                if sum(map(len, waiting)) > COUNTED:
                    merge()
                    if len(code) > COUNTED:
                        yield made()
                        code, n = code[:0], n[:0]
            waiting += pieces if not bad else []
        merge()
        yield made()

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_TAIL = "array<struct<code:bigint,times:bigint>>"


def align(docs: DataFrame, a: str | None = None, b: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    a, b = a or default_models()[0], b or default_models()[1]
    tool = aligner(a, b)
    n_a, n_b = tool.n_a, tool.n_b
    counts, size = measured(pair_counts(docs, a, b), "align-counts")
    best = np.zeros(n_a, np.int64)
    for row in counts.groupBy(F.floor(F.col("code") / n_b).alias("a")).agg(F.max("n").alias("n")).collect():  # a row for each id of A at most
        best[row.a] = row.n
    least = _least(counts, size.n, hot_pairs)
    known = counts.where(F.col("n") >= least).toArrow().sort_by("code")
    shared = spark.sparkContext.broadcast((known["code"].to_numpy(), known["n"].to_numpy(), best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a, b)
        code, n, best = shared.value
        # n_best and count_sum of each entry by the pairs known here, and which pairs of entries are not
        per, rare, made = np.empty((2, 0), np.int64), np.empty(0, bool), None

        def score() -> None:
            nonlocal per, rare, made
            if made != tool.forgotten:
                per, rare, made = per[:, :0], rare[:0], tool.forgotten
            done, links = per.shape[1], tool.links
            pairs, times, edge = links.code[len(rare) :], links.times[len(rare) :], links.edge[done:] - links.edge[done]
            at = np.searchsorted(code, pairs)
            found = np.zeros(len(pairs), bool)
            found[at < len(code)] = code[at[at < len(code)]] == pairs[at < len(code)]
            c = np.zeros(len(pairs), np.int64)
            c[found] = n[at[found]]
            sums = [np.r_[0, np.cumsum(x)][edge] for x in (times * (found & (c == best[pairs // n_b])), times * c)]
            per, rare = np.hstack([per, np.diff(sums, axis=1)]), np.r_[rare, ~found]

        for batch in batches:
            rows = batch.num_rows
            at, texts = _usable(batch, 1)
            sums = np.zeros((6, rows), np.int64)
            digest: list[str] = [""] * rows
            tails: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
            bad = np.zeros(rows, bool)
            running, whole = hashlib.sha256(), None
            last = b""
            for which, entries, first in tool.windows(texts):
                score()
                own, links = at[which], tool.links
                below = np.hstack([np.zeros((7, 1), np.int64), np.cumsum(np.vstack([links.counts[:, entries], per[:, entries]]), axis=1)])
                got = np.diff(below[:, first], axis=1)
                sums[:, own] += got[[0, 1, 2, 3, 5, 6]]
                bad[own] |= got[4] > 0
                written = _joined(links.written, entries, first)
                for k, text in zip(own.tolist(), written):
                    if k != whole:
                        running, whole, last = hashlib.sha256(), k, b""
                    body = last + text.as_buffer().to_pybytes()
                    running.update(body[:-1])
                    last = body[-1:]  # the last semicolon ends no group until another group follows
                    digest[k] = running.hexdigest()
                if rare.any():
                    place, back = _spread(links.edge, entries)
                    odd = rare[place]
                    text = own[np.searchsorted(first, back[odd], "right") - 1]
                    for k, c, t in zip(text.tolist(), links.code[place[odd]].tolist(), links.times[place[odd]].tolist(), strict=True):
                        tails[k].append((c, t))
            none = bad.copy()
            none[np.setdiff1d(np.arange(rows), at)] = True
            sums[:, none] = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(s) for s in sums), pa.array(["" if z else d for d, z in zip(digest, none.tolist(), strict=True)]), pa.array([[] if z else [{"code": c, "times": t} for c, t in x] for x, z in zip(tails, none.tolist(), strict=True)], pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())])))],
                ["doc_id", *_SUMS, "groups_sha256", "tail"],
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'{s} long' for s in _SUMS)}, groups_sha256 string, tail {_TAIL}")
    if known.num_rows == size.n:
        discard(counts)
        return out.drop("tail")
    return _with_tail(out, counts, least, best, n_b)


def _least(counts: DataFrame, n: int, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs reach; 0 if all pairs are so few."""
    if n <= most:
        return 0
    power = F.floor(F.log2("n")).cast("int").alias("power")
    above = 0
    for row in counts.groupBy(power).count().orderBy(F.desc("power")).collect():  # 64 rows at most
        above += row["count"]
        if above > most:
            return 1 << (row.power + 1)
    return 0


def _with_tail(rows: DataFrame, counts: DataFrame, least: int, best: np.ndarray, n_b: int) -> DataFrame:
    """Add the links whose pairs are too rare to be known to every task."""
    kept = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "align-rows")
    spark = rows.sparkSession
    top = spark.createDataFrame([(i, int(n)) for i, n in enumerate(best) if n], "a long, top long")  # a row for each id of A at most
    tail, size = measured(kept.select("row", F.explode("tail").alias("t")).select("row", "t.code", "t.times"), "align-tail")
    facts = counts.where(F.col("n") < least).join(F.broadcast(top), F.floor(F.col("code") / n_b) == F.col("a")).select("code", "n", (F.col("n") == F.col("top")).alias("is_best"), F.col("n").alias("m"))
    scored = join_by_key(tail, facts, ["code"], size.n).groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    both = kept.drop("tail").join(scored, "row", "left")
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("c", F.lit(0))).alias("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align the tokens of the byte-level and the piece vocabulary in all documents."""
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {}
