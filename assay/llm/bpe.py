"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts go through ``mapInArrow``: no shuffle, one pass, memory bounded by the Arrow batch.  A text
longer than ``cut`` characters is split into pieces first.  A cut lies between a character that is
no white space and one that is: no match of the split pattern spans such a place (white space only
leads a match, and the look-ahead of the white-space branch never looks past a following
non-space), so the pieces give exactly the ids of the whole text.  A run of ``cut`` or more white
space is one match but for its last character (all of it at the end of the text), so it is encoded
as one piece without the pattern, whose look-ahead gives up on a million of them.  A run of other
characters without any such place stays whole.

Defined cases: a null or empty text has no ids and decodes to no bytes; very long texts are encoded
piece by piece, whatever they are made of; special-token strings inside a text are ordinary text;
there are no ties; rows are never dropped, so repeated rows and null ids stay; an empty table gives
no rows; columns whose names are those of the result, in any case, are replaced, others stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, table

CUT = 1 << 16
# fixed values: white space as the split pattern's engine knows it
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_RUN = re.compile(f"[{_WHITE}]{{2,}}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; one per worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _cut(text: str, cut: int) -> Iterator[tuple[str, bool]]:
    at = 0
    while len(text) - at > cut:
        found = _SAFE.search(text, at + cut)
        if not found:
            break
        yield text[at : found.start()], False
        at = found.start()
    if at < len(text):
        yield text[at:] if at else text, False


def safe_pieces(text: str, cut: int = CUT) -> Iterator[tuple[str, bool]]:
    """Split a text where matches of the pattern end: pieces that join to the text, and whether each is one match."""
    at = 0
    if len(text) > cut:
        for run in _RUN.finditer(text):
            a, b = run.span()
            if b - a >= cut:
                b -= b < len(text)
                yield from _cut(text[at:a], cut)
                yield text[a:b], True
                at = b
    yield from _cut(text[at:] if at else text, cut)


def encode_pieces(enc: tiktoken.Encoding, text: str | None, cut: int = CUT) -> Iterator[list[int]]:
    """The ids of a text, piece by piece."""
    for piece, one in safe_pieces(text, cut) if text else ():
        yield enc._encode_single_piece(piece) if one else enc.encode_ordinary(piece)


def encode_text(enc: tiktoken.Encoding, text: str | None, cut: int = CUT) -> list[int]:
    return [i for ids in encode_pieces(enc, text, cut) for i in ids]


def _per_batch(ranks: str | None, pattern: str | None, column: str, added: list[pa.Field], make: Callable[[tiktoken.Encoding, list], list[list]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        enc = encoding(ranks or default_ranks(), pattern or public_tokenizers.PATTERN)
        new = [f.name for f in added]
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                values = part.column(part.schema.get_field_index(column)).to_pylist()
                made = make(enc, values)
                keep = others(part.schema.names, *new)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in keep] + [pa.array(v, f.type) for v, f in zip(made, added, strict=True)], keep + new)

    return run


def _schema(df: DataFrame, added: list[tuple[str, T.DataType]]) -> T.StructType:
    keep = others(df.columns, *(n for n, _ in added))
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added])


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", ranks: str | None = None, pattern: str | None = None, cut: int = CUT) -> DataFrame:
    """Add the ids of each text as ``array<int>``; a column of that name is replaced."""
    added = [pa.field(ids, pa.list_(pa.int32()))]
    fn = _per_batch(ranks, pattern, text, added, lambda enc, texts: [[encode_text(enc, x, cut) for x in texts]])
    return df.mapInArrow(fn, _schema(df, [(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "token_ids", raw: str = "decoded", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add the raw bytes that each id list stands for (null list: no bytes); an unknown id is an error."""
    added = [pa.field(raw, pa.binary())]
    fn = _per_batch(ranks, pattern, ids, added, lambda enc, lists: [[enc.decode_bytes(x or []) for x in lists]])
    return df.mapInArrow(fn, _schema(df, [(raw, T.BinaryType())]))


@lru_cache(maxsize=1)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def _digests(enc: tiktoken.Encoding, texts: list, cut: int) -> list[list]:
    names = _decimals(enc.max_token_value + 1)
    counts, ids_sha, raw_sha = [], [], []
    for text in texts:
        n, said, raw, first = 0, hashlib.sha256(), hashlib.sha256(), True
        for ids in encode_pieces(enc, text, cut):
            said.update(("" if first else " ").encode() + " ".join(map(names.__getitem__, ids)).encode())
            raw.update(enc.decode_bytes(ids))
            n, first = n + len(ids), False
        counts.append(n)
        ids_sha.append(said.hexdigest())
        raw_sha.append(raw.hexdigest())
    return [counts, ids_sha, raw_sha]


def round_trip(df: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None, cut: int = CUT) -> DataFrame:
    """Encode and decode each text piece by piece and add n_tokens, ids_sha256 and decoded_sha256.

    The ids are streamed into the digests, so no id list of a whole text is ever held.
    """
    added = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    fn = _per_batch(ranks, pattern, text, added, lambda enc, texts: _digests(enc, texts, cut))
    return df.mapInArrow(fn, _schema(df, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents: token count and digests of its ids and of the decoded bytes."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return round_trip(docs).drop("text")


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLES: dict[str, str] = {}
