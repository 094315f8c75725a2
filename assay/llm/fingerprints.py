"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its word pairs (two words in a row, A-Z folded) with their counts; a text
of one word is that word.  Each of ``samples`` samples draws, per term, r and c from Gamma(2, 1)
and b from U(0, 1), quantises the log weight to t = floor(ln w / r + b), and keeps the term with
the smallest a = c / (exp(r (t - b)) exp(r)).  Two sets agree on a sample's (term, t) with the
probability of their generalised Jaccard similarity, sum of minima over sum of maxima.  The draws
of a term and a sample come from a fixed table of 2^18 triples, picked by a hash of its own for each
sample.  Terms that pick the same triple tie, and the tie goes to the smaller term hash: that rule is
min-wise too, so texts of far more terms than triples still collide at the rate of their similarity.

A fingerprint is 16 bits per sample, in hexadecimal; likeness is the share of equal samples.

The edited texts need the next document in descending doc_id order.  Rows are range-partitioned
once (``ordered.with_buckets``) and sorted within tasks; the first row of each bucket also goes to
the bucket before it, so every row meets its successor without a task that sees all rows.

A likeness of ``samples`` samples has a standard error of at most 0.5 / sqrt(samples): 0.063 for 64.

Defined cases: null and empty texts count as empty; a text without words has the fingerprint ""
and likeness 1 to another such text, 0 to any other; very long texts count whole; rows with equal ids
follow in the order of their texts' hash, and repeated rows each count; null ids come last; a single
row is its own next document; an empty table gives no rows; ``fingerprint`` replaces a column of its
name, in any case, and keeps others; ``compare_with_next`` reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, hash_words, mix, ngram_hashes, others, table
from .ordered import unsigned, with_buckets

SAMPLES = 64
TABLE = 18

_rng = np.random.Generator(np.random.PCG64(1905))
_R = _rng.gamma(2.0, 1.0, 1 << TABLE).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << TABLE)).astype(np.float32)
_BETA = _rng.random(1 << TABLE).astype(np.float32)
#: ln a for a term of weight 1, where t is 0.
_LOG_A1 = _LOG_C + _R * _BETA - _R
_ODD = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def weighted_terms(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Term hashes and counts of each text in a UTF-8 buffer."""
    words, first = hash_words(data, offsets)
    pairs = ngram_hashes(words, 2)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(np.unique(pairs[a : b - 1] if b - a > 1 else words[a:b], return_counts=True))
    return out


def signature(terms: np.ndarray, counts: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """16 bits for each sample's (term, t)."""
    best = np.full(samples, np.inf, np.float32)
    who, level = np.zeros(samples, np.int64), np.zeros(samples, np.int64)
    odd, lanes = _ODD[:samples], np.arange(samples)
    for part in (counts == 1), (counts > 1):
        at = np.flatnonzero(part)
        for k in range(0, len(at), 1024):
            some = at[k : k + 1024]
            pick = ((terms[some, None] * odd) >> np.uint64(64 - TABLE)).astype(np.int32)
            if counts[some[0]] == 1:
                t = None
                log_a = _LOG_A1[pick]
            else:
                r = _R[pick]
                t = np.floor(np.log(counts[some].astype(np.float32))[:, None] / r + _BETA[pick])
                log_a = _LOG_C[pick] - r * (t - _BETA[pick]) - r
            low = log_a.argmin(axis=0)
            value = log_a[low, lanes]
            win = value < best
            best[win] = value[win]
            who[win] = some[low[win]]
            level[win] = 0 if t is None else t[low, lanes][win].astype(np.int64)
    return (mix(terms[who] ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(40)).astype(np.uint16)


def fingerprints_of(texts: list[str], samples: int = SAMPLES) -> list[np.ndarray | None]:
    """Signatures of texts; None for a text without words."""
    out: list[np.ndarray | None] = []
    for _, data, offsets in buffers(pa.array(texts, pa.large_string())):
        out += [signature(t, c, samples) if len(t) else None for t, c in weighted_terms(data, offsets)]
    return out


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def _hex(s: np.ndarray | None) -> str:
    return "" if s is None else s.astype(">u2").tobytes().hex()


def fingerprint(df: DataFrame, text: str = "text", into: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """Add the fingerprint of each text; a column of that name is replaced."""
    keep = others(df.columns, into)
    at = [c.lower() for c in df.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_hex(signature(t, c, samples) if len(t) else None) for _, d, o in buffers(batch.column(at)) for t, c in weighted_terms(d, o)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(marks, pa.string())], [*keep, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (df.schema[c] for c in keep))
    return df.mapInArrow(run, f"{schema}, `{into}` string")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compare_with_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last floor(n / 3) code points give way to the first as many of the next document.
    """
    key = F.bitwise_not(F.col("doc_id").cast("long"))  # rising where doc_id falls
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_k": key, "_tie": F.xxhash64("text")})
    rows, _ = with_buckets(rows, "_k", "_tie", nulls_first=False)
    first = rows.groupBy("_bucket").agg(F.min(F.struct(F.col("_k").isNull().alias("n"), "_k", unsigned("_tie").alias("u"))).alias("f"))
    first = sorted(first.collect(), key=lambda r: r["_bucket"])  # a row for each bucket
    if not first:
        return docs.sparkSession.createDataFrame([], _RESULT)
    heads = [(r["f"]["_k"], r["f"]["u"], first[i - 1]["_bucket"]) for i, r in enumerate(first)]
    heads = docs.sparkSession.createDataFrame(heads, "hk long, hu long, _before int")
    sent = rows.withColumn("_u", unsigned("_tie")).join(F.broadcast(heads), F.col("_k").eqNullSafe(F.col("hk")) & (F.col("_u") == F.col("hu")), "left")
    copies = F.array_compact(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("tail")), F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("b"), F.lit(1).alias("tail")))))
    sent = sent.select("doc_id", "text", "_k", "_u", F.explode(copies).alias("_to"))
    dealt = sent.select("doc_id", "text", "_k", "_u", "_to.b", "_to.tail").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b")
    dealt = dealt.sortWithinPartitions("b", "tail", F.col("_k").asc_nulls_last(), "_u").select("doc_id", "text", "b", "tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, which waits for its successor: (doc_id, text, bucket, tail, signature)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids, texts, buckets, tails = (part.column(i).to_pylist() for i in range(4))
                rows = list(zip(ids, texts, buckets, tails, fingerprints_of(texts, samples), strict=True))
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3] and a[2] == b[2]]
                edited = [edit(a[1], b[1]) for a, b in pairs]
                marks = fingerprints_of(edited, samples)
                out = [
                    (a[0], len(a[1]), hashlib.sha256(e.encode()).hexdigest(), _hex(a[4]), _hex(m), likeness(a[4], m), likeness(a[4], b[4]))
                    for (a, b), e, m in zip(pairs, edited, marks, strict=True)
                ]
                columns = list(zip(*out, strict=True)) or [[]] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return dealt.mapInArrow(run, _RESULT)


def edit(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op10_weighted_sampling": op10_weighted_sampling}
ORACLES: dict[str, str] = {}
