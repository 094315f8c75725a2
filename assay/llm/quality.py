"""Quality classifier: naive Bayes support vectors.

Every text becomes a set of n-gram indicators (hashed word 1- and 2-grams, and 1- to 3-grams of
word shapes: case, digits, symbols, repetition of the word before).  Indicators are scaled by the
class log-count ratios of naive Bayes, each row is brought to unit length, and a linear hinge-loss
model is fitted by dual coordinate descent.  A logistic curve fitted on rows that the descent did
not see turns margins into scores.

The fit uses a bounded sample: the ``sample`` labelled rows (default 8000) with the smallest hash
of doc_id.  It needs one broadcast of that many ids, never a shuffle of the texts.  Scoring is a
map over all rows with the broadcast weights (2 x 2^18 floats, whatever the input).

Defined cases: null and empty texts have no indicators and get the score of the intercept; very long
texts count whole; null or contradicting labels and null ids teach nothing; of rows that repeat a
labelled id the least text teaches; a score of exactly 0.5 predicts 1, and rows of equal texts have
equal scores; without rows of both classes every score is the smoothed share of label 1 (0.5 without
any label, so too for an empty table); rows are never dropped, so repeated rows and null ids stay;
columns called ``score`` or ``predicted``, in any case, are replaced, others stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, buffers, hash_words, mix, ngram_hashes, others, table

BITS = 18
SAMPLE = 8000

_KIND = np.zeros((4, 256), np.int64)  # lower, upper, digit, symbol
_KIND[0, 97:123] = 1
_KIND[0, 128:] = 1
_KIND[1, 65:91] = 1
_KIND[2, 48:58] = 1
_KIND[3] = 1 - _KIND[:3].max(axis=0)
_KIND[3, SPACE] = 0


class Model(NamedTuple):
    weight: np.ndarray  # weight times ratio, by indicator
    square: np.ndarray  # squared ratio, by indicator
    intercept: float
    slope: float
    shift: float


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small code per word: which kinds of characters it has and how many symbols."""
    counts = []
    for kind in _KIND:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=total[1:])
        counts.append(total[ends] - total[starts])
    low, up, digit, symbol = counts
    return (low > 0) + 2 * np.minimum(up, 2) + 6 * (digit > 0) + 12 * np.minimum(symbol, 3)


def indicators(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """The sorted indicator numbers of each text in a UTF-8 buffer."""
    base = int(offsets[0])
    own = data[base : int(offsets[-1])]
    words, first = hash_words(data, offsets)
    if len(own):
        gap = SPACE[own]
        marks = np.zeros(len(own) + 1, bool)
        marks[offsets - base] = True
        head, tail = ~gap, ~gap
        head[1:] &= gap[:-1] | marks[1:-1]
        tail[:-1] &= gap[1:] | marks[1:-1]
        shape = _shapes(own, np.flatnonzero(head), np.flatnonzero(tail) + 1)
    else:
        shape = np.empty(0, np.int64)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][first[:-1] < len(words)]] = False
    shape = mix((shape + 64 * again).astype(np.uint64) + np.uint64(1 << 32))
    mask = np.uint64((1 << bits) - 1)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        w, s = words[a:b], shape[a:b]
        grams = np.concatenate([w, ngram_hashes(w, 2), s, ngram_hashes(s, 2), ngram_hashes(s, 3)])
        out.append(np.unique((grams >> np.uint64(20)) & mask).astype(np.int32))
    return out


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, size: int, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model by dual coordinate descent; the intercept is a constant indicator of value 1."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1 for v in values])
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (float(values[i] @ w[rows[i]]) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * signs[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                worst = max(worst, abs(step))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, with smoothed targets, by Newton steps."""
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = 20) -> Model:
    """Fit on indicator sets that are at hand."""
    size, labels = 1 << bits, np.asarray(labels)
    share = float((labels.sum() + 1) / (len(labels) + 2)) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), np.ones(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(labels)) % 5 == 4
    if len(set(labels[apart])) < 2 or len(set(labels[~apart])) < 2:
        apart = np.zeros(len(labels), bool)
    counts = np.ones((2, size))
    for row, label in zip(rows, labels, strict=True):
        counts[label, row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratio[r] / (np.sqrt((ratio[r] ** 2).sum()) + 1e-9) for r in rows]
    signs = np.where(labels == 1, 1.0, -1.0)
    inside = np.flatnonzero(~apart)
    w, bias = descend([rows[i] for i in inside], [values[i] for i in inside], signs[inside], size, epochs=epochs)
    margins = np.array([float(v @ w[r]) + bias for r, v in zip(rows, values, strict=True)])
    seen = np.flatnonzero(apart) if apart.any() else inside
    slope, shift = _curve(margins[seen], labels[seen])
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, slope, shift)


def margins(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    return np.array([float(model.weight[r].sum(dtype=np.float64)) / (float(np.sqrt(model.square[r].sum(dtype=np.float64))) + 1e-9) + model.intercept for r in rows])


def scores(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * margins(model, rows) + model.shift, -30, 30)))


def held_out(doc_id: str = "doc_id"):
    """True for rows whose label must not be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, label: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .where("label = _most")
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most ``sample`` ids are broadcast

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for _, data, offsets in buffers(batch.column(2)) for r in indicators(data, offsets, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "label", "row"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: (r[1], r[0]))
        order = np.random.Generator(np.random.PCG64(11)).permutation(len(found))
        found = [found[i] for i in order]
        model = fit_rows([np.frombuffer(r[2], np.int32) for r in found], np.array([r[1] for r in found], np.int64), bits)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # the fit of the bounded sample is one task, so that its rows never reach the driver
    made = texts.mapInArrow(featurise, "doc_id long, label int, row binary").repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit_rows([], np.empty(0, np.int64), bits)


def score(df: DataFrame, model: Model, text: str = "text", bits: int = BITS) -> DataFrame:
    """Add ``score`` and ``predicted`` to every row, from its whole text alone."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # 2 x 2^bits floats
    keep = others(df.columns, "score", "predicted")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            p = np.concatenate([scores(sent.value, indicators(data, offsets, bits)) for _, data, offsets in buffers(texts)]) if batch.num_rows else np.empty(0)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return df.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of the held-out fold are never seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
