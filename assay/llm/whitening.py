"""Embedding whitening by shifted CholeskyQR.

Let A be the centred rows.  ``fit`` never builds a covariance of the raw entries:

1. one pass takes the number of rows n and the exact sums S; rows are centred as (n x - S) / n, whose
   numerator is an exact integer;
2. Gram passes: each partition adds up Q'Q of its rows, the driver sees one matrix of the size of the
   dimension squared.  The first Gram matrix gets the shift that keeps its Cholesky factor R1 defined
   whatever the condition number; the next pass sees Q = A / R1 (a triangular solve a row), and so on, until
   Q'Q is the identity to rounding.  A = Q Rk ... R2 R1, so no digit is lost to the squared
   condition number of one Gram matrix;
3. the singular values and right vectors of the composed factor are those of A: components and variances.

Where directions have no variance at all, the last Q'Q keeps zeros in its spectrum; its square root takes
the place of the last factor.

Defined cases: a vector that is null, or holds nulls, NaN or infinities, is dropped; so is a vector
whose length is not the most frequent one of the remaining (in a tie the longest), and an empty one.  Rows
without vec_id and rows that repeat an id or a vector count like all others.  An entry is quantised to
x = floor(1024 c) + 100000, held at 2^62 at most in size; a deviation beyond a long is null.  A component without variance
(relative to the largest: below rounding) has null ``whitened`` and no part in ``identity_error``; of equal
variances any orthonormal vectors are taken.  An empty table gives no rows.  Only the two columns
named are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

COMPONENTS = 8
SCALE, OFFSET, LARGEST = 1024.0, 100_000, 2.0**62
#: Gram passes at most; three do for any condition number that doubles can hold, more for lost directions.
PASSES = 6
#: Entries of a block that is worked on at a time.
BLOCK = 1 << 20


@dataclass
class Whitening:
    """What a fit gives: rows, exact sums, unit components (columns) and their variances, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def _valid(vector: str) -> F.Column:
    bad = F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)) & (F.size(vector) > 0)


def _blocks(column: pa.Array, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of usable vectors, their quantised entries as an int64 matrix), block by block."""
    column = column.cast(pa.large_list(pa.float64()))
    size = max(1, BLOCK // dim)
    for first in range(0, len(column), size):
        part = column.slice(first, size)
        fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(part), dim), False).to_numpy(zero_copy_only=False))
        values = pc.list_flatten(part.take(pa.array(fits))).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
        fine = np.isfinite(values).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(values[fine] * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET
        yield fits[fine] + first, x


def _over(x: np.ndarray, factor: float) -> bool:
    """Whether ``factor`` times an entry may leave the longs."""
    return bool(x.size) and float(np.abs(x.astype(float)).max()) * factor >= 2.0**62


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as int64 where that holds them, as Python integers otherwise."""
    if _over(x, n) or max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _deviations(top: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; null beyond a long."""
    if top.dtype != object and not _over(top, float(np.abs(top.astype(float)).max(initial=0)) * top.shape[1]):
        return (top * top).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in top.astype(object).tolist())
    return [v if v < 1 << 63 else None for v in exact]


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows R^-1 for an upper triangular R, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part`` over all batches: a row for each partition, added up in two levels by tasks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["body"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for body in batch.column(0):
                total += np.frombuffer(body.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["body"])

    width = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    rows = df.mapInArrow(first, "body binary").repartition(width).mapInArrow(fold, "body binary").repartition(1).mapInArrow(fold, "body binary").collect()
    return np.sum([np.frombuffer(r.body) for r in rows], axis=0)


def _exact_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            for _, x in _blocks(batch.column(0), dim):
                own = (x.astype(object) if _over(x, len(x)) else x).sum(axis=0).tolist() if len(x) else total[:0]
                n, total = n + len(x), [a + b for a, b in zip(total, own, strict=True)] if own else total
        yield pa.RecordBatch.from_arrays([pa.array([n] * dim, pa.int64()), pa.array(range(dim), pa.int32()), pa.array([str(v) for v in total])], ["n", "dim", "s"])

    found = vectors.mapInArrow(run, "n long, dim int, s string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return (found[0].n, [int(r.s) for r in found]) if found else (0, [])


def _root(gram: np.ndarray) -> np.ndarray:
    """A matrix M with M'M = gram, which may be singular."""
    values, vectors = np.linalg.eigh(gram)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of the usable vectors; None if there is no such vector."""
    vectors = df.select(vector)
    lengths = vectors.where(_valid(vector)).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return None
    dim = lengths[0].dim
    n, sums = _exact_sums(vectors, dim)

    def gram_of(factors: list[np.ndarray]) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((dim, dim))
            for _, x in _blocks(batch.column(0), dim):
                q = _numerators(x, n, sums).astype(float) / n
                for r in factors:
                    q = _solved(q, r)
                out += q.T @ q
            return out.ravel()

        return _summed(vectors, part, dim * dim).reshape(dim, dim)

    factors: list[np.ndarray] = []
    composed, trace = np.eye(dim), 0.0
    for k in range(PASSES):
        gram = gram_of(factors)
        if not k:
            trace = float(np.trace(gram)) / n
            if trace == 0:
                return Whitening(n, sums, np.eye(dim)[:, :components], np.zeros(min(dim, components)), 0.0)
        spectrum = np.linalg.eigvalsh(gram)
        settled = k > 0 and np.abs(spectrum * (spectrum - 1)).max() < 1e-10  # one, or zero for a direction without rows
        if settled or k == PASSES - 1:
            composed = _root(gram) @ composed
            break
        shift = 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * spectrum[-1]
        try:
            if not k or spectrum[0] < shift:
                raise np.linalg.LinAlgError
            r = np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            r = np.linalg.cholesky(gram + min(shift, 0.1 * spectrum[-1]) * np.eye(dim)).T
        factors.append(r)
        composed = r @ composed
    _, singular, right = np.linalg.svd(composed)
    singular[singular <= dim * np.finfo(float).eps * singular[0]] = 0
    return Whitening(n, sums, right[:components].T, singular[:components] ** 2 / n, trace)


def _projector(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    """From numerators n x - S to whitened components; NaN where a component has no variance."""
    with np.errstate(divide="ignore"):
        scale = np.where(model.variances > 0, 1 / np.sqrt(model.variances), np.nan)
    return lambda top: (top.astype(float) / model.n) @ model.components * scale


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity; None without variance."""
    dim, keep = len(model.sums), np.flatnonzero(model.variances > 0)
    k, project = len(keep), _projector(model)
    if not k:
        return None

    def part(batch: pa.RecordBatch) -> np.ndarray:
        square, total = np.zeros((k, k)), np.zeros(k)
        for _, x in _blocks(batch.column(0), dim):
            w = project(_numerators(x, model.n, model.sums))[:, keep]
            square, total = square + w.T @ w, total + w.sum(axis=0)
        return np.r_[square.ravel(), total]

    got = _summed(df.select(vector), part, k * k + k)
    mean = got[k * k :] / model.n
    return float(np.abs(got[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, vector, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error, dim, k, project = identity_error(df, model, vector), len(model.sums), len(model.variances), _projector(model)
    share = (model.variances / model.trace).tolist() if model.trace else [None] * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch.column(1), dim):
                top, m = _numerators(x, model.n, model.sums), len(x)
                white = project(top).ravel()
                repeated = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[repeated])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array(_deviations(top), pa.int64()).take(pa.array(repeated)), pa.array(white, pa.float64(), from_pandas=True), pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), vector).mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
