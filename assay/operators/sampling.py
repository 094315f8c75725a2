"""Deterministic samples by content hash.

Membership depends on the row alone, so it does not change with partitioning.  Whole-row samples
break up groups of duplicate keys; ``key_sample`` keeps them together and is what ``unique`` needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named, portable_hash, row_hash
from ..sources.scratch import materialise, shared_dir
from ..sources.tables import PartitionFilter, exists, row_count, scan_partition

#: The bucket of a table whose size is not known.
UNKNOWN_BUCKET = 1000
#: Rows from which an unfiltered sample is refused.
GUARD_ROWS = 100_000_000


class SampleError(ValueError):
    """A sample can not be drawn as asked."""


def sample_bucket(rows: int | None, n: int) -> int:
    """Keep one row in so many to get about n."""
    return UNKNOWN_BUCKET if rows is None else max(rows // n, 1)


def sample_guard(rows: int | None, n: int, filtered: bool) -> None:
    if n <= 0:
        raise SampleError("a sample has at least one row")
    if filtered:
        return
    if not rows:
        raise SampleError("the size of the table is not known or zero; give a partition filter")
    if rows >= GUARD_ROWS:
        raise SampleError(f"{rows} rows; give a partition filter")


def _hash(df: DataFrame, key: Sequence[str] | None, portable: bool) -> Column:
    return portable_hash(*(key or df.columns)) if portable else row_hash(df, list(key) if key else None)


def hash_sample(df: DataFrame, bucket: int, key: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """Rows whose hash falls in bucket 0 of ``bucket``; over all columns, or over ``key``."""
    return df.where(F.pmod(_hash(df, key, portable), F.lit(bucket)) == 0)


def key_sample(df: DataFrame, key: Sequence[str], bucket: int, portable: bool = False) -> DataFrame:
    """A sample of keys with all their rows."""
    return hash_sample(df, bucket, key, portable)


def sample_rows(df: DataFrame, n: int, bucket: int = 1, key: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """The first n rows of the hash sample in hash order (ties by the columns): a top-n, not a sort."""
    h = _hash(df, key, portable)
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    return hash_sample(df, bucket, key, portable).orderBy(h, *[named(c) for c in (key or plain)]).limit(n)


#: Bits of the hash by which a bottom-k sample counts rows.
_PREFIX = 16


def bottom_k(df: DataFrame, n: int, key: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """The n rows with the smallest hashes, with the hash as ``_hash``: a sample of exactly n rows of a table of any size.

    The rows of each hash prefix are counted, combined on the map side (65,536 counters, whatever the
    table), which says what prefixes hold the first n; only their rows, about n, are then ordered.
    Neither a row count nor a limit on the table's size is needed.  Samples of parts of a table can be
    merged to the sample of the whole (``merge_samples``), as long as they have the same n and key.
    Ties go by the columns; equal rows are the same row.
    """
    if n <= 0:
        raise SampleError("a sample has at least one row")
    hashed = df.withColumn("_hash", _hash(df, key, portable))
    prefix = F.shiftright("_hash", (60 if portable else 64) - _PREFIX)
    last, below = None, 0
    for row in sorted(hashed.groupBy(prefix.alias("p")).count().collect()):  # a row for each prefix
        last, below = row.p, below + row["count"]
        if below >= n:
            break
    return _first(hashed.where(prefix <= last) if last is not None else hashed, n)


def _first(hashed: DataFrame, n: int) -> DataFrame:
    plain = [f.name for f in hashed.schema if f.name != "_hash" and f.dataType.typeName() not in ("map", "variant")]
    return hashed.orderBy("_hash", *[named(c) for c in plain]).limit(n)


def merge_samples(samples: Sequence[DataFrame], n: int) -> DataFrame:
    """The bottom-k sample of the whole from those of its parts, of which a row may be in one only."""
    return _first(reduce(DataFrame.unionByName, samples), n)


def sample_id(table: str, n: int, by: PartitionFilter | None = None, version: str = "1") -> str:
    """A stable 16-digit name for a sample."""
    import hashlib

    parts = [table, str(n), *(map(str, by) if by else ["", "", ""]), version]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def _drawn(df: DataFrame, n: int, by: PartitionFilter | None, key: Sequence[str] | None, portable: bool) -> DataFrame:
    """The sample as a plan: rows are counted first, in a scan of the filter's column alone, so that the bucket fits them."""
    rows = scan_partition(df, by)
    size = row_count(rows)
    sample_guard(size, n, by is not None)
    return sample_rows(rows, n, sample_bucket(size or 0, n), key, portable)


def materialise_sample(df: DataFrame, n: int, by: PartitionFilter | None = None, key: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """Draw the sample once and keep it, so that every test reads the small table."""
    return materialise(_drawn(df, n, by, key, portable), "sample")


def one_shot_sample(df: DataFrame, n: int, by: PartitionFilter | None = None, key: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """The same rows without keeping them: every test draws the sample anew."""
    return _drawn(df, n, by, key, portable)


def kept_sample(df: DataFrame, table: str, n: int, by: PartitionFilter | None = None, key: Sequence[str] | None = None, portable: bool = False, version: str = "1") -> DataFrame:
    """The sample of that id: read if it has been drawn before, drawn and kept if not.

    version: what tells states of the table apart; a new one draws anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sample-{sample_id(table, n, by, version)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        _drawn(df, n, by, key, portable).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
