"""Range buckets: a total order over all rows without one task that sorts them all.

Rows are ordered by (key, tie).  Splitters are approximate percentiles of the key, one aggregate
that keeps a bounded summary.  A key that many rows share takes several splitters; its rows are
spread over the buckets between them by ``tie``, a 64-bit hash, so a hot key does not land in one
bucket.  Rows with a null key get buckets of their own at one end, in proportion.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets for each shuffle partition: hashing the bucket numbers to tasks then comes out even.
OVER = 4


def _longs(values: list[int]) -> Column:
    """An array constant; as JSON, since that is one expression however long the list."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _at_most(splitters: list[int], x: Column) -> Column:
    """How many of the sorted splitters are at most x; looks at 2 sqrt(n) of them."""
    if not splitters:
        return F.lit(0)
    width = math.isqrt(len(splitters) - 1) + 1
    array, top = _longs(splitters), _longs(splitters[width - 1 :: width])
    group = F.size(F.filter(top, lambda s: s <= x))
    return group * width + F.size(F.filter(F.slice(array, group * width + 1, F.lit(width)), lambda s: s <= x))


def with_buckets(df: DataFrame, key: str, tie: str, bucket: str = "_bucket", nulls_first: bool = True) -> tuple[DataFrame, int]:
    """Add the bucket number of each row; ordering by (bucket, key, tie) is ordering by (key, tie).

    The number of buckets follows ``spark.sql.shuffle.partitions``.  Returns it beside the rows.
    """
    parts = OVER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts)).alias("s"), F.count("*").alias("n"), F.count(key).alias("k")).first()
    splitters = sorted(found["s"] or [])
    nulls = math.ceil(parts * (found["n"] - found["k"]) / found["n"]) if found["n"] else 0
    unit = F.shiftrightunsigned(F.col(tie), 11) / F.lit(float(1 << 53))  # [0, 1), rising with the unsigned hash
    below = _at_most(splitters, F.col(key))
    for value, times in Counter(splitters).items():
        if times > 1:
            first = splitters.index(value) + 1
            below = F.when(F.col(key) == value, F.lit(first) + F.floor(unit * times).cast("int")).otherwise(below)
    known = len(splitters) + 1
    own = F.floor(unit * max(nulls, 1)).cast("int")
    shift, null_bucket = (nulls, own) if nulls_first else (0, own + known)
    return df.withColumn(bucket, F.when(F.col(key).isNull(), null_bucket).otherwise(below + shift).cast("int")), known + nulls


def unsigned(tie: str) -> Column:
    """An ascending order of the tie as with_buckets spreads it."""
    return F.col(tie).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
