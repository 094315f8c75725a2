"""Stable names for tests and other artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import named, short_hash


def canonical_args(df: DataFrame) -> Column:
    """The arguments of a test as one text; the order of accepted values does not matter."""
    t = F.col("test_type")
    return (
        F.when(t == "accepted_values", F.concat(F.lit("values="), F.array_join(F.array_sort(F.coalesce("values", F.array().cast("array<string>"))), "|")))
        .when(t == "relationships", F.concat(F.lit("to="), F.coalesce("to", F.lit("")), F.lit("|field="), F.coalesce("field", F.lit(""))))
        .when(t == "custom_sql", F.concat(F.lit("sql="), F.trim(F.regexp_replace(F.coalesce("sql", F.lit("")), r"\s+", " "))))
        .otherwise(F.lit(""))
    )


def args_hash(df: DataFrame) -> Column:
    return short_hash(canonical_args(df), 8)


#: Positions that one task numbers at most.
RANGE = 1 << 16


def with_artifact_ids(tests: DataFrame) -> DataFrame:
    """Add args_hash and artifact_id to rows of tests.

    The hash enters the id only where the scope has several tests of the type; exact repeats are
    told apart by :1, :2 and so on, in order of position.  No group of tests meets in one task as
    a whole: counts combine on the map side and are joined back, and repeats are numbered within
    ranges of RANGE positions, on top of the counts of the ranges before.
    """
    scope = F.when(F.col("column").isNotNull() & (F.col("anchor") != "model"), F.concat(F.lit("column."), F.col("column"))).otherwise("model")
    of_type = ["table_name", "_scope", "test_type"]
    same = [*of_type, "args_hash"]
    hashed = tests.withColumn("args_hash", args_hash(tests)).withColumn("_scope", scope).withColumn("_range", F.floor(F.coalesce("position", F.lit(0)) / RANGE))
    ranges = hashed.groupBy(*same, "_range").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*same).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    numbered = ranges.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_c")  # a row per 65,536 positions of a key
    several = ranges.groupBy(*of_type).agg((F.sum("_c") > 1).alias("_several"))
    within = Window.partitionBy(*same, "_range").orderBy("position")
    hashed = hashed.withColumn("_n", F.row_number().over(within)).join(numbered.join(several, of_type), [*same, "_range"])
    n = F.col("_before") + F.col("_n")
    plain = F.concat_ws(".", F.lit("test"), "_scope", "test_type", F.when(F.col("_several"), F.col("args_hash")))
    name = F.when(n > 1, F.concat(plain, F.lit(":"), (n - 1).cast("string"))).otherwise(plain)
    return hashed.withColumn("artifact_id", name).select(*tests.columns, "args_hash", "artifact_id")


def description_ids(columns: DataFrame) -> DataFrame:
    """Ids of column descriptions and, once per table, of its rationale."""
    cols = columns.select("table_name", F.concat(F.lit("column."), F.col("column_name"), F.lit(".description")).alias("artifact_id"))
    return cols.union(columns.select("table_name").distinct().select("table_name", F.lit("model.rationale").alias("artifact_id")))


_SUMS = ("n", "high", "low")


def fingerprint_state(df: DataFrame) -> DataFrame:
    """One row (n, high, low) that stands for the rows of a table as a multiset, of any size.

    ``high`` and ``low`` are sums of two 60-bit halves of each row's SHA-256, so partial sums combine on the map side,
    the order of rows does not matter, repeated rows count, and states can be added and taken away.
    """
    row = F.sha2(F.to_json(F.struct(*[named(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), part(1).alias("high"), part(16).alias("low"))


def changed_state(state: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The state after rows were added and removed, from the states of these rows alone."""
    signed = [(state, 1), *((s, sign) for s, sign in ((added, 1), (removed, -1)) if s is not None)]
    every = [s.select(*[(F.col(c) * sign).cast("decimal(38,0)").alias(c) for c in _SUMS]) for s, sign in signed]
    return reduce(DataFrame.union, every).agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in _SUMS]).withColumn("n", F.col("n").cast("long"))  # a row for each state


def fingerprint_of(state: DataFrame) -> DataFrame:
    return state.select(short_hash(F.concat_ws(":", *[F.col(c).cast("string") for c in _SUMS])).alias("fingerprint"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One hash of a result set of any size, whatever the order of its rows."""
    return fingerprint_of(fingerprint_state(df))
