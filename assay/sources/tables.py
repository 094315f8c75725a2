"""Table scans: resolve, project, filter by partition, count."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPARISONS = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "!=": operator.ne}


class PartitionFilter(NamedTuple):
    """column, an operator of COMPARISONS, and a date, datetime or string."""

    column: str
    op: str
    value: date | datetime | str


def scan(spark: SparkSession, ref: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table by catalogue name, or by path if the reference has a slash; only ``columns`` are read."""
    df = spark.read.parquet(ref) if "/" in ref else spark.table(ref)
    return df.select(*columns) if columns is not None else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", columns or None)


def is_directory(spark: SparkSession, path: str) -> bool:
    """Whether a table is a directory of part files, in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def partition_condition(by: PartitionFilter) -> Column:
    if by.op not in COMPARISONS:
        raise ValueError(f"operator {by.op!r} is not one of {sorted(COMPARISONS)}")
    if not isinstance(by.value, date | datetime | str):
        raise TypeError("a partition value is a date, a datetime or a string")
    return COMPARISONS[by.op](F.col(by.column), F.lit(by.value))


def scan_partition(df: DataFrame, by: PartitionFilter | None) -> DataFrame:
    """The rows of a partition filter; pushed to the scan by Catalyst."""
    return df if by is None else df.where(partition_condition(by))


def row_count(df: DataFrame) -> int | None:
    """Rows, from a scan without columns; None for an empty table, whose size no sample can use."""
    return df.count() or None
