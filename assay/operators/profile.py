"""Column profiles: exact statistics of all columns, in one job.

Up to GROUPED columns, each is grouped by its values (``checks.value_counts``), with map-side counts,
and the groups give its statistics: a scan reads that column alone, no row is multiplied, and a
value that most rows have is one row for each map task.  Tests of the same columns in the same job share these groups.

Wider tables are melted: one scan turns a row into its cells (number of the column, value in the type of
its family), cells are counted on the map side, and one exchange of distinct cells gives all
statistics.  The plan has one branch whatever the number of columns, and no name is part of an SQL text.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import COMPLEX, hashable, named
from .checks import value_counts

WIDE = 500
#: Columns that are grouped one by one at most; wider tables are melted.
GROUPED = 64


_STATS = ("non_null", "distinct_values", "nulls", "min_value", "max_value")


def _approximate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All columns from one aggregate without exchange of rows; distinct counts by a sketch."""
    rows, aggs = [], [F.count("*").alias("n")]
    none = F.lit(None).cast("string")
    for i, c in enumerate(cols):
        col, kind = named(c), df.schema[c].dataType
        plain = not isinstance(kind, COMPLEX)
        aggs += [F.count(col).alias(f"k{i}"), F.approx_count_distinct(hashable(df, c)).alias(f"d{i}"), *([F.min(col).cast("string").alias(f"a{i}"), F.max(col).cast("string").alias(f"z{i}")] if plain else [])]
        ends = [F.col(f"a{i}"), F.col(f"z{i}")] if plain else [none, none]
        values = (F.col(f"k{i}"), F.col(f"d{i}"), F.col("n") - F.col(f"k{i}"), *ends)
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kind.simpleString()).alias("data_type"), *[v.alias(name) for v, name in zip(values, _STATS, strict=True)]))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: Fields of a melted cell, by the family of its type, with the order that minimum and maximum take.
_FIELDS = {"whole": "bigint", "real": "double", "exact": "decimal(38,0)", "text": "string"}


def _cell(df: DataFrame, name: str) -> tuple[str, Column]:
    """The field of a column's values, and the values in its type."""
    kind, col = df.schema[name].dataType, named(name)
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return "whole", col.cast("bigint")
    if isinstance(kind, T.DateType):
        return "whole", F.unix_date(col).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return "whole", F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return "whole", F.unix_micros(F.to_utc_timestamp(col.cast("timestamp"), F.current_timezone()))
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "real", col.cast("double")
    if isinstance(kind, T.DecimalType):
        return "exact", F.regexp_replace(F.format_number(col, kind.scale), "[,.]", "").cast("decimal(38,0)")  # the unscaled number
    if isinstance(kind, T.BinaryType):
        return "text", F.hex(col)
    return "text", col if isinstance(kind, T.StringType) else F.when(col.isNotNull(), F.to_json(F.struct(hashable(df, name).alias("v")), {"ignoreNullFields": "false"})) if isinstance(kind, COMPLEX) else col.cast("string")


def _shown(kind: T.DataType, field: str, value: Column) -> Column:
    """A minimum or maximum as the text that a cast of the column gives."""
    if isinstance(kind, COMPLEX):
        return F.lit(None).cast("string")
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(value.cast("int")).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(value).cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return F.from_utc_timestamp(F.timestamp_micros(value), F.current_timezone()).cast("timestamp_ntz").cast("string")
    if isinstance(kind, T.DecimalType) and kind.scale:
        bare = F.lpad(F.abs(value).cast("string"), kind.precision + 1, "0")
        whole, part = F.substring(bare, 1, kind.precision + 1 - kind.scale), F.substring(bare, kind.precision + 2 - kind.scale, kind.scale)
        return F.concat(F.when(value < 0, "-").otherwise(""), F.regexp_replace(whole, "^0+(?=[0-9])", ""), F.lit("."), part)
    return value.cast(kind).cast("string") if field in ("whole", "real") else value.cast("string")


def _melted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same rows from one scan and one exchange of distinct cells."""
    cells = []
    for i, c in enumerate(cols):
        field, value = _cell(df, c)
        cells.append(F.struct(F.lit(i).alias("i"), *[(value if f == field else F.lit(None)).cast(t).alias(f) for f, t in _FIELDS.items()]))
    counted = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("i", *_FIELDS).agg(F.count("*").alias("n"))
    present = F.coalesce(*[F.col(f).cast("string") for f in _FIELDS]).isNotNull()
    ends = [f(name).alias(f"{mark}_{name}") for name in _FIELDS for f, mark in ((F.min, "a"), (F.max, "z"))]
    rows = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long")
    by_column = counted.groupBy("i").agg(rows(present).alias("non_null"), F.count_if(present).alias("distinct_values"), rows(~present).alias("nulls"), *ends)
    kinds = sorted({df.schema[c].dataType.json() for c in cols})
    names = df.sparkSession.createDataFrame([(i, c, df.schema[c].dataType.simpleString(), kinds.index(df.schema[c].dataType.json())) for i, c in enumerate(cols)], "i int, column string, data_type string, kind int")  # a row for each column
    shown = []
    for mark in ("a", "z"):
        out = F.lit(None).cast("string")
        for k, text in enumerate(kinds):
            kind = next(df.schema[c].dataType for c in cols if df.schema[c].dataType.json() == text)
            field = _cell(df, next(c for c in cols if df.schema[c].dataType.json() == text))[0]
            out = F.when(F.col("kind") == k, _shown(kind, field, F.col(f"{mark}_{field}"))).otherwise(out)
        shown.append(out)
    found = F.broadcast(names).join(by_column, "i", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("column", "data_type", zero("non_null"), zero("distinct_values"), zero("nulls"), shown[0].alias("min_value"), shown[1].alias("max_value"))


def _grouped(df: DataFrame, name: str) -> DataFrame:
    """The same row for one column, from the groups of its values."""
    kind = df.schema[name].dataType
    groups = value_counts(df, name)
    rows = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long")
    end = lambda f: f("v").cast("string") if not isinstance(kind, COMPLEX) else F.lit(None).cast("string")
    none = F.col("v").isNull()
    return groups.agg(rows(~none).alias("non_null"), F.count("v").alias("distinct_values"), rows(none).alias("nulls"), end(F.min).alias("min_value"), end(F.max).alias("max_value")).select(
        F.lit(name).alias("column"), F.lit(kind.simpleString()).alias("data_type"), "*"
    )


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """column, data_type, non_null, distinct_values, nulls, min_value and max_value (as text).

    Complex types have no minimum and maximum.  ``approximate`` is for tables so large that exact
    distinct counts are out of reach; exact is the default.
    """
    columns = list(columns or df.columns)
    if len(columns) > WIDE:
        logging.getLogger(__name__).warning("%d columns in one profile; consider splitting them", len(columns))
    if approximate:
        return _approximate(df, columns)
    if len(columns) > GROUPED:
        return _melted(df, columns)
    return reduce(DataFrame.union, [_grouped(df, c) for c in columns])


def profile_with_redaction(df: DataFrame, policy: DataFrame) -> DataFrame:
    """A profile that never reads redacted columns: they appear under their alias without statistics.

    policy: rows of ``redact.classify_columns`` for this table (column_name, redacted, alias); it
    has a row per column, and decides which columns are scanned at all.
    """
    rules = {r["column_name"]: r for r in policy.select("column_name", "redacted", "alias").collect()}
    hidden = [c for c in df.columns if c in rules and rules[c]["redacted"]]
    shown = [c for c in df.columns if c not in hidden]
    parts = [column_stats(df, shown)] if shown else []
    if hidden:
        rows = [(rules[c]["alias"], df.schema[c].dataType.simpleString()) for c in hidden]
        empty = df.sparkSession.createDataFrame(rows, "column string, data_type string")
        parts.append(empty.selectExpr("column", "data_type", "CAST(NULL AS bigint) non_null", "CAST(NULL AS bigint) distinct_values", "CAST(NULL AS bigint) nulls", "CAST(NULL AS string) min_value", "CAST(NULL AS string) max_value"))
    return reduce(DataFrame.union, parts)
