"""Small column functions that the operators share; all stay inside Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types without an order that min and max would mean anything for.
COMPLEX = (T.BinaryType, T.ArrayType, T.StructType, T.MapType, T.VariantType)


def named(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(df: DataFrame, name: str) -> Column:
    """The column in a form that hash functions take; maps become sorted entries."""
    kind = df.schema[name].dataType
    col = named(name)
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(col)))
    return F.to_json(col) if isinstance(kind, T.VariantType) else col


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    return F.xxhash64(*[hashable(df, c) for c in columns or df.columns])


def portable_hash(*columns: str) -> Column:
    """A 60-bit hash that other engines can repeat: the first 15 hex digits of md5 over the texts."""
    text = F.concat_ws("|", *[named(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where text was cut."""
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def first_sentence(text: Column, n: int = 120) -> Column:
    """Up to and including the first full stop that ends a sentence, n characters at most."""
    one = F.regexp_extract(F.trim(text), r"^(.*?\.)(?:\s|$)", 1)
    return F.substring(F.when(one != "", one).otherwise(F.trim(text)), 1, n)


def value_text(df: DataFrame, name: str, n: int = 40) -> Column:
    """A value as a report shows it: NULL, TRUE or FALSE, DATE('...'), a quoted and cut string, a number."""
    kind, col = df.schema[name].dataType, named(name)
    if isinstance(kind, T.BooleanType):
        out = F.upper(col.cast("string"))
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit("DATE('"), col.cast("string"), F.lit("')"))
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        out = F.concat(F.lit("TIMESTAMP('"), F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("')"))
    elif isinstance(kind, T.StringType):
        out = F.concat(F.lit("'"), truncate(col, n), F.lit("'"))
    elif isinstance(kind, COMPLEX):
        out = truncate(F.to_json(F.struct(col.alias("v"))), n)
    else:
        out = col.cast("string")
    return F.when(col.isNull(), F.lit("NULL")).otherwise(out)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
