"""Candidate tests from a profile, by fixed rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import named
from ..sources.scratch import materialise
from .checks import Test

#: Share of distinct values from which a column looks like a key, and the most values of a list.
KEY_SHARE, MOST_VALUES = 0.99, 8
#: Share of a column's rows that must have a parent for a reference to be proposed.
CONTAINED = 0.9


def propose_frame(profile: DataFrame) -> DataFrame:
    """(column, test_type): not_null for all, unique for key-like columns, accepted_values for short lists."""
    rows = F.col("non_null") + F.col("nulls")
    kinds = F.array_compact(
        F.array(
            F.lit("not_null"),
            F.when((F.col("non_null") > 0) & (F.col("distinct_values") >= KEY_SHARE * F.col("non_null")), F.lit("unique")),
            F.when((F.col("distinct_values") > 0) & (F.col("distinct_values") <= MOST_VALUES) & (F.col("distinct_values") < rows) & (F.col("data_type") == "string"), F.lit("accepted_values")),
        )
    )
    return profile.select("column", F.explode(kinds).alias("test_type"))


def propose_candidates(df: DataFrame, table: str, profile: DataFrame, parents: dict[str, DataFrame] | None = None) -> list[Test]:
    """Tests of one table.  Lists of values hold what all rows have.

    parents: tables by name.  A column whose values a key of another table contains (``references``, measured on
    all rows) is proposed as a reference to it, if it is named like the key or uses half of it.
    """
    out = []
    kinds = propose_frame(profile).collect()  # metadata: a few rows per column
    lists = [r["column"] for r in kinds if r["test_type"] == "accepted_values"]
    found = df.agg(*(F.slice(F.array_sort(F.collect_set(F.col(c).cast("string"))), 1, MOST_VALUES + 1) for c in lists)).first() if lists else ()  # the profile says that they are short
    values = dict(zip(lists, found, strict=True))
    for column, kind in kinds:
        out.append(Test(table, kind, column, tuple(values[column])) if kind == "accepted_values" else Test(table, kind, column))
    others = {n: p for n, p in (parents or {}).items() if n != table}
    like = lambda a, b: a.split("_", 1)[-1] == b.split("_", 1)[-1]
    found = references({table: df, **others}).where(F.col("child_table") == table).orderBy("child_column", "parent_table", "parent_column").collect() if others else []  # a row for each pair of columns
    out += [Test(table, "relationships", r.child_column, to=r.parent_table, field=r.parent_column) for r in found if like(r.child_column, r.parent_column) or r.coverage >= 0.5]
    return out


#: Families of values that are compared with each other.
_FAMILIES = (((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "whole"), ((T.StringType,), "text"), ((T.DateType,), "day"))


def references(tables: dict[str, DataFrame], least: float = CONTAINED) -> DataFrame:
    """Inclusion dependencies: child_table, child_column, parent_table, parent_column, contained, coverage.

    contained: the share of the child's non-null rows whose value is in the parent's column, which must be a key
    (no value twice).  coverage: the share of the parent's values that the child uses.  Whole
    numbers, texts and dates are compared, each with its own kind.  All pairs of columns are judged at
    once from an inverted index: each table's cells are counted by (column, value) on the map side, one
    exchange brings the columns of a value together, at most one entry for each column, and the pairs
    within these lists are counted.
    """
    spark = next(iter(tables.values())).sparkSession
    columns: list[tuple[str, str]] = []
    counted = []
    for name, df in tables.items():
        cells = []
        for field in df.schema:
            kind = next((k for types, k in _FAMILIES if isinstance(field.dataType, types)), None)
            if kind:
                cells.append(F.struct(F.lit(len(columns)).alias("i"), F.lit(kind).alias("kind"), named(field.name).cast("string").alias("v")))
                columns.append((name, field.name))
        if cells:
            counted.append(df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("v IS NOT NULL").groupBy("i", "kind", "v").agg(F.count("*").alias("n")))
    schema = "i int, t string, c string"
    names = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(columns)], schema)  # a row for each column
    if not counted:
        return spark.createDataFrame([], "child_table string, child_column string, parent_table string, parent_column string, contained double, coverage double")
    index = materialise(reduce(DataFrame.unionByName, counted).groupBy("kind", "v").agg(F.collect_list(F.struct("i", "n")).alias("held")), "values")  # a list has an entry for each column at most
    sizes = index.select(F.explode("held").alias("h")).groupBy("h.i").agg(F.sum("h.n").alias("rows"), F.count("*").alias("values"))
    known = {r.i: r for r in sizes.collect()}  # a row for each column
    keys = [i for i, r in known.items() if r["rows"] == r["values"]]
    own = [next(k for k, t in enumerate(tables) if t == name) for name, _ in columns]
    table_of = F.array(*[F.lit(k) for k in own])
    pairs = index.where(F.size("held") > 1).select("held", F.explode(F.filter("held", lambda h: h["i"].isin(keys))).alias("p")).select("p", F.explode("held").alias("c")).where(F.get(table_of, F.col("c.i")) != F.get(table_of, F.col("p.i")))
    met = pairs.groupBy(F.col("c.i").alias("ci"), F.col("p.i").alias("pi")).agg(F.sum("c.n").alias("rows"), F.count("*").alias("values"))
    totals = names.join(sizes, "i")
    child, parent = (totals.select(F.col("i").alias(f"{k}i"), F.col("t").alias(f"{n}_table"), F.col("c").alias(f"{n}_column"), F.col("rows").alias(f"{k}rows"), F.col("values").alias(f"{k}values")) for k, n in (("c", "child"), ("p", "parent")))
    found = met.join(F.broadcast(child), "ci").join(F.broadcast(parent), "pi")
    share = F.col("rows") / F.col("crows")
    return found.where(share >= least).select("child_table", "child_column", "parent_table", "parent_column", F.round(share, 6).alias("contained"), F.round(F.col("values") / F.col("pvalues"), 6).alias("coverage"))
