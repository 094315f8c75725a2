"""Checks and repairs of sets of tests, which are tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checks import TYPES
from .identity import args_hash

COLUMN_TYPES = ("not_null", "unique", "accepted_values", "relationships")


def dedupe_tests(tests: DataFrame) -> DataFrame:
    """The first test of each (table, type, column, arguments)."""
    key = Window.partitionBy("table_name", "test_type", F.when(F.col("test_type") != "custom_sql", F.lower("column")), "_args").orderBy("position")
    return tests.withColumn("_args", args_hash(tests)).withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n", "_args")


def unknown_columns(tests: DataFrame, columns: DataFrame) -> DataFrame:
    """Column tests whose column the table does not have (names fold case) or whose name is malformed."""
    known = columns.select("table_name", F.lower("column_name").alias("_c")).distinct()
    asked = tests.where(F.col("test_type").isin(*COLUMN_TYPES)).withColumn("_c", F.lower("column"))
    return asked.join(known, ["table_name", "_c"], "left_anti").drop("_c")


def anchor_violations(tests: DataFrame, columns: DataFrame) -> DataFrame:
    """All violations: a column that does not exist, a test that sits at another column than its own."""
    missing = unknown_columns(tests, columns).select("table_name", "position", F.lit("nonexistent-column").alias("violation"))
    apart = tests.where(F.col("anchor").startswith("column.") & (F.lower(F.substring_index("anchor", ".", -1)) != F.lower("column")))
    return missing.union(apart.select("table_name", "position", F.lit("column-differs-from-anchor").alias("violation")))


def contract_violations(tests: DataFrame, columns: DataFrame, excluded: tuple[str, ...] = (), least_rules: int = 0) -> DataFrame:
    """Anchor violations, repeated not_null or unique, empty rules, excluded types, too few rules."""
    twice = tests.where(F.col("test_type").isin("not_null", "unique")).groupBy("table_name", "test_type", F.lower("column").alias("c")).agg(F.count("*").alias("n"), F.max("position").alias("position")).where("n > 1")
    parts = [
        anchor_violations(tests, columns),
        twice.select("table_name", "position", F.lit("duplicate-test").alias("violation")),
        tests.where((F.col("test_type") == "custom_sql") & (F.trim(F.coalesce("sql", F.lit(""))) == "")).select("table_name", "position", F.lit("empty-rule").alias("violation")),
    ]
    if excluded:
        parts.append(tests.where(F.col("test_type").isin(*excluded)).select("table_name", "position", F.lit("excluded-type").alias("violation")))
    if least_rules:
        few = tests.groupBy("table_name").agg(F.count_if(F.col("test_type") == "custom_sql").alias("n")).where(F.col("n") < least_rules)
        parts.append(few.select("table_name", F.lit(-1).alias("position"), F.lit("too-few-rules").alias("violation")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def skipped_tests(raw: DataFrame) -> DataFrame:
    """Entries that become no test, with the reason.

    raw: table_name, position, column (null at table level), name, body_json.
    """
    args = F.coalesce(F.get_json_object("body_json", "$.arguments"), F.col("body_json"))
    values = F.get_json_object(args, "$.values")
    bare = F.col("name").contains(".") | ~F.col("name").rlike(r"^[a-z_]+$")
    reason = (
        F.when(bare, "unsupported-test-type")
        .when(~F.col("name").isin(*TYPES), "custom-or-generic-test")
        .when(F.col("name").isin(*COLUMN_TYPES) & F.col("column").isNull(), "malformed-supported-test")
        .when((F.col("name") == "accepted_values") & ~F.coalesce(values.startswith("["), F.lit(False)), "malformed-supported-test")
        .when((F.col("name") == "relationships") & (F.get_json_object(args, "$.to").isNull() | F.get_json_object(args, "$.field").isNull()), "malformed-supported-test")
    )
    return raw.withColumn("reason", reason).where("reason IS NOT NULL")


def parse_raw_tests(raw: DataFrame) -> DataFrame:
    """Supported entries as rows of tests."""
    args = F.coalesce(F.get_json_object("body_json", "$.arguments"), F.col("body_json"))
    good = raw.join(skipped_tests(raw).select("table_name", "position"), ["table_name", "position"], "left_anti")
    to = F.regexp_extract(F.coalesce(F.get_json_object(args, "$.to"), F.lit("")), r"""(?:ref\(['"])?([A-Za-z0-9_.]+)""", 1)
    return good.select(
        "position", "table_name", F.coalesce(F.concat(F.lit("column."), F.col("column")), F.lit("model")).alias("anchor"), F.col("name").alias("test_type"), "column",
        F.from_json(F.get_json_object(args, "$.values"), "array<string>").alias("values"), F.when(to != "", to).alias("to"), F.get_json_object(args, "$.field").alias("field"), F.get_json_object(args, "$.sql").alias("sql"),
    )


def test_set_diff(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """added, removed and unchanged tests between two sets, by (table, anchor, type, arguments)."""
    key = ["table_name", "anchor", "test_type", "args_hash"]
    side = lambda df, c: df.withColumn("args_hash", args_hash(df)).select(*key).distinct().withColumn(c, F.lit(True))
    both = side(existing, "_old").join(side(proposed, "_new"), key, "full_outer")
    return both.select(*key, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("unchanged").alias("change"))
