"""Whole runs: tests that are already written, and tests proposed from a profile."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, hygiene, identity, profile, propose, verdict
from ..operators.checks import Test


class Run(NamedTuple):
    decisions: DataFrame  # a row per test, with artifact_id
    skipped: DataFrame  # entries that are no test, with the reason
    changes: DataFrame  # removed and unchanged tests, against the existing set


def tests_from(rows: DataFrame) -> list[Test]:
    """Tests of a table of tests: metadata, a few rows per column of the data."""
    rows = rows.select("table_name", "test_type", "column", "values", "to", "field", "sql", "anchor").orderBy("position") if "position" in rows.columns else rows
    return [Test(r["table_name"], r["test_type"], r["column"], tuple(r["values"] or ()), r["to"], r["field"], r["sql"], anchor=r["anchor"]) for r in rows.collect()]


def prune_existing(df: DataFrame, raw: DataFrame, tables: dict[str, DataFrame], trusted: bool = False) -> Run:
    """Verdicts on the written tests of one table.

    raw: entries as ``hygiene.skipped_tests`` takes them.  What is not supported is reported and
    never lost; repeated tests are judged once.
    """
    tests = hygiene.dedupe_tests(hygiene.parse_raw_tests(raw))
    columns = df.sparkSession.createDataFrame([(r["table_name"], c) for r in tests.select("table_name").distinct().collect() for c in df.columns], "table_name string, column_name string")
    stray = hygiene.unknown_columns(tests, columns).select(*raw.select("table_name", "position").columns, F.col("test_type").alias("name"), F.lit("nonexistent-column").alias("reason"))
    skipped = hygiene.skipped_tests(raw).select("table_name", "position", "name", "reason").unionByName(stray)
    sound = tests.join(stray, ["table_name", "position"], "left_anti")
    decisions = identity.with_artifact_ids(verdict.prune(df, tests_from(sound), tables, trusted))
    return Run(decisions, skipped, hygiene.test_set_diff(sound, decisions.where("decision = 'kept'")))


def profile_and_evaluate(df: DataFrame, tests: Sequence[Test], tables: dict[str, DataFrame]) -> DataFrame:
    """Profile of a table and counts of its tests from one job: kind, name, rows, found.

    kind ``column``: non-null rows and distinct values of the column; ``test``: evaluated rows and failures of the test at
    that position.  A column that is both profiled and tested by its values is grouped once: both
    sides read the same exchange.  Tests that can not be analysed have no row.
    """
    stats = profile.column_stats(df).select(F.lit("column").alias("kind"), F.col("column").alias("name"), F.col("non_null").alias("rows"), F.col("distinct_values").alias("found"))
    counted = checks.plan(df, tests, tables)
    if not counted.units:
        return stats
    found = checks.joint(counted.units).select(F.lit("test"), F.col("position").cast("string"), "evaluated_rows", "failures")
    return stats.union(found)


def propose_and_prune(df: DataFrame, table: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Profile a table, propose tests by rule, and judge them."""
    tests = propose.propose_candidates(df, table, profile.column_stats(df), tables)
    return identity.with_artifact_ids(verdict.prune(df, tests, tables))
