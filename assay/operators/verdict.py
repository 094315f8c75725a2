"""From counts to verdicts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import Test, TimeLimit, evaluate, limited

REASONS = ("always-passes", "failed-on-known-clean-data", "kept", "requires-future-data", "kept-without-evidence")


def flatten(tests: Iterable[Test]) -> list[Test]:
    """Tests of columns first, in declared order, then those of the table."""
    tests = list(tests)
    return [t for t in tests if t.place != "model"] + [t for t in tests if t.place == "model"]


def tests_frame(spark: SparkSession, tests: Sequence[Test]) -> DataFrame:
    rows = [(i, t.table, t.place, t.type, t.column, list(t.values), t.to, t.field, t.sql, t.rationale) for i, t in enumerate(tests)]
    return spark.createDataFrame(rows, "position int, table_name string, anchor string, test_type string, column string, values array<string>, `to` string, field string, sql string, rationale string")


def validate_trusted(trusted: Iterable[str], known: Iterable[str]) -> set[str]:
    """Trusted tables must exist; checked before anything is scanned."""
    trusted = set(trusted)
    if missing := trusted - set(known):
        raise ValueError(f"trusted tables are not known: {sorted(missing)}")
    return trusted


def verdict(results: DataFrame, trusted: bool = False) -> DataFrame:
    """Add decision, reason and why to rows with status, failures and evaluated_rows."""
    ok, none = F.col("status") == "ok", F.col("failures") == 0
    reason = (
        F.when(F.col("status") == "future", "requires-future-data")
        .when(~ok, "kept-without-evidence")
        .when(none, "always-passes")
        .when(F.lit(trusted), "failed-on-known-clean-data")
        .otherwise("kept")
    )
    decision = F.when(F.col("reason").isin("kept", "kept-without-evidence"), "kept").otherwise("dropped")
    said = (
        F.when(F.col("reason") == "always-passes", F.format_string("passed on %d rows", "evaluated_rows"))
        .when(F.col("reason") == "kept", F.format_string("%d failures in %d rows", "failures", "evaluated_rows"))
        .when(F.col("reason") == "failed-on-known-clean-data", F.format_string("%d failures in %d rows of a trusted table", "failures", "evaluated_rows"))
        .when(F.col("reason") == "requires-future-data", F.concat(F.lit("not run: "), F.coalesce("why", F.lit("the target does not exist"))))
        .otherwise(F.concat(F.lit("not evaluated: "), F.coalesce("why", F.lit("unknown"))))
    )
    return results.withColumn("reason", reason).withColumn("decision", decision).withColumn("why", said)


def unevaluated(spark: SparkSession, tests: Sequence[Test], why: str) -> DataFrame:
    """Every test kept without evidence, for one reason."""
    return spark.createDataFrame([(i, None, None, None, "error", why) for i in range(len(tests))], "position int, failures long, excess_rows long, evaluated_rows long, status string, why string")


def prune(df: DataFrame, tests: Sequence[Test], tables: dict[str, DataFrame], trusted: bool = False, sample: Callable[[DataFrame], DataFrame] | None = None, enabled: bool = True, budget: float | None = None, timeout: float | None = None, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """One decision per test of a table, in flattened order.

    sample: how to draw the rows under test; if that fails, every test is kept without evidence.
    budget: seconds for everything, drawing the sample too; what runs when they are used up is cancelled, and
    tests that have not run are kept without evidence.  timeout: the same for one test.
    """
    spark, tests, scope = df.sparkSession, flatten(tests), "full"
    end = None if budget is None else clock() + budget
    if not enabled:
        found = unevaluated(spark, tests, "pruning is disabled")
    elif not tests:
        found = unevaluated(spark, tests, "")
    else:
        try:
            rows = limited(spark, budget, lambda: sample(df)) if sample else df
        except TimeLimit:
            found = unevaluated(spark, tests, f"sampling failed: the budget of {budget:g} s was used up")
        except Exception as e:
            found = unevaluated(spark, tests, f"sampling failed: {e}")
        else:
            scope = "sample" if sample else "full"
            found = evaluate(rows, tests, tables, full=df, budget=budget, end=end, timeout=timeout, clock=clock)
    out = tests_frame(spark, tests).join(F.broadcast(found), "position")
    return verdict(out, trusted).withColumn("scope", F.lit(scope))


#: Tables whose jobs are on their way at the same time.
TOGETHER = 4


def prune_many(tests: dict[str, Sequence[Test]], tables: dict[str, DataFrame], trusted: Iterable[str] = (), **options) -> DataFrame:
    """Decisions for several tables, some at a time; one that fails does not stop the others: its tests are kept without evidence."""
    trusted = validate_trusted(trusted, tables)
    spark = next(iter(tables.values())).sparkSession

    def judged(name: str) -> DataFrame:
        own = tests[name]
        try:
            if name not in tables:
                raise ValueError(f"table {name} is not known")
            return prune(tables[name], own, tables, name in trusted, **options)
        except Exception as e:
            gone = tests_frame(spark, flatten(own)).join(F.broadcast(unevaluated(spark, own, str(e)[:200])), "position")  # a row per test
            return verdict(gone).withColumn("scope", F.lit("none"))

    with ThreadPoolExecutor(TOGETHER) as pool:
        parts = [pool.submit(inheritable_thread_target(spark)(judged), name) for name in tests]
        return reduce(DataFrame.unionByName, [p.result() for p in parts])


def table_status(decisions: DataFrame) -> DataFrame:
    """The worst status of each table's tests (ok, then future, then error), and that of the whole run (null table)."""
    rank = F.max(F.when(F.col("status") == "error", 2).when(F.col("status") == "future", 1).otherwise(0))
    found = decisions.rollup("table_name").agg(rank.alias("_rank"), F.count("*").alias("tests"))
    return found.select("table_name", F.element_at(F.array(*map(F.lit, ("ok", "future", "error"))), F.col("_rank") + 1).alias("status"), "tests")


def summary(decisions: DataFrame) -> DataFrame:
    """kept, dropped and total per table."""
    return decisions.groupBy("table_name").agg(F.count_if(F.col("decision") == "kept").alias("kept"), F.count_if(F.col("decision") == "dropped").alias("dropped"), F.count("*").alias("total"))


def kept_rate_alert(decisions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Tables whose share of kept tests is at most the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is a share")
    return summary(decisions).where((F.col("total") > 0) & (F.col("kept") / F.col("total") <= threshold)).withColumn("kept_rate", F.round(F.col("kept") / F.col("total"), 6))


def drop_rate_by_type(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("test_type").agg(F.count("*").alias("drafted"), F.count_if(F.col("decision") == "dropped").alias("dropped"), F.count_if(F.col("decision") == "kept").alias("kept"))


def drop_reason_histogram(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("table_name", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "table_name", "reason")
