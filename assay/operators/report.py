"""Tiers and report entries from decisions and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_sentence, truncate
from .grades import artifact_grade

WHY = 80
TIERS = ("kept", "kept-uncertain", "dropped", "flagged")


def stray_tables(decisions: DataFrame, grades: DataFrame) -> DataFrame:
    """Tables that have grades and no decisions."""
    return grades.select("table_name").distinct().join(decisions.select("table_name").distinct(), "table_name", "left_anti")


def check_same_tables(decisions: DataFrame, grades: DataFrame) -> None:
    """Grades must be of tables that have decisions; ``tiers`` says the same while it runs."""
    if names := [r[0] for r in stray_tables(decisions, grades).limit(5).collect()]:
        raise ValueError(f"grades of tables without decisions: {names}")


def _summed(grades: DataFrame) -> DataFrame:
    """Score, verdict, first failing criterion with its reasoning, and first evidence of each artifact, from one grouping."""
    bad = ~F.col("passed") | F.col("score").isNull()
    evidence = F.when(F.trim("evidence") != "", F.col("evidence")) if "evidence" in grades.columns else F.lit(None).cast("string")
    first = lambda what, which: F.min_by(what, F.when(which, F.col("pos")))
    one = grades.withColumn("_e", evidence).groupBy("table_name", "artifact_id").agg(
        F.round(F.avg("score"), 6).alias("score"), (F.bool_and("passed") & F.bool_and(F.col("score").isNotNull())).alias("passed"),
        first(F.struct("criterion_id", "reasoning"), bad).alias("_f"), first("_e", F.col("_e").isNotNull()).alias("_evidence"),
    )
    return one.select("table_name", "artifact_id", "score", "passed", F.col("_f.criterion_id").alias("criterion_id"), F.col("_f.reasoning").alias("_because"), "_evidence")


def tiers(decisions: DataFrame, grades: DataFrame) -> DataFrame:
    """Add score, passed, tier and tier_why to decisions (which have table_name and artifact_id).

    The text of a kept test is its rationale, else the first evidence of its grades, else why it was
    kept.  Grades of tables without decisions are an error.  Grades are grouped once, for all of this.
    """
    by = ["table_name", "artifact_id"]
    graded = decisions.join(_summed(grades), by, "left")
    stray = stray_tables(decisions, grades).agg(F.min("table_name").alias("_stray"))
    # one more row, which brings the error or goes; no job runs before the rows are asked for
    marked = graded.withColumn("_mark", F.lit(False)).unionByName(stray.withColumn("_mark", F.lit(True)), allowMissingColumns=True)
    error = F.raise_error(F.concat(F.lit("grades of tables without decisions: "), "_stray")).cast("boolean")
    graded = marked.where(F.when(~F.col("_mark"), F.lit(True)).when(F.col("_stray").isNull(), F.lit(False)).otherwise(error)).drop("_stray", "_mark")
    tier = (
        F.when(F.col("decision") == "dropped", "dropped")
        .when(F.col("reason") == "kept-without-evidence", "kept-uncertain")
        .when(F.col("passed").isNull(), "kept")
        .when(~F.col("passed") | F.col("score").isNull(), "flagged")
        .otherwise("kept")
    )
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    flagged = F.concat(F.lit("failed grading: "), F.coalesce("criterion_id", F.lit("?")), F.lit(" — "), F.coalesce(first_sentence(F.col("_because")), F.lit("no reason given")))
    said = F.when(F.col("tier") == "flagged", flagged).when(F.col("tier") == "kept", F.coalesce(blank("rationale"), blank("_evidence"), blank("why"))).otherwise(F.col("why"))
    return graded.withColumn("tier", tier).withColumn("tier_why", truncate(said, WHY)).drop("criterion_id", "_because", "_evidence")


def tier_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("tier").agg(F.count("*").alias("n"))


def report_entries(tiered: DataFrame, descriptions: DataFrame, grades: DataFrame) -> DataFrame:
    """Entries of descriptions first, then one of each decision.

    descriptions: table_name, artifact_id; their tier comes from their grades alone.
    """
    graded = descriptions.join(artifact_grade(grades, "table_name"), ["table_name", "artifact_id"], "left")
    tier = F.when(F.col("passed").isNull() | F.col("passed"), "kept").otherwise("flagged")
    docs = graded.select("table_name", F.lit(0).alias("part"), F.lit(0).alias("position"), "artifact_id", F.lit(None).cast("string").alias("test_type"), tier.alias("tier"), F.lit(None).cast("string").alias("drop_reason"), "score", "passed")
    tests = tiered.select("table_name", F.lit(1).alias("part"), "position", "artifact_id", "test_type", "tier", F.when(F.col("tier") == "dropped", F.col("reason")).alias("drop_reason"), "score", "passed")
    return docs.unionByName(tests)


def proposed_tests(tests: DataFrame, tiered: DataFrame) -> DataFrame:
    """Tests whose artifact was kept, one of each (table, anchor, type, arguments), sorted."""
    kept = tiered.where(F.col("tier") != "dropped").select("table_name", "artifact_id")
    out = tests.join(kept, ["table_name", "artifact_id"], "left_semi")
    one = out.groupBy("table_name", "anchor", "test_type", "args_hash").agg(F.min("artifact_id").alias("artifact_id"))
    return one.orderBy("table_name", "anchor", "test_type", "args_hash")
