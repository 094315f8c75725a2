"""Rubric scores: parsing, completion and aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_PASS_RATE, MIN_MEAN_SCORE = 0.7, 0.5


def parse_judgements(responses: DataFrame) -> DataFrame:
    """criterion_id, score, passed, reasoning, evidence and the kind of violation (null if sound) of each response.

    responses: artifact_id, criterion_id (asked), response_text.  A fenced block is unwrapped and
    the first JSON object of the text is taken.  Types are those of the JSON: a number in quotes is
    no score and a flag in quotes, 0 or 1 no flag; a null score is sound and stays null.
    """
    text = F.trim(F.col("response_text"))
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(fence != "", fence).otherwise(text), r"(?s)(\{.*\})", 1)
    rows = responses.withColumn("_v", F.try_parse_json(F.nullif(body, F.lit(""))))
    at = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    kind = lambda name: F.coalesce(F.schema_of_variant(at(name, "variant")), F.lit("MISSING"))
    score, number = at("score", "double"), kind("score").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    wrong = lambda name: ~kind(name).isin("STRING", "MISSING")
    violation = (
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "no-json")
        .when(kind("criterion_id") == "MISSING", "missing-criterion")
        .when(kind("score") == "MISSING", "missing-score")
        .when(kind("passed") == "MISSING", "missing-passed")
        .when(~at("criterion_id", "string").eqNullSafe(F.col("criterion_id")), "criterion-mismatch")
        .when((kind("score") != "VOID") & ~number, "score-not-a-number")
        .when(number & (score.isNull() | F.isnan(score) | ~score.between(0, 1)), "score-out-of-range")
        .when(kind("passed") != "BOOLEAN", "passed-not-boolean")
        .when(wrong("evidence") | wrong("reasoning"), "field-not-text")
    )
    rows = rows.withColumn("violation", violation)
    sound = lambda c: F.when(F.col("violation").isNull(), c)
    return rows.select(
        "artifact_id", "criterion_id", sound(score).alias("score"), sound(at("passed", "boolean")).alias("passed"),
        sound(at("reasoning", "string")).alias("reasoning"), sound(at("evidence", "string")).alias("evidence"), "violation",
    )


def invalid_scores(scores: DataFrame) -> DataFrame:
    """NaN, infinite or out of [0, 1]; a null score is allowed."""
    return scores.where(F.col("score").isNotNull() & (F.isnan("score") | ~F.col("score").between(0, 1)))


def work_list(artifacts: DataFrame, rubric: DataFrame) -> DataFrame:
    """Every artifact with every criterion, by criterion; the rubric (criterion_id, pos) is a handful of rows."""
    if rubric.count() > 1000:
        raise ValueError("a rubric has at most 1000 criteria")
    return artifacts.crossJoin(F.broadcast(rubric.select("criterion_id", "pos")))


def complete(work: DataFrame, scores: DataFrame, why: str = "not evaluated") -> DataFrame:
    """Scores of the whole work list; pairs without one are degraded: null score, not passed, with a reason."""
    out = work.join(scores, ["artifact_id", "criterion_id"], "left")
    return out.withColumn("passed", F.coalesce("passed", F.lit(False))).withColumn("reasoning", F.when(F.col("score").isNull(), F.coalesce("reasoning", F.lit(why))).otherwise(F.col("reasoning")))


def grade_summary(grades: DataFrame, *by: str) -> DataFrame:
    """pass_rate and mean_score over the scored rows (0 if none), whether all are scored, and the verdict."""
    scored = F.col("score").isNotNull()
    rate = F.coalesce(F.avg(F.when(scored, F.col("passed").cast("double"))), F.lit(0.0))
    mean = F.coalesce(F.avg("score"), F.lit(0.0))
    return grades.groupBy(*by).agg(F.round(rate, 6).alias("pass_rate"), F.round(mean, 6).alias("mean_score"), F.coalesce(F.bool_and(scored), F.lit(True)).alias("aggregate_complete"), F.count("*").alias("pairs"))


def grade_verdict(summary: DataFrame, min_pass_rate: float = MIN_PASS_RATE, min_mean_score: float = MIN_MEAN_SCORE) -> DataFrame:
    return summary.withColumn("passed", (F.col("pass_rate") >= min_pass_rate) & (F.col("mean_score") >= min_mean_score))


def artifact_grade(grades: DataFrame, *by: str) -> DataFrame:
    """Mean of the scored rows; passed only if all rows are scored and passed."""
    return grades.groupBy(*by, "artifact_id").agg(F.round(F.avg("score"), 6).alias("score"), (F.bool_and("passed") & F.bool_and(F.col("score").isNotNull())).alias("passed"))


def first_failing_criterion(grades: DataFrame, *by: str) -> DataFrame:
    """The first criterion, in rubric order, that did not pass or has no score."""
    bad = grades.where(~F.col("passed") | F.col("score").isNull())
    return bad.groupBy(*by, "artifact_id").agg(F.min_by(F.struct("criterion_id", "reasoning"), "pos").alias("_f")).select(*by, "artifact_id", F.col("_f.criterion_id").alias("criterion_id"), F.col("_f.reasoning").alias("reasoning"))


def first_evidence(grades: DataFrame, *by: str) -> DataFrame:
    """The first evidence that is not blank, in rubric order."""
    said = grades.where(F.trim(F.coalesce("evidence", F.lit(""))) != "")
    return said.groupBy(*by, "artifact_id").agg(F.min_by("evidence", "pos").alias("evidence"))


def degrade_rate(grades: DataFrame) -> DataFrame:
    return grades.groupBy("criterion_id").agg(F.round(F.avg(F.col("score").isNull().cast("double")), 6).alias("degrade_rate"), F.count("*").alias("n"))


def grade_drift(log: DataFrame, report: DataFrame) -> DataFrame:
    """Logged grades that the report lacks or shows with another score."""
    key = ["run_id", "artifact_id", "criterion_id"]
    said = report.select(*key, F.col("score").alias("_reported"), F.lit(True).alias("_there"))
    return log.join(said, key, "left").where(F.col("_there").isNull() | ~F.col("score").eqNullSafe(F.col("_reported"))).select(*key, "score", F.col("_reported").alias("reported_score"))
