"""Audit logs as JSON lines: reading with a pinned schema, quarantine, appending, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LOGS, REQUIRED
from .scratch import materialise

#: Bytes that one record may take.
RECORD_BYTES = 4000
_BAD = "_corrupt_record"


def _raw(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    schema = T.StructType([*LOGS[kind].fields, T.StructField(_BAD, T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", _BAD).json(paths)
    return rows.select(*schema.names, F.col("_metadata.file_path").alias("_file"))  # and no batch of append_audit


def _problem(kind: str) -> Column:
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing field: {c}")) for c in REQUIRED[kind]]
    numbers = [c for c in LOGS[kind].names if c.endswith("_tokens")]
    negative = [F.when(F.col(c) < 0, F.lit(f"negative: {c}")) for c in numbers]
    score = [F.when((F.col("score") < 0) | (F.col("score") > 1) | F.isnan("score"), F.lit("score out of range"))] if kind == "grade" else []
    return F.coalesce(F.when(F.col(_BAD).isNotNull(), F.lit("not JSON of this shape")), *missing, *negative, *score)


def read_audit(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    """The sound records of a log; blank lines are no records."""
    return _raw(spark, paths, kind).where(_problem(kind).isNull()).drop(_BAD, "_file")


def malformed_records(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    """file, reason and text (where it is not JSON) of the other records."""
    rows = _raw(spark, paths, kind)
    return rows.select(F.col("_file").alias("file"), _problem(kind).alias("reason"), F.col(_BAD).alias("record")).where("reason IS NOT NULL")


def oversized(df: DataFrame, limit: int = RECORD_BYTES) -> Column:
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) > limit


def append_audit(df: DataFrame, path: str, limit: int = RECORD_BYTES, batch_id: int | str | None = None) -> DataFrame:
    """Append records to a log, by table; returns the records that are too long to be written.

    The records are computed once, so a source that changes or draws random numbers loses and doubles none.
    With a batch_id the batch has a folder of its own, which a repeated append of the batch replaces.
    """
    rows = materialise(df.withColumn("_long", oversized(df, limit)), "append")
    target, mode = (path, "append") if batch_id is None else (f"{path.rstrip('/')}/batch={batch_id}", "overwrite")
    rows.where(~F.col("_long")).drop("_long").write.mode(mode).partitionBy("model_unique_id").json(target)
    return rows.where("_long").drop("_long")


def write_report(df: DataFrame, path: str, by: str = "table_name") -> None:
    """Replace the report of each table in ``df``; other tables' reports stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def version_gate(log: DataFrame, least: int) -> DataFrame:
    return log.where(F.col("audit_schema_version") >= least)
