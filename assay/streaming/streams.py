"""Audit logs and data tables as streams.

Event-time windows carry watermarks, so state is bounded; append mode emits a window once it can
not change.  Rows later than the watermark are dropped by Spark; ``check_batches`` counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import Test
from ..operators.cost import priced
from ..operators.verdict import prune
from ..schemas import LOGS


def audit_stream(spark: SparkSession, path: str, kind: str, files_per_trigger: int = 100) -> DataFrame:
    """Tail a log."""
    return spark.readStream.schema(LOGS[kind]).option("maxFilesPerTrigger", files_per_trigger).json(path)


def reason_counts(stream: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 day", by: Sequence[str] = ("model_unique_id", "reason")) -> DataFrame:
    """Counts per window; tumbling, or sliding if ``slide`` is given."""
    w = F.window("timestamp", length, slide or length)
    return stream.withWatermark("timestamp", late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def kept_rate_by_window(stream: DataFrame, length: str = "1 day", late: str = "1 day", threshold: float = 0.0) -> DataFrame:
    """Windows and tables whose share of kept tests is at most the threshold."""
    counted = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", length), "model_unique_id").agg(F.count_if(F.col("decision") == "kept").alias("kept"), F.count("*").alias("total"))
    return counted.where(F.col("kept") / F.col("total") <= threshold).select(F.col("window.start").alias("window_start"), "model_unique_id", "kept", "total")


def without_duplicates(stream: DataFrame, key: str = "record_id", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark([key])


def pairs(left: DataFrame, right: DataFrame, key: str, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Each right record with the left records of its key in the time before it."""
    a = left.withWatermark("timestamp", late).select(F.col(key).alias("_k"), F.col("timestamp").alias("left_ts"), F.struct(*left.columns).alias("l"))
    b = right.withWatermark("timestamp", late).select(F.col(key), F.col("timestamp").alias("right_ts"), F.struct(*right.columns).alias("r"))
    return b.join(a, F.expr(f"_k = {key} AND left_ts <= right_ts AND left_ts >= right_ts - INTERVAL {within}")).drop("_k")


def running_cost(stream: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost and calls per model so far; for update or complete mode."""
    return priced(stream, prices).where("cost IS NOT NULL").groupBy("provider", "model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of records of a key without a gap."""
    found = stream.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def check_batches(stream: DataFrame, tests: Sequence[Test], sink: Callable[[DataFrame, int], None], checkpoint: str, late: str = "1 day", ts: str = "timestamp", tables: dict[str, DataFrame] | None = None) -> StreamingQuery:
    """Run the tests on every micro-batch and hand its decisions to ``sink``.

    late: how far an event may lie behind the latest one that earlier batches saw.  Rows behind this
    watermark are tested like others and counted as late_rows, so they are not lost silently.  The
    latest event so far is kept beside the checkpoint in two places that batches write in turn: a batch reads
    what the batch before it left, and one that runs again finds the watermark that it had.  So the ten
    thousandth batch costs what the tenth did.
    """
    marks, kept = f"{checkpoint.rstrip('/')}-latest", "batch_id long, latest timestamp"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            seen = spark.read.schema(kept).parquet(f"{marks}/{(batch_id - 1) % 2}").where(F.col("batch_id") == batch_id - 1) if batch_id else spark.createDataFrame([], kept)
            before = seen.agg(F.max("latest").alias("latest")).withColumn("mark", F.col("latest") - F.expr(f"INTERVAL {late}")).first()
            at = F.col(ts).cast("timestamp")
            facts = rows.agg(F.max(at), F.count_if(at < F.lit(before.mark).cast("timestamp"))).first()
            sink(prune(rows, tests, tables or {}).withColumns({"batch_id": F.lit(batch_id).cast("long"), "late_rows": F.lit(facts[1] or 0).cast("long")}), batch_id)
            latest = max((x for x in (before.latest, facts[0]) if x is not None), default=None)
            spark.createDataFrame([(batch_id, latest)], kept).coalesce(1).write.mode("overwrite").parquet(f"{marks}/{batch_id % 2}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, into Parquet."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
