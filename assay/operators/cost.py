"""Token costs and joins across audit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

TOKENS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
# fixed values: model name prefixes and their providers
PROVIDERS = (("claude-", "anthropic"), ("gpt-", "openai"), ("gemini-", "gemini"))


def provider_of(model: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, name in PROVIDERS:
        out = F.when(model.startswith(prefix), name).otherwise(out)
    return out


def priced(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Add provider and cost; both are null for a model without a price.

    prices: model, input_per_mtok, output_per_mtok, cache_write_per_mtok, cache_read_per_mtok - a
    price list of at most a few thousand models.
    """
    if prices.count() > 10_000:
        raise ValueError("a price list has at most 10,000 models")
    rates = ("input_per_mtok", "output_per_mtok", "cache_write_per_mtok", "cache_read_per_mtok")
    cost = sum((F.coalesce(F.col(t), F.lit(0)) * F.col(r) for t, r in zip(TOKENS, rates, strict=True)), F.lit(0.0)) / 1e6
    return log.join(F.broadcast(prices), "model", "left").withColumn("provider", provider_of(F.col("model"))).withColumn("cost", F.when(F.col("provider").isNotNull(), cost)).drop(*rates)


def calls(response_log: DataFrame, grade_log: DataFrame) -> DataFrame:
    """Both logs as one list of calls with their stage."""
    cols = ["timestamp", "model_unique_id", "model", *TOKENS]
    return response_log.select(*cols, F.lit("draft").alias("stage")).unionByName(grade_log.select(*cols, F.lit("grade").alias("stage")))


def cost_by_model(priced_calls: DataFrame) -> DataFrame:
    sums = [F.sum(t).alias(t) for t in TOKENS]
    return priced_calls.where("cost IS NOT NULL").groupBy("provider", "model").agg(F.count("*").alias("calls"), *sums, F.round(F.sum("cost"), 6).alias("cost"))


def cost_report(priced_calls: DataFrame) -> DataFrame:
    """Cost and calls per model, with subtotals per provider and the grand total (nulls)."""
    return priced_calls.where("cost IS NOT NULL").rollup("provider", "model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


def unpriced_models(priced_calls: DataFrame) -> DataFrame:
    return priced_calls.where("cost IS NULL").groupBy("model").agg(F.count("*").alias("calls"))


def tokens_by_table_stage(all_calls: DataFrame) -> DataFrame:
    return all_calls.groupBy("model_unique_id", "stage").agg(*[F.sum(t).alias(t) for t in TOKENS])


def nearest_earlier(left: DataFrame, right: DataFrame, key: str, seconds: int, left_ts: str = "timestamp", right_ts: str = "timestamp") -> DataFrame:
    """As-of join: each left row with the latest right row of its key at or before it, within a window.

    A blocked prefix scan.  Both sides are sorted together into ranges of (key, time) of about equal
    size, whatever share one key, one hour or one instant has (a hash of the row cuts instants).  Within a range, one
    ordered window finds the last right row.  The last right row of each range is carried on into the
    ranges of the same key that follow: one row for each range, so this is small by counting.  Of right
    rows at one instant the one with the largest hash counts.  Rows without key or time match nothing.
    """
    columns = [c for c in right.columns if c not in (key, right_ts)]
    facts = F.struct(F.col(right_ts).alias("ts"), *columns)
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("c")).schema["c"].dataType)
    asked = F.struct(*left.columns)
    events = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(key, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.xxhash64(*right.columns).alias("_tie"), facts.alias("_right"), none(left, asked).alias("_left"))
    asks = left.select(key, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_tie"), none(right, facts).alias("_right"), asked.alias("_left"))
    order = ["_t", "_side", "_tie"]
    # written, so that the ranges stay as they are in both uses
    dealt = events.unionByName(asks).repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "asof")
    seen = dealt.withColumn("_last", F.last("_right", ignorenulls=True).over(Window.partitionBy(key, "_range").orderBy(*order)))
    ends = dealt.groupBy(key, "_range").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_end"), F.count("*").alias("_n"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.withColumn("_carried", carried).where("_carried is not null").select(key, "_range", "_carried")
    found = seen.where("_side = 1").join(F.broadcast(carry), [key, "_range"], "left")  # only keys that go on from one range to the next
    last = F.coalesce("_last", "_carried")
    found = found.withColumn("_last", F.when(last["ts"] >= F.col("_t") - F.expr(f"INTERVAL {seconds} SECONDS"), last))
    return found.select("_left.*", F.col("_last.ts").alias(f"matched_{right_ts}"), *[F.col(f"_last.{c}").alias(f"matched_{c}") for c in columns])
