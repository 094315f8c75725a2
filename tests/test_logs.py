"""Audit logs, costs, as-of joins and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from assay.operators import cost
from assay.operators.checks import Test
from assay.sources import audit
from assay.sources.scratch import new_path
from assay.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def record(**more):
    return {"audit_schema_version": 2, "record_id": "r1", "timestamp": "2024-01-01T00:00:00Z", "model_unique_id": "m", "decision": "kept", "reason": "kept", **more}


@pytest.fixture
def log(tmp_path):
    lines = [json.dumps(record()), "", json.dumps(record(record_id="r2", audit_schema_version=1, extra=5)), '{"record_id": "r3", ', json.dumps({"record_id": "r4"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "log.jsonl")


def test_logs_and_quarantine(spark, log, tmp_path):
    good = audit.read_audit(spark, log, "prune")
    assert sorted(r["record_id"] for r in good.collect()) == ["r1", "r2"]
    bad = {r["reason"] for r in audit.malformed_records(spark, log, "prune").collect()}
    assert bad == {"not JSON of this shape", "missing field: timestamp"}
    assert [r["record_id"] for r in audit.version_gate(good, 2).collect()] == ["r1"]
    long = good.withColumn("why", F.when(F.col("record_id") == "r2", F.repeat(F.lit("x"), 5000)))
    assert [r["record_id"] for r in audit.append_audit(long, str(tmp_path / "out")).collect()] == ["r2"]
    assert [r["record_id"] for r in audit.read_audit(spark, str(tmp_path / "out"), "prune").collect()] == [] or spark.read.json(str(tmp_path / "out")).count() == 1


def test_reports_of_other_tables_stay(spark, tmp_path):
    path = str(tmp_path / "report")
    frame = lambda rows: spark.createDataFrame(rows, "table_name string, n int")
    audit.write_report(frame([("a", 1), ("b", 1)]), path)
    audit.write_report(frame([("b", 2)]), path)
    assert {(r["table_name"], r["n"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}


def test_costs(spark):
    log = spark.createDataFrame([(T0, "t", "gpt-a", 1_000_000, 0, None, 0), (T0, "t", "gpt-a", 0, 1_000_000, 0, 0), (T0, "t", "new", 5, 5, 0, 0)], "timestamp timestamp, model_unique_id string, model string, input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long")
    prices = spark.createDataFrame([("gpt-a", 2.0, 8.0, 0.0, 0.0), ("idle", 1.0, 1.0, 1.0, 1.0)], "model string, input_per_mtok double, output_per_mtok double, cache_write_per_mtok double, cache_read_per_mtok double")
    priced = cost.priced(log, prices)
    one = cost.cost_by_model(priced).first()
    assert (one["provider"], one["calls"], one["cost"]) == ("openai", 2, 10.0)
    assert [(r["model"], r["calls"]) for r in cost.unpriced_models(priced).collect()] == [("new", 1)]
    assert cost.cost_report(priced).where("provider IS NULL AND model IS NULL").first()["cost"] == 10.0
    assert {r["stage"] for r in cost.calls(log, log).collect()} == {"draft", "grade"}


def test_nearest_earlier_against_brute_force(spark):
    import random

    r = random.Random(1)
    left = [(i, r.choice("ab"), T0 + dt.timedelta(seconds=r.randrange(5000))) for i in range(200)]
    right = [(i, r.choice("ab"), T0 + dt.timedelta(seconds=r.randrange(5000))) for i in range(60)]
    got = cost.nearest_earlier(spark.createDataFrame(left, "l int, k string, timestamp timestamp"), spark.createDataFrame(right, "r int, k string, timestamp timestamp"), "k", 100)
    for row in got.collect():
        near = [b for b in right if b[1] == row["k"] and dt.timedelta(0) <= row["timestamp"] - b[2] <= dt.timedelta(seconds=100)]
        assert row["matched_timestamp"] == max((b[2] for b in near), default=None)
    assert got.count() == 200


def test_one_key_with_all_rows_is_dealt_to_ranges(spark):
    """Also if all rows share an instant; the same result whatever the number of ranges."""
    import random

    r = random.Random(2)
    at = lambda: T0 + dt.timedelta(seconds=r.choice([50, 50, 50, r.randrange(400)]))
    left = [(i, "hot" if i % 9 else None, None if i % 31 == 0 else at()) for i in range(600)]
    right = [(i, "hot" if i % 7 else "cold", at()) for i in range(300)] + [(900, None, T0), (901, "hot", None)]
    a, b = spark.createDataFrame(left, "l int, k string, timestamp timestamp"), spark.createDataFrame(right, "r int, k string, timestamp timestamp")
    results = []
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = cost.nearest_earlier(a, b, "k", 60)
        results.append(sorted((x["l"], str(x["matched_timestamp"]), x["matched_r"] or -1) for x in out.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and len(results[0]) == 600
    for l, when, _ in results[0]:
        _, k, t = left[l]
        near = [x[2] for x in right if k and t and x[1] == k and x[2] and dt.timedelta(0) <= t - x[2] <= dt.timedelta(seconds=60)]
        assert when == str(max(near, default=None))


def test_appending_computes_its_records_once(spark, tmp_path):
    """Records that are drawn anew each time are written or returned, never both and never neither."""
    path = str(tmp_path / "log")
    drawn = spark.range(400).select(F.col("id").cast("string").alias("record_id"), F.lit("m").alias("model_unique_id"), F.when(F.rand() < 0.5, F.repeat(F.lit("x"), 5000)).alias("reason"))
    long = audit.append_audit(drawn, path)
    kept = spark.read.json(path).select(F.col("record_id").cast("string"))
    assert sorted(r[0] for r in kept.union(long.select("record_id")).collect()) == sorted(map(str, range(400))) and 100 < long.count() < 300


def test_a_repeated_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = rows(spark, 6)
    for k in ("a", "b", "a"):
        audit.append_audit(batch, path, batch_id=k)
    assert spark.read.json(path).groupBy("batch").count().orderBy("batch").collect() == [("a", 6), ("b", 6)]


def rows(spark, n=40):
    return spark.createDataFrame([(T0 + dt.timedelta(hours=i), f"m{i % 2}", "kept" if i % 4 else "dropped", "x", f"r{i % 30}") for i in range(n)], "timestamp timestamp, model_unique_id string, decision string, reason string, record_id string")


@pytest.fixture
def stream(spark):
    path = new_path(spark, "rows")
    df = rows(spark)
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(spark, df):
    out = new_path(spark, "out")
    streams.drain(df, out, new_path(spark, "state"))
    return spark.read.schema(df.schema).parquet(out)


def test_windows_alerts_duplicates_sessions(spark, stream):
    counts = drained(spark, streams.reason_counts(stream, "6 hours", late="1 hour"))
    assert counts.agg(F.sum("n")).first()[0] == 36  # windows that ended before the watermark
    sliding = drained(spark, streams.reason_counts(stream, "6 hours", "3 hours", "1 hour"))
    assert sliding.count() > counts.count()
    alert = drained(spark, streams.kept_rate_by_window(stream, "4 hours", "1 hour", 0.5)).collect()
    assert alert and all(r["kept"] <= 0.5 * r["total"] for r in alert)
    assert drained(spark, streams.without_duplicates(stream, late="9 days")).count() == 30
    sessions = drained(spark, streams.sessions(stream, "model_unique_id", "3 hours", "1 hour"))
    assert sessions.count() == 0  # both are still open


def test_a_log_can_be_tailed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(record()) + "\n")
    assert drained(spark, streams.audit_stream(spark, str(tmp_path / "in"), "prune").select("record_id", "decision")).first()["record_id"] == "r1"


def test_batches_are_tested(spark, stream):
    out = []
    query = streams.check_batches(stream, [Test("log", "accepted_values", "decision", ("kept",)), Test("log", "not_null", "nothing")], lambda d, i: out.extend(d.collect()), new_path(spark, "state"), late="1 day")
    query.awaitTermination()
    assert {(r["test_type"], r["failures"], r["reason"], r["late_rows"]) for r in out} == {("accepted_values", 10, "kept", 0), ("not_null", None, "kept-without-evidence", 0)}


def test_many_batches_leave_two_marks_and_go_on_after_a_restart(spark, tmp_path):
    """A batch reads one row of the batch before it, whatever their number."""
    source, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    schema = "timestamp timestamp, decision string"
    for k in range(5):
        spark.createDataFrame([(T0 + dt.timedelta(hours=h), "kept") for h in (20 - 4 * k, 30 + k)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        tests = [Test("log", "not_null", "decision")]
        streams.check_batches(stream, tests, lambda d, i: seen.extend(d.collect()), state, late="12 hours").awaitTermination()
    assert [(r["batch_id"], r["evaluated_rows"], r["late_rows"]) for r in seen] == [(0, 2, 0), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1)]
    assert sorted(p.name for p in (tmp_path / "state-latest").iterdir()) == ["0", "1"]
    assert spark.read.parquet(f"{state}-latest/0").collect() == [(4, T0 + dt.timedelta(hours=34))]
