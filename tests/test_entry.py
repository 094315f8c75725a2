"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from assay.plans import fixtures

DATA = "/root/testdata/sf0.001"
SKIP = {"pipeline"}
ORACLES = entry.oracle_sql()
CHECKED = [n for n in ORACLES if not n.startswith("op")]


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v.tolist() if hasattr(v, "tolist") else v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() == sum(map(len, fixtures.ALL.values())) == 36 and "decision" in out.columns


def test_filters_and_columns_reach_the_scan(spark):
    from assay.operators.checks import Test, failing_rows
    from assay.sources.tables import PartitionFilter, scan_partition, table

    df = scan_partition(table(spark, DATA, "lineitem"), PartitionFilter("l_shipdate", ">=", "1999-01-01"))
    plan = failing_rows(df, Test("lineitem", "not_null", "l_tax"), {}).select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_tax:double,l_shipdate" in plan


STREAMS = ["stream_reason_counts", "stream_kept_rate", "stream_dedupe", "stream_batch_checks", "stream_pairs", "stream_sessions"]


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_a_file_or_a_directory_of_part_files(spark, duck, tmp_path, name):
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "events.parquet").symlink_to(f"{DATA}/events.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/parts/events.parquet")
    want = duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    for form in ("file", "parts"):
        got = entry.queries()[name](spark, f"{tmp_path}/{form}").collect()
        assert sorted(tuple(plain(r[c]) for c in columns) for r in got) == want and want
