"""Profiles by groups and by melted cells."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assay.operators import profile

KINDS = "i int, l long, b boolean, f float, d double, s string, day date, at timestamp, ntz timestamp_ntz, dec decimal(10,3), big decimal(38,0), bin binary, a array<int>, m map<string,int>, st struct<x:int>, `it's` string, `a.b` int, `c``d` string"


@pytest.fixture(scope="module")
def mixed(spark):
    one = [3, 2**60, True, 0.5, -1.5, "x", date(1969, 5, 1), datetime(2020, 1, 2, 3, 4, 5, 678), datetime(1960, 1, 2), Decimal("-0.045"), Decimal(10**37), b"ab", [1], {"k": 1}, (1,), "q", 4, "z"]
    two = [-7, 5, False, float("nan"), 2.25, "", date(2024, 2, 29), datetime(1950, 1, 1), datetime(2030, 6, 7, 1, 2, 3), Decimal("1234567.100"), Decimal(-3), b"", [], {}, (None,), "p", 5, "z"]
    three = [3, 5, True, 0.5, float("inf"), "x", date(2024, 2, 29), datetime(1950, 1, 1), None, Decimal("0.000"), Decimal(0), None, [1], {"k": 1}, None, "q", 4, None]
    return spark.createDataFrame([one, two, three, [None] * len(one)], KINDS).repartition(3)


def shown(df):
    return {r["column"]: tuple(r)[1:] for r in df.collect()}


def test_melted_cells_give_what_groups_give(spark, mixed, monkeypatch):
    grouped = shown(profile.column_stats(mixed))
    monkeypatch.setattr(profile, "GROUPED", 3)
    melted = profile.column_stats(mixed)
    assert shown(melted) == grouped and set(grouped) == set(mixed.columns)
    assert grouped["it's"] == ("string", 3, 2, 1, "p", "q") and grouped["dec"][3:] == (1, "-0.045", "1234567.100")
    sketch = shown(profile.column_stats(mixed, approximate=True))
    assert sketch == grouped  # so few values are counted exactly
    empty = shown(profile.column_stats(mixed.where("false")))
    assert {v[1:] for v in empty.values()} == {(0, 0, 0, None, None)}


def test_a_wide_table_is_scanned_once_without_expand(spark, tmp_path):
    spark.range(50).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(150)]).write.parquet(f"{tmp_path}/wide")
    stats = profile.column_stats(spark.read.parquet(f"{tmp_path}/wide"))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan and plan.count("Exchange hashpartitioning(i") == 2  # distinct cells, then a row for each column and task
    got = shown(stats)
    assert all(got[f"c{i}"][1:] == (50, min(50, i + 2), 0, "0", str(min(49, i + 1))) for i in range(150))


def test_a_profile_and_tests_of_a_column_share_its_groups(spark, tmp_path):
    from assay.operators.checks import Test
    from assay.plans.runs import profile_and_evaluate

    spark.range(3000).selectExpr("id % 1000 AS k", "id AS v").repartition(3).write.parquet(f"{tmp_path}/t")
    both = profile_and_evaluate(spark.read.parquet(f"{tmp_path}/t"), [Test("t", "unique", "k"), Test("t", "not_null", "k"), Test("t", "unique", "v")], {})
    assert sorted(map(tuple, both.collect())) == [("column", "k", 3000, 1000), ("column", "v", 3000, 3000), ("test", "0", 3000, 1000), ("test", "1", 3000, 0), ("test", "2", 3000, 0)]
    final = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 2
