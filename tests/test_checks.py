"""Data tests, verdicts and samples on small tables."""

import time

import pytest
from pyspark.sql import functions as F

from assay.operators import checks, sampling, verdict
from assay.operators.checks import Test
from assay.sources.tables import PartitionFilter, row_count, scan_partition


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, 1, "placed", 5.0), (2, 1, "shipped", -1.0), (3, None, None, 0.0), (4, 9, "cancelled", 7.5), (4, 2, "placed", None)]
    return spark.createDataFrame(rows, "order_id long, customer_id int, status string, amount double")


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, name string")


CASES = [
    (Test("orders", "custom_sql", sql="SELECT * FROM {{this}} WHERE status RLIKE '^[a-z]{7}$'"), 1),
    (Test("orders", "custom_sql", sql="SELECT o.* FROM {{this}} o WHERE o.status RLIKE '^[a-z]{6}$' OR o.status = '{}{0}'"), 2),
    (Test("orders", "custom_sql", sql="status RLIKE '^p.{5}$' OR status = '-- ; /* ('"), 2),
    (Test("orders", "custom_sql", sql="SELECT * FROM {{this}} WHERE amount = (SELECT max(amount) FROM {{this}})"), 1),
    (Test("orders", "custom_sql", sql="SELECT status FROM {{this}} WHERE amount > 0 GROUP BY status HAVING count(*) > 0"), 2),
    (Test("orders", "custom_sql", sql="select * from {{this}} where true limit 1"), 1),
    (Test("orders", "not_null", "customer_id"), 1),
    (Test("orders", "not_null", "ORDER_ID"), 0),
    (Test("orders", "unique", "order_id"), 1),
    (Test("orders", "unique", "customer_id"), 1),
    (Test("orders", "unique", "amount"), 0),
    (Test("orders", "accepted_values", "status", ("placed", "shipped")), 1),
    (Test("orders", "accepted_values", "customer_id", ("1", "2", "9")), 0),
    (Test("orders", "relationships", "customer_id", to="customers", field="id"), 1),
    (Test("orders", "custom_sql", sql="amount <= 0"), 2),
    (Test("orders", "custom_sql", sql="SELECT * FROM {{ this }} WHERE amount <= 0 AND order_id IN (SELECT order_id FROM {{this}})"), 2),
    (Test("orders", "custom_sql", sql="SELECT o.* FROM {{this}} o JOIN {{ ref('customers') }} c ON o.customer_id = c.id"), 4),
]
BAD = [
    (Test("orders", "not_null", "nothing"), "error"),
    (Test("orders", "accepted_values", "customer_id", ("many",)), "error"),
    (Test("orders", "relationships", "customer_id", to="later", field="id"), "future"),
    (Test("orders", "relationships", "customer_id", to="customers", field="nothing"), "error"),
    (Test("orders", "custom_sql", sql="SELECT 1; SELECT 2 FROM {{this}}"), "error"),
    (Test("orders", "custom_sql", sql="SELECT * FROM other"), "error"),
    (Test("orders", "custom_sql", sql="SELECT * FROM {{this}} JOIN {{ref('later')}} USING (id)"), "future"),
    (Test("orders", "custom_sql", sql=" "), "error"),
    (Test("orders", "no_such_type", "status"), "error"),
    (Test("orders", "custom_sql", sql="amount"), "error"),
    (Test("orders", "custom_sql", sql="count(*) > 5"), "error"),
    (Test("orders", "custom_sql", sql="row_number() OVER (ORDER BY order_id) > 5"), "error"),
    (Test("orders", "custom_sql", sql="explode(array(true, false))"), "error"),
    (Test("orders", "custom_sql", sql="amount > 0 -- all"), "error"),
    (Test("orders", "custom_sql", sql="SELECT * FROM {{this}} /* all */"), "error"),
    (Test("orders", "custom_sql", sql="SELECT * FROM {{this}};"), "error"),
    (Test("orders", "custom_sql", sql="(amount > 0"), "error"),
    (Test("orders", "custom_sql", sql="amount > 0) OR (true"), "error"),
    (Test("orders", "custom_sql", sql="''"), "error"),
    (Test("orders", "custom_sql", sql="SELECT * FROM {{this}} WHERE status = '{x}' AND {{ source('a', 'b') }}"), "error"),
    (Test("orders", "custom_sql", sql="SELECT count(*) AS n, {{this}}"), "error"),
    (Test("orders", "custom_sql"), "error"),
    (Test("orders", "accepted_values", None, ("a",)), "error"),
]


def test_all_families_in_one_job(orders, customers):
    tests = [t for t, _ in CASES + BAD]
    got = {r["position"]: r for r in checks.evaluate(orders, tests, {"customers": customers}).collect()}
    assert [got[i]["failures"] for i in range(len(CASES))] == [n for _, n in CASES]
    assert [got[i]["status"] for i in range(len(CASES), len(tests))] == [s for _, s in BAD]
    assert got[[t for t, _ in CASES].index(Test("orders", "unique", "order_id"))]["excess_rows"] == 1 and got[0]["evaluated_rows"] == 5


def test_one_by_one_equals_fused(orders, customers):
    for test, n in CASES:
        assert checks.failing_rows(orders, test, {"customers": customers}).count() == n


def test_a_test_that_fails_while_running_does_not_spoil_the_rest(orders):
    tests = [Test("orders", "custom_sql", sql="CAST(status AS int) > 1"), Test("orders", "not_null", "customer_id"), Test("orders", "unique", "order_id")]
    got = {r["position"]: (r["status"], r["failures"]) for r in checks.evaluate(orders, tests, {}).collect()}
    assert got == {0: ("error", None), 1: ("ok", 1), 2: ("ok", 1)}


def test_faults_are_found_by_halves(orders):
    tests = [Test("orders", "custom_sql", sql=f"CAST(status AS int) > {i}" if i in (1, 6) else f"amount > {i}") for i in range(8)] + [Test("orders", "unique", "order_id"), Test("orders", "custom_sql", sql="SELECT CAST(status AS int) FROM {{this}} ORDER BY 1")]
    got = {r["position"]: (r["status"], r["failures"]) for r in checks.evaluate(orders, tests, {}).collect()}
    assert {i for i, (s, _) in got.items() if s == "error"} >= {1, 6} and len(got) == 10
    assert got[0] == ("ok", 2) and got[5] == ("ok", 1) and got[8] == ("ok", 1)


def test_filter_rules_share_the_scan(orders):
    tests = [Test("orders", "custom_sql", sql=f"SELECT * FROM {{{{this}}}} WHERE amount > {i}") for i in range(4)]
    counted = checks.plan(orders, tests, {})
    assert [u.positions for u in counted.units] == [[0, 1, 2, 3]] and not counted.failed
    mixed = [*tests, Test("orders", "custom_sql", sql="SELECT * FROM {{this}} WHERE rand() < 2")]
    assert [u.positions for u in checks.plan(orders, mixed, {}).units] == [[0, 1, 2, 3], [4]]


def test_no_test_starts_after_the_budget(orders):
    tests = [Test("orders", "unique", "order_id"), Test("orders", "not_null", "amount"), Test("orders", "unique", "amount")]
    ticks = iter([0.0, 1.0, 5.0, 6.0])
    got = {r["position"]: (r["status"], r["failures"], r["why"]) for r in checks.evaluate(orders, tests, {}, budget=5, clock=lambda: next(ticks)).collect()}
    assert got[1] == ("ok", 1, None)
    assert got[0] == got[2] == ("error", None, "the budget of 5 s was used up")
    done = verdict.prune(orders, tests, {}, budget=0)
    assert {(r["reason"], r["why"]) for r in done.collect()} == {("kept-without-evidence", "not evaluated: the budget of 0 s was used up")}


def test_ambiguous_references_can_not_be_judged(orders, customers):
    rule = Test("orders", "custom_sql", sql="SELECT o.* FROM {{this}} o JOIN {{ref('customers')}} c ON o.customer_id = c.id")
    found = lambda tables: checks.evaluate(orders, [rule], tables).first()
    assert found({"a.customers": customers})["failures"] == 4
    assert found({"a.customers": customers, "b.customers": customers})["status"] == "error"
    assert found({})["status"] == "future"


def test_a_table_that_fails_does_not_stop_the_others(spark, orders):
    class Broken:
        sparkSession, columns = spark, ()

        def __getattr__(self, name):
            raise RuntimeError("gone")

    tests = {"broken": [Test("broken", "not_null", "a")], "orders": [Test("orders", "not_null", "status")]}
    got = verdict.prune_many(tests, {"orders": orders, "broken": Broken()})
    assert {(r["table_name"], r["reason"]) for r in got.collect()} == {("broken", "kept-without-evidence"), ("orders", "kept")}
    status = {r["table_name"]: (r["status"], r["tests"]) for r in verdict.table_status(got).collect()}
    assert status == {"broken": ("error", 1), "orders": ("ok", 1), None: ("error", 2)}


def test_verdicts(orders, customers):
    tests = [Test("orders", "not_null", "customer_id"), Test("orders", "not_null", "order_id"), Test("orders", "not_null", "nothing"), Test("orders", "relationships", "customer_id", to="later", field="id")]
    reason = lambda **o: [r["reason"] for r in verdict.prune(orders, tests, {"customers": customers}, **o).orderBy("position").collect()]
    assert reason() == ["kept", "always-passes", "kept-without-evidence", "requires-future-data"]
    assert reason(trusted=True)[0] == "failed-on-known-clean-data"
    assert set(reason(enabled=False)) == {"kept-without-evidence"}
    assert set(reason(sample=lambda d: sampling.materialise_sample(d.limit(0), 5))) == {"kept-without-evidence"}
    assert verdict.prune(orders, [], {}).count() == 0
    with pytest.raises(ValueError):
        verdict.validate_trusted(["x"], ["orders"])


def test_flattened_order_and_several_tables(orders, customers):
    tests = {"orders": [Test("orders", "custom_sql", sql="amount < 0"), Test("orders", "not_null", "status")], "gone": [Test("gone", "not_null", "a")], "customers": [Test("customers", "unique", "id")]}
    got = verdict.prune_many(tests, {"orders": orders, "customers": customers}, trusted=["customers"])
    rows = {(r["table_name"], r["position"]): (r["test_type"], r["reason"]) for r in got.collect()}
    assert rows == {("orders", 0): ("not_null", "kept"), ("orders", 1): ("custom_sql", "kept"), ("gone", 0): ("not_null", "kept-without-evidence"), ("customers", 0): ("unique", "failed-on-known-clean-data")}
    assert [r["table_name"] for r in verdict.kept_rate_alert(got).collect()] == ["customers"]


def test_examples_and_explanations(orders):
    rule = Test("orders", "custom_sql", sql="amount <= 0")
    first = [r[0] for r in checks.examples(orders, rule, {}, 1).collect()]
    assert first == [r[0] for r in checks.examples(orders.repartition(7), rule, {}, 1).collect()]
    assert checks.explain_failure(orders, rule, {}, ["order_id"]).first()[0] == "2 rows failed (example: order_id=2, customer_id=1, status='shipped', amount=-1.0)"
    assert checks.explain_failure(orders, Test("orders", "not_null", "order_id"), {}).first()[0] == "passed"


# samples


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    one = {r["id"] for r in sampling.hash_sample(df.coalesce(1), 10).collect()}
    assert one == {r["id"] for r in sampling.hash_sample(df.repartition(9), 10).collect()} and 350 < len(one) < 650
    top = [r["id"] for r in sampling.sample_rows(df, 50, 10).collect()]
    assert top == [r["id"] for r in sampling.sample_rows(df.repartition(9), 50, 10).collect()] and set(top) <= one


def test_key_samples_keep_groups_together(spark):
    df = spark.range(4000).select((F.col("id") % 500).alias("k"), "id")
    sizes = sampling.key_sample(df, ["k"], 5).groupBy("k").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [8]


def test_materialised_equals_one_shot(spark):
    df = spark.range(3000).withColumn("s", F.col("id").cast("string"))
    a, b = (sorted(draw(df, 200).collect()) for draw in (sampling.materialise_sample, sampling.one_shot_sample))
    assert a == b and len(a) <= 200
    filtered = sampling.one_shot_sample(df.withColumn("d", F.lit("x")), 5, PartitionFilter("d", "=", "x"))
    assert filtered.count() <= 5


def test_guards(spark):
    for args in ((10, 0, False), (None, 5, False), (0, 5, False), (sampling.GUARD_ROWS, 5, False)):
        with pytest.raises(sampling.SampleError):
            sampling.sample_guard(*args)
    sampling.sample_guard(None, 5, True)
    assert (sampling.sample_bucket(1000, 10), sampling.sample_bucket(5, 10), sampling.sample_bucket(None, 10)) == (100, 1, 1000)
    assert row_count(spark.range(0)) is None
    assert sampling.sample_id("t", 5) == sampling.sample_id("t", 5) != sampling.sample_id("t", 6)


def test_partition_filters(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("d"))
    assert scan_partition(df, PartitionFilter("d", ">=", "5")).count() == 5
    assert scan_partition(df, None).count() == 10
    with pytest.raises(ValueError):
        scan_partition(df, PartitionFilter("d", "LIKE", "5"))
    with pytest.raises(TypeError):
        scan_partition(df, PartitionFilter("d", "=", 5))


def test_filtered_samples_count_the_rows_they_draw_from(spark):
    df = spark.range(30_000).withColumn("d", F.when(F.col("id") < 20_000, "x").otherwise("y"))
    drawn = sampling.one_shot_sample(df, 5000, PartitionFilter("d", "=", "x"))
    assert 4500 < drawn.count() <= 5000 and drawn.where("d <> 'x'").count() == 0
    assert sampling.one_shot_sample(df, 50_000, PartitionFilter("d", "=", "x")).count() == 20_000
    assert sampling.one_shot_sample(df, 5, PartitionFilter("d", "=", "z")).count() == 0


def test_a_kept_sample_is_drawn_once(spark):
    df = spark.range(1000)
    first = sampling.kept_sample(df, "t", 50, version="a").collect()
    assert sampling.kept_sample(df.where("false"), "t", 50, version="a").collect() == first and len(first) <= 50
    assert sampling.kept_sample(df.where("false"), "t", 50, version="b", by=PartitionFilter("id", ">=", "0")).count() == 0


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_tests_of_a_column_share_one_scan_and_one_exchange(spark, tmp_path):
    spark.range(1000).selectExpr("id % 300 AS k", "id % 7 AS v", "CAST(id % 300 AS string) AS t").write.parquet(f"{tmp_path}/child")
    spark.range(290).selectExpr("id AS pk", "CAST(id AS int) AS narrow").write.parquet(f"{tmp_path}/parent")
    child, parent = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("child", "parent"))
    tests = [
        Test("child", "not_null", "k"), Test("child", "unique", "k"), Test("child", "accepted_values", "k", ("1", "2")), Test("child", "relationships", "k", to="parent", field="pk"),
        Test("child", "not_null", "v"), Test("child", "relationships", "k", to="parent", field="narrow"), Test("child", "relationships", "t", to="parent", field="pk"),
    ]
    counted = checks.plan(child, tests, {"parent": parent})
    assert [u.positions for u in counted.units] == [[4], [1, 3, 0, 2], [5], [6]]
    keyed = counted.units[1].count(counted.units[1].positions)
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert scans(keyed) == 2 and plan.count("Exchange hashpartitioning(k#") == 1
    got = {r["position"]: (r["failures"], r["evaluated_rows"]) for r in checks.evaluate(child, tests, {"parent": parent}).collect()}
    assert got == {0: (0, 1000), 1: (300, 1000), 2: (1000 - 8, 1000), 3: (30, 1000), 4: (0, 1000), 5: (30, 1000), 6: (30, 1000)}


def test_a_slow_rule_is_cancelled_and_the_others_are_judged(spark, orders, customers):
    """It would take hours; the other rules of its job are judged, and nothing of it goes on running."""
    endless = "SELECT o.* FROM {{this}} o JOIN range(1000000000000000) a ON a.id % 7 = 9"
    tests = [Test("orders", "custom_sql", sql=endless), Test("orders", "not_null", "customer_id"), Test("orders", "unique", "order_id"), Test("orders", "custom_sql", sql="amount > 1")]
    began = time.monotonic()
    got = {r["position"]: (r["status"], r["failures"], r["why"]) for r in checks.evaluate(orders, tests, {}, timeout=6).collect()}
    assert got[0] == ("error", None, "cancelled after 6 s") and [got[i][0] for i in (1, 2, 3)] == ["ok"] * 3
    assert time.monotonic() - began < 60
    done = verdict.prune(orders, tests, {}, budget=8)
    by = {r["position"]: r for r in done.collect()}
    assert [by[i]["reason"] for i in range(4)].count("kept-without-evidence") == 1
    assert next(r for r in by.values() if r["reason"] == "kept-without-evidence")["why"].startswith("not evaluated: cancelled after")
    assert spark.range(3).count() == 3  # the session goes on


def test_the_budget_counts_the_drawing_of_the_sample(spark, orders):
    tests = [Test("orders", "not_null", "amount"), Test("orders", "unique", "order_id")]

    def slow(df):
        spark.range(10**15).where("id % 7 = 9").count()
        return df

    assert {r["why"] for r in verdict.prune(orders, tests, {}, sample=slow, budget=3).collect()} == {"not evaluated: sampling failed: the budget of 3 s was used up"}
    ticks = iter([0.0, 9.0, 9.0])
    late = verdict.prune(orders, tests, {}, sample=lambda df: df, budget=3, clock=lambda: next(ticks))
    assert {r["why"] for r in late.collect()} == {"not evaluated: the budget of 3 s was used up"}


@pytest.mark.parametrize("values", [("1", "2"), ("1", "a")])
def test_columns_of_different_families_are_not_compared(spark, values):
    """Whatever the data: the same rule is kept without evidence for texts that are numbers and for others."""
    rows = spark.createDataFrame([(i, float(i), v, v == "1") for i, v in enumerate(values)], "b int, d double, c string, f boolean").withColumn("day", F.current_date()).withColumn("at", F.current_timestamp())
    bad = ["b <> c", "c < d", "SELECT * FROM {{this}} WHERE b = c", "SELECT t.* FROM {{this}} t JOIN {{this}} u ON t.b = u.c", "day > c", "f = b", "NOT (b >= c) OR d > 1", "SELECT * FROM {{this}} WHERE b IN (SELECT b FROM {{this}} WHERE c > d)", "b IS NULL AND c <=> b"]
    good = ["b <> d", "CAST(b AS string) <> c", "b <> TRY_CAST(c AS int)", "day < at", "c > '0'", "day > '2000-01-01'", "b > 1", "length(c) > b", "b <> coalesce(TRY_CAST(c AS int), 0)", "SELECT t.* FROM {{this}} t JOIN {{this}} u ON t.b = u.d"]
    got = {r["position"]: (r["status"], r["why"]) for r in checks.evaluate(rows, [Test("t", "custom_sql", sql=x) for x in bad + good], {}).collect()}
    assert [x for i, x in enumerate(bad) if got[i][0] != "error" or "do not belong together" not in got[i][1] and x != "f = b"] == []  # that one Spark refuses itself
    assert [(x, got[i]) for i, x in enumerate(good, len(bad)) if got[i][0] != "ok"] == []


def test_tables_are_judged_at_the_same_time(spark, orders, customers):
    tests = {"orders": [Test("orders", "not_null", "amount")], "customers": [Test("customers", "unique", "id")]}
    got = verdict.prune_many(tests, {"orders": orders, "customers": customers}).collect()
    assert [r["table_name"] for r in sorted(got, key=lambda r: r["table_name"])] == ["customers", "orders"]


@pytest.mark.parametrize("portable", [False, True])
def test_bottom_k_samples_have_their_size_and_merge(spark, portable):
    rows = spark.range(5000).selectExpr("id", "id % 7 AS v").union(spark.range(40).selectExpr("5 AS id", "1 AS v"))
    ask = lambda df, n=300: sampling.bottom_k(df, n, portable=portable)
    plain = lambda df: sorted(map(tuple, df.collect()))
    whole = plain(ask(rows))
    assert len(whole) == 300 == len(plain(ask(rows.repartition(11)))) and whole == plain(ask(rows.repartition(11)))
    halves = [ask(rows.where(f"v {sign} 3")) for sign in ("<", ">=")]
    assert plain(sampling.merge_samples(halves, 300)) == whole
    assert len(plain(ask(rows, 9999))) == 5040 and plain(ask(rows.where("false"))) == []
    with pytest.raises(sampling.SampleError):
        ask(rows, 0)
