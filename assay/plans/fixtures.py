"""Inputs of the registered queries: tests on the given tables, and logs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import Test
from ..operators.verdict import flatten
from ..sources.tables import table

LINEITEM = [
    Test("lineitem", "not_null", "l_orderkey"),
    Test("lineitem", "not_null", "l_shipdate"),
    Test("lineitem", "not_null", "l_quantity"),
    Test("lineitem", "unique", "l_orderkey"),
    Test("lineitem", "accepted_values", "l_returnflag", ("A", "N")),
    Test("lineitem", "accepted_values", "l_linestatus", ("O", "F")),
    Test("lineitem", "accepted_values", "l_linenumber", ("1", "2", "3")),
    Test("lineitem", "relationships", "l_orderkey", to="orders", field="o_orderkey"),
    Test("lineitem", "relationships", "l_partkey", to="part", field="p_partkey"),
    Test("lineitem", "custom_sql", sql="l_discount < 0 OR l_discount > 1"),
    Test("lineitem", "custom_sql", sql="l_quantity > 45"),
    Test("lineitem", "custom_sql", sql="SELECT * FROM {{this}} WHERE l_tax > l_discount"),
]
#: Rules that can not be judged: not boolean, not about one row, commented, several statements, unbalanced.
UNSOUND = ("o_totalprice", "count(*) > 5", "row_number() OVER (ORDER BY o_orderkey) > 5", "o_totalprice > 5 -- dear ones", "SELECT * FROM {{this}} /* all */", "SELECT * FROM {{this}}; SELECT 1", "(o_totalprice > 5")
ORDERS = [
    Test("orders", "not_null", "o_orderkey"),
    Test("orders", "unique", "o_orderkey"),
    Test("orders", "not_null", "o_custkey"),
    Test("orders", "accepted_values", "o_orderstatus", ("O", "F"), rationale="Open and finished orders only. Others are errors."),
    Test("orders", "relationships", "o_custkey", to="customer", field="c_custkey"),
    Test("orders", "relationships", "o_custkey", to="shipments", field="s_id"),
    Test("orders", "not_null", "no_such_column"),
    Test("orders", "accepted_values", "o_custkey", ("many", "few")),
    Test("orders", "custom_sql", sql="o_totalprice <= 0"),
    Test("orders", "custom_sql", sql="SELECT o.* FROM {{this}} o JOIN {{ref('customer')}} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0"),
    Test("orders", "custom_sql", sql="SELECT * FROM nowhere_at_all"),
    Test("orders", "custom_sql", sql="SELECT o.* FROM {{this}} o WHERE o.o_orderpriority LIKE '%{2}%' OR o.o_totalprice > 300000"),
    *(Test("orders", "custom_sql", sql=rule) for rule in UNSOUND),
]
CUSTOMER = [
    Test("customer", "not_null", "c_custkey"),
    Test("customer", "unique", "c_custkey"),
    Test("customer", "unique", "c_mktsegment"),
    Test("customer", "relationships", "c_nationkey", to="nation", field="n_nationkey"),
    Test("customer", "custom_sql", sql="c_acctbal < 0"),
]
ALL = {"lineitem": LINEITEM, "orders": ORDERS, "customer": CUSTOMER}
NAMES = ("lineitem", "orders", "customer", "part", "nation")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in NAMES}


def sql_count(test: Test, source: str | None = None) -> str:
    """The failing rows of a test, counted by plain SQL; null where it can not be judged."""
    t, c = source or test.table, test.column
    if c == "no_such_column" or test.to == "shipments" or "nowhere" in (test.sql or "") or test.sql in UNSOUND or (test.values and test.values[0] == "many"):
        return "NULL::BIGINT"
    if test.type == "not_null":
        return f"(SELECT count(*) FROM {t} WHERE {c} IS NULL)"
    if test.type == "unique":
        return f"(SELECT count(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1))"
    if test.type == "accepted_values":
        values = ", ".join(f"'{v}'" for v in test.values)
        return f"(SELECT count(*) FROM {t} WHERE CAST({c} AS VARCHAR) NOT IN ({values}))"
    if test.type == "relationships":
        return f"(SELECT count(*) FROM {t} a LEFT JOIN {test.to} b ON a.{c} = b.{test.field} WHERE a.{c} IS NOT NULL AND b.{test.field} IS NULL)"
    sql = test.sql.replace("{{this}}", t).replace("{{ref('customer')}}", "customer")
    return f"(SELECT count(*) FROM ({sql}))" if sql.lower().startswith("select") else f"(SELECT count(*) FROM {t} WHERE {sql})"


def sql_results(tests: list[Test], source: str | None = None) -> str:
    """position, table_name, anchor, test_type, failures, evaluated_rows, status as rows."""
    rows = []
    for i, test in enumerate(flatten(tests)):
        status = "future" if test.to == "shipments" else "error" if sql_count(test) == "NULL::BIGINT" else "ok"
        n = f"(SELECT count(*) FROM {source or test.table})" if status == "ok" else "NULL::BIGINT"
        rows.append(f"SELECT {i} AS position, '{test.table}' AS table_name, '{test.place}' AS anchor, '{test.type}' AS test_type, {sql_count(test, source)} AS failures, {n} AS evaluated_rows, '{status}' AS status")
    return "\nUNION ALL ".join(rows)


def sql_decisions(tests: dict[str, list[Test]], trusted: tuple[str, ...] = ()) -> str:
    inner = "\nUNION ALL ".join(sql_results(own) for own in tests.values())
    known = ", ".join(f"'{t}'" for t in trusted) or "''"
    return f"""SELECT *, CASE WHEN reason IN ('kept', 'kept-without-evidence') THEN 'kept' ELSE 'dropped' END AS decision FROM (
SELECT *, CASE WHEN status = 'future' THEN 'requires-future-data' WHEN status <> 'ok' THEN 'kept-without-evidence' WHEN failures = 0 THEN 'always-passes'
WHEN table_name IN ({known}) THEN 'failed-on-known-clean-data' ELSE 'kept' END AS reason FROM ({inner}))"""


# logs ------------------------------------------------------------------------------------------

PRICES = [("claude-a", 3.0, 15.0, 3.75, 0.3), ("claude-b", 0.8, 4.0, 1.0, 0.08), ("gpt-a", 2.5, 10.0, 0.0, 0.0), ("gemini-a", 0.3, 2.5, 0.0, 0.0)]
MODELS = ("claude-a", "claude-b", "gpt-a", "gemini-a", "other-a")
SQL_PRICES = "prices(model, p_in, p_out, p_write, p_read) AS (VALUES " + ", ".join(str(p) for p in PRICES) + ")"


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_per_mtok double, output_per_mtok double, cache_write_per_mtok double, cache_read_per_mtok double")


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token log from conversations: a turn is a call, its text length the tokens."""
    conv = table(spark, sf_dir, "conversations")
    models = F.array(*map(F.lit, MODELS))
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return conv.select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("timestamp"),
        F.concat(F.lit("model."), (F.col("conv_id") % 7).cast("string")).alias("model_unique_id"),
        F.element_at(models, (F.col("conv_id") % 5 + 1).cast("int")).alias("model"),
        n.alias("input_tokens"), F.floor(n / 2).cast("long").alias("output_tokens"), (n % 10).alias("cache_creation_input_tokens"), (n % 100).alias("cache_read_input_tokens"),
        F.when(F.col("role") == "user", "draft").otherwise("grade").alias("stage"), "conv_id", "turn",
    )


SQL_CALLS = f"""calls AS (SELECT conv_id, turn, 'model.' || (conv_id % 7) AS model_unique_id, ([{", ".join(repr(m) for m in MODELS)}])[conv_id % 5 + 1] AS model,
length(coalesce(text, ''))::BIGINT AS input_tokens, (length(coalesce(text, '')) // 2)::BIGINT AS output_tokens, (length(coalesce(text, '')) % 10)::BIGINT AS cache_creation_input_tokens,
(length(coalesce(text, '')) % 100)::BIGINT AS cache_read_input_tokens, CASE WHEN role = 'user' THEN 'draft' ELSE 'grade' END AS stage FROM conversations)"""
SQL_PRICED = f"""{SQL_PRICES}, {SQL_CALLS}, priced AS (SELECT c.*, CASE WHEN c.model LIKE 'claude-%' THEN 'anthropic' WHEN c.model LIKE 'gpt-%' THEN 'openai' WHEN c.model LIKE 'gemini-%' THEN 'gemini' END AS provider,
(input_tokens * p_in + output_tokens * p_out + cache_creation_input_tokens * p_write + cache_read_input_tokens * p_read) / 1e6 AS cost FROM calls c LEFT JOIN prices p USING (model))"""


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents by two criteria; documents without labels have none (null)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    each = F.explode(F.array(F.struct(F.lit("quality").alias("criterion_id"), F.lit(0).alias("pos"), F.col("quality").cast("double").alias("score")), F.struct(F.lit("harmless").alias("criterion_id"), F.lit(1).alias("pos"), (1 - F.col("toxic")).cast("double").alias("score"))))
    rows = docs.select(F.col("source").alias("table_name"), F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("artifact_id"), each.alias("g")).select("table_name", "artifact_id", "g.*")
    return rows.withColumn("passed", F.coalesce(F.col("score") >= 0.5, F.lit(False))).withColumn("reasoning", F.concat(F.lit("By the label of "), F.col("criterion_id"), F.lit(". No more is known."))).withColumn("evidence", F.when(F.col("pos") == 1, F.concat(F.lit("Shown by "), F.col("artifact_id"))))


SQL_GRADES = """grades AS (SELECT source AS table_name, 'doc.' || doc_id AS artifact_id, u.criterion_id, u.pos, u.score, coalesce(u.score >= 0.5, false) AS passed
FROM (SELECT d.doc_id, d.source, unnest([{'criterion_id': 'quality', 'pos': 0, 'score': quality::DOUBLE}, {'criterion_id': 'harmless', 'pos': 1, 'score': (1 - toxic)::DOUBLE}]) AS u
FROM documents d LEFT JOIN labels l USING (doc_id)))"""
