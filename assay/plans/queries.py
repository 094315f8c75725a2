"""The registered queries of the analytics operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import short_hash
from ..operators import checks, cost, grades, hygiene, identity, profile, propose, redact, report, sampling, verdict
from ..operators.checks import Test
from ..sources import audit
from ..sources.scratch import materialise, new_path
from ..sources.tables import PartitionFilter, is_directory, row_count, scan_partition, table
from ..streaming import streams
from . import fixtures as fx
from . import runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _fails(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("failures"))


# tests -----------------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("SELECT count(*) AS failures FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def check_not_null(spark, sf_dir):
    return _fails(checks.failing_rows(labelled(spark, sf_dir), Test("docs", "not_null", "quality"), {}))


@query("SELECT count(*) AS failures, sum(n - 1)::BIGINT AS excess_rows FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def check_unique(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "text")
    return checks.count_one(docs, 0, Test("documents", "unique", "text"), {}).select("failures", F.col("excess_rows").cast("long"))


@query("SELECT count(*) AS failures FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def check_accepted_values(spark, sf_dir):
    return _fails(checks.failing_rows(table(spark, sf_dir, "events"), Test("events", "accepted_values", "event_type", ("view", "click", "purchase")), {}))


@query("SELECT count(*) AS failures FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL AND l.l_orderkey IS NOT NULL")
def check_relationships(spark, sf_dir):
    parents = {"orders": table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")}
    return _fails(checks.failing_rows(table(spark, sf_dir, "lineitem"), Test("lineitem", "relationships", "l_orderkey", to="orders", field="o_orderkey"), parents))


@query("SELECT count(*) AS failures FROM customer WHERE c_acctbal < 0")
def check_rule(spark, sf_dir):
    return _fails(checks.failing_rows(table(spark, sf_dir, "customer"), Test("customer", "custom_sql", sql="SELECT * FROM {{this}} WHERE c_acctbal < 0"), {}))


@query("SELECT count(*) AS failures FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0")
def check_rule_multi_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    test = Test("orders", "custom_sql", sql="SELECT o.* FROM {{this}} o JOIN {{ref('customer')}} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0")
    return _fails(checks.failing_rows(sampling.hash_sample(orders, 10), test, {"customer": table(spark, sf_dir, "customer")}, full=orders))


@query("SELECT count(*) AS failures FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus NOT IN ('O', 'F')")
def check_partition_filter(spark, sf_dir):
    rows = scan_partition(table(spark, sf_dir, "orders"), PartitionFilter("o_orderdate", ">=", "1996-01-01"))
    return _fails(checks.failing_rows(rows, Test("orders", "accepted_values", "o_orderstatus", ("O", "F")), {}))


@query(fx.sql_results(fx.LINEITEM))
def evaluate_fused(spark, sf_dir):
    known = fx.tables(spark, sf_dir)
    tests = verdict.flatten(fx.LINEITEM)
    found = checks.evaluate(known["lineitem"], tests, known).drop("why", "excess_rows")
    return verdict.tests_frame(spark, tests).join(F.broadcast(found), "position").select("position", "table_name", "anchor", "test_type", "failures", "evaluated_rows", "status")


@query("SELECT to_json({'c_custkey': c_custkey, 'c_nationkey': c_nationkey}) AS example FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 3")
def failure_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    failing = checks.failing_rows(rows, Test("customer", "custom_sql", sql="c_acctbal < 0"), {}).select("c_custkey", "c_nationkey")
    return checks.examples(failing, Test("failing", "custom_sql", sql="true"), {}, 3, ["c_custkey"])


@query("SELECT count(*) || ' rows failed (example: o_orderkey=' || arg_min(o_orderkey, o_orderkey) || ', o_orderstatus=''' || arg_min(o_orderstatus, o_orderkey) || ''')' AS explanation FROM orders WHERE o_orderkey > 5")
def explain_failure(spark, sf_dir):
    return checks.explain_failure(table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"), Test("orders", "custom_sql", sql="o_orderkey > 5"), {}, ["o_orderkey"])


@query(
    "SELECT 'error' AS status, NULL::BIGINT AS failures, NULL::BIGINT AS evaluated_rows, " + str(len(fx.UNSOUND)) + "::BIGINT AS tests UNION ALL "
    "SELECT 'ok', (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '%{1}%' OR o_totalprice > 200000), (SELECT count(*) FROM orders), 1"
)
def unevaluable_rules(spark, sf_dir):
    rules = [*fx.UNSOUND, "SELECT o.* FROM {{this}} o WHERE o.o_orderpriority LIKE '%{1}%' OR o.o_totalprice > 200000"]
    found = checks.evaluate(table(spark, sf_dir, "orders"), [Test("orders", "custom_sql", sql=r) for r in rules], {})
    return found.groupBy("status", "failures", "evaluated_rows").agg(F.count("*").alias("tests"))


_MIXED = ("o_orderkey <> o_orderstatus", "o_orderdate > o_orderpriority", "SELECT a.* FROM {{this}} a JOIN {{this}} b ON a.o_custkey = b.o_orderpriority", "o_orderkey < o_custkey", "CAST(o_orderkey AS string) = o_orderstatus")


@query("SELECT i AS position, CASE WHEN i < 3 THEN 'error' ELSE 'ok' END AS status, CASE i WHEN 3 THEN (SELECT count(*) FROM orders WHERE o_orderkey < o_custkey) WHEN 4 THEN (SELECT count(*) FROM orders WHERE o_orderkey::VARCHAR = o_orderstatus) END AS failures, i < 3 AS incoherent FROM range(5) t(i)")
def incoherent_rules(spark, sf_dir):
    """Rules that compare columns of different families are kept without evidence, whatever the data."""
    found = checks.evaluate(table(spark, sf_dir, "orders"), [Test("orders", "custom_sql", sql=r) for r in _MIXED], {})
    return found.select(F.col("position").cast("long").alias("position"), "status", "failures", F.coalesce(F.col("why").contains("do not belong together"), F.lit(False)).alias("incoherent"))


# verdicts --------------------------------------------------------------------------------------

#: A rule that never ends, among others that do.
_ENDLESS = Test("orders", "custom_sql", sql="SELECT o.* FROM {{this}} o JOIN range(1000000000000000) a ON a.id % 7 = 9")


@query(
    "SELECT 0 AS position, 'not_null' AS test_type, (SELECT count(*) FROM orders WHERE o_custkey IS NULL) AS failures, 'always-passes' AS reason UNION ALL SELECT 1, 'custom_sql', NULL, 'kept-without-evidence' "
    "UNION ALL SELECT 2, 'custom_sql', (SELECT count(*) FROM orders WHERE o_totalprice > 100000), 'kept'"
)
def verdicts_budget(spark, sf_dir):
    """A rule that would run for hours is cancelled at its limit and kept without evidence; the others are judged."""
    tests = [Test("orders", "not_null", "o_custkey"), _ENDLESS, Test("orders", "custom_sql", sql="o_totalprice > 100000")]
    return verdict.prune(table(spark, sf_dir, "orders"), tests, {}, timeout=12).select("position", "test_type", "failures", "reason")


_SHOWN = ("position", "table_name", "anchor", "test_type", "failures", "evaluated_rows", "status", "reason", "decision")


@query(fx.sql_decisions(fx.ALL))
def verdicts(spark, sf_dir):
    return verdict.prune_many(fx.ALL, fx.tables(spark, sf_dir)).select(*_SHOWN)


@query(fx.sql_decisions(fx.ALL, ("customer", "lineitem")))
def verdicts_trusted(spark, sf_dir):
    return verdict.prune_many(fx.ALL, fx.tables(spark, sf_dir), trusted=("customer", "lineitem")).select(*_SHOWN)


@query("SELECT n AS rows_seen, 'kept' AS decision, 'kept-without-evidence' AS reason, 'not evaluated: pruning is disabled' AS why, 5::BIGINT AS tests FROM (SELECT count(*) AS n FROM customer)")
def verdicts_disabled(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    off = verdict.prune(rows, fx.CUSTOMER, {}, enabled=False).groupBy("decision", "reason", "why").agg(F.count("*").alias("tests"))
    return off.join(F.broadcast(rows.agg(F.count("*").alias("rows_seen"))))


@query(f"SELECT table_name, test_type, failures, reason, CASE WHEN reason = 'always-passes' THEN 'passed on ' || evaluated_rows || ' rows' ELSE failures || ' failures in ' || evaluated_rows || ' rows' END AS why FROM ({fx.sql_decisions({'customer': fx.CUSTOMER})})")
def verdict_why(spark, sf_dir):
    known = fx.tables(spark, sf_dir)
    return verdict.prune(known["customer"], fx.CUSTOMER, known).select("table_name", "test_type", "failures", "reason", "why")


@query("SELECT 'relationships' AS test_type, 'dropped' AS decision, 'requires-future-data' AS reason, count(*) AS rows_not_scanned FROM orders")
def future_data(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = verdict.prune(orders, [Test("orders", "relationships", "o_custkey", to="shipments", field="id")], {"customer": table(spark, sf_dir, "customer")})
    return out.select("test_type", "decision", "reason").join(F.broadcast(orders.agg(F.count("*").alias("rows_not_scanned"))))


@query(f"SELECT table_name, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision = 'dropped') AS dropped, count(*) AS total FROM ({fx.sql_decisions(fx.ALL)}) GROUP BY table_name")
def prune_summary(spark, sf_dir):
    return verdict.summary(verdicts(spark, sf_dir))


@query(f"SELECT table_name, kept, dropped, total, round(kept / total, 6) AS kept_rate FROM (SELECT table_name, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision = 'dropped') AS dropped, count(*) AS total FROM ({fx.sql_decisions(fx.ALL)}) GROUP BY table_name) WHERE kept / total <= 0.45")
def kept_rate_alert(spark, sf_dir):
    return verdict.kept_rate_alert(verdicts(spark, sf_dir), 0.45)


@query(f"SELECT test_type, count(*) AS drafted, count(*) FILTER (decision = 'dropped') AS dropped, count(*) FILTER (decision = 'kept') AS kept FROM ({fx.sql_decisions(fx.ALL)}) GROUP BY test_type")
def drop_rate_by_type(spark, sf_dir):
    return verdict.drop_rate_by_type(verdicts(spark, sf_dir))


@query(f"SELECT table_name, reason, count(*) AS n FROM ({fx.sql_decisions(fx.ALL)}) GROUP BY ALL")
def drop_reason_histogram(spark, sf_dir):
    return verdict.drop_reason_histogram(verdicts(spark, sf_dir))


@query(
    f"SELECT table_name, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'future') THEN 'future' ELSE 'ok' END AS status, count(*) AS tests FROM ({fx.sql_decisions(fx.ALL)}) GROUP BY ROLLUP (table_name)"
)
def table_status(spark, sf_dir):
    return verdict.table_status(verdicts(spark, sf_dir))


# samples ---------------------------------------------------------------------------------------

_H = "('0x' || substr(md5({k}), 1, 15))::BIGINT"


@query(f"SELECT * FROM orders WHERE {_H.format(k='o_orderkey::VARCHAR')} % 10 = 0")
def sample_keyhash(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "orders"), 10, ["o_orderkey"], portable=True)


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE {_H.format(k='o_orderkey::VARCHAR')} % 3 = 0 ORDER BY {_H.format(k='o_orderkey::VARCHAR')}, o_orderkey LIMIT 100")
def sample_topn(spark, sf_dir):
    return sampling.sample_rows(table(spark, sf_dir, "orders"), 100, 3, ["o_orderkey"], portable=True).select("o_orderkey", "o_custkey", "o_orderstatus")


_SQL_FIRST = f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY {_H.format(k='o_orderkey::VARCHAR')}, o_orderkey LIMIT 700"


@query(_SQL_FIRST)
def sample_bottom_k(spark, sf_dir):
    """Exactly 700 rows, without counting the table."""
    return sampling.bottom_k(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), 700, ["o_orderkey"], portable=True).drop("_hash")


@query(_SQL_FIRST)
def sample_merged(spark, sf_dir):
    """The same sample from those of three parts, one of which came later."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    parts = [materialise(sampling.bottom_k(orders.where(F.col("o_orderkey") % 3 == k), 700, ["o_orderkey"], portable=True), "part") for k in range(3)]
    earlier = sampling.merge_samples(parts[:2], 700)
    return sampling.merge_samples([earlier, parts[2]], 700).drop("_hash")


@query(f"SELECT count(*) AS failures FROM (SELECT * FROM lineitem WHERE {_H.format(k="l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR")} % 5 = 0) l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'O')")
def sample_child_only(spark, sf_dir):
    child = sampling.hash_sample(table(spark, sf_dir, "lineitem"), 5, ["l_orderkey", "l_linenumber"], portable=True)
    parents = {"orders": table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")}
    return _fails(checks.failing_rows(child, Test("lineitem", "relationships", "l_orderkey", to="orders", field="o_orderkey"), parents))


@query(f"SELECT count(*) AS failures FROM (SELECT l_orderkey FROM lineitem WHERE {_H.format(k='l_orderkey::VARCHAR')} % 4 = 0 GROUP BY 1 HAVING count(*) > 1)")
def sample_unique_keyed(spark, sf_dir):
    return _fails(checks.failing_rows(sampling.key_sample(table(spark, sf_dir, "lineitem"), ["l_orderkey"], 4, portable=True), Test("lineitem", "unique", "l_orderkey"), {}))


@query(
    f"""WITH b AS (SELECT greatest(count(*) // 2000, 1) AS bucket FROM orders),
s AS (SELECT o.* FROM orders o, b WHERE {_H.format(k='o_orderkey::VARCHAR')} % bucket = 0 ORDER BY {_H.format(k='o_orderkey::VARCHAR')}, o_orderkey LIMIT 2000)
SELECT 'materialised' AS strategy, count(*) AS evaluated_rows, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS failures FROM s
UNION ALL SELECT 'one-shot', count(*), count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM s"""
)
def materialised_vs_oneshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    test = Test("orders", "accepted_values", "o_orderstatus", ("O", "F"))
    parts = [(name, draw(orders, 2000, None, ["o_orderkey"], True)) for name, draw in (("materialised", sampling.materialise_sample), ("one-shot", sampling.one_shot_sample))]
    plans = [checks.count_fused(rows, [(0, checks.failing_condition(rows, test))]).select(F.lit(name).alias("strategy"), "evaluated_rows", "failures") for name, rows in parts]
    return plans[0].union(plans[1])


_SIZED = ("orders", "lineitem", "documents", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _SIZED) + " UNION ALL SELECT 'no rows', NULL")
def row_counts(spark, sf_dir):
    """Sizes as samples use them: an empty table has none."""
    rows = [(n, row_count(table(spark, sf_dir, n))) for n in _SIZED]
    rows.append(("no rows", row_count(table(spark, sf_dir, "orders").where("o_orderkey < 0"))))
    return spark.createDataFrame(rows, "table_name string, row_count long")


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, greatest(count(*) // 100, 1) AS bucket, 'drawn' AS outcome FROM {t}" for t in _SIZED)
    + " UNION ALL SELECT 'no rows', 1, 'the size of the table is not known or zero; give a partition filter'"
)
def sample_guards(spark, sf_dir):
    """Which tables a sample of 100 rows may be drawn from."""
    rows = []
    for n in (*_SIZED, "no rows"):
        size = row_count(table(spark, sf_dir, "orders").where("o_orderkey < 0") if n == "no rows" else table(spark, sf_dir, n))
        try:
            sampling.sample_guard(size, 100, False)
            outcome = "drawn"
        except sampling.SampleError as e:
            outcome = str(e)
        rows.append((n, sampling.sample_bucket(size or 0, 100), outcome))
    return spark.createDataFrame(rows, "table_name string, bucket long, outcome string")


@query(
    f"""WITH r AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'), b AS (SELECT greatest(count(*) // 500, 1) AS bucket FROM r)
SELECT o_orderkey, 2::BIGINT AS times FROM r, b WHERE {_H.format(k='o_orderkey::VARCHAR')} % bucket = 0 ORDER BY {_H.format(k='o_orderkey::VARCHAR')}, o_orderkey LIMIT 500"""
)
def sample_kept_by_id(spark, sf_dir):
    """A filtered sample is drawn once under its id, and read when it is asked for again."""
    orders, version = table(spark, sf_dir, "orders"), new_path(spark, "run")
    ask = lambda rows: sampling.kept_sample(rows, "orders", 500, PartitionFilter("o_orderdate", ">=", "1995-01-01"), ["o_orderkey"], True, version).select("o_orderkey")
    return ask(orders).union(ask(orders.where("false"))).groupBy("o_orderkey").agg(F.count("*").alias("times"))


# profiles and redaction ------------------------------------------------------------------------


def _sql_stats(name: str, kinds: dict[str, str]) -> str:
    one = "SELECT '{c}' AS \"column\", '{k}' AS data_type, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS nulls, {a} AS min_value, {z} AS max_value FROM " + name
    text = lambda f, c, k: "NULL::VARCHAR" if "array" in k else f"strftime({f}({c}), '%Y-%m-%d %H:%M:%S')" if k == "timestamp_ntz" else f"{f}({c})::VARCHAR"
    return " UNION ALL ".join(one.format(c=c, k=k, a=text("min", c, k), z=text("max", c, k)) for c, k in kinds.items())


_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query(_sql_stats("orders", _ORDERS))
def column_stats(spark, sf_dir):
    return profile.column_stats(table(spark, sf_dir, "orders"), list(_ORDERS))


@query(_sql_stats("embeddings", {"vec_id": "bigint", "embedding": "array<float>", "label": "int"}))
def column_stats_complex(spark, sf_dir):
    return profile.column_stats(table(spark, sf_dir, "embeddings"))


_NAMES = ("work_email", "phone", "author_id", "note", "api_key_label", "token", "Contact_Phone")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with tags and settings, as a catalogue would have them, made from documents: a source is a table."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    i = F.col("doc_id")
    none = F.create_map().cast("map<string,string>")
    tags = lambda c: F.when(c, F.array(F.lit("x"), F.lit("PII"))).otherwise(F.array().cast("array<string>"))
    meta = F.when(i % 13 == 0, F.create_map(F.lit("contains_pii"), F.lit("true"))).when(i % 13 == 1, F.create_map(F.lit("contains_pii"), F.lit('""'))).when(i % 13 == 2, F.create_map(F.lit("contains_pii"), F.lit('"false"')))
    meta = meta.when(i % 13 == 3, F.create_map(F.lit("sample"), F.lit("false"))).otherwise(none)
    of_table = F.when(F.col("source") == "src3", F.create_map(F.lit("contains_pii"), F.lit("[1]"))).when(F.col("source") == "src4", F.create_map(F.lit("sample"), F.lit(" False"))).when(F.col("source") == "src5", F.create_map(F.lit("contains_pii"), F.lit("0"))).otherwise(none)
    name = F.concat("lang", F.lit("_"), F.element_at(F.array(*map(F.lit, _NAMES)), (i % len(_NAMES) + 1).cast("int")))
    return docs.select(i.alias("position"), F.col("source").alias("table_name"), tags(F.col("source") == "src2").alias("table_tags"), of_table.alias("table_meta"), name.alias("column_name"), tags(i % 11 == 0).alias("tags"), meta.alias("meta"))


_POLICY = redact.Policy(skip_columns=("src1.en_note",), skip_tables=("src6",), patterns=redact.redact_patterns(extend=("*_id",)))
_SQL_CLASS = f"""WITH n AS (SELECT doc_id AS position, source AS table_name, lang || '_' || ([{", ".join(repr(x) for x in _NAMES)}])[doc_id % {len(_NAMES)} + 1] AS column_name FROM documents),
m AS (SELECT *, CASE WHEN table_name || '.' || column_name = 'src1.en_note' THEN 'skip-column' WHEN table_name = 'src6' THEN 'skip-table'
WHEN position % 13 = 3 THEN 'column-opt-out' WHEN position % 11 = 0 THEN 'column-tag-pii' WHEN position % 13 IN (0, 2) THEN 'column-contains-pii'
WHEN table_name = 'src4' THEN 'table-opt-out' WHEN table_name = 'src2' THEN 'table-tag-pii' WHEN table_name = 'src3' THEN 'table-contains-pii'
WHEN regexp_matches(lower(column_name), '(email|phone|_id)$') THEN 'pattern' END AS reason FROM n)"""


@query(_SQL_CLASS + " SELECT position, table_name, column_name, reason IS NOT NULL AS redacted, reason, CASE WHEN reason IS NOT NULL THEN 'col_' || substr(sha256(column_name), 1, 8) END AS alias FROM m")
def classify_columns(spark, sf_dir):
    return redact.classify_columns(_metadata(spark, sf_dir), _POLICY).select("position", "table_name", "column_name", "redacted", "reason", "alias")


@query(_SQL_CLASS + " SELECT table_name, column_name FROM m WHERE reason IS NULL AND regexp_matches(lower(column_name), 'email|phone|ssn|password|token|secret|api_key')")
def suspicious_columns(spark, sf_dir):
    return redact.suspicious_columns(redact.classify_columns(_metadata(spark, sf_dir), _POLICY))


def _policy(spark: SparkSession, sf_dir: str, name: str, marks: dict[str, tuple[list[str], dict[str, str]]], policy: redact.Policy) -> DataFrame:
    """The policy of one of the given tables: a row per column."""
    rows = [(name, [], {}, c, *marks.get(c, ([], {}))) for c in table(spark, sf_dir, name).columns]
    meta = spark.createDataFrame(rows, "table_name string, table_tags array<string>, table_meta map<string,string>, column_name string, tags array<string>, meta map<string,string>")
    return redact.classify_columns(meta, policy)


@query("SELECT page_id, url FROM pages")
def drop_columns(spark, sf_dir):
    policy = _policy(spark, sf_dir, "pages", {"url": (["pii"], {})}, redact.Policy(skip_columns=("pages.html",)))
    return redact.drop_columns_by_policy(table(spark, sf_dir, "pages"), policy)


@query(
    """SELECT 'pages' AS model_unique_id, 'sample' AS mode, 'col_' || substr(sha256('page_id'), 1, 8) || ',url' AS columns_sent, (SELECT count(*) FROM (SELECT 1 FROM pages LIMIT 300)) AS row_count,
'html:skip-column,page_id:pattern' AS redactions, 'sample_mode_enabled,audit_path_overridden' AS policy_flags"""
)
def share_audit_row(spark, sf_dir):
    settings = redact.Policy(skip_columns=("pages.html",), patterns=redact.redact_patterns(replace=["*_id"]))
    policy = _policy(spark, sf_dir, "pages", {}, settings)
    shared = redact.share_payload(table(spark, sf_dir, "pages"), policy, "sample", 300, ["page_id"])
    row = redact.share_audit_row(shared, policy, "pages", "sample", settings, path_overridden=True)
    listed = F.array_join(F.transform("redactions", lambda r: F.concat_ws(":", r["column_name"], r["reason"])), ",")
    return row.select("model_unique_id", "mode", F.array_join("columns_sent", ",").alias("columns_sent"), "row_count", listed.alias("redactions"), F.array_join("policy_flags", ",").alias("policy_flags"))


def _customer_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir, "customer", {"c_name": (["pii"], {}), "c_acctbal": ([], {"contains_pii": "true"}), "c_mktsegment": ([], {"contains_pii": '""'})}, _POLICY)


_A = {c: f"'col_' || substr(sha256('{c}'), 1, 8)" for c in ("c_name", "c_acctbal")}


@query("SELECT c_custkey, '<REDACTED>' AS c_name, c_nationkey, '<REDACTED>' AS c_acctbal, c_mktsegment FROM customer")
def mask_rows(spark, sf_dir):
    return redact.mask_values(table(spark, sf_dir, "customer"), _customer_policy(spark, sf_dir))


@query(f"SELECT c_custkey, c_nationkey, c_mktsegment, 2 AS hidden FROM customer ORDER BY {_H.format(k='c_custkey::VARCHAR')}, c_custkey LIMIT 50")
def share_sample(spark, sf_dir):
    shared = redact.share_payload(table(spark, sf_dir, "customer"), _customer_policy(spark, sf_dir), "sample", 50, ["c_custkey"], portable=True)
    hidden = [c for c in shared.columns if c.startswith("col_")]
    same = [(F.col(c) == redact.REDACTED).cast("int") for c in hidden]
    return shared.select("c_custkey", "c_nationkey", "c_mktsegment", sum(same, F.lit(0)).alias("hidden"))


@query(
    _sql_stats("customer", {"c_custkey": "bigint", "c_nationkey": "int", "c_mktsegment": "string"})
    + "".join(f" UNION ALL SELECT {a}, '{k}', NULL, NULL, NULL, NULL, NULL" for a, k in ((_A["c_name"], "string"), (_A["c_acctbal"], "double")))
)
def profile_redacted(spark, sf_dir):
    return profile.profile_with_redaction(table(spark, sf_dir, "customer"), _customer_policy(spark, sf_dir))


_WIDE = 501


@query(" UNION ALL ".join(f"SELECT 'c{i}' AS \"column\", count(*) AS non_null, count(DISTINCT s_suppkey % {i + 2}) AS distinct_values, max(s_suppkey % {i + 2})::VARCHAR AS max_value FROM supplier" for i in range(_WIDE)))
def wide_profile(spark, sf_dir):
    """A table of more than 500 columns: one warning, and exact counts from one scan."""
    wide = table(spark, sf_dir, "supplier", "s_suppkey").select(*[(F.col("s_suppkey") % (i + 2)).alias(f"c{i}") for i in range(_WIDE)])
    return profile.column_stats(wide).select("column", "non_null", "distinct_values", "max_value")


# sets of tests: entries come from documents, so that they grow with the input -------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of tests made from documents: source and language say which test an entry is."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    kind = F.element_at(F.array(*map(F.lit, checks.TYPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    column = F.concat(F.lit("c_"), F.col("lang"))
    values = F.array(F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")), F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")))
    rule = F.concat(F.lit("n > "), (F.col("doc_id") % 7).cast("string"))
    return docs.select(
        F.col("doc_id").cast("int").alias("position"), F.col("source").alias("table_name"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("column.c_other")).when(kind == "custom_sql", "model").otherwise(F.concat(F.lit("column."), column)).alias("anchor"),
        kind.alias("test_type"), F.when(kind != "custom_sql", column).alias("column"), F.when(kind == "accepted_values", values).alias("values"),
        F.when(kind == "relationships", F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string"))).alias("to"), F.when(kind == "relationships", "id").alias("field"), F.when(kind == "custom_sql", rule).alias("sql"),
    )


_SQL_ENTRIES = """e0 AS (SELECT doc_id::INT AS position, source AS table_name, (['not_null', 'unique', 'accepted_values', 'relationships', 'custom_sql'])[doc_id % 5 + 1] AS test_type, 'c_' || lang AS c, doc_id FROM documents),
e AS (SELECT position, table_name, CASE WHEN doc_id % 11 = 0 THEN 'column.c_other' WHEN test_type = 'custom_sql' THEN 'model' ELSE 'column.' || c END AS anchor, test_type,
CASE WHEN test_type <> 'custom_sql' THEN c END AS col,
CASE test_type WHEN 'accepted_values' THEN 'values=' || array_to_string(list_sort(['v' || (doc_id % 3), 'v' || (doc_id % 2)]), '|') WHEN 'relationships' THEN 'to=t' || (doc_id % 2) || '|field=id' WHEN 'custom_sql' THEN 'sql=n > ' || (doc_id % 7) ELSE '' END AS args FROM e0)"""
_SQL_IDS = (
    f"WITH {_SQL_ENTRIES}, h AS (SELECT *, substr(sha256(args), 1, 8) AS args_hash, CASE WHEN col IS NOT NULL AND anchor <> 'model' THEN 'column.' || col ELSE 'model' END AS scope FROM e), "
    "w AS (SELECT *, count(*) OVER (PARTITION BY table_name, scope, test_type) > 1 AS several, row_number() OVER (PARTITION BY table_name, scope, test_type, args_hash ORDER BY position) AS n FROM h), "
    "ids AS (SELECT position, table_name, anchor, test_type, args_hash, 'test.' || scope || '.' || test_type || CASE WHEN several THEN '.' || args_hash ELSE '' END || CASE WHEN n > 1 THEN ':' || (n - 1) ELSE '' END AS artifact_id FROM w)"
)


@query(f"WITH {_SQL_ENTRIES} SELECT position, table_name, test_type FROM (SELECT *, row_number() OVER (PARTITION BY table_name, test_type, col, args ORDER BY position) AS n FROM e) WHERE n = 1")
def dedupe_tests(spark, sf_dir):
    return hygiene.dedupe_tests(_entries(spark, sf_dir)).select("position", "table_name", "test_type")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "source", "lang").where("lang <> 'fr'")
    return docs.select(F.col("source").alias("table_name"), F.concat(F.lit("C_"), F.upper("lang")).alias("column_name")).distinct()


_SQL_BAD = "SELECT table_name, position, 'nonexistent-column' AS violation FROM e WHERE col IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = e.table_name AND d.lang <> 'fr' AND 'c_' || d.lang = e.col) UNION ALL SELECT table_name, position, 'column-differs-from-anchor' FROM e WHERE anchor LIKE 'column.%' AND col IS NOT NULL AND anchor <> 'column.' || col"


@query(f"WITH {_SQL_ENTRIES} {_SQL_BAD}")
def anchor_violations(spark, sf_dir):
    return hygiene.anchor_violations(_entries(spark, sf_dir), _known(spark, sf_dir))


@query(
    f"WITH {_SQL_ENTRIES} {_SQL_BAD} UNION ALL SELECT table_name, max(position), 'duplicate-test' FROM e WHERE test_type IN ('not_null', 'unique') GROUP BY table_name, test_type, col HAVING count(*) > 1 "
    "UNION ALL SELECT table_name, position, 'excluded-type' FROM e WHERE test_type = 'relationships'"
)
def contract_violations(spark, sf_dir):
    return hygiene.contract_violations(_entries(spark, sf_dir), _known(spark, sf_dir), excluded=("relationships",))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    names = F.array(*map(F.lit, ("not_null", "accepted_values", "relationships", "pkg.positive", "positive", "unique")))
    body = F.when(F.col("doc_id") % 4 == 0, F.lit('{"arguments": {"values": ["a", "b"], "to": "ref(\'customers\')", "field": "id"}}')).when(F.col("doc_id") % 4 == 1, F.lit('{"values": ["a"]}')).otherwise(F.lit("{}"))
    return docs.select(F.col("source").alias("table_name"), F.col("doc_id").cast("int").alias("position"), F.when(F.col("lang") != "es", F.col("lang")).alias("column"), F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("name"), body.alias("body_json"))


@query(
    """WITH r AS (SELECT source AS table_name, doc_id::INT AS position, lang <> 'es' AS has_column, (['not_null', 'accepted_values', 'relationships', 'pkg.positive', 'positive', 'unique'])[doc_id % 6 + 1] AS name, doc_id % 4 AS b FROM documents)
SELECT table_name, position, name, reason FROM (SELECT *, CASE WHEN name = 'pkg.positive' THEN 'unsupported-test-type' WHEN name = 'positive' THEN 'custom-or-generic-test' WHEN NOT has_column THEN 'malformed-supported-test'
WHEN name = 'accepted_values' AND b > 1 THEN 'malformed-supported-test' WHEN name = 'relationships' AND b <> 0 THEN 'malformed-supported-test' END AS reason FROM r) WHERE reason IS NOT NULL"""
)
def skipped_tests(spark, sf_dir):
    return hygiene.skipped_tests(_raw(spark, sf_dir)).select("table_name", "position", "name", "reason")


@query(_SQL_IDS + " SELECT * FROM ids")
def artifact_ids(spark, sf_dir):
    return identity.with_artifact_ids(_entries(spark, sf_dir)).select("position", "table_name", "anchor", "test_type", "args_hash", "artifact_id")


@query(
    f"WITH {_SQL_ENTRIES}, k AS (SELECT DISTINCT table_name, anchor, test_type, substr(sha256(args), 1, 8) AS args_hash, position % 3 AS m FROM e) "
    "SELECT table_name, anchor, test_type, args_hash, CASE WHEN bool_or(m <> 0) AND bool_or(m <> 1) THEN 'unchanged' WHEN bool_or(m <> 1) THEN 'added' ELSE 'removed' END AS change FROM k GROUP BY ALL"
)
def test_set_diff(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return hygiene.test_set_diff(entries.where("position % 3 <> 0"), entries.where("position % 3 <> 1"))


@query(_SQL_IDS + " SELECT table_name, anchor, test_type, args_hash, min(artifact_id) AS artifact_id FROM ids WHERE position % 4 <> 0 GROUP BY ALL")
def proposed_tests(spark, sf_dir):
    tests = identity.with_artifact_ids(_entries(spark, sf_dir))
    tiered = tests.select("table_name", "artifact_id", F.when(F.col("position") % 4 == 0, "dropped").otherwise("kept").alias("tier"))
    return report.proposed_tests(tests, tiered)


@query(
    """WITH s AS (SELECT 'c_custkey' AS c, count(c_custkey) AS k, count(DISTINCT c_custkey) AS d, 'bigint' AS t FROM customer UNION ALL SELECT 'c_name', count(c_name), count(DISTINCT c_name), 'string' FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(DISTINCT c_nationkey), 'int' FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(DISTINCT c_acctbal), 'double' FROM customer
UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment), 'string' FROM customer)
SELECT c AS "column", 'not_null' AS test_type FROM s UNION ALL SELECT c, 'unique' FROM s WHERE d >= 0.99 * k UNION ALL SELECT c, 'accepted_values' FROM s WHERE d BETWEEN 1 AND 8 AND t = 'string' AND d < k"""
)
def propose_candidates(spark, sf_dir):
    return propose.propose_frame(profile.column_stats(table(spark, sf_dir, "customer")))


_KEYED = {"nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey"), "supplier": ("s_nationkey", "s_suppkey"), "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_suppkey")}


@query(
    "WITH v AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c}::BIGINT AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cs in _KEYED.items() for c in cs) + "), "
    """k AS (SELECT t, c, sum(n) AS r, count(*) AS d FROM v GROUP BY ALL), m AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, sum(a.n) AS n, count(*) AS d FROM v a JOIN v b ON a.v = b.v AND a.t <> b.t GROUP BY ALL)
SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column, round(m.n / k1.r, 6)::DOUBLE AS contained, round(m.d / k2.d, 6)::DOUBLE AS coverage FROM m
JOIN k k1 ON k1.t = ct AND k1.c = cc JOIN k k2 ON k2.t = pt AND k2.c = pc WHERE k2.r = k2.d AND m.n / k1.r >= 0.9"""
)
def reference_discovery(spark, sf_dir):
    """References by data: also to keys that are not the first column, and whatever the names."""
    return propose.references({t: table(spark, sf_dir, t, *cs) for t, cs in _KEYED.items()})


@query(
    " UNION ALL ".join(f"SELECT 'column' AS kind, '{c}' AS name, count({c}) AS \"rows\", count(DISTINCT {c}) AS found FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    + f" UNION ALL SELECT 'test', position::VARCHAR, evaluated_rows, failures FROM ({fx.sql_results(fx.CUSTOMER)})"
)
def profile_and_evaluate(spark, sf_dir):
    known = fx.tables(spark, sf_dir)
    return runs.profile_and_evaluate(known["customer"], verdict.flatten(fx.CUSTOMER), known)


_WRITTEN = [
    (0, "customer", "c_custkey", "unique", "{}"),
    (1, "customer", "c_custkey", "unique", "{}"),
    (2, "customer", "c_nationkey", "accepted_values", '{"values": ["1", "2", "3"]}'),
    (3, "customer", "c_nationkey", "relationships", '{"to": "ref(\'nation\')", "field": "n_nationkey"}'),
    (4, "customer", "c_phone", "not_null", "{}"),
    (5, "customer", "c_name", "pkg.positive", "{}"),
    (6, "customer", None, "custom_sql", '{"sql": "c_acctbal < 0"}'),
]


@query(
    """SELECT 'unique' AS test_type, 'always-passes' AS reason, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS failures, 'removed' AS change
UNION ALL SELECT 'accepted_values', 'kept', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (1, 2, 3)), 'unchanged'
UNION ALL SELECT 'relationships', 'always-passes', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)), 'removed'
UNION ALL SELECT 'custom_sql', 'kept', (SELECT count(*) FROM customer WHERE c_acctbal < 0), 'unchanged'
UNION ALL SELECT 'not_null', 'nonexistent-column', NULL, 'skipped' UNION ALL SELECT 'pkg.positive', 'unsupported-test-type', NULL, 'skipped'"""
)
def prune_existing(spark, sf_dir):
    raw = spark.createDataFrame(_WRITTEN, "position int, table_name string, column string, name string, body_json string")
    run = runs.prune_existing(table(spark, sf_dir, "customer"), raw, {"nation": table(spark, sf_dir, "nation")})
    judged = run.decisions.join(run.changes, ["table_name", "anchor", "test_type", "args_hash"]).select("test_type", "reason", "failures", "change")
    return judged.union(run.skipped.select("name", "reason", F.lit(None).cast("long"), F.lit("skipped")))


@query(
    """SELECT 'c_custkey' AS "column", 'unique' AS test_type, 'always-passes' AS reason, 0::BIGINT AS failures FROM (SELECT count(*) FROM customer)
UNION ALL SELECT c, 'not_null', 'always-passes', 0 FROM (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS c)
UNION ALL SELECT 'c_name', 'unique', 'always-passes', 0 UNION ALL SELECT 'c_mktsegment', 'accepted_values', 'always-passes', 0
UNION ALL SELECT 'c_nationkey', 'relationships', 'always-passes', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))"""
)
def propose_and_prune(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.floor(F.col("c_acctbal") / 100))
    return runs.propose_and_prune(customer, "customer", {"nation": table(spark, sf_dir, "nation")}).select("column", "test_type", "reason", "failures")


_SQL_PRINT = """h AS (SELECT sha256(j) AS h FROM r), st AS (SELECT count(*) AS n, coalesce(sum(('0x' || substr(h, 1, 15))::BIGINT), 0) AS high, coalesce(sum(('0x' || substr(h, 16, 15))::BIGINT), 0) AS low FROM h)
SELECT substr(sha256(n || ':' || high || ':' || low), 1, 16) AS fingerprint FROM st"""


@query("WITH r AS (SELECT to_json({'doc_id': doc_id, 'lang': lang, 'source': source}) AS j FROM documents), " + _SQL_PRINT)
def fingerprint(spark, sf_dir):
    return identity.fingerprint(table(spark, sf_dir, "documents", "doc_id", "source", "lang"))


@query("WITH r AS (SELECT to_json({'doc_id': doc_id, 'lang': lang}) AS j FROM documents WHERE doc_id % 3 <> 1), " + _SQL_PRINT)
def fingerprint_of_changes(spark, sf_dir):
    """The print of a table after rows came and went, from the prints of these rows alone."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    state = lambda which: identity.fingerprint_state(docs.where(which))
    return identity.fingerprint_of(identity.changed_state(state("doc_id % 3 < 2"), added=state("doc_id % 3 = 2"), removed=state("doc_id % 3 = 1")))


# grades and tiers ------------------------------------------------------------------------------


@query(f"WITH {fx.SQL_GRADES} SELECT table_name, round(coalesce(avg(passed::INT) FILTER (score IS NOT NULL), 0), 6) AS pass_rate, round(coalesce(avg(score), 0), 6) AS mean_score, bool_and(score IS NOT NULL) AS aggregate_complete, count(*) AS pairs FROM grades GROUP BY table_name")
def grade_summary(spark, sf_dir):
    return grades.grade_summary(fx.grades(spark, sf_dir), "table_name")


@query(
    f"WITH {fx.SQL_GRADES}, s AS (SELECT table_name, round(coalesce(avg(passed::INT) FILTER (score IS NOT NULL), 0), 6) AS pass_rate, round(coalesce(avg(score), 0), 6) AS mean_score FROM grades GROUP BY table_name) SELECT *, pass_rate >= 0.9 AND mean_score >= 0.5 AS passed FROM s"
)
def grade_verdict(spark, sf_dir):
    return grades.grade_verdict(grades.grade_summary(fx.grades(spark, sf_dir), "table_name"), 0.9).select("table_name", "pass_rate", "mean_score", "passed")


@query(f"WITH {fx.SQL_GRADES} SELECT table_name, artifact_id, round(avg(score), 6) AS score, bool_and(passed) AND bool_and(score IS NOT NULL) AS passed FROM grades GROUP BY ALL")
def artifact_grade(spark, sf_dir):
    return grades.artifact_grade(fx.grades(spark, sf_dir), "table_name")


@query(f"WITH {fx.SQL_GRADES} SELECT criterion_id, round(avg((score IS NULL)::INT), 6) AS degrade_rate, count(*) AS n FROM grades GROUP BY criterion_id")
def degrade_rate(spark, sf_dir):
    return grades.degrade_rate(fx.grades(spark, sf_dir))


@query(f"WITH {fx.SQL_GRADES} SELECT table_name, artifact_id, arg_min(criterion_id, pos) AS criterion_id FROM grades WHERE NOT passed OR score IS NULL GROUP BY ALL")
def first_failing_criterion(spark, sf_dir):
    return grades.first_failing_criterion(fx.grades(spark, sf_dir), "table_name").drop("reasoning")


@query(
    """WITH r AS (SELECT doc_id, quality, toxic, doc_id % 8 AS k FROM labels)
SELECT 'doc.' || doc_id AS artifact_id, 'quality' AS criterion_id, CASE WHEN k IN (0, 1) THEN quality::DOUBLE END AS score, CASE WHEN k IN (0, 1, 5) THEN quality = 1 END AS passed,
CASE WHEN k IN (0, 1, 5) THEN 'Seen.' END AS evidence, CASE k WHEN 2 THEN 'score-out-of-range' WHEN 3 THEN 'criterion-mismatch' WHEN 4 THEN 'no-json' WHEN 6 THEN 'score-not-a-number' WHEN 7 THEN 'missing-score' END AS violation FROM r"""
)
def parse_judgements(spark, sf_dir):
    r = table(spark, sf_dir, "labels")
    said = F.concat(F.lit(', "passed": '), (F.col("quality") == 1).cast("string"), F.lit(', "reasoning": "So it is.", "evidence": "Seen."}'))
    body = lambda crit, score: F.concat(F.lit(f'{{"criterion_id": "{crit}"'), score, said)
    scored = lambda c: F.concat(F.lit(', "score": '), c)
    q = F.col("quality").cast("string")
    k = F.col("doc_id") % 8
    fenced = F.concat(F.lit("Here it is:\n```json\n"), body("quality", scored(q)), F.lit("\n```"))
    text = F.when(k == 0, body("quality", scored(q))).when(k == 1, fenced).when(k == 2, body("quality", scored(F.lit("7.5")))).when(k == 3, body("style", scored(q))).when(k == 4, F.lit("I can not say."))
    text = text.when(k == 5, body("quality", scored(F.lit("null")))).when(k == 6, body("quality", scored(F.lit('"0.5"')))).otherwise(body("quality", F.lit("")))
    return grades.parse_judgements(r.select(F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("artifact_id"), F.lit("quality").alias("criterion_id"), text.alias("response_text"))).drop("reasoning")


@query("SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN quality WHEN 1 THEN quality + 0.5 WHEN 2 THEN quality - 0.25 END)::DOUBLE AS score FROM labels WHERE doc_id % 4 = 1 AND quality = 1 OR doc_id % 4 = 2 AND quality = 0")
def invalid_scores(spark, sf_dir):
    i, q = F.col("doc_id") % 4, F.col("quality").cast("double")
    return grades.invalid_scores(table(spark, sf_dir, "labels").select("doc_id", F.when(i == 0, q).when(i == 1, q + 0.5).when(i == 2, q - 0.25).alias("score")))


@query("SELECT DISTINCT source AS table_name FROM documents WHERE source IN (SELECT min(source) FROM documents UNION ALL SELECT max(source) FROM documents)")
def stray_tables(spark, sf_dir):
    """Tables that have grades and no decisions."""
    decided, ends = _decided(spark, sf_dir), table(spark, sf_dir, "documents", "source").agg(F.min("source").alias("a"), F.max("source").alias("z"))
    known = decided.join(F.broadcast(ends), (F.col("table_name") != F.col("a")) & (F.col("table_name") != F.col("z")))  # one row
    return report.stray_tables(known, fx.grades(spark, sf_dir))


@query(
    """WITH r(criterion_id, pos) AS (VALUES ('quality', 0), ('style', 1)) SELECT 'doc.' || d.doc_id AS artifact_id, r.criterion_id, r.pos, CASE WHEN r.pos = 0 THEN l.quality::DOUBLE END AS score, coalesce(CASE WHEN r.pos = 0 THEN l.quality = 1 END, false) AS passed,
CASE WHEN r.pos = 1 OR l.quality IS NULL THEN 'not evaluated' END AS reasoning FROM documents d CROSS JOIN r LEFT JOIN labels l USING (doc_id)"""
)
def degraded_pairs(spark, sf_dir):
    name = F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("artifact_id")
    rubric = spark.createDataFrame([("quality", 0), ("style", 1)], "criterion_id string, pos int")
    scores = table(spark, sf_dir, "labels").select(name, F.lit("quality").alias("criterion_id"), F.col("quality").cast("double").alias("score"), (F.col("quality") == 1).alias("passed"), F.lit(None).cast("string").alias("reasoning"))
    return grades.complete(grades.work_list(table(spark, sf_dir, "documents", "doc_id").select(name), rubric), scores)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each document, from its length."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    reason = F.when(F.col("n_chars") < 500, "always-passes").when(F.col("n_chars") % 5 == 0, "kept-without-evidence").otherwise("kept")
    return docs.select(
        F.col("source").alias("table_name"), F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("artifact_id"), F.col("doc_id").cast("int").alias("position"), F.lit("not_null").alias("test_type"), reason.alias("reason"),
        F.when(reason == "always-passes", "dropped").otherwise("kept").alias("decision"), F.when(F.col("n_chars") % 2 == 0, F.lit("The column must have a value in every row, since reports that read it count on that, always.")).alias("rationale"), F.lit("some failures").alias("why"),
    )


_SQL_TIERS = (
    f"WITH {fx.SQL_GRADES}, a AS (SELECT artifact_id, round(avg(score), 6) AS score, bool_and(passed) AND bool_and(score IS NOT NULL) AS passed, arg_min(criterion_id, pos) FILTER (NOT passed OR score IS NULL) AS crit FROM grades GROUP BY 1), "
    "x AS (SELECT source AS table_name, 'doc.' || doc_id AS artifact_id, doc_id::INT AS position, n_chars, CASE WHEN n_chars < 500 THEN 'always-passes' WHEN n_chars % 5 = 0 THEN 'kept-without-evidence' ELSE 'kept' END AS reason FROM documents), "
    "t AS (SELECT x.*, a.score, a.passed, a.crit, CASE WHEN reason = 'always-passes' THEN 'dropped' WHEN reason = 'kept-without-evidence' THEN 'kept-uncertain' WHEN a.passed IS NULL THEN 'kept' WHEN NOT a.passed OR a.score IS NULL THEN 'flagged' ELSE 'kept' END AS tier FROM x LEFT JOIN a USING (artifact_id))"
)
_CUT = "The column must have a value in every row, since reports that read it count on"


@query(
    _SQL_TIERS
    + f" SELECT table_name, artifact_id, reason, score, passed, tier, CASE WHEN tier = 'flagged' THEN 'failed grading: ' || crit || ' — By the label of ' || crit || '.' WHEN tier = 'kept' AND n_chars % 2 = 0 THEN '{_CUT}…' WHEN tier = 'kept' THEN 'Shown by ' || artifact_id ELSE 'some failures' END AS tier_why FROM t"
)
def tiers(spark, sf_dir):
    return report.tiers(_decided(spark, sf_dir), fx.grades(spark, sf_dir)).select("table_name", "artifact_id", "reason", "score", "passed", "tier", "tier_why")


@query(_SQL_TIERS + " SELECT tier, count(*) AS n FROM t GROUP BY tier")
def tier_counts(spark, sf_dir):
    return report.tier_counts(report.tiers(_decided(spark, sf_dir), fx.grades(spark, sf_dir)))


@query(
    _SQL_TIERS
    + " SELECT table_name, 1 AS part, position, artifact_id, 'not_null' AS test_type, tier, CASE WHEN tier = 'dropped' THEN reason END AS drop_reason, score, passed FROM t UNION ALL SELECT DISTINCT source, 0, 0, 'column.' || lang || '.description', NULL, 'kept', NULL, NULL::DOUBLE, NULL::BOOLEAN FROM documents UNION ALL SELECT DISTINCT source, 0, 0, 'model.rationale', NULL, 'kept', NULL, NULL::DOUBLE, NULL::BOOLEAN FROM documents"
)
def report_entries(spark, sf_dir):
    columns = table(spark, sf_dir, "documents", "source", "lang").distinct().select(F.col("source").alias("table_name"), F.col("lang").alias("column_name"))
    scores = fx.grades(spark, sf_dir)
    return report.report_entries(report.tiers(_decided(spark, sf_dir), scores), identity.description_ids(columns), scores)


@query(f"WITH {fx.SQL_GRADES} SELECT artifact_id, criterion_id, score, CASE WHEN pos = 0 THEN score ELSE 0.5 END AS reported_score FROM grades WHERE pos = 1 AND score IS NOT NULL AND score <> 0.5")
def grade_drift(spark, sf_dir):
    log = fx.grades(spark, sf_dir).where("score IS NOT NULL").withColumn("run_id", F.lit("r"))
    said = log.withColumn("score", F.when(F.col("pos") == 0, F.col("score")).otherwise(0.5))
    return grades.grade_drift(log, said).drop("run_id")


# costs and logs --------------------------------------------------------------------------------


@query(
    f"WITH {fx.SQL_PRICED} SELECT provider, model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_input_tokens)::BIGINT AS cache_creation_input_tokens, sum(cache_read_input_tokens)::BIGINT AS cache_read_input_tokens, round(sum(cost), 6) AS cost FROM priced WHERE cost IS NOT NULL AND provider IS NOT NULL GROUP BY ALL"
)
def cost_by_model(spark, sf_dir):
    log = fx.call_log(spark, sf_dir)
    both = cost.calls(*(log.where(F.col("stage") == stage) for stage in ("draft", "grade")))
    return cost.cost_by_model(cost.priced(both, fx.prices(spark)))


@query(f"WITH {fx.SQL_PRICED} SELECT provider, model, count(*) AS calls, round(sum(cost), 6) AS cost FROM priced WHERE cost IS NOT NULL AND provider IS NOT NULL GROUP BY ROLLUP (provider, model)")
def cost_rollup(spark, sf_dir):
    return cost.cost_report(cost.priced(fx.call_log(spark, sf_dir), fx.prices(spark)))


@query(f"WITH {fx.SQL_PRICED} SELECT model, count(*) AS calls FROM priced WHERE cost IS NULL OR provider IS NULL GROUP BY model")
def unpriced_models(spark, sf_dir):
    return cost.unpriced_models(cost.priced(fx.call_log(spark, sf_dir), fx.prices(spark)))


@query(
    f"WITH {fx.SQL_CALLS} SELECT model_unique_id, stage, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_input_tokens)::BIGINT AS cache_creation_input_tokens, sum(cache_read_input_tokens)::BIGINT AS cache_read_input_tokens FROM calls GROUP BY ALL"
)
def tokens_by_table_stage(spark, sf_dir):
    return cost.tokens_by_table_stage(fx.call_log(spark, sf_dir))


@query(
    """SELECT p.event_id, v.event_id AS matched_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v0 ON p.user_id = v0.user_id AND p.ts >= v0.ts
LEFT JOIN (SELECT event_id, ts FROM events WHERE event_type = 'view') v ON v.event_id = v0.event_id AND v.ts >= p.ts - INTERVAL 2 DAY"""
)
def asof_pairing(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    buys, views = (events.where(F.col("event_type") == t).drop("event_type") for t in ("purchase", "view"))
    return cost.nearest_earlier(buys, views, "user_id", 2 * 86400, "ts", "ts").select("event_id", "matched_event_id")


@query(
    """WITH v AS (SELECT ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ts) SELECT p.event_id, v.value AS matched_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.ts >= v.ts"""
)
def asof_one_key(spark, sf_dir):
    """All rows have one key: the last view, of any user, before each purchase."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("all", F.lit(1))
    views = events.where("event_type = 'view'").groupBy("all", "ts").agg(F.max("value").alias("value"))
    buys = events.where("event_type = 'purchase'").select("event_id", "ts", "all")
    return cost.nearest_earlier(buys, views, "all", 400 * 86400, "ts", "ts").select("event_id", "matched_value")


def _response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response log made from conversations.  Some records name no model, some have negative counts, some are too long."""
    log = fx.call_log(spark, sf_dir)
    i, long = F.col("conv_id"), F.repeat(F.lit("x"), 5000)
    return log.select(
        (1 + F.col("turn") % 2).cast("int").alias("audit_schema_version"), "timestamp", "model_unique_id", F.when(i % 50 == 7, long).otherwise("v1").alias("prompt_version"), F.concat_ws("-", "conv_id", "turn").alias("response_text_hash"),
        F.lit(None).cast("string").alias("parsed_schema_hash"), F.lit(None).cast("string").alias("sent_sql_hash"), F.when(i % 10 == 4, -1).otherwise(F.col("input_tokens")).alias("input_tokens"), "output_tokens", "cache_creation_input_tokens",
        "cache_read_input_tokens", F.when(i % 10 != 3, F.col("model")).alias("model"),
    )


def _written_log(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The log as files, with the records that were too long for it; every tenth conversation also left a broken line."""
    path = new_path(spark, "log")
    long = audit.append_audit(_response_records(spark, sf_dir), path)
    broken = table(spark, sf_dir, "conversations", "conv_id", "turn").where("conv_id % 10 = 5 AND turn = 0")
    broken.select(F.concat(F.lit('{"model": "a", "conv": '), F.col("conv_id").cast("string"), F.lit(', "input'))).write.mode("append").text(f"{path}/model_unique_id=broken")
    return path, long


_SQL_WRITTEN = f"WITH {fx.SQL_CALLS}, written AS (SELECT * FROM calls WHERE conv_id % 50 <> 7), sound AS (SELECT * FROM written WHERE conv_id % 10 NOT IN (3, 4))"


@query(_SQL_WRITTEN + " SELECT conv_id || '-' || turn AS response_text_hash FROM calls WHERE conv_id % 50 = 7")
def append_audit(spark, sf_dir):
    """The records that are too long for the log."""
    return _written_log(spark, sf_dir)[1].select("response_text_hash")


@query("SELECT conv_id % 2 AS half, count(*) AS n, count(DISTINCT conv_id || '-' || turn) AS records FROM conversations WHERE conv_id % 50 <> 7 AND conv_id % 10 NOT IN (3, 4) GROUP BY ALL")
def append_audit_batches(spark, sf_dir):
    """Two batches, of which one is appended twice, as after a failure: it is in the log once."""
    path, records = new_path(spark, "log"), _response_records(spark, sf_dir)
    half = F.element_at(F.split("response_text_hash", "-"), 1).cast("long") % 2
    for k in (0, 1, 1):
        audit.append_audit(records.where(half == k), path, batch_id=k)
    log = audit.read_audit(spark, path, "response")
    return log.groupBy(half.alias("half")).agg(F.count("*").alias("n"), F.count_distinct("response_text_hash").alias("records"))


@query(_SQL_WRITTEN + " SELECT model_unique_id, model, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM sound GROUP BY ALL")
def read_audit(spark, sf_dir):
    log = audit.read_audit(spark, _written_log(spark, sf_dir)[0], "response")
    return log.groupBy("model_unique_id", "model").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query(_SQL_WRITTEN + " SELECT CASE conv_id % 10 WHEN 3 THEN 'missing field: model' WHEN 4 THEN 'negative: input_tokens' END AS reason, count(*) AS n FROM written WHERE conv_id % 10 IN (3, 4) GROUP BY ALL UNION ALL SELECT 'not JSON of this shape', count(*) FROM conversations WHERE conv_id % 10 = 5 AND turn = 0")
def malformed_records(spark, sf_dir):
    return audit.malformed_records(spark, _written_log(spark, sf_dir)[0], "response").groupBy("reason").agg(F.count("*").alias("n"))


@query(_SQL_WRITTEN + " SELECT count(*) AS n, sum(turn % 2)::BIGINT AS second_version FROM sound WHERE turn % 2 = 1")
def version_gate(spark, sf_dir):
    gated = audit.version_gate(audit.read_audit(spark, _written_log(spark, sf_dir)[0], "response"), 2)
    return gated.agg(F.count("*").alias("n"), F.sum(F.col("audit_schema_version") - 1).cast("long").alias("second_version"))


@query("SELECT source AS table_name, lang, count(*) * CASE WHEN source = (SELECT min(source) FROM documents) THEN 2 ELSE 1 END AS n FROM documents GROUP BY source, lang")
def write_report(spark, sf_dir):
    """A report of all tables, and then a later one of one table only: the others' stay."""
    path = new_path(spark, "report")
    found = table(spark, sf_dir, "documents", "source", "lang").groupBy(F.col("source").alias("table_name"), "lang").agg(F.count("*").alias("n"))
    audit.write_report(found, path)
    first = found.agg(F.min("table_name").alias("first"))
    audit.write_report(found.join(F.broadcast(first), F.col("table_name") == F.col("first")).select("table_name", "lang", (F.col("n") * 2).alias("n")), path)  # one row
    return spark.read.parquet(path)


# streams ---------------------------------------------------------------------------------------


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log stream: user groups are tables, types are reasons."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a stream reads directories; the glob is held against file names, so it fits a single file only
    rows = reader.parquet(path) if is_directory(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("model."), (F.col("user_id") % 5).cast("string")).alias("model_unique_id"), F.col("event_type").alias("reason"),
        F.when(F.col("event_type").isin("purchase", "signup"), "kept").otherwise("dropped").alias("decision"), (F.col("event_id") % 5000).cast("string").alias("record_id"), "event_id", "user_id", "value",
    )


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    streams.drain(stream, out, state, mode)
    return spark.read.schema(stream.schema).parquet(out)


_SQL_LOG = "l AS (SELECT ts, 'model.' || (user_id % 5) AS model_unique_id, event_type AS reason, event_id FROM events)"


@query(f"WITH {_SQL_LOG}, w AS (SELECT date_trunc('day', ts) AS window_start, model_unique_id, reason, count(*) AS n FROM l GROUP BY ALL) SELECT window_start, model_unique_id, reason, n FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM l)")
def stream_reason_counts(spark, sf_dir):
    return _drained(spark, streams.reason_counts(_event_log(spark, sf_dir)))


@query(
    f"WITH {_SQL_LOG}, w AS (SELECT date_trunc('day', ts) AS window_start, model_unique_id, count(*) FILTER (reason IN ('purchase', 'signup')) AS kept, count(*) AS total FROM l GROUP BY ALL) "
    "SELECT * FROM w WHERE kept / total <= 0.35 AND window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM l)"
)
def stream_kept_rate(spark, sf_dir):
    return _drained(spark, streams.kept_rate_by_window(_event_log(spark, sf_dir), threshold=0.35))


@query(
    f"WITH {_SQL_LOG}, w AS (SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS window_start, model_unique_id, reason, count(*) AS n FROM l, (SELECT unnest([0, 1]) AS k) GROUP BY ALL) SELECT window_start, model_unique_id, reason, n FROM w WHERE window_start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM l)"
)
def stream_sliding_counts(spark, sf_dir):
    return _drained(spark, streams.reason_counts(_event_log(spark, sf_dir), "2 days", "1 day"))


@query(_SQL_WRITTEN + " SELECT model, count(*) AS n, sum(output_tokens)::BIGINT AS output_tokens FROM written WHERE conv_id % 10 <> 3 GROUP BY model")
def stream_audit_log(spark, sf_dir):
    """A log that is tailed as it is appended to."""
    path = new_path(spark, "log")
    audit.append_audit(_response_records(spark, sf_dir), path)
    log = _drained(spark, streams.audit_stream(spark, path, "response").select("model", "output_tokens"))
    return log.where("model IS NOT NULL").groupBy("model").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("output_tokens"))


@query("SELECT record_id FROM (SELECT DISTINCT (event_id % 5000)::VARCHAR AS record_id FROM events)")
def stream_dedupe(spark, sf_dir):
    return _drained(spark, streams.without_duplicates(_event_log(spark, sf_dir), late="60 days").select("record_id"))


@query(
    """SELECT 'column.reason' AS anchor, 'accepted_values' AS test_type, count(*) AS evaluated_rows, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase')) AS failures FROM events
UNION ALL SELECT 'column.timestamp', 'not_null', count(*), count(*) FILTER (ts IS NULL) FROM events"""
)
def stream_batch_checks(spark, sf_dir):
    out = new_path(spark, "decisions")
    tests = [Test("events", "accepted_values", "reason", ("view", "click", "purchase")), Test("events", "not_null", "timestamp")]
    streams.check_batches(_event_log(spark, sf_dir), tests, lambda d, i: d.write.mode("overwrite").parquet(f"{out}/batch_id={i}"), new_path(spark, "state")).awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy("anchor", "test_type").agg(F.sum("evaluated_rows").alias("evaluated_rows"), F.sum("failures").alias("failures"))


@query(
    """SELECT sum(n)::BIGINT AS evaluated_rows, sum(bad)::BIGINT AS failures, sum(late)::BIGINT AS late_rows FROM (
SELECT count(*) AS n, count(*) FILTER (event_type NOT IN ('view', 'click')) AS bad, count(*) FILTER (event_id % 2 = 1 AND ts < (SELECT max(ts) - INTERVAL 10 DAY FROM events WHERE event_id % 2 = 0)) AS late FROM events)"""
)
def stream_late_rows(spark, sf_dir):
    """Two batches: of the second, the rows behind the watermark of the first are tested and counted as late."""
    path, state, out = new_path(spark, "arrived"), new_path(spark, "state"), new_path(spark, "decisions")
    events = table(spark, sf_dir, "events", "event_id", "event_type", "ts")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(path)
        stream = spark.readStream.schema(events.schema).parquet(path)
        tests = [Test("events", "accepted_values", "event_type", ("view", "click"))]
        streams.check_batches(stream, tests, lambda d, i: d.write.mode("overwrite").parquet(f"{out}/batch={i}"), state, late="10 days", ts="ts").awaitTermination()
    return spark.read.parquet(out).agg(*[F.sum(c).alias(c) for c in ("evaluated_rows", "failures", "late_rows")])


@query(f"WITH {fx.SQL_PRICED} SELECT provider, model, count(*) AS calls, round(sum(cost), 6) AS cost FROM priced WHERE cost IS NOT NULL AND provider IS NOT NULL GROUP BY ALL")
def stream_cost(spark, sf_dir):
    log = materialise(fx.call_log(spark, sf_dir).drop("conv_id", "turn"), "calls")
    source = new_path(spark, "calls")
    log.write.parquet(source)
    stream = streams.running_cost(spark.readStream.schema(log.schema).parquet(source), fx.prices(spark))
    out = new_path(spark, "cost")
    stream.writeStream.outputMode("complete").foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(out)).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT v.event_id AS left_id, p.event_id AS right_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 6 HOUR WHERE p.event_type = 'purchase' AND v.event_type = 'view'")
def stream_pairs(spark, sf_dir):
    log = _event_log(spark, sf_dir).select("timestamp", "user_id", "event_id", "reason")
    both = streams.pairs(log.where("reason = 'view'"), log.where("reason = 'purchase'"), "user_id", "6 HOURS", "1 day")
    return _drained(spark, both.select(F.col("l.event_id").alias("left_id"), F.col("r.event_id").alias("right_id")))


@query(
    f"""WITH {_SQL_LOG}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY model_unique_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM l),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY model_unique_id ORDER BY ts, event_id) AS k FROM g)
SELECT model_unique_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY model_unique_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM l)"""
)
def stream_sessions(spark, sf_dir):
    return _drained(spark, streams.sessions(_event_log(spark, sf_dir).select("timestamp", "model_unique_id"), "model_unique_id"))


