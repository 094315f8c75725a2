"""Profiles, redaction, hygiene, identity, grades, tiers."""

import pytest
from pyspark.sql import functions as F

from assay.functions.columns import first_sentence, truncate
from assay.operators import grades, hygiene, identity, profile, propose, redact, report

COLUMNS = "table_name string, table_tags array<string>, table_meta map<string,string>, column_name string, tags array<string>, meta map<string,string>"
TESTS = "position int, table_name string, anchor string, test_type string, column string, values array<string>, to string, field string, sql string"


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", [1], {"k": 1}, b"x"), (None, "b", [1], {"k": 1}, b"x"), (1, None, None, None, None)], "i int, s string, a array<int>, m map<string,int>, b binary")
    got = {r["column"]: r for r in profile.column_stats(df).collect()}
    assert (got["i"]["non_null"], got["i"]["distinct_values"], got["i"]["nulls"], got["i"]["min_value"]) == (2, 1, 1, "1")
    assert got["s"]["max_value"] == "b"
    for c in ("a", "m", "b"):
        assert (got[c]["distinct_values"], got[c]["min_value"], got[c]["max_value"]) == (1, None, None)
    assert {r["column"]: r for r in profile.column_stats(df).collect()} == got
    assert {r["column"]: r["distinct_values"] for r in profile.column_stats(df.limit(0)).collect()} == dict.fromkeys("isamb", 0)


@pytest.fixture(scope="module")
def classified(spark):
    rows = [
        ("t", [], {}, "id", [], {}),
        ("t", [], {}, "work_email", [], {}),
        ("t", [], {}, "Phone", [], {}),
        ("t", [], {}, "email_address", [], {}),
        ("t", [], {}, "optout", ["pii"], {"sample": "false"}),
        ("t", [], {}, "taxpayer", ["PII"], {}),
        ("t", [], {}, "birth", [], {"contains_pii": "1"}),
        ("t", [], {}, "empty", [], {"contains_pii": '""'}),
        ("t", [], {}, "text", [], {"contains_pii": '"false"'}),
        ("u", ["pii"], {}, "a", [], {}),
        ("v", None, {"contains_pii": "true"}, "a", None, None),
        ("w", [], {"sample": "false"}, "a", [], {}),
        ("x", [], {}, "a", [], {}),
        ("t", [], {}, "gone", [], {}),
    ]
    return redact.classify_columns(spark.createDataFrame(rows, COLUMNS), redact.Policy(("t.gone",), ("x",)))


def test_reasons(classified):
    got = {(r["table_name"], r["column_name"]): r["reason"] for r in classified.collect()}
    assert got == {
        ("t", "id"): None, ("t", "work_email"): "pattern", ("t", "Phone"): "pattern", ("t", "email_address"): None, ("t", "optout"): "column-opt-out", ("t", "taxpayer"): "column-tag-pii",
        ("t", "birth"): "column-contains-pii", ("t", "empty"): None, ("t", "text"): "column-contains-pii", ("u", "a"): "table-tag-pii", ("v", "a"): "table-contains-pii", ("w", "a"): "table-opt-out",
        ("x", "a"): "skip-table", ("t", "gone"): "skip-column",
    }
    assert [r["column_name"] for r in redact.suspicious_columns(classified).collect()] == ["email_address"]
    for bad in ("", "*", "?"):
        with pytest.raises(ValueError):
            redact.glob_regex([bad])


def test_payloads(spark, classified):
    policy = classified.where("table_name = 't'")
    df = spark.createDataFrame([(1, "a@b", "x"), (2, None, "y")], "id int, work_email string, gone string")
    sent = redact.share_payload(df, policy, "sample", 10)
    alias = [c for c in sent.columns if c.startswith("col_")]
    assert len(alias) == 1 and set(sent.columns) == {"id", *alias}
    assert {r[alias[0]] for r in sent.collect()} == {redact.REDACTED}
    stats = {r["column"]: r["non_null"] for r in redact.share_payload(df, policy, "aggregate-only").collect()}
    assert stats == {"id": 2, alias[0]: None}
    assert {r["column"] for r in redact.share_payload(df, policy, "schema-only").collect()} == {"id", alias[0]}
    row = redact.share_audit_row(sent, policy, "t", "sample").first()
    assert row["row_count"] == 2 and row["policy_flags"] == ["sample_mode_enabled"] and row["columns_sent"] == sent.columns
    with pytest.raises(ValueError):
        redact.share_payload(df, policy, "all")


def rules_of(spark, rows):
    return spark.createDataFrame(rows, TESTS)


def test_hygiene(spark):
    tests = rules_of(spark, [
        (0, "t", "column.a", "not_null", "a", None, None, None, None), (1, "t", "column.a", "not_null", "A", None, None, None, None),
        (2, "t", "column.a", "accepted_values", "a", ["x", "y"], None, None, None), (3, "t", "column.a", "accepted_values", "a", ["y", "x"], None, None, None),
        (4, "t", "column.b", "unique", "c", None, None, None, None), (5, "t", "model", "custom_sql", None, None, None, None, " "), (6, "t", "model", "custom_sql", None, None, None, None, "n  > 1"), (7, "t", "model", "custom_sql", None, None, None, None, "n > 1"),
    ])
    assert sorted(r["position"] for r in hygiene.dedupe_tests(tests).collect()) == [0, 2, 4, 5, 6]
    columns = spark.createDataFrame([("t", "A"), ("t", "b")], "table_name string, column_name string")
    got = sorted((r["position"], r["violation"]) for r in hygiene.contract_violations(tests, columns, ("unique",), 9).collect())
    assert got == [(-1, "too-few-rules"), (1, "duplicate-test"), (4, "column-differs-from-anchor"), (4, "excluded-type"), (4, "nonexistent-column"), (5, "empty-rule")]


def test_raw_entries(spark):
    rows = [(0, "t", "a", "not_null", "{}"), (1, "t", None, "unique", "{}"), (2, "t", "a", "accepted_values", '{"arguments": {"values": ["x", "1"]}}'), (3, "t", "a", "accepted_values", "{}"), (4, "t", "a", "relationships", '{"to": "ref(\'u\')", "field": "id"}'), (5, "t", "a", "pkg.x", "{}"), (6, "t", "a", "positive", None), (7, "t", "a", "relationships", '{"to": "u"}')]
    raw = spark.createDataFrame(rows, "position int, table_name string, column string, name string, body_json string")
    assert {r["position"]: r["reason"] for r in hygiene.skipped_tests(raw).collect()} == {1: "malformed-supported-test", 3: "malformed-supported-test", 5: "unsupported-test-type", 6: "custom-or-generic-test", 7: "malformed-supported-test"}
    parsed = {r["position"]: r for r in hygiene.parse_raw_tests(raw).collect()}
    assert sorted(parsed) == [0, 2, 4] and parsed[2]["values"] == ["x", "1"] and (parsed[4]["to"], parsed[4]["field"]) == ("u", "id")


def test_artifact_ids(spark):
    tests = rules_of(spark, [(0, "t", "column.a", "not_null", "a", None, None, None, None), (1, "t", "model", "custom_sql", None, None, None, None, "x"), (2, "t", "model", "custom_sql", None, None, None, None, "y"), (3, "t", "model", "custom_sql", None, None, None, None, "x")])
    ids = [r["artifact_id"] for r in identity.with_artifact_ids(tests).orderBy("position").collect()]
    assert ids[0] == "test.column.a.not_null" and ids[3] == ids[1] + ":1" and ids[1].startswith("test.model.custom_sql.") and ids[1] != ids[2]
    change = {r["change"] for r in hygiene.test_set_diff(tests.where("position < 2"), tests.where("position > 0")).collect()}
    assert change == {"added", "removed", "unchanged"}
    assert identity.fingerprint(tests).first() == identity.fingerprint(tests.repartition(3)).first()


def test_proposals(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 10).alias("u_id"))
    got = propose.propose_candidates(df, "t", profile.column_stats(df), {"u": spark.range(10).toDF("x_id")})
    assert {(t.type, t.column) for t in got} == {("not_null", "id"), ("not_null", "kind"), ("not_null", "u_id"), ("unique", "id"), ("accepted_values", "kind"), ("relationships", "u_id")}
    assert [t.values for t in got if t.values] == [("a", "b")]


def test_proposals_look_at_all_rows(spark):
    for k in range(6):  # equal rows share a hash, so a sample by it has all of them or none
        good = spark.range(200).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 10).alias("u_id"), "id")
        df = good.union(spark.range(100).select(F.lit("c"), F.lit(90 + k), F.lit(-1)))
        got = propose.propose_candidates(df, "t", profile.column_stats(df), {"u": spark.range(10).toDF("x_id")})
        assert [t.values for t in got if t.type == "accepted_values"] == [("a", "b", "c")]
        assert not [t for t in got if t.type == "relationships"]
        found = {r.child_column: r.contained for r in propose.references({"t": df, "x": spark.range(10).toDF("x_id")}, 0.5).collect() if r.child_table == "t"}
        assert found["u_id"] == pytest.approx(2 / 3, abs=1e-6)


GRADES = "table_name string, artifact_id string, criterion_id string, pos int, score double, passed boolean, reasoning string"


def test_grades_and_tiers(spark):
    scored = spark.createDataFrame([("t", "a", "c1", 0, 0.9, True, "Fine."), ("t", "a", "c2", 1, 0.8, True, "Fine."), ("t", "b", "c1", 0, 0.9, True, "Fine."), ("t", "b", "c2", 1, 0.1, False, "Too vague. And more."), ("t", "c", "c1", 0, None, False, "not evaluated")], GRADES)
    one = grades.grade_verdict(grades.grade_summary(scored)).first()
    assert (one["pass_rate"], one["mean_score"], one["aggregate_complete"], one["passed"]) == (0.75, 0.675, False, True)
    assert {r["artifact_id"]: (r["score"], r["passed"]) for r in grades.artifact_grade(scored).collect()} == {"a": (0.85, True), "b": (0.5, False), "c": (None, False)}
    none = grades.grade_summary(scored.where("score IS NULL")).first()
    assert (none["pass_rate"], none["mean_score"]) == (0.0, 0.0)
    rows = [(i, "t", a, "not_null", d, r, "some failures", w) for i, (a, d, r, w) in enumerate([("a", "kept", "kept", "x" * 200), ("b", "kept", "kept", ""), ("c", "kept", "kept", None), ("d", "kept", "kept", None), ("a", "dropped", "always-passes", None), ("b", "kept", "kept-without-evidence", None)])]
    decided = spark.createDataFrame(rows, "position int, table_name string, artifact_id string, test_type string, decision string, reason string, why string, rationale string")
    got = report.tiers(decided, scored).orderBy("position").collect()
    assert [r["tier"] for r in got] == ["kept", "flagged", "flagged", "kept", "dropped", "kept-uncertain"]
    assert got[0]["tier_why"] == "x" * 79 + "…" and got[1]["tier_why"] == "failed grading: c2 — Too vague." and got[3]["tier_why"] == "some failures"
    entries = report.report_entries(report.tiers(decided, scored), spark.createDataFrame([("t", "column.x.description"), ("t", "b")], "table_name string, artifact_id string"), scored)
    assert {(r["artifact_id"], r["tier"]) for r in entries.where("part = 0").collect()} == {("column.x.description", "kept"), ("b", "flagged")}
    report.check_same_tables(decided, scored)
    with pytest.raises(ValueError):
        report.check_same_tables(decided.limit(0), scored)


def test_judgements(spark):
    said = {
        "plain": '{"criterion_id": "c", "score": 0.5, "passed": true, "reasoning": "r"}', "fenced": 'So:\n```json\n{"criterion_id": "c", "score": 1, "passed": false}\n```', "none": "no", "other": '{"criterion_id": "d", "score": 1, "passed": true}',
        "high": '{"criterion_id": "c", "score": 2, "passed": true}', "nan": '{"criterion_id": "c", "score": "NaN", "passed": true}', "text": '{"criterion_id": "c", "score": 1, "passed": "true"}', "missing": '{"criterion_id": "c", "passed": true}', "nameless": '{"score": 1, "passed": true}', "null": None,
        "no score": '{"criterion_id": "c", "score": null, "passed": false}', "quoted": '{"criterion_id": "c", "score": "0.5", "passed": true}', "flag": '{"criterion_id": "c", "score": true, "passed": true}', "one": '{"criterion_id": "c", "score": 1, "passed": 1}',
        "no flag": '{"criterion_id": "c", "score": 1}', "list": "[1]", "odd": '{"criterion_id": "c", "score": 1, "passed": true, "evidence": 5}',
    }
    rows = spark.createDataFrame([(k, "c", v) for k, v in said.items()], "artifact_id string, criterion_id string, response_text string")
    got = {r["artifact_id"]: r for r in grades.parse_judgements(rows).collect()}
    assert (got["plain"]["score"], got["plain"]["passed"], got["fenced"]["score"], got["fenced"]["passed"]) == (0.5, True, 1.0, False)
    assert {k: r["violation"] for k, r in got.items() if r["violation"]} == {"none": "no-json", "other": "criterion-mismatch", "high": "score-out-of-range", "nan": "score-not-a-number", "text": "passed-not-boolean", "missing": "missing-score", "nameless": "missing-criterion", "null": "no-json", "quoted": "score-not-a-number", "flag": "score-not-a-number", "one": "passed-not-boolean", "no flag": "missing-passed", "list": "no-json", "odd": "field-not-text"}
    assert (got["no score"]["score"], got["no score"]["passed"]) == (None, False)
    work = grades.work_list(spark.createDataFrame([("plain",), ("none",)], "artifact_id string"), spark.createDataFrame([("c", 0)], "criterion_id string, pos int"))
    full = {r["artifact_id"]: (r["score"], r["passed"], r["reasoning"]) for r in grades.complete(work, grades.parse_judgements(rows).where("violation IS NULL").drop("violation", "evidence")).collect()}
    assert full == {"plain": (0.5, True, "r"), "none": (None, False, "not evaluated")}
    assert grades.invalid_scores(spark.createDataFrame([(None,), (0.5,), (1.5,), (float("nan"),)], "score double")).count() == 2


def test_text_functions(spark):
    row = spark.range(1).select(truncate(F.lit("abcdef"), 4).alias("a"), truncate(F.lit("abcd"), 4).alias("b"), first_sentence(F.lit("One v1.2 here. Two.")).alias("c"), first_sentence(F.lit("no stop")).alias("d")).first()
    assert tuple(row) == ("abc…", "abcd", "One v1.2 here.", "no stop")


def test_patterns_are_extended_or_replaced(caplog):
    assert redact.redact_patterns() == redact.PATTERNS
    assert redact.redact_patterns(extend=["*_dob"]) == (*redact.PATTERNS, "*_dob")
    assert redact.redact_patterns(replace=["x*"]) == ("x*",)
    assert redact.redact_patterns(replace=[]) == () and "no patterns" in caplog.text
    for bad in ({"extend": ["a"], "replace": ["b"]}, {"extend": ["*"]}, {"replace": [" "]}):
        with pytest.raises(ValueError):
            redact.redact_patterns(**bad)


def test_kept_tests_show_evidence_where_they_have_no_rationale(spark):
    decisions = spark.createDataFrame([("t", a, "kept", "kept", r, "why") for a, r in (("a", " "), ("b", "Because."), ("c", None))], "table_name string, artifact_id string, decision string, reason string, rationale string, why string")
    scores = spark.createDataFrame([("t", a, "c", p, 1.0, True, "r", e) for a, p, e in (("a", 0, " "), ("a", 1, "Seen " + "x" * 100), ("b", 0, "Seen."), ("c", 0, None))], "table_name string, artifact_id string, criterion_id string, pos int, score double, passed boolean, reasoning string, evidence string")
    got = {r["artifact_id"]: r["tier_why"] for r in report.tiers(decisions, scores).collect()}
    assert got == {"a": "Seen " + "x" * 74 + "…", "b": "Because.", "c": "why"}
    with pytest.raises(Exception, match="grades of tables without decisions: t"):
        report.tiers(decisions.limit(0), scores).collect()


def test_wide_profiles_warn(spark, caplog):
    wide = spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(501)])
    assert profile.column_stats(wide, approximate=True).count() == 501 and "consider splitting" in caplog.text


def test_numbers_of_repeats_go_through_ranges(spark, monkeypatch):
    monkeypatch.setattr(identity, "RANGE", 4)
    rows = [(i, "t", "model", "custom_sql", None, None, None, None, "n > 1" if i % 3 else "n > 2") for i in range(30)]
    got = {r["position"]: r["artifact_id"] for r in identity.with_artifact_ids(spark.createDataFrame(rows, TESTS)).collect()}
    hashed = {got[i].split(":")[0] for i in range(30)}
    assert len(hashed) == 2 and sorted(int((got[i].split(":") + ["0"])[1]) for i in range(0, 30, 3)) == list(range(10))
    assert [int((got[i].split(":") + ["0"])[1]) for i in range(30) if i % 3] == list(range(20))


def test_fingerprints_are_of_multisets(spark):
    prints = lambda df: identity.fingerprint(df).first()[0]
    a = prints(spark.range(5))
    assert a == prints(spark.range(5).orderBy(F.desc("id")).repartition(3)) != prints(spark.range(6))
    assert prints(spark.range(5).union(spark.range(2))) not in (a, prints(spark.range(5).union(spark.range(1, 3))))
    state = identity.fingerprint_state
    changed = identity.changed_state(state(spark.range(4)), added=state(spark.range(3, 5)), removed=state(spark.range(3, 4)))
    assert identity.fingerprint_of(changed).first()[0] == a
    assert prints(spark.range(0)) == prints(spark.range(3).where("false"))
    plan = identity.fingerprint(spark.range(200_000))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and prints(spark.range(200_000, numPartitions=3)) == prints(spark.range(200_000, numPartitions=7))


def test_references_are_found_by_values(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "supplier": frame([(f"n{i}", i, "x") for i in range(20)], "name string, s_key long, `it's` string"),
        "line": frame([(i % 15, f"n{i % 4}", i % 2 == 0, None) for i in range(60)], "l_supp int, label string, flag boolean, nothing long"),
        "dup": frame([(i % 10,) for i in range(20)], "k long"),
        "mostly": frame([(i if i < 19 else 99,) for i in range(20)], "v short"),
    }
    got = {tuple(r)[:4]: (r.contained, r.coverage) for r in propose.references(tables).collect()}
    assert got == {
        ("line", "l_supp", "supplier", "s_key"): (1.0, 0.75), ("line", "label", "supplier", "name"): (1.0, 0.2), ("dup", "k", "supplier", "s_key"): (1.0, 0.5), ("dup", "k", "mostly", "v"): (1.0, 0.5),
        ("line", "l_supp", "mostly", "v"): (1.0, 0.75), ("mostly", "v", "supplier", "s_key"): (0.95, 0.95), ("supplier", "s_key", "mostly", "v"): (0.95, 0.95),
    }
    assert propose.references({"a": spark.range(0), "b": spark.range(0)}).collect() == []
    tests = propose.propose_candidates(tables["line"], "line", profile.column_stats(tables["line"]), {"supplier": tables["supplier"]})
    assert [(t.column, t.to, t.field) for t in tests if t.type == "relationships"] == [("l_supp", "supplier", "s_key")]
