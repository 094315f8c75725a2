"""Data tests as failing-row queries.

``not_null``, ``accepted_values`` and boolean rules look at one row at a time: their counts are
fused into one aggregate over one scan, and so are rules of the form ``SELECT * FROM {{this}} WHERE
condition``.  A column with ``unique`` or ``relationships`` tests is grouped by its values once: one scan of
that column, one exchange of values with their counts, combined on the map side.  All tests of the
column are read off these counts, a reference by looking each value up once among the parent's
keys.  Rules that read other tables are SQL over the DataFrames.  Every family ends in one row per
test; they are united, so all of them run as one Spark job.

A test that can not be judged never raises: whatever Spark says of it, while it is analysed or while
it runs, is the reason why it has no evidence, and the other tests are judged as if it were not there.
With a time limit, a job that reaches it is cancelled, and its tests are tried apart until the slow one is alone.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import NamedTuple, TypeVar

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hashable, named, row_hash, value_text
from .coherence import incoherent

A = TypeVar("A")
TYPES = ("not_null", "unique", "accepted_values", "relationships", "custom_sql")


class Test(NamedTuple):
    """A candidate test.  ``sql``: a SELECT of failing rows with {{this}}, or a condition that failing rows meet."""

    table: str
    type: str
    column: str | None = None
    values: tuple[str, ...] = ()
    to: str | None = None
    field: str | None = None
    sql: str | None = None
    rationale: str | None = None
    anchor: str = ""
    __test__ = False  # no case of a test runner

    @property
    def place(self) -> str:
        return self.anchor or (f"column.{self.column}" if self.column and self.type != "custom_sql" else "model")


class NotEvaluable(ValueError):
    """The test can not be judged; it is kept without evidence."""


class FutureData(NotEvaluable):
    """The table that the test refers to does not exist yet."""


_SELECT = re.compile(r"^\s*(select|with)\b", re.I)
_THIS = re.compile(r"\{\{\s*this\s*\}\}", re.I)
_REF = re.compile(r"""\{\{\s*ref\(\s*['"]([^'"]+)['"]\s*\)\s*\}\}""")
_MARK = re.compile(f"{_THIS.pattern}|{_REF.pattern}", re.I)
_QUOTED = re.compile(r"""'(?:\\.|''|[^'\\])*'|"(?:\\.|""|[^"\\])*"|`(?:``|[^`])*`""", re.S)
#: A rule that is only a filter, unless its condition has one of the words that make it more.
_FILTER = re.compile(rf"^\s*select\s+\*\s+from\s+{_THIS.pattern}\s+where\s+(.+)$", re.I | re.S)
_MORE = re.compile(r"\b(select|from|group|having|order|sort|cluster|distribute|limit|offset|union|intersect|except|minus|window|qualify|lateral|join|pivot|tablesample)\b|\{\{", re.I)


def _column(df: DataFrame, name: str | None) -> Column:
    found = [c for c in df.columns if name and c.lower() == name.lower()]
    if len(found) != 1:
        raise NotEvaluable(f"column {name!r} is not in the table")
    return named(found[0])


def typed_values(df: DataFrame, column: str, values: Iterable[str]) -> list[Column]:
    """Accepted values, written as strings, in the type of the column."""
    kind = df.schema[[c for c in df.columns if c.lower() == column.lower()][0]].dataType
    values = list(values)
    if isinstance(kind, T.StringType) or not values:
        return [F.lit(v) for v in values]
    one = df.sparkSession.sql("SELECT * FROM VALUES (0)")  # a constant relation: the optimiser casts, and no job runs
    cast = one.select(*[F.lit(v).try_cast(kind).alias(f"v{i}") for i, v in enumerate(values)]).first()
    if any(v is None for v in cast):
        raise NotEvaluable(f"a value of {column!r} is no {kind.simpleString()}")
    return [F.lit(v).cast(kind) for v in values]


def check_rule_text(sql: str) -> None:
    """A rule is one statement without comments and with balanced parentheses; what stands in quotes does not count."""
    bare = _QUOTED.sub("", sql)
    if not bare.strip():
        raise NotEvaluable("the rule is empty")
    for mark, what in ((";", "more than one statement"), ("--", "a comment"), ("/*", "a comment"), ("*/", "a comment")):
        if mark in bare:
            raise NotEvaluable(f"the rule has {what} ({mark})")
    depth = 0
    for c in re.findall(r"[()]", bare):
        depth += 1 if c == "(" else -1
        if depth < 0:
            break
    if depth:
        raise NotEvaluable("the rule's parentheses are not balanced")


def row_condition(df: DataFrame, sql: str) -> Column:
    """A rule's condition, if it is boolean and looks at one row at a time."""
    condition = F.expr(sql)
    rows = df.where(condition)  # analysed: no aggregates, windows or generators, and boolean
    df.agg(F.count_if(condition))  # and the same each time it is computed
    _check_coherence(rows, whole=False)
    return condition


def _check_coherence(rows: DataFrame, whole: bool = True) -> None:
    if said := incoherent(rows, whole):
        raise NotEvaluable(said)


def failing_condition(df: DataFrame, test: Test) -> Column | None:
    """What failing rows of a row-local test meet; None for tests of other families."""
    if test.type == "not_null":
        return _column(df, test.column).isNull()
    if test.type == "accepted_values":
        col = _column(df, test.column)
        return col.isNotNull() & ~col.isin(typed_values(df, test.column, test.values)) if test.values else col.isNotNull()
    if test.type == "custom_sql":
        sql = test.sql or ""
        check_rule_text(sql)
        if not _SELECT.match(sql):
            return row_condition(df, sql)
        only = _FILTER.match(sql)
        if only and not _MORE.search(_QUOTED.sub("", only[1])):
            try:
                return row_condition(df, only[1])
            except (AnalysisException, ParseException):  # what names the table in its condition, for one
                return None
    return None


def _named(name: str | None, tables: dict[str, DataFrame]) -> list[str]:
    """Tables of that name, with or without what stands before its last dot."""
    want = (name or "").lower()
    return [n for n in tables if want in (n.lower(), n.lower().rsplit(".", 1)[-1])]


def resolve_target(test: Test, tables: dict[str, DataFrame]) -> DataFrame:
    """The table that ``to`` names; 0 or several candidates mean that its data is still to come."""
    named = _named(test.to, tables)
    if len(named) != 1:
        raise FutureData(f"{test.to!r} names {len(named)} known tables")
    return tables[named[0]]


def refers_elsewhere(test: Test) -> list[str]:
    """The other tables that a rule reads."""
    return _REF.findall(test.sql or "") if test.type == "custom_sql" else []


def failing_rows(df: DataFrame, test: Test, tables: dict[str, DataFrame], full: DataFrame | None = None) -> DataFrame:
    """The failing rows (for ``unique``: the failing keys with their counts).

    df: the table under test, sampled or not.  full: the same unsampled, for rules that read other
    tables, since sampling one side of a join makes orphans.
    """
    condition = failing_condition(df, test)
    if condition is not None:
        return df.where(condition)
    if test.type == "unique":
        key = _column(df, test.column)
        return df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("rows")).where("rows > 1")
    if test.type == "relationships":
        parent = resolve_target(test, tables)
        child = _column(df, test.column)
        field = _column(parent, test.field)
        return df.where(child.isNotNull()).withColumn("_fk", child).join(parent.select(field.alias("_pk")), F.col("_fk") == F.col("_pk"), "left_anti").drop("_fk")
    if test.type == "custom_sql":
        return bind_rule(df, test, tables, full)
    raise NotEvaluable(f"{test.type!r} is no known test")


def bind_rule(df: DataFrame, test: Test, tables: dict[str, DataFrame], full: DataFrame | None = None) -> DataFrame:
    """The rows of a SELECT rule: {{this}} and {{ref('t')}} become the DataFrames themselves.

    A rule that names a missing table waits for it; one that names several can not be judged.
    """
    sql = test.sql or ""
    if not _THIS.search(sql):
        raise NotEvaluable("the rule never reads {{this}}")
    bound = {"this_table": full if refers_elsewhere(test) and full is not None else df}
    plain = lambda text: text.replace("{", "{{").replace("}", "}}")  # noqa: E731 - other braces stand for themselves
    out, at = [], 0
    for mark in _MARK.finditer(sql):
        name = "this_table"
        if mark[1]:
            known = _named(mark[1], tables)
            if not known:
                raise FutureData(f"{mark[1]!r} is no known table")
            if len(known) > 1:
                raise NotEvaluable(f"{mark[1]!r} names {len(known)} known tables")
            name = f"ref_{list(tables).index(known[0])}"
            bound[name] = tables[known[0]]
        out += [plain(sql[at : mark.start()]), f"{{{name}}}"]
        at = mark.end()
    try:
        rows = df.sparkSession.sql("".join(out) + plain(sql[at:]), **bound)
    except (AnalysisException, ParseException) as e:
        raise NotEvaluable(str(e).split("\n")[0]) from e
    _check_coherence(rows)
    return rows


_COUNTS = "position int, failures long, excess_rows long, evaluated_rows long"


def _stacked(one: DataFrame, tests: Sequence[tuple[int, Column, Column | None]], n: Column) -> DataFrame:
    """One aggregated row as a row for each test: position, failures, excess rows."""
    none = F.lit(None).cast("long")
    rows = [F.struct(F.lit(i).alias("position"), failures.cast("long").alias("failures"), (none if excess is None else excess.cast("long")).alias("excess_rows"), n.cast("long").alias("evaluated_rows")) for i, failures, excess in tests]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def count_fused(df: DataFrame, conditions: Sequence[tuple[int, Column]]) -> DataFrame:
    """(position, failures, excess_rows, evaluated_rows) of many row-local tests from one aggregate."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"f{i}") for i, c in conditions])
    return _stacked(one, [(i, F.col(f"f{i}"), None) for i, _ in conditions], F.col("n"))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(v, n): the values of a column with their rows; nulls are a value."""
    return df.groupBy(hashable(df, name).alias("v")).agg(F.count("*").alias("n"))


def count_keys(df: DataFrame, column: str, tests: Sequence[tuple[int, Test]], tables: dict[str, DataFrame]) -> DataFrame:
    """The same rows for tests of one column, all from one grouping by its values."""
    v, n = F.col("v"), F.col("n")
    rows = lambda which: F.coalesce(F.sum(F.when(which, n)), F.lit(0))
    groups, aggs, out = value_counts(df, column), [F.coalesce(F.sum("n"), F.lit(0)).alias("all")], []
    for i, test in tests:
        excess = None
        if test.type == "unique":
            several = v.isNotNull() & (n > 1)
            failures, excess = F.count_if(several), F.coalesce(F.sum(F.when(several, n - 1)), F.lit(0))
        elif test.type == "relationships":
            parent = resolve_target(test, tables)
            keys = parent.select(_column(parent, test.field).alias(f"p{i}")).where(F.col(f"p{i}").isNotNull()).distinct()
            groups = groups.join(keys, v == F.col(f"p{i}"), "left")
            failures = rows(v.isNotNull() & F.col(f"p{i}").isNull())
        elif test.type == "not_null":
            failures = rows(v.isNull())
        else:
            failures = rows(v.isNotNull() & ~v.isin(typed_values(df, column, test.values)) if test.values else v.isNotNull())
        aggs += [failures.alias(f"f{i}"), *([excess.alias(f"e{i}")] if excess is not None else [])]
        out.append((i, F.col(f"f{i}"), F.col(f"e{i}") if excess is not None else None))
    return _stacked(groups.agg(*aggs), out, F.col("all"))


def count_one(df: DataFrame, i: int, test: Test, tables: dict[str, DataFrame], full: DataFrame | None = None) -> DataFrame:
    """The same row for one test of any family."""
    if _by_key(df, test, tables):
        return count_keys(df, _name(df, test.column), [(i, test)], tables)
    failing = failing_rows(df, test, tables, full).agg(F.count("*").alias("failures"))
    rows = df.agg(F.count("*").alias("n"))
    return _stacked(failing.join(F.broadcast(rows)), [(i, F.col("failures"), None)], F.col("n"))  # one row each


def _name(df: DataFrame, column: str | None) -> str:
    _column(df, column)
    return next(c for c in df.columns if c.lower() == column.lower())


def _by_key(df: DataFrame, test: Test, tables: dict[str, DataFrame]) -> bool:
    """Whether a test needs the counts of a column's values; a reference to a key of another type is a join of rows, as Spark casts it."""
    if test.type == "unique":
        return not isinstance(df.schema[_name(df, test.column)].dataType, T.MapType | T.VariantType)
    if test.type != "relationships":
        return False
    parent = resolve_target(test, tables)
    return df.schema[_name(df, test.column)].dataType == parent.schema[_name(parent, test.field)].dataType


class Unit(NamedTuple):
    """Tests that are counted together, by position, and how some of them are."""

    positions: list[int]
    count: Callable[[list[int]], DataFrame]


class Plan(NamedTuple):
    """How the tests of a table are counted, and those that can not be, by position."""

    units: list[Unit]
    failed: dict[int, Exception]


def plan(df: DataFrame, tests: Sequence[Test], tables: dict[str, DataFrame], full: DataFrame | None = None, apart: bool = False) -> Plan:
    """Analyse each test on its own, so that a bad one fails alone; row-local tests are the first unit.

    apart: row-local tests stay there, also those of a column whose values are counted.
    """
    conditions: dict[int, Column] = {}
    keyed: dict[str, list[int]] = {}
    single: list[int] = []
    failed: dict[int, Exception] = {}
    columns: dict[int, str] = {}
    for i, test in enumerate(tests):
        try:
            condition = failing_condition(df, test)
            if condition is not None:
                df.where(condition)
                conditions[i] = condition
                if test.type in ("not_null", "accepted_values"):
                    columns[i] = _name(df, test.column)
            else:
                count_one(df, i, test, tables, full)
                if _by_key(df, test, tables):
                    keyed.setdefault(_name(df, test.column), []).append(i)
                else:
                    single.append(i)
        except Exception as e:  # whatever is wrong with a test, it is no reason to stop
            failed[i] = e
    for i, name in columns.items():
        if name in keyed and not apart:
            keyed[name].append(i)
            del conditions[i]
    units = [Unit(list(conditions), lambda some: count_fused(df, [(i, conditions[i]) for i in some]))] if conditions else []
    units += [Unit(own, lambda some, name=name: count_keys(df, name, [(i, tests[i]) for i in some], tables)) for name, own in keyed.items()]
    units += [Unit([i], lambda some: count_one(df, some[0], tests[some[0]], tables, full)) for i in single]
    return Plan(units, failed)


def joint(units: Sequence[Unit]) -> DataFrame:
    """All counts of some units as one DataFrame, and so as one job."""
    return reduce(DataFrame.union, [u.count(u.positions) for u in units])


class TimeLimit(NotEvaluable):
    """A job was cancelled at its limit."""


def limited(spark: SparkSession, seconds: float | None, run: Callable[[], A]) -> A:
    """What ``run`` gives; the jobs that it starts are cancelled once the time is over, also one that starts later.

    Spark asks a task to end and interrupts it.  On a cluster set ``spark.task.reaper.enabled``, so that
    a task that does neither look nor listen is ended with its executor.
    """
    if seconds is None:
        return run()
    context, tag, key = spark.sparkContext, f"assay-{uuid.uuid4().hex}", "spark.job.interruptOnCancel"
    before = context.getLocalProperty(key)
    context.setLocalProperty(key, "true")
    done, over = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(max(seconds, 0)):
            over.set()
            while not done.wait(0.1):
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        return run()
    except Exception as e:
        if over.is_set():
            raise TimeLimit(f"cancelled after {seconds:g} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
        context.setLocalProperty(key, before)


def _halves(units: Sequence[Unit]) -> list[list[Unit]]:
    """Two parts of about as many tests; a single unit is cut."""
    if len(units) == 1:
        own, count = units[0]
        return [[Unit(own[: len(own) // 2], count)], [Unit(own[len(own) // 2 :], count)]]
    return [list(units[: len(units) // 2]), list(units[len(units) // 2 :])]


def _run(spark: SparkSession, units: Sequence[Unit], failed: dict[int, Exception], limit: Callable[[], float | None]) -> list[tuple]:
    """Counts of some tests in one job.  If it fails, its halves run apart, down to the test that is at fault."""
    positions = [i for u in units for i in u.positions]
    try:
        seconds = limit()
    except NotEvaluable as e:
        failed |= dict.fromkeys(positions, e)
        return []
    try:
        return limited(spark, seconds, lambda: [tuple(r) for r in joint(units).collect()])  # a row for each test
    except Exception as e:
        if len(positions) == 1:
            failed[positions[0]] = e
            return []
    return [r for half in _halves(units) for r in _run(spark, half, failed, limit)]


def evaluate(
    df: DataFrame, tests: Sequence[Test], tables: dict[str, DataFrame], full: DataFrame | None = None,
    budget: float | None = None, clock: Callable[[], float] = time.monotonic, timeout: float | None = None, end: float | None = None,
) -> DataFrame:
    """(position, failures, excess_rows, evaluated_rows, status, why) of each test, in one job.

    status: ok, future or error.  timeout: seconds after which a job is cancelled; a test that reaches it on its
    own is kept without evidence.  budget: seconds for all tests together, after which the running
    job is cancelled and no other is started; ``end`` says when that is, if the clock runs already.  With
    either, the row-local tests run first, in one job, and then the tests of each column and the others.
    """
    spark = df.sparkSession
    if end is None and budget is not None:
        end = clock() + budget
    timed = timeout is not None or end is not None
    units, failed = plan(df, tests, tables, full, apart=timed)

    def limit() -> float | None:
        if end is None:
            return timeout
        left = end - clock()
        if left <= 0:
            raise NotEvaluable("the budget was used up" if budget is None else f"the budget of {budget:g} s was used up")
        return left if timeout is None else min(left, timeout)

    rows: list[tuple] = []
    for step in [[u] for u in units] if timed else [units]:
        rows += _run(spark, step, failed, limit) if step else []
    out = [(*r, "ok", None) for r in rows]
    out += [(i, None, None, None, "future" if isinstance(e, FutureData) else "error", re.sub(r"\s+", " ", str(e))[:200]) for i, e in failed.items()]
    return spark.createDataFrame(out, f"{_COUNTS}, status string, why string")


def examples(df: DataFrame, test: Test, tables: dict[str, DataFrame], k: int = 3, order: Sequence[str] | None = None) -> DataFrame:
    """Up to k failing rows as JSON, the same ones every time: the first by row hash, or by ``order``."""
    rows = failing_rows(df, test, tables)
    by = [F.col(c) for c in order] if order else [row_hash(rows)]
    return rows.orderBy(*by).limit(k).select(F.to_json(F.struct(*[named(c) for c in rows.columns])).alias("example"))


def explain_failure(df: DataFrame, test: Test, tables: dict[str, DataFrame], order: Sequence[str] | None = None) -> DataFrame:
    """One sentence: ``passed``, or the number of failing rows with the first of them."""
    rows = failing_rows(df, test, tables)
    by = F.struct(*[F.col(c) for c in order]) if order else row_hash(rows)
    pairs = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), value_text(rows, c)) for c in rows.columns])
    found = rows.select(by.alias("o"), pairs.alias("p")).agg(F.count("*").alias("n"), F.min_by("p", "o").alias("p"))
    return found.select(F.when(F.col("n") == 0, F.lit("passed")).otherwise(F.format_string("%d rows failed (example: %s)", "n", "p")).alias("explanation"))
