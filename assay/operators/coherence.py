"""Whether a rule compares columns whose types belong together, read from the analysed plan.

Spark casts one side of ``a = b`` where the types differ, and then the outcome depends on the data: a text that
is no number stops the job, and another one is compared as a number.  Such comparisons of two
bare columns are found before anything runs.  Comparisons with literals, functions or explicit casts
are the writer's own decision and are left alone, and so are types that belong to no family.
"""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame

_COMPARISONS = {"EqualTo": "=", "EqualNullSafe": "<=>", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
_FAMILIES = {
    **dict.fromkeys(("byte", "short", "integer", "long", "float", "double", "decimal"), "number"),
    **dict.fromkeys(("string", "char", "varchar"), "text"),
    **dict.fromkeys(("date", "timestamp", "timestamp_ntz"), "time"),
    "boolean": "boolean",
    "binary": "binary",
}


def family(type_name: str) -> str | None:
    return _FAMILIES.get(type_name.split("(")[0])


def _items(seq: JavaObject) -> Iterator[JavaObject]:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def _expressions(plan: JavaObject) -> Iterator[JavaObject]:
    """All expressions of a plan and its subqueries, down to the tables that were handed in (views)."""
    if _kind(plan) == "View":
        return
    stack = list(_items(plan.expressions()))
    while stack:
        e = stack.pop()
        yield e
        stack += _items(e.children())
        if _kind(e) in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery"):
            yield from _expressions(e.plan()) if _kind(e) != "InSubquery" else ()
    for child in _items(plan.children()):
        yield from _expressions(child)


def _bare(e: JavaObject, asked: JavaObject) -> JavaObject | None:
    """The column that an expression is, under casts that nobody wrote."""
    while _kind(e) == "Cast" and not e.getTagValue(asked).isDefined():
        e = e.child()
    return e if _kind(e) == "AttributeReference" else None


def incoherent(rows: DataFrame, whole: bool = True) -> str | None:
    """What is wrong with the first comparison of columns of different families; None if there is none.

    whole: look at the whole plan; otherwise at its topmost node only, for a condition on top of any table.
    """
    asked = rows.sparkSession._jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
    plan = rows._jdf.queryExecution().analyzed()
    stack = [] if whole else list(_items(plan.expressions()))
    while stack:
        e = stack.pop()
        stack += _items(e.children())
        if said := _said(e, asked):
            return said
    return next((said for e in _expressions(plan) if (said := _said(e, asked))), None) if whole else None


def _said(e: JavaObject, asked: JavaObject) -> str | None:
    sign = _COMPARISONS.get(_kind(e))
    sides = [_bare(c, asked) for c in _items(e.children())] if sign else []
    if not sides or None in sides:
        return None
    names, types = [s.name() for s in sides], [s.dataType().typeName() for s in sides]
    known = [family(t) for t in types]
    if None in known or known[0] == known[1]:
        return None
    return f"{names[0]!r} ({types[0]}) and {names[1]!r} ({types[1]}) are compared ({sign}), but their types do not belong together"
