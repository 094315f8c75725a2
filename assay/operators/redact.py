"""Which columns may leave, and what the others look like when they do."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import short_hash
from .profile import profile_with_redaction
from .sampling import sample_rows

REDACTED = "<REDACTED>"
# fixed values: globs of names that are redacted by default, and names that only raise suspicion
PATTERNS = ("*email", "email", "*phone", "phone", "*ssn", "ssn")
SUSPICIOUS = ("email", "phone", "ssn", "password", "token", "secret", "api_key")


class Policy(NamedTuple):
    skip_columns: tuple[str, ...] = ()  # table.column
    skip_tables: tuple[str, ...] = ()
    patterns: tuple[str, ...] = PATTERNS
    enabled: bool = True


def redact_patterns(extend: Sequence[str] | None = None, replace: Sequence[str] | None = None) -> tuple[str, ...]:
    """The default globs, with more of them, or others in their place; an empty ``replace`` turns globs off."""
    if extend is not None and replace is not None:
        raise ValueError("patterns are extended or replaced, not both")
    found = PATTERNS + tuple(extend or ()) if replace is None else tuple(replace)
    if found:
        glob_regex(found)  # refuses globs that fit every name, or none
    else:
        logging.getLogger(__name__).warning("no patterns: names alone redact no column")
    return found


def glob_regex(patterns: Sequence[str]) -> str:
    """One anchored, case-insensitive regex for some globs (* and ?)."""
    for p in patterns:
        if p.strip() in ("", "*", "?"):
            raise ValueError(f"pattern {p!r} would match every column, or none")
    parts = ["".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) for p in patterns]
    return "(?i)^(" + "|".join(parts) + ")$"


def alias_of(name: Column) -> Column:
    return F.concat(F.lit("col_"), short_hash(name, 8))


def truthy(value: Column) -> Column:
    """JSON text as a flag: false, null, 0, "" and empty collections are not set; "false" in quotes is."""
    v = F.trim(value)
    return F.coalesce(v.isNotNull() & ~v.isin("false", "null", "", '""', "[]", "{}") & ~v.rlike(r"^-?0+(\.0+)?$"), F.lit(False))


def classify_columns(columns: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Add redacted, reason and alias; the first of nine reasons that applies wins.

    columns: table_name, table_tags array<string>, table_meta map<string,string> (JSON values),
    column_name, tags array<string>, meta map<string,string>.
    """
    name = F.concat_ws(".", "table_name", "column_name")
    has = lambda tags: F.coalesce(F.exists(tags, lambda t: F.lower(t) == "pii"), F.lit(False))
    out = lambda meta: F.coalesce(F.lower(F.trim(F.col(meta)["sample"])) == "false", F.lit(False))
    reason = F.coalesce(
        F.when(name.isin(*policy.skip_columns), "skip-column") if policy.skip_columns else F.lit(None),
        F.when(F.col("table_name").isin(*policy.skip_tables), "skip-table") if policy.skip_tables else F.lit(None),
        F.when(out("meta"), "column-opt-out"),
        F.when(has("tags"), "column-tag-pii"),
        F.when(truthy(F.col("meta")["contains_pii"]), "column-contains-pii"),
        F.when(out("table_meta"), "table-opt-out"),
        F.when(has("table_tags"), "table-tag-pii"),
        F.when(truthy(F.col("table_meta")["contains_pii"]), "table-contains-pii"),
        F.when(F.col("column_name").rlike(glob_regex(policy.patterns)), "pattern") if policy.patterns else F.lit(None),
    )
    reason = reason if policy.enabled else F.lit(None).cast("string")
    return columns.withColumn("reason", reason).withColumn("redacted", F.col("reason").isNotNull()).withColumn("alias", F.when(F.col("redacted"), alias_of(F.col("column_name"))))


def suspicious_columns(classified: DataFrame, marks: Sequence[str] = SUSPICIOUS) -> DataFrame:
    """Names that look personal but that no rule caught."""
    return classified.where(~F.col("redacted") & F.lower("column_name").rlike("|".join(map(re.escape, marks)))).select("table_name", "column_name")


def _rules(policy: DataFrame) -> dict[str, str]:
    """Redacted columns of one table with their reasons: metadata, a row per column."""
    return {r["column_name"]: r["reason"] for r in policy.where("redacted").select("column_name", "reason").collect()}


def drop_columns_by_policy(df: DataFrame, policy: DataFrame) -> DataFrame:
    """Without the columns that are to be skipped altogether."""
    return df.drop(*[c for c, why in _rules(policy).items() if why in ("skip-column", "skip-table")])


def mask_values(df: DataFrame, policy: DataFrame) -> DataFrame:
    """Redacted cells, nulls too, read <REDACTED>."""
    hidden = _rules(policy)
    return df.select(*[F.lit(REDACTED).alias(c) if c in hidden else F.col(f"`{c}`") for c in df.columns])


def rename_redacted(df: DataFrame, policy: DataFrame) -> DataFrame:
    """Redacted columns under their alias."""
    names = {r["column_name"]: r["alias"] for r in policy.where("redacted").select("column_name", "alias").collect()}
    return df.withColumnsRenamed({c: a for c, a in names.items() if c in df.columns})


def share_payload(df: DataFrame, policy: DataFrame, mode: str, n: int = 100, key: Sequence[str] | None = None, portable: bool = False) -> DataFrame:
    """What may be shared of a table: names and types, a profile, or masked sample rows."""
    if mode == "schema-only":
        shown = rename_redacted(drop_columns_by_policy(df, policy), policy)
        return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in shown.schema], "column string, data_type string")
    if mode == "aggregate-only":
        return profile_with_redaction(drop_columns_by_policy(df, policy), policy)
    if mode == "sample":
        rows = sample_rows(df, n, 1, key, portable)
        return rename_redacted(mask_values(drop_columns_by_policy(rows, policy), policy), policy)
    raise ValueError(f"mode {mode!r} is not schema-only, aggregate-only or sample")


def share_audit_row(payload: DataFrame, policy: DataFrame, table: str, mode: str, settings: Policy = Policy(), path_overridden: bool = False) -> DataFrame:
    """One row that says what left: columns, redactions, rows, policy hash and flags."""
    flags = [f for f, on in (("sample_mode_enabled", mode == "sample"), ("redaction_disabled", not settings.enabled), ("audit_path_overridden", path_overridden)) if on]
    redactions = policy.where("redacted").agg(F.array_sort(F.collect_list(F.struct("column_name", F.col("alias").alias("hashed_name"), "redacted", "reason"))).alias("redactions"))
    rows = payload.agg(F.count("*").alias("row_count"))
    return rows.join(F.broadcast(redactions)).select(  # one row each
        F.current_timestamp().alias("timestamp"),
        F.lit(table).alias("model_unique_id"),
        F.lit(mode).alias("mode"),
        F.array(*map(F.lit, payload.columns)).alias("columns_sent"),
        "redactions",
        "row_count",
        short_hash(F.lit(repr(settings))).alias("policy_hash"),
        F.array(*map(F.lit, flags)).cast("array<string>").alias("policy_flags"),
        F.lit(1).alias("audit_schema_version"),
    )
