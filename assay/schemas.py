"""Pinned schemas of the audit logs.  Fields that a reader does not know are ignored, missing ones are null."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "t": T.TimestampType()}


def _struct(fields: str, **others: T.DataType) -> T.StructType:
    """``name:kind`` pairs, and fields of other types by name."""
    plain = [T.StructField(n, _KINDS[k]) for n, k in (f.split(":") for f in fields.split())]
    return T.StructType(plain + [T.StructField(n, t) for n, t in others.items()])


_TOKENS = "input_tokens:l output_tokens:l cache_creation_input_tokens:l cache_read_input_tokens:l"
_STRINGS = T.ArrayType(T.StringType())
_REDACTIONS = T.ArrayType(_struct("column_name:s hashed_name:s redacted:b reason:s"))
LOGS = {
    "prune": _struct(
        "audit_schema_version:i record_id:s timestamp:t config_hash:s model_unique_id:s anchor:s test_type:s decision:s reason:s failures:l evaluated_rows:l scope:s elapsed_ms:l why:s",
        sample_failures=_STRINGS,
    ),
    "share": _struct("audit_schema_version:i timestamp:t model_unique_id:s mode:s row_count:l policy_hash:s", columns_sent=_STRINGS, redactions=_REDACTIONS, policy_flags=_STRINGS),
    "response": _struct(f"audit_schema_version:i timestamp:t model_unique_id:s prompt_version:s response_text_hash:s parsed_schema_hash:s sent_sql_hash:s {_TOKENS} model:s"),
    "grade": _struct(f"audit_schema_version:i run_id:s timestamp:t model_unique_id:s artifact_id:s criterion_id:s score:d passed:b evidence:s reasoning:s rubric_hash:s model:s {_TOKENS}"),
}
#: Fields without which a record says nothing.
REQUIRED = {
    "prune": ("record_id", "timestamp", "model_unique_id", "decision", "reason"),
    "share": ("timestamp", "model_unique_id", "mode"),
    "response": ("timestamp", "model_unique_id", "model", "input_tokens", "output_tokens"),
    "grade": ("timestamp", "run_id", "model_unique_id", "artifact_id", "criterion_id", "model"),
}
