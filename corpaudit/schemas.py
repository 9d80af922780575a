"""Schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "BINARY": T.BinaryType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _table(spec: str) -> T.StructType:
    """Schema from "name TYPE, ..."; unlike fromDDL it needs no session."""
    fields = (field.split() for field in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# What a source delivers: one row per file (or directory) of a repository.
RAW_FILES = _table(
    "repo_id STRING, path STRING, kind STRING, size BIGINT, "
    "unreadable BOOLEAN, error STRING, content BINARY"
)
FILES = _table(
    "repo_id STRING, path STRING, kind STRING, size BIGINT, extension STRING, "
    "is_binary BOOLEAN, is_source BOOLEAN, unreadable BOOLEAN, error STRING, "
    "content BINARY"
)
FINDINGS = _table(
    "repo_id STRING, id STRING, severity STRING, severity_rank INT, "
    "category STRING, title STRING, path STRING, line INT, evidence STRING, "
    "explanation STRING, recommendation STRING"
)
DEPENDENCIES = _table(
    "repo_id STRING, ecosystem STRING, manifest_file STRING, scope STRING, "
    "ordinal INT, name STRING, operator STRING, version STRING"
)
MANIFEST_SUMMARY = _table(
    "repo_id STRING, ecosystem STRING, manifest_file STRING, "
    "runtime ARRAY<STRING>, dev ARRAY<STRING>, pinned BOOLEAN, "
    "lockfile_present BOOLEAN, duplicates ARRAY<STRING>"
)
PYTHON_METRICS = _table(
    "functions INT, classes INT, imports INT, max_depth INT, "
    "syntax_error STRING, error_line INT, modules ARRAY<STRING>"
)

FINDING_COLUMNS = FINDINGS.fieldNames()
