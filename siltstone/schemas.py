"""Explicit schemas of the engine's tables, and the checks that stand for keys and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "relative_path STRING, absolute_path STRING, size_bytes BIGINT, mtime_ns BIGINT, sha256 STRING"
ERRORS = "stage STRING, relative_path STRING, error_type STRING, message STRING, error_line INT, error_column INT"
SYMBOLS = (
    "relative_path STRING, kind STRING, name STRING, qualified_name STRING, parent_qualified_name STRING, is_async BOOLEAN, start_line INT, end_line INT, "
    "parameters ARRAY<STRING>, returns STRING, decorators ARRAY<STRING>, bases ARRAY<STRING>, docstring STRING"
)
IMPORTS = "relative_path STRING, module STRING, name STRING, alias STRING, kind STRING, line INT"
CHUNKS = (
    "relative_path STRING, chunk_id STRING, chunk_type STRING, qualified_name STRING, start_line INT, end_line INT, code STRING, embedding_text STRING, content_hash STRING"
)
PROJECTS = "id BIGINT, name STRING, root_path STRING, created_at TIMESTAMP, updated_at TIMESTAMP, index_schema_version INT, vector_generation STRING"
JOBS = (
    "id STRING, state STRING, operation STRING, project_id BIGINT, counters MAP<STRING,BIGINT>, stages ARRAY<STRING>, result STRING, error STRING, "
    "previous_index_preserved BOOLEAN, created_at TIMESTAMP, started_at TIMESTAMP, updated_at TIMESTAMP, completed_at TIMESTAMP"
)
VECTORS = "chunk_id STRING, vector ARRAY<FLOAT>, project_id BIGINT, content_hash STRING, embedding_model STRING, dimensions INT"
QUESTIONS = (
    "id STRING, question STRING, expected ARRAY<STRUCT<relative_path: STRING, qualified_name: STRING, start_line: INT, end_line: INT>>, "
    "pair_id STRING, language STRING, category STRING, repository_name STRING, repository_commit STRING"
)


class IntegrityError(ValueError):
    """A table breaks a constraint of the engine."""


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_empty(rows: DataFrame, message: str) -> None:
    if first := rows.take(1):
        raise IntegrityError(f"{message}: {first[0].asDict()}")


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    assert_empty(violations(rows, keys), f"duplicate {', '.join(keys)}")
    return rows
