"""Typed file sources and sinks: JSON questions, JSON lines, CSV, event logs, manifests and write-once output."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.schemas import QUESTIONS, assert_empty, assert_unique

SECRET_KEY = re.compile(r"(?i)api[_-]?key|secret|password|authorization|token$")
EVENTS = (
    "type STRING, sessionID STRING, part STRUCT<text: STRING, tool: STRING, reason: STRING, tokens: STRUCT<total: BIGINT, input: BIGINT, output: BIGINT, "
    "reasoning: BIGINT, cache: STRUCT<read: BIGINT, write: BIGINT>>>, _corrupt_record STRING"
)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of benchmark questions, validated."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    assert_unique(rows, ["id"])
    bad_range = F.exists("expected", lambda e: (e["start_line"] < 1) | (e["end_line"] < e["start_line"]))
    bad = (F.trim(F.coalesce("question", F.lit(""))) == "") | (F.size("expected") < 1) | ~F.coalesce(F.col("language").isin("fa", "en"), F.lit(True)) | F.coalesce(bad_range, F.lit(False))
    assert_empty(rows.where(bad), "invalid question")
    return rows


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object per line; blank lines are skipped, anything else that is no object fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def agent_events(spark: SparkSession, path: str) -> DataFrame:
    """Event log of an agent; lines that are no JSON are left out."""
    return spark.read.schema(EVENTS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).where("type IS NOT NULL").drop("_corrupt_record")


def agent_usage(events: DataFrame) -> DataFrame:
    """Steps, tool calls and token sums of each session."""
    t = F.col("part.tokens")
    return events.groupBy("sessionID").agg(
        F.count_if(F.col("type") == "step_finish").alias("steps"), F.count_if(F.col("type") == "tool_use").alias("tool_calls"),
        *[F.sum(F.when(F.col("type") == "step_finish", t[k])).alias(k) for k in ("input", "output", "reasoning")],
        F.sum(F.when(F.col("type") == "step_finish", t["cache"]["read"])).alias("cache_read"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.col("part.text")))), lambda x: x), "\n").alias("texts"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def directory_digest(files: DataFrame) -> DataFrame:
    """One row with the SHA-256 over the sorted path and hash lines."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "sha256", "path")))
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), F.count("*").alias("files"))


def frozen_violations(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Frozen (path, sha256) that are missing or differ."""
    now = files.select("path", F.col("sha256").alias("found"))
    return expected.join(now, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found")))


def check_portable(payload, where: str = "$") -> None:
    """Reject secrets, absolute paths and home folders anywhere in a JSON payload."""
    if isinstance(payload, dict):
        for key, value in payload.items():
            if SECRET_KEY.search(str(key)):
                raise ValueError(f"secret key at {where}.{key}")
            check_portable(value, f"{where}.{key}")
    elif isinstance(payload, list):
        for k, value in enumerate(payload):
            check_portable(value, f"{where}[{k}]")
    elif isinstance(payload, str) and re.match(r"^(?:/(?:home|Users|root|tmp)/|[A-Za-z]:\\)", payload):
        raise ValueError(f"absolute path at {where}")


def write_json(payload, path: str, once: bool = False) -> None:
    """A small result as pretty JSON, replaced in one step; ``once`` refuses to overwrite."""
    check_portable(payload)
    target = Path(path)
    if once and target.exists() and target.stat().st_size:
        raise FileExistsError(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    partial = target.with_name(target.name + ".partial")
    with partial.open("w", encoding="utf-8") as f:
        f.write(json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(partial, target)
