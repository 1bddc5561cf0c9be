"""The index store: layered tables behind one pointer, full and incremental maintenance.

The pointer names the layers of files, chunks and vectors, so one switch makes all three live and a
failure before it leaves the active generation as it was. An incremental change adds a layer to each,
which costs the change and not the index; see ``layers``.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import layers
from siltstone.operators.folder import Folder
from siltstone.schemas import IntegrityError, assert_empty, assert_unique

POINTER_KEYS = frozenset(["generation", "provider", "dimensions", "model", "endpoint_sha256", "schema_version", "layers"])
SCHEMA_VERSION = 4
#: Tables of a generation and their keys.
TABLES = {"files": "relative_path", "chunks": "chunk_id", "vectors": "chunk_id"}


def file_delta(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(relative_path, change): added, deleted, modified or unchanged by content hash."""
    a, b = stored.select("relative_path", F.col("sha256").alias("before")), current.select("relative_path", F.col("sha256").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") == F.col("after"), "unchanged").otherwise("modified")
    return a.join(b, "relative_path", "full").select("relative_path", change.alias("change"))


def retained(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of files that did not change."""
    gone = delta.where("change IN ('modified', 'deleted')").select("relative_path")
    return rows.join(gone, "relative_path", "left_anti")


def apply_delta(rows: DataFrame, fresh: DataFrame, delta: DataFrame) -> DataFrame:
    """Retained rows and the new rows of changed files."""
    return retained(rows, delta).unionByName(fresh, allowMissingColumns=True)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in exactly one side, with multiplicity."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win by key, missing ones keep the stored."""
    names = [c for c in stored.columns if c != key]
    b = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in names if c in new.columns])
    return stored.join(b, key, "full").select(key, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in names])


def deletable(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Projects without schema version, generation and files."""
    return projects.where("index_schema_version IS NULL AND vector_generation IS NULL").join(files.select(F.col("project_id").alias("id")), "id", "left_anti")


def reusable_vectors(chunks: DataFrame, vectors: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Stored vectors of retained chunks that fit in hash, model and size."""
    fits = (F.col("embedding_model") == model) & (F.col("dimensions") == dimensions) & (F.size("vector") == dimensions)
    return chunks.select("chunk_id", "content_hash").join(vectors.where(fits), ["chunk_id", "content_hash"])


class Store:
    """Generations under ``root``, in any store that Spark reaches; readers resolve the pointer before they plan."""

    POINTER = "active.json"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, str(root))
        self.tables = {name: layers.Layers(spark, self.folder, name, key) for name, key in TABLES.items()}

    def active(self) -> dict | None:
        """The pointer, validated; None before the first activation."""
        text = self.folder.read(self.POINTER)
        if text is None:
            return None
        try:
            pointer = json.loads(text)
        except ValueError as bad:
            raise IntegrityError("the pointer is damaged") from bad
        if not isinstance(pointer, dict) or set(pointer) != POINTER_KEYS or not re.fullmatch("[0-9a-f]{32}", str(pointer["generation"])):
            raise IntegrityError("the pointer is damaged")
        if pointer["schema_version"] != SCHEMA_VERSION or any(not self.folder.exists(f"{t}/{x['name']}") for t in TABLES for x in pointer["layers"][t]):
            raise IntegrityError("the pointer names no readable generation")
        return pointer

    def _layers(self, pointer: dict, table: str) -> list[layers.Layer]:
        return layers.from_json(pointer["layers"][table])

    def read(self, table: str) -> DataFrame:
        pointer = self.active()
        if pointer is None:
            raise IntegrityError("nothing is indexed yet")
        return self.tables[table].read(self._layers(pointer, table))

    def stage(self, files: DataFrame, chunks: DataFrame, vectors: DataFrame, identity: dict) -> dict:
        """Write a whole new generation and verify it; nothing is live yet. ``identity`` is that of the embedding provider."""
        return self._staged(identity, lambda: {t: self.tables[t].create(rows) for t, rows in (("files", files), ("chunks", chunks), ("vectors", vectors))})

    def stage_change(self, delta: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, identity: dict) -> dict:
        """Write what differs from the active generation as layers over it and verify the result; nothing is live yet.

        ``delta`` is that of ``file_delta``; ``files``, ``chunks`` and ``vectors`` are those of its added and modified files.
        """
        pointer = self.active()
        gone = delta.where("change IN ('modified', 'deleted')").select("relative_path")
        lost = self.read("chunks").join(gone, "relative_path", "left_semi").select("chunk_id")
        changes = {"files": (files, gone), "chunks": (chunks, gone), "vectors": (vectors, lost)}
        return self._staged(identity, lambda: {t: self.tables[t].compact(self.tables[t].change(self._layers(pointer, t), *change)) for t, change in changes.items()})

    def _staged(self, identity: dict, write) -> dict:
        staged: dict = {"generation": uuid.uuid4().hex, **identity, "schema_version": SCHEMA_VERSION}
        try:
            staged["layers"] = {t: layers.to_json(found) for t, found in write().items()}
            self.verify(staged, identity["dimensions"])
        except BaseException:
            self.clean()
            raise
        return staged

    def verify(self, staged: dict, dimensions: int) -> None:
        """Unique keys, equal id sets of chunks and vectors, and one vector size."""
        chunks, vectors = (self.tables[t].read(self._layers(staged, t)) for t in ("chunks", "vectors"))
        assert_unique(chunks, ["chunk_id"])
        assert_unique(vectors, ["chunk_id"])
        assert_empty(symmetric_difference(chunks.select("chunk_id"), vectors.select("chunk_id")), "chunks and vectors differ")
        assert_empty(vectors.where(F.size("vector") != dimensions).select("chunk_id"), "wrong vector size")

    def activate(self, staged: dict, expected: str | None) -> None:
        """Switch the pointer if the active generation is still the expected one."""
        now = self.active()
        if (now["generation"] if now else None) != expected:
            raise IntegrityError("another generation went live meanwhile")
        self.folder.replace(self.POINTER, json.dumps(staged, sort_keys=True))

    def discard(self, staged: dict) -> None:
        """Remove a staged generation that is not live."""
        now = self.active()
        if now is None or now["generation"] != staged["generation"]:
            self.clean()

    def clean(self) -> list[str]:
        """Remove layers that the pointer does not name."""
        now = self.active()
        return [f"{t}/{name}" for t, table in self.tables.items() for name in table.clean(self._layers(now, t) if now else [])]
