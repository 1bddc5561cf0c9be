"""A collection of vectors with upsert, delete, search and safe replacement, behind one protocol."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import layers, rank
from siltstone.operators.folder import Folder
from siltstone.operators.store import symmetric_difference
from siltstone.schemas import IntegrityError, assert_empty, assert_unique

RECORD = "chunk_id string, vector array<double>, project_id long, content_hash string"


class VectorIndex(Protocol):
    """What the engine needs of a vector collection; records are tables, not lists."""

    def initialize(self) -> None: ...
    def upsert(self, records: DataFrame) -> None: ...
    def delete(self, chunk_ids: DataFrame) -> None: ...
    def search(self, queries: DataFrame, limit: int) -> DataFrame: ...
    def get(self, chunk_ids: DataFrame) -> DataFrame: ...
    def get_vectors(self, chunk_ids: DataFrame) -> DataFrame: ...
    def list_ids(self, project_id: int | None = None) -> DataFrame: ...
    def get_index_metadata(self) -> dict: ...
    def set_index_metadata(self, metadata: dict) -> None: ...
    def replace_collection(self, records: DataFrame, metadata: dict, expected_ids: DataFrame) -> None: ...


COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


class ParquetVectors:
    """A collection as a layered table: a change writes a layer of its own size and switches the state file to it."""

    STATE = "collection.json"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.table = layers.Layers(spark, self.folder, "records", "chunk_id")

    def _state(self) -> dict:
        text = self.folder.read(self.STATE)
        if text is None:
            raise IntegrityError("the collection is not initialised")
        return json.loads(text)

    def _layers(self) -> list[layers.Layer]:
        return layers.from_json(self._state()["layers"])

    def _switch(self, made: list[layers.Layer], metadata: dict, expected_ids: DataFrame | None = None) -> None:
        """Check a new list of layers and make it the collection."""
        try:
            written = self.table.read(made)
            assert_unique(written, ["chunk_id"])
            if written.select(F.size("vector")).distinct().count() > 1:
                raise IntegrityError("vectors of several sizes")
            if expected_ids is not None:
                assert_empty(symmetric_difference(written.select("chunk_id"), expected_ids.select("chunk_id")), "the collection does not hold the expected ids")
            self.folder.replace(self.STATE, json.dumps({"layers": layers.to_json(made), "metadata": metadata}, sort_keys=True))
        finally:
            self.table.clean(self._layers() if self.folder.exists(self.STATE) else [])

    def _records(self) -> DataFrame:
        return self.table.read(self._layers()).select(*COLUMNS)

    def initialize(self) -> None:
        """Make an empty collection, if there is none."""
        if self.folder.read(self.STATE) is None:
            self._switch(self.table.create(self.spark.createDataFrame([], RECORD)), {})

    def upsert(self, records: DataFrame) -> None:
        """Replace records of the same id and add the others."""
        new = records.select(*COLUMNS)
        assert_unique(new, ["chunk_id"])
        self._switch(self.table.compact(self.table.change(self._layers(), new)), self._state()["metadata"])

    def delete(self, chunk_ids: DataFrame) -> None:
        self._switch(self.table.compact(self.table.change(self._layers(), gone=chunk_ids.select("chunk_id"))), self._state()["metadata"])

    def search(self, queries: DataFrame, limit: int) -> DataFrame:
        """(question_id, rank, chunk_id, score, distance) of the nearest records of each query (chunk_id, vector) by cosine."""
        found = rank.semantic(queries, self._records().select("chunk_id", "vector"), limit, exclude_self=False)
        return found.select("question_id", "rank", "chunk_id", "score", F.round(1 - F.col("score"), 9).alias("distance"))

    def get(self, chunk_ids: DataFrame) -> DataFrame:
        """Metadata of stored records, without vectors."""
        return self.get_vectors(chunk_ids).drop("vector")

    def get_vectors(self, chunk_ids: DataFrame) -> DataFrame:
        return self._records().join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def list_ids(self, project_id: int | None = None) -> DataFrame:
        rows = self._records()
        return (rows if project_id is None else rows.where(F.col("project_id") == project_id)).select("chunk_id")

    def get_index_metadata(self) -> dict:
        return self._state()["metadata"]

    def set_index_metadata(self, metadata: dict) -> None:
        """Merge: given keys replace stored ones."""
        state = self._state()
        self.folder.replace(self.STATE, json.dumps(state | {"metadata": state["metadata"] | metadata}, sort_keys=True))

    def replace_collection(self, records: DataFrame, metadata: dict, expected_ids: DataFrame) -> None:
        """Build a new collection, check that it holds the expected ids, and put it in the old one's place."""
        self._switch(self.table.create(records.select(*COLUMNS)), metadata, expected_ids)
