"""Tables that change at the cost of the change: layers of Parquet, read together.

A table is a list of layers, the newest last. A change writes one layer: the new rows, and for the rows
that they replace or that go, one bit each, in bitmaps by file and block of 32,768 rows of the layers below.
Nothing else is written, so bytes follow the change and not the table. A reader scans all layers once
and leaves out the rows whose bit is set; the bitmaps are few bytes a changed file and are broadcast
only under a checked size. Sizes of layers are kept in a steep order: when the newest ones have grown
to FAN layers that are not far apart in size, they are merged into one, without their dead rows, so a row is
written again as often as the logarithm of the table's size, and readers meet a logarithm of layers.

A list of layers is plain data; whoever keeps it (a pointer file) makes a change live by replacing it.
A layer is never changed once written, so a failure leaves only folders that no list names.

Defined cases: rows with a null key neither replace nor are replaced; a key that comes twice in one
change is an error of the caller, which ``schemas.assert_unique`` finds; a change without rows may still
delete; an empty list has no schema and cannot be read.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.folder import Folder
from siltstone.operators.rank import BROADCAST_BYTES

#: Layers of like size that are merged, and how many times smaller the newer ones together may be to count as alike.
FAN, RATIO = 4, 4
GONE = "file string, bucket long, bits binary"
#: Columns that the reader adds and takes away again.
_FILE, _BUCKET, _BIT = "_layer_file", "_layer_bucket", "_layer_bit"


@dataclass(frozen=True)
class Layer:
    name: str
    rows: int
    bytes: int
    gone_bytes: int


class Layers:
    """Layers of one table under ``folder``/``table``; every method takes and gives lists of layers."""

    def __init__(self, spark: SparkSession, folder: Folder, table: str, key: str):
        self.spark, self.folder, self.table, self.key = spark, folder, table, key

    def _path(self, layer: Layer | str, part: str) -> str:
        name = layer if isinstance(layer, str) else layer.name
        return f"{self.table}/{name}/{part}"

    def _scan(self, layers: list[Layer]) -> DataFrame:
        """All rows of the layers with the file (layer and name), block and bit of each."""
        rows = self.spark.read.parquet(*[self.folder.join(self._path(x, "rows")) for x in layers])
        place = F.col("_metadata.row_index") + 1
        file = F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -3), F.col("_metadata.file_name"))
        return rows.withColumns({_FILE: file, _BUCKET: F.bitmap_bucket_number(place), _BIT: F.bitmap_bit_position(place)})

    def _gone(self, layers: list[Layer]) -> DataFrame | None:
        """The bitmaps of rows that are no longer alive."""
        paths = [self.folder.join(self._path(x, "gone")) for x in layers if x.gone_bytes]
        if not paths:
            return None
        return self.spark.read.schema(GONE).parquet(*paths).groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    @staticmethod
    def _is_set(bits: Column, bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (bit % 8).cast("int")) == 1

    def _alive(self, layers: list[Layer]) -> DataFrame:
        scanned, gone = self._scan(layers), self._gone(layers)
        if gone is None:
            return scanned
        if sum(x.gone_bytes for x in layers) * 64 <= BROADCAST_BYTES:  # compressed; a bitmap unpacks to 4 KB at most
            gone = F.broadcast(gone)
        marked = scanned.join(gone, (F.col(_FILE) == F.col("file")) & (F.col(_BUCKET) == F.col("bucket")), "left")
        return marked.where(F.col("bits").isNull() | ~self._is_set(F.col("bits"), F.col(_BIT))).drop("file", "bucket", "bits")

    def read(self, layers: list[Layer]) -> DataFrame:
        """The rows that are alive."""
        return self._alive(layers).drop(_FILE, _BUCKET, _BIT)

    def _size(self, name: str) -> int:
        return self.folder.size(name) if self.folder.exists(name) else 0

    def _written(self, name: str, rows: DataFrame, gone: DataFrame | None) -> Layer:
        rows.write.option("compression", "zstd").parquet(self.folder.join(self._path(name, "rows")))
        gone_bytes = 0
        if gone is not None:
            gone.write.option("compression", "zstd").parquet(self.folder.join(self._path(name, "gone")))
            if self.spark.read.schema(GONE).parquet(self.folder.join(self._path(name, "gone"))).take(1):
                gone_bytes = self._size(self._path(name, "gone"))
        written = self.spark.read.parquet(self.folder.join(self._path(name, "rows")))
        return Layer(name, written.count(), self._size(self._path(name, "rows")), gone_bytes)

    def create(self, rows: DataFrame) -> list[Layer]:
        """A table of one layer."""
        return [self._written(uuid.uuid4().hex, rows, None)]

    def change(self, layers: list[Layer], rows: DataFrame | None = None, gone: DataFrame | None = None) -> list[Layer]:
        """Put ``rows`` in, in place of those with the same key, and take out the rows whose columns are in ``gone``.

        ``gone`` may have any columns of the table; a row goes where all of them are equal. Of the layers
        below only the columns compared are read, and nothing of them is written.
        """
        if not layers:
            raise ValueError("a table begins with create")
        scanned = self._scan(layers)
        rows = self.spark.createDataFrame([], self.read(layers).schema) if rows is None else rows.select(*[c for c in scanned.columns if c not in (_FILE, _BUCKET, _BIT)])
        marks = [scanned.join(rows.select(self.key).distinct(), self.key, "left_semi").select(_FILE, _BUCKET, _BIT)]
        if gone is not None:
            marks.append(scanned.join(gone.distinct(), gone.columns, "left_semi").select(_FILE, _BUCKET, _BIT))
        every = marks[0] if len(marks) == 1 else marks[0].unionAll(marks[1])
        bits = every.groupBy(F.col(_FILE).alias("file"), F.col(_BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(_BIT).alias("bits"))
        return [*layers, self._written(uuid.uuid4().hex, rows, bits)]

    def due(self, layers: list[Layer]) -> int:
        """How many of the newest layers should be merged; 0 if none.

        From the newest on, a layer belongs to them while it is at most RATIO times as large as all newer ones together.
        """
        total, n = 0, 0
        for layer in reversed(layers):
            if n and layer.bytes > RATIO * max(1, total):
                break
            total, n = total + layer.bytes, n + 1
        return n if n >= FAN else 0

    def compact(self, layers: list[Layer], newest: int | None = None) -> list[Layer]:
        """Merge the ``newest`` layers (those that are due) into one without dead rows."""
        n = self.due(layers) if newest is None else newest
        if n < 2:
            return layers
        below, merged = layers[:-n], layers[-n:]
        rows = self.read(merged)
        inside = [x.name for x in merged]
        gone = self._gone(merged)
        if gone is not None:
            gone = gone.where(~F.substring_index("file", "/", 1).isin(inside)) if below else None
        size = sum(x.bytes for x in merged)
        rows = rows.coalesce(max(1, math.ceil(size / (128 << 20)))) if size <= 1 << 30 else rows.repartition(math.ceil(size / (128 << 20)))
        return [*below, self._written(uuid.uuid4().hex, rows, gone)]

    def clean(self, layers: list[Layer]) -> list[str]:
        """Remove the folders of layers that the list does not name."""
        keep = {x.name for x in layers}
        lost = [name for name in self.folder.children(self.table) if name not in keep]
        for name in lost:
            self.folder.delete(f"{self.table}/{name}")
        return lost


def to_json(layers: list[Layer]) -> list[dict]:
    return [asdict(x) for x in layers]


def from_json(layers: list[dict]) -> list[Layer]:
    return [Layer(**x) for x in layers]
