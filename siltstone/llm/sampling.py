"""Bounded, reproducible samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import session_partitions

SPACE = 1 << 30


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def per_class(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each class (all, where a class has fewer), chosen by a hash of the key.

    Class sizes are counted over all rows and joined to them, however many classes there are; the
    cut is then a filter, so nothing is sorted or shuffled but one count per class. Repeated keys
    are chosen or left together.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    share = F.when(F.col("_n") <= most, F.lit(SPACE)).otherwise(F.floor(F.lit(SPACE * most) / F.col("_n")))
    return rows.join(F.broadcast(counts), label).where(F.pmod(F.xxhash64(F.col(key)), F.lit(SPACE)) < share).select(*rows.columns)


def first_of_each(batch: pa.RecordBatch, key: str, seen: set) -> pa.RecordBatch:
    """The rows of ``batch`` with a key that is not in ``seen``, one of each; puts the keys there."""
    keep = []
    for k in batch.column(key).to_pylist():
        keep.append(k not in seen)
        seen.add(k)
    return batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))


def once(sample: DataFrame, key: str) -> DataFrame:
    """One row of each key of a bounded sample, whose tasks have left out their own repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            yield first_of_each(batch, key, seen)

    return sample.repartition(session_partitions(sample.sparkSession), key).mapInArrow(run, sample.schema)
