"""What operators need to know about the session they run in."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at a time, and Spark's own limit.
BATCH_BYTES = 4 << 20
_KEY, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python workers in batches of BATCH_BYTES, unless the session has a limit of its own.

    Spark's limit of 64 MB is taken up several times over by every task, in Java and in Python; with
    long texts 10,000 rows reach it.
    """
    if spark.conf.get(_KEY, _DEFAULT) in (_DEFAULT, "64m", "64MB", "67108864"):
        spark.conf.set(_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path under the folder that all executors share (``spark.checkpoint.dir``).

    Where the session names no folder, a temporary one is set on a local master; on a cluster that
    would be a folder of one machine, so it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Names of plan nodes that pass on the rows of files, at most fewer or other columns of them, and of what reads files.
_NARROW, _FILES = {"Project", "Filter", "SubqueryAlias", "View", "ResolvedHint"}, {"LogicalRelation", "DataSourceV2ScanRelation"}


def _nodes(plan) -> Iterator:
    """A logical plan's nodes."""
    yield plan
    children = plan.children()
    for k in range(children.length()):
        yield from _nodes(children.apply(k))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate, without a job; None where it is a guess (anything but filtered file scans)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if not {_kind(n) for n in _nodes(plan)} <= _NARROW | _FILES:
        return None
    return int(str(plan.stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads, however it goes on; no job."""
    return sum(int(str(n.stats().sizeInBytes())) for n in _nodes(df._jdf.queryExecution().optimizedPlan()) if _kind(n) in _FILES)


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of files, dealt over all cores where a small input has fewer partitions than that.

    Other plans stay as they are: their number of partitions is only known once their shuffles have run.
    """
    if estimated_bytes(rows) is None:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def partitions_for(df: DataFrame, target: int = 16 << 20) -> int:
    """Shuffle partitions so that each gets about ``target`` bytes of the files read, never fewer than the session's."""
    return max(session_partitions(df.sparkSession), math.ceil(input_bytes(df) / target))


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sound_unions(spark: SparkSession) -> None:
    """Keep aggregates above unions correct.

    Spark 4.1 takes a union of equally partitioned inputs as partitioned itself and leaves out the
    exchange of a following aggregate; with reused exchanges under adaptive execution groups then come
    out in several pieces (75 groups as 100 rows in our tests). This internal setting turns that off.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def running(rows: DataFrame, order: list, sums: dict[str, str], place: str | None = None) -> DataFrame:
    """``rows`` with running sums of columns (new name: column) in a total order of columns, and the 1-based place if it is named.

    The rows are dealt into ranges of the order, staged, summed inside each range, and moved on by the
    sums of the ranges before, of which the driver sees one row each.
    """
    spark, part = rows.sparkSession, "_range"
    while part in rows.columns:
        part += "_"
    ranged = stage_table(rows.repartitionByRange(session_partitions(spark), *order).withColumn(part, F.spark_partition_id()), "running")
    each = ranged.groupBy(part).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{new}") for new, c in sums.items()]).orderBy(part).collect()
    table, before = [], [0] * (1 + len(sums))
    for r in each:
        table.append((r[0], *before))
        before = [b + (v or 0) for b, v in zip(before, r[1:], strict=True)]
    names = ["_before", *[f"_before_{new}" for new in sums]]
    starts = spark.createDataFrame(table, f"{part} int, _before long" + "".join(f", {c} {rows.select(F.sum(x)).dtypes[0][1]}" for c, x in zip(names[1:], sums.values(), strict=True)))
    inside = Window.partitionBy(part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {new: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_before_{new}") for new, c in sums.items()}
    if place is not None:
        added[place] = F.row_number().over(inside) + F.col("_before")
    return ranged.join(F.broadcast(starts), part).withColumns(added).drop(part, *names)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their 1-based place in a total order of columns, without bringing them into one task."""
    return running(rows, order, {}, name)
