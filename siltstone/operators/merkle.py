"""Digests of snapshots that can be compared and updated: a tree over the hashes of paths.

A path belongs to the bucket of the first ``depth`` hexadecimal digits of its SHA-256, which spreads any paths
evenly. A bucket's digest is the SHA-256 of its lines (path, space, content hash) in the order of the paths, a node's
that of its children's digests in order, sixteen at most. Nodes are a table (level, prefix, digest, n) with
a partition for each level, in the order of their prefixes.

Two snapshots are compared from the root down: of each level only the children of differing nodes are
asked for, so k changes read about 16 k nodes a level, and the files of differing buckets alone are compared. A
change makes the buckets that it touches and the nodes above them anew. The depth grows with the number of
files, so that a bucket holds about BUCKET of them.

Defined cases: null paths are left out; a null hash counts as no content; a path should come once; an empty
snapshot has one node, the root, with the digest of no text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import stage_table

#: Files of a bucket, about, and prefixes that are pushed to the scan as a list.
BUCKET, PUSHED = 64, 4096


def depth_for(files: int) -> int:
    return max(0, math.ceil(math.log(max(1, files / BUCKET), 16)))


def placed(files: DataFrame, depth: int) -> DataFrame:
    """(path, sha256, prefix) of files with a path."""
    return files.where(F.col("path").isNotNull()).select("path", F.coalesce("sha256", F.lit("")).alias("sha256"), F.left(F.sha2("path", 256), F.lit(depth)).alias("prefix"))


def _joined(order: str, line: Column, separator: str) -> Column:
    """Digest of a bounded group's lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return F.sha2(F.array_join(F.transform(lines, lambda x: x["l"]), separator), 256)


def _buckets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prefix").agg(_joined("path", F.concat_ws(" ", "path", "sha256"), "\n").alias("digest"), F.count("*").alias("n"))


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of ``level`` from those below."""
    up = nodes.select(F.left("prefix", F.lit(level)).alias("up"), "prefix", "digest", "n")
    made = up.groupBy("up").agg(_joined("prefix", F.col("digest"), "").alias("digest"), F.sum("n").alias("n"))
    return made.select(F.col("up").alias("prefix"), "digest", "n")


def tree(files: DataFrame, depth: int | None = None) -> DataFrame:
    """(level, prefix, digest, n) of all nodes of a snapshot (path, sha256); level 0 is the root."""
    depth = depth_for(files.count()) if depth is None else depth
    level = _buckets(placed(files, depth))
    every = level.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        level = _above(level, k)
        every = every.unionByName(level.withColumn("level", F.lit(k)))
    root = files.sparkSession.createDataFrame([("", "", 0, 0)], "prefix string, digest string, n long, level int").withColumn("digest", F.sha2("digest", 256))
    return every.unionByName(root.join(every.where("level = 0").select("level").distinct(), "level", "left_anti")).select("level", "prefix", "digest", "n")


def write(nodes: DataFrame, folder: str) -> None:
    nodes.repartitionByRange("level", "prefix").sortWithinPartitions("level", "prefix").write.partitionBy("level").parquet(folder)


def _within(rows: DataFrame, digits: int, prefixes: DataFrame, n: int) -> DataFrame:
    """Rows whose first digits are among the prefixes: few go to the scan as a list, more are joined."""
    start = F.left("prefix", F.lit(digits))
    if n <= PUSHED:
        return rows.where(start.isin([r["prefix"] for r in prefixes.collect()]))
    return rows.withColumn("_start", start).join(prefixes.select(F.col("prefix").alias("_start")), "_start", "left_semi").drop("_start")


def differing(first: DataFrame, second: DataFrame, depth: int) -> tuple[DataFrame, int, int]:
    """(prefix) of the differing buckets of two trees of one depth, their number, and how many nodes were read to find them."""
    prefixes, n, seen = first.sparkSession.createDataFrame([("",)], "prefix string"), 1, 0
    for level in range(depth + 1):
        nodes = [_within(t.where(F.col("level") == level), max(0, level - 1), prefixes, n).select("prefix", F.col("digest").alias(f"d{k}")) for k, t in enumerate((first, second))]
        read = stage_table(nodes[0].join(nodes[1], "prefix", "full"), "level")
        seen += read.count()
        prefixes = read.where(~F.col("d0").eqNullSafe(F.col("d1"))).select("prefix")
        n = prefixes.count()
        if not n:
            break
    return prefixes, n, seen


def changes(first: DataFrame, second: DataFrame, trees: tuple[DataFrame, DataFrame], depth: int) -> DataFrame:
    """(path, change): added, deleted or modified, from the files (path, sha256) of the differing buckets alone."""
    prefixes, n, _ = differing(*trees, depth)
    sides = [_within(placed(f, depth), depth, prefixes, n).select("path", F.col("sha256").alias(f"h{k}")) for k, f in enumerate((first, second))]
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").otherwise("modified")
    return sides[0].join(sides[1], "path", "full").where(~F.col("h0").eqNullSafe(F.col("h1"))).select("path", change.alias("change"))


def updated(nodes: DataFrame, files: DataFrame, touched: DataFrame, depth: int) -> DataFrame:
    """The tree after a change: ``files`` is the new snapshot, ``touched`` the paths that changed or went.

    Buckets of touched paths are made anew, and of the levels above only the nodes on the way to the root.
    """
    marks = stage_table(placed(touched.select("path", F.lit(None).cast("string").alias("sha256")), depth).select("prefix").distinct(), "touched")
    fresh = stage_table(_buckets(placed(files, depth).join(marks, "prefix", "left_semi")), "fresh")
    level, kept = fresh, nodes.where(F.col("level") == depth).join(marks, "prefix", "left_anti").select("prefix", "digest", "n")
    made = fresh.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        ways = marks.select(F.left("prefix", F.lit(k)).alias("way")).distinct()
        below = kept.withColumn("way", F.left("prefix", F.lit(k))).join(ways, "way", "left_semi").select("prefix", "digest", "n").unionByName(level)
        level = stage_table(_above(below, k), "above")
        made = made.unionByName(level.withColumn("level", F.lit(k)))
        kept = nodes.where(F.col("level") == k).join(ways.withColumnRenamed("way", "prefix"), "prefix", "left_anti").select("prefix", "digest", "n")
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    gone = marks.withColumn("level", levels).select("level", F.left("prefix", F.col("level")).alias("prefix")).distinct()
    return nodes.join(gone, ["level", "prefix"], "left_anti").select("level", "prefix", "digest", "n").unionByName(made.select("level", "prefix", "digest", "n"))
