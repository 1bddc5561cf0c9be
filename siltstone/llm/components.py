"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import sound_unions, stage_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "parent"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, parent) for every node of the links (a, b) but the smallest of each component, which is the parent.

    Every step hangs neighbours onto the smallest node near them, so the number of steps grows
    with the logarithm of the longest path; each is written to the shared folder, and no step
    brings more of the table to the driver than its size and checksum. What a step joins to the
    links is staged too: both sides are then plain tables, and the links of a node with very many
    can be dealt out over several tasks.
    """
    sound_unions(links.sparkSession)
    edges = stage_table(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        around = edges.select(F.col("node").alias("u"), F.col("parent").alias("v")).unionAll(edges.select(F.col("parent").alias("u"), F.col("node").alias("v")))
        least = stage_table(around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
        large = stage_table(around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = stage_table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("node"), F.col("m").alias("parent")).unionAll(least.select(F.col("u").alias("node"), F.col("m").alias("parent")))
        edges = stage_table(small.distinct(), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges
