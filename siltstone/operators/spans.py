"""Joins of spans and points of any length, by dyadic nodes.

A node of level v is an aligned stretch of 2**v places. A span of n places belongs to the level at which a node
holds n at least, and touches two nodes there at most, so a span is two rows, however long it is. A point looks
into its node at each level that occurs among the spans: as many rows as there are levels, 63 at most. Both meet by equality
of keys, level and node; what meets lies within two node lengths, which are less than four span lengths.

Two spans overlap if the start of one lies in the other; each pair is found once, by the later start.

Defined cases: spans and points with a null in a key or bound meet nothing, nor do spans that end before
they start; bounds are whole numbers and belong to the span; equal spans meet each; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nodes(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Each span once for every node that it touches at its level."""
    sound = spans.where(F.col(start) <= F.col(end))
    size = F.col(end).cast("long") - F.col(start).cast("long")
    levelled = sound.withColumn("_level", F.when(size == 0, 0).otherwise(F.length(F.bin(size))))
    ends = [F.expr(f"shiftright(CAST(`{c}` AS BIGINT), _level)") for c in (start, end)]
    return levelled.withColumn("_node", F.explode(F.array_distinct(F.array(*ends))))


def stab(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Rows of ``points`` joined to the spans of the same keys that hold the place ``at``.

    The tables must not share other column names than the keys.
    """
    placed = _nodes(spans, start, end)
    levels = sorted(r["_level"] for r in placed.select("_level").distinct().collect())
    if not levels:
        return points.join(spans, keys).limit(0)
    looks = F.array(*[F.struct(F.lit(v).alias("l"), F.shiftright(F.col(at).cast("long"), v).alias("n")) for v in levels])
    asked = points.withColumn("_look", F.explode(looks)).withColumns({"_level": F.col("_look.l"), "_node": F.col("_look.n")}).drop("_look")
    met = asked.join(placed, [*keys, "_level", "_node"])
    return met.where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_level", "_node")


def overlaps(first: DataFrame, second: DataFrame, keys: list[str], bounds: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """All pairs of spans of two tables with the same keys that share a place; the tables share no other column names."""
    sound = first.where(F.col(bounds[0]) <= F.col(bounds[1])), second.where(F.col(other[0]) <= F.col(other[1]))
    begins = stab(sound[0], sound[1], keys, bounds[0], *other)
    holds = stab(sound[1], sound[0], keys, other[0], *bounds).where(F.col(other[0]) > F.col(bounds[0]))
    return begins.unionByName(holds)
