"""Paths against the files that end in them, by reversed names in order.

The files that end in "/path" are those whose reversed names begin with the reversed path and "/": one stretch of
the sorted reversed names. Files and the two bounds of every path are sorted together by ranges, and a
running count of files gives how many lie between the bounds and, where it is one, which. No file name is a join
key and no pair is made, so 100,000 files of one name cost what any other 100,000 cost.

Defined cases: null paths and files meet nothing; repeated ones count once; the empty path has no ending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import running, stage_table


def endings(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, n, file): how many files end in "/path", and which where it is one; paths without any are missing."""
    known = files.where(F.col("file").isNotNull()).select("file").distinct()
    asked = paths.where(F.col("path").isNotNull() & (F.col("path") != "")).select("path").distinct()
    name = F.reverse("path")
    # "0" follows "/", so the names that begin with name + "/" lie from there to name + "0".
    bounds = asked.select("path", F.explode(F.array(F.struct(F.concat(name, F.lit("/")).alias("key"), F.lit(0).alias("high")), F.struct(F.concat(name, F.lit("0")).alias("key"), F.lit(1).alias("high")))).alias("b"))
    none = F.lit(None).cast("string")
    rows = bounds.select(F.col("b.key").alias("key"), F.lit(0).alias("is_file"), F.col("b.high").alias("high"), "path", none.alias("file"))
    rows = rows.unionByName(known.select(F.reverse("file").alias("key"), F.lit(1).alias("is_file"), F.lit(None).cast("int").alias("high"), none.alias("path"), "file"))
    counted = stage_table(running(rows, ["key", "is_file", "path", "high"], {"upto": "is_file"}), "counted")
    met = counted.where("is_file = 0").groupBy("path").agg(F.max(F.when(F.col("high") == 0, F.col("upto"))).alias("low"), F.max(F.when(F.col("high") == 1, F.col("upto"))).alias("top"))
    found = met.where("top > low").select("path", (F.col("top") - F.col("low")).alias("n"), F.when(F.col("top") - F.col("low") == 1, F.col("top")).alias("upto"))
    return found.join(counted.where("is_file = 1").select("upto", "file"), "upto", "left").select("path", "n", "file")


def resolve(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file, tier) of the paths that mean one file: 1 the same, 2 the same below src/, 3 the only one with that ending."""
    known = files.where(F.col("file").isNotNull()).select("file").distinct()
    asked = paths.where(F.col("path").isNotNull()).select("path").distinct()
    tiers = asked.join(known.select(F.col("file").alias("path"), F.col("file").alias("same")), "path", "left")
    tiers = tiers.withColumn("_below", F.concat(F.lit("src/"), "path")).join(known.select(F.col("file").alias("_below"), F.col("file").alias("below")), "_below", "left").drop("_below")
    tiers = tiers.join(endings(asked, known), "path", "left")
    tier = F.when(F.col("same").isNotNull(), 1).when(F.col("below").isNotNull(), 2).when(F.col("n") == 1, 3)
    return tiers.select("path", F.coalesce("same", "below", "file").alias("file"), tier.alias("tier")).where("tier IS NOT NULL")
