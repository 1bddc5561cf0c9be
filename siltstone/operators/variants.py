"""Context variants over one stored ranking, with paired intervals.

All variants read the same ranking; a variant is a row of a small table that each ranked row meets once, so
the ranking is neither searched nor read again for each of them. A variant cuts the list at a depth,
keeps so many blocks a file, and packs what is left under a budget, skipping what does not fit. What a
question's packed blocks cover of its gold files is compared with a control variant; the bootstrap draws
questions by counts that all variants share, so differences are paired.

Defined cases: questions without ranked rows pack nothing; questions without gold files have no coverage
and are left out of the intervals; files that are null hold no gold, and count as one file each.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import context, resample
from siltstone.runtime import stage_table


@dataclass(frozen=True)
class Variant:
    name: str
    depth: int
    per_file: int
    budget: int


#: The variants of a gate: depth, blocks a file (0: any number) and characters.
GATE = (
    Variant("control", 10, 0, 6000), Variant("wide", 10, 0, 12000), Variant("deep", 20, 0, 6000), Variant("deep_wide", 20, 0, 12000),
    Variant("deepest", 50, 0, 12000), Variant("one_a_file", 20, 1, 12000), Variant("two_a_file", 20, 2, 12000), Variant("spread", 50, 1, 6000),
)


def packed(ranking: DataFrame, variants: tuple[Variant, ...] = GATE) -> DataFrame:
    """(question_id, variant, total_chars, omitted, chunk_ids) of a ranking (question_id, rank, chunk_id, file, chars)."""
    spark = ranking.sparkSession
    table = F.broadcast(spark.createDataFrame([astuple(v) for v in variants], "variant string, depth int, per_file int, budget long"))
    met = ranking.join(table, F.col("rank") <= F.col("depth"))
    same = F.coalesce("file", F.concat(F.lit("\0"), F.col("chunk_id").cast("string")))
    turn = F.row_number().over(Window.partitionBy("question_id", "variant", same).orderBy("rank"))
    kept = met.withColumn("_turn", turn).where((F.col("per_file") == 0) | (F.col("_turn") <= F.col("per_file")))
    units = kept.select(F.struct("question_id", "variant").alias("unit"), "rank", "chunk_id", "chars", "budget")
    return context.pack(units, "unit", F.col("budget")).select("unit.*", "total_chars", "omitted", "chunk_ids")


def coverage(ranking: DataFrame, gold: DataFrame, variants: tuple[Variant, ...] = GATE) -> DataFrame:
    """(question_id, variant, gold, found, coverage, blocks, total_chars) of every question (question_id, file) with gold and every variant."""
    spark = ranking.sparkSession
    made = packed(ranking, variants)
    files = made.select("question_id", "variant", F.explode("chunk_ids").alias("chunk_id")).join(ranking.select("question_id", "chunk_id", "file"), ["question_id", "chunk_id"])
    wanted = gold.where(F.col("file").isNotNull()).select("question_id", "file").distinct()
    found = files.join(wanted, ["question_id", "file"]).groupBy("question_id", "variant").agg(F.count_distinct("file").alias("found"))
    names = F.broadcast(spark.createDataFrame([(v.name,) for v in variants], "variant string"))
    units = wanted.groupBy("question_id").agg(F.count("*").alias("gold")).crossJoin(names)  # eight names
    joined = units.join(found, ["question_id", "variant"], "left").join(made, ["question_id", "variant"], "left")
    hit = F.coalesce("found", F.lit(0).cast("long"))
    return joined.select("question_id", "variant", "gold", hit.alias("found"), (hit / F.col("gold")).alias("coverage"), F.coalesce(F.size("chunk_ids"), F.lit(0)).alias("blocks"), F.coalesce("total_chars", F.lit(0).cast("long")).alias("total_chars"))


def summary(units: DataFrame) -> DataFrame:
    """(variant, questions, mean_coverage, complete, mean_blocks, mean_chars)."""
    return units.groupBy("variant").agg(
        F.count("*").alias("questions"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.count_if(F.col("found") == F.col("gold")).alias("complete"),
        F.round(F.avg("blocks"), 6).alias("mean_blocks"), F.round(F.avg("total_chars"), 6).alias("mean_chars"),
    )


def differences(units: DataFrame, control: str, variants: tuple[Variant, ...] = GATE, resamples: int = 20000, seed: int = 20260930) -> DataFrame:
    """(variant, difference, ci_low, ci_high, better): mean coverage minus the control's, with a paired interval."""
    others = [v.name for v in variants if v.name != control]
    wide = stage_table(units.groupBy("question_id").pivot("variant", [v.name for v in variants]).agg(F.first("coverage")), "wide")
    apart = wide.select("question_id", *[(F.col(n) - F.col(control)).alias(n) for n in others])
    bounds = resample.intervals(resample.means(apart, others, ["question_id"], [], resamples, seed), others, resamples)
    means = apart.agg(*[F.round(F.avg(n), 6).alias(n) for n in others])
    both = means.crossJoin(bounds)  # single rows
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("difference"), F.col(f"{n}_low").alias("ci_low"), F.col(f"{n}_high").alias("ci_high")) for n in others]))
    return both.select(rows.alias("r")).select("r.*", (F.col("r.ci_low") > 0).alias("better"))
