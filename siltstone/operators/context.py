"""Context building: focus on named symbols, greedy packing under a character budget, prompt blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 6000
HUB = 2400


def dedupe_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_turn = 1").drop("_turn")


def pack(blocks: DataFrame, group: str, budget: Column | int = BUDGET) -> DataFrame:
    """(group, total_chars, packed ids in order, omitted): take each block, by rank, if it still fits, else skip it.

    ``blocks``: (group, rank, chunk_id, chars). Skipping goes on to later, smaller blocks, so this is a
    fold and not a running sum; only ranks, lengths and ids are gathered, not the texts.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "chars"))).alias("blocks")
    limit = F.lit(budget) if isinstance(budget, int) else budget
    gathered = blocks.groupBy(group).agg(ordered, F.max(limit).cast("long").alias("budget"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("omitted"), F.array().cast("array<bigint>").alias("ids"))

    def step(s: Column, b: Column) -> Column:
        fits = s["used"] + b["chars"] <= F.col("budget")
        return F.struct(
            F.when(fits, s["used"] + b["chars"]).otherwise(s["used"]).alias("used"), F.when(fits, s["omitted"]).otherwise(s["omitted"] + 1).alias("omitted"),
            F.when(fits, F.concat(s["ids"], F.array(b["chunk_id"].cast("bigint")))).otherwise(s["ids"]).alias("ids"),
        )

    packed = gathered.select(group, F.aggregate("blocks", start, step).alias("p"))
    return packed.select(group, F.col("p.used").alias("total_chars"), F.col("p.ids").alias("chunk_ids"), F.col("p.omitted").alias("omitted"))


def quota_pack(blocks: DataFrame, group: str, cap: int, budget: int = BUDGET) -> DataFrame:
    """(group, rank, chunk_id, taken): each block cut to its cap and to what is left of the budget, empty ones dropped."""
    w = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    capped = blocks.withColumn("capped", F.least(F.col("chars"), F.lit(cap)))
    left = F.lit(budget) - F.coalesce(F.sum("capped").over(w), F.lit(0))
    return capped.withColumn("taken", F.greatest(F.least(F.col("capped"), left), F.lit(0))).where("taken > 0").select(group, "rank", "chunk_id", "taken")


def soft_focus(ranking: DataFrame, matched: Column) -> DataFrame:
    """Matched rows first, then the others, each in rank order."""
    return ranking.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(matched), F.asc("rank"))))


def soft_focus_rescue(ranking: DataFrame, matched: Column, file: str, extras: int) -> DataFrame:
    """Matched rows, and up to ``extras`` others, the first of each file in rank order."""
    marked = ranking.withColumn("matched", matched)
    first = marked.where("NOT matched").withColumn("_f", F.row_number().over(Window.partitionBy("question_id", file).orderBy("rank"))).where("_f = 1").drop("_f")
    rest = first.withColumn("_k", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("_k") <= extras).drop("_k")
    return marked.where("matched").unionByName(rest)


def best_tier(rows: DataFrame, group: str | list[str], tier: Column) -> DataFrame:
    """Rows of the greatest tier of their group."""
    marked = rows.withColumn("tier", tier)
    return marked.withColumn("_m", F.max("tier").over(Window.partitionBy(group))).where("tier = _m").drop("_m")


def prompt_blocks(blocks: DataFrame, group: str, text: str) -> DataFrame:
    """(group, prompt): blocks as [S1] ... [Sn], by rank, a blank line between."""
    numbered = blocks.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("rank")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t")))), lambda b: F.concat(F.lit("[S"), b["_n"].cast("string"), F.lit("]\n"), b["t"]))
    return numbered.groupBy(group).agg(F.array_join(lines, "\n\n").alias("prompt"))


def best_window(lines: DataFrame, group: str, budget: int) -> DataFrame:
    """(group, start_line, end_line, score, chars): the contiguous lines of most score under the budget.

    ``lines``: (group, line, chars, score), scores not negative. Ties go to fewer characters, then the
    earlier start. The furthest end under the budget of each start is found by one sort of a group's
    starts and ends by their running lengths, so a group costs its length, not its square.
    """
    w = Window.partitionBy(group).orderBy("line")
    sums = lines.withColumn("c", F.sum("chars").over(w)).withColumn("s", F.sum("score").over(w))
    # The first line that reaches a running score: the shortest window of that score ends there.
    same = Window.partitionBy(group, "s")
    sums = sums.withColumns({"first": F.min("line").over(same), "first_c": F.min("c").over(same)})
    end = F.struct("line", "s", "first", "first_c")
    ends = sums.select(group, F.col("c").alias("at"), F.lit(0).alias("kind"), end.alias("end"), F.lit(None).cast("struct<line:bigint,c:bigint,c0:bigint,s0:bigint>").alias("start"))
    start = F.struct(F.col("line").cast("bigint").alias("line"), F.col("c").cast("bigint").alias("c"), (F.col("c") - F.col("chars")).cast("bigint").alias("c0"), (F.col("s") - F.col("score")).cast("bigint").alias("s0"))
    starts = sums.select(group, (F.col("c") - F.col("chars") + budget).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(ends.schema["end"].dataType).alias("end"), start.alias("start"))
    reach = F.max("end").over(Window.partitionBy(group).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    met = ends.unionAll(starts).withColumn("reach", reach).where("kind = 1 AND reach.line >= start.line")
    alone = F.col("reach.first") < F.col("start.line")  # nothing is gained: the start line by itself
    spans = met.select(
        group, F.col("start.line").alias("start_line"), F.when(alone, F.col("start.line")).otherwise(F.col("reach.first")).alias("end_line"),
        (F.col("reach.s") - F.col("start.s0")).alias("score"), (F.when(alone, F.col("start.c")).otherwise(F.col("reach.first_c")) - F.col("start.c0")).alias("chars"),
    )
    return dedupe_first(spans, [group], [F.desc("score"), F.asc("chars"), F.asc("start_line")])


def pack_uncovered(blocks: DataFrame, group: str, budget: int = BUDGET) -> DataFrame:
    """As ``pack``, but a block whose lines a chosen block of its file already holds is left out and not counted.

    ``blocks``: (group, rank, chunk_id, chars, source_file, start_line, end_line).
    """
    gathered = blocks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "chars", "source_file", "start_line", "end_line"))).alias("blocks"))
    kind = "array<struct<chunk_id:bigint,f:string,s:bigint,e:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("omitted"), F.array().cast(kind).alias("taken"))

    def step(s: Column, b: Column) -> Column:
        covered = F.exists(s["taken"], lambda t: (t["f"] == b["source_file"]) & (t["s"] <= b["start_line"]) & (t["e"] >= b["end_line"]))
        fits = ~covered & (s["used"] + b["chars"] <= budget)
        one = F.array(F.struct(b["chunk_id"].cast("long").alias("chunk_id"), b["source_file"].alias("f"), b["start_line"].cast("long").alias("s"), b["end_line"].cast("long").alias("e")))
        return F.struct(
            F.when(fits, s["used"] + b["chars"]).otherwise(s["used"]).alias("used"), F.when(fits | covered, s["omitted"]).otherwise(s["omitted"] + 1).alias("omitted"),
            F.when(fits, F.concat(s["taken"], one)).otherwise(s["taken"]).alias("taken"),
        )

    packed = gathered.select(group, F.aggregate("blocks", start, step).alias("p"))
    return packed.select(group, F.col("p.used").alias("total_chars"), F.transform("p.taken", lambda t: t["chunk_id"]).alias("chunk_ids"), F.col("p.omitted").alias("omitted"))
