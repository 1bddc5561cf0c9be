"""Rank metrics, slices and comparisons of retrieval methods.

``outcomes`` are rows (question_id, method, first_rank, slices...): one for every question that a
method was run on, first_rank null where nothing relevant was found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed cut-offs of the evaluation.
CUTS = (1, 3, 5, 20)
THRESHOLDS = (1, 3, 10)
MISS = 11


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def rate(condition: Column) -> Column:
    """Share of rows with the condition; a null condition counts as false."""
    return rounded(F.avg(F.coalesce(condition, F.lit(False)).cast("double")))


def first_relevant(ranking: DataFrame, relevant: Column, runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Smallest rank with a relevant row for every (question_id, method) of ``runs``; its other columns are kept."""
    hit = relevant if limit is None else relevant & (F.col("rank") <= limit)
    found = ranking.groupBy("question_id", "method").agg(F.min(F.when(hit, F.col("rank"))).alias("first_rank"))
    return runs.join(found, ["question_id", "method"], "left")


def hit_rates(cuts: tuple[int, ...] = CUTS) -> list[Column]:
    return [rate(F.col("first_rank") <= k).alias(f"hit_at_{k}") for k in cuts]


def mrr(limit: int | None = None) -> Column:
    good = F.lit(True) if limit is None else F.col("first_rank") <= limit
    return rounded(F.avg(F.when(good & F.col("first_rank").isNotNull(), 1.0 / F.col("first_rank")).otherwise(0.0)))


def summary(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Hit rates, untruncated MRR and the rank distribution; ranks past 20 count as not found but add to MRR."""
    r = F.col("first_rank")
    spread = {"rank_1": r == 1, "rank_2_5": r.between(2, 5), "rank_6_20": r.between(6, 20), "not_found": r.isNull() | (r > 20)}
    return outcomes.groupBy(*keys).agg(F.count("*").alias("questions"), *hit_rates(), mrr().alias("mrr"), *[F.count_if(c).alias(k) for k, c in spread.items()])


def baseline_row() -> list[Column]:
    return [F.count("*").alias("questions"), rate(F.col("first_rank") <= 1).alias("top_1"), rate(F.col("first_rank") <= 3).alias("top_3"), mrr(10).alias("mrr_at_10")]


def sliced(outcomes: DataFrame, sets: list[tuple[str, ...]], metrics: list[Column]) -> DataFrame:
    """GROUPING SETS over method and each set of slices; ``slice`` names the set."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    grouped = outcomes.groupingSets([["method", *s] for s in sets], "method", *every).agg(*metrics, *[F.grouping(c).alias(f"g_{c}") for c in every])
    name = reduce(lambda a, s: F.when(reduce(lambda x, c: x & (F.col(f"g_{c}") == (0 if c in s else 1)), every, F.lit(True)), "+".join(s) or "global").otherwise(a), sets, F.lit(None).cast("string"))
    return grouped.withColumn("slice", name).drop(*[f"g_{c}" for c in every])


def macro(outcomes: DataFrame, over: str) -> DataFrame:
    """Metrics of each slice, then their plain mean."""
    per = outcomes.groupBy("method", over).agg(F.avg(F.coalesce(F.col("first_rank") <= 1, F.lit(False)).cast("double")).alias("a"), F.avg(F.coalesce(F.col("first_rank") <= 3, F.lit(False)).cast("double")).alias("b"), F.avg(F.when(F.col("first_rank") <= 10, 1.0 / F.col("first_rank")).otherwise(0.0)).alias("c"))
    return per.groupBy("method").agg(rounded(F.avg("a")).alias("macro_top_1"), rounded(F.avg("b")).alias("macro_top_3"), rounded(F.avg("c")).alias("macro_mrr_at_10"), F.count("*").alias("slices"))


def rank_outcome(rank: Column) -> Column:
    return F.when(rank == 1, "rank_1").when(rank.between(2, 3), "rank_2_3").when(rank.between(4, 10), "rank_4_10").otherwise("miss_at_10")


def transition(before: Column, after: Column, at: Column) -> Column:
    """repair, regression, both_success or both_fail of two ranks at a threshold."""
    a, b = F.coalesce(before <= at, F.lit(False)), F.coalesce(after <= at, F.lit(False))
    return F.when(~a & b, "repair").when(a & ~b, "regression").when(a & b, "both_success").otherwise("both_fail")


def compare_ranks(candidate: Column, baseline: Column) -> Column:
    """better, worse or equal, a miss being rank 11."""
    a, b = F.coalesce(candidate, F.lit(MISS)), F.coalesce(baseline, F.lit(MISS))
    return F.when(a < b, "better").when(a > b, "worse").otherwise("equal")


def paired(outcomes: DataFrame, left: str, right: str, key: str = "question_id", by: str = "method") -> DataFrame:
    """Rows with first_rank of two levels of ``by`` side by side, where both were run."""
    a = outcomes.where(F.col(by) == left).select(key, F.col("first_rank").alias("rank_a"))
    b = outcomes.where(F.col(by) == right).select(key, F.col("first_rank").alias("rank_b"))
    return a.join(b, key)


def pair_outcome(a: Column, b: Column, at: int, names: tuple[str, str]) -> Column:
    x, y = F.coalesce(a <= at, F.lit(False)), F.coalesce(b <= at, F.lit(False))
    return F.when(x & y, "both").when(x, f"{names[0]}_only").when(y, f"{names[1]}_only").otherwise("both_fail")


def hit5_transition(before: Column, after: Column) -> Column:
    a, b = F.coalesce(before <= 5, F.lit(False)), F.coalesce(after <= 5, F.lit(False))
    low = F.lit(1_000_000)
    return (
        F.when(~a & b, "recovered_at_5").when(a & ~b, "regressed_at_5").when(F.coalesce(after, low) < F.coalesce(before, low), "rank_improved")
        .when(F.coalesce(after, low) > F.coalesce(before, low), "rank_regressed").otherwise("unchanged")
    )


def coverage(recall: Column) -> Column:
    return F.when(recall >= 1, "complete").when(recall > 0, "partial").otherwise("miss")


def file_metrics(ranking: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10), file: str = "source_file") -> DataFrame:
    """Per question and method: hit, recall and precision at each cut, and MRR@10, over distinct files in order of first rank.

    ``gold``: (question_id, gold_file). Precision divides by the cut or the list's length, whichever is less.
    """
    from pyspark.sql import Window

    files = ranking.groupBy("question_id", "method", file).agg(F.min("rank").alias("first"))
    files = files.withColumn("place", F.row_number().over(Window.partitionBy("question_id", "method").orderBy("first", file)))
    marked = files.join(gold.select("question_id", F.col("gold_file").alias(file), F.lit(1).alias("is_gold")), ["question_id", file], "left")
    counts = gold.groupBy("question_id").agg(F.count("*").alias("n_gold"))
    got = [F.count_if((F.col("is_gold") == 1) & (F.col("place") <= k)).alias(f"found_{k}") for k in cuts]
    per = marked.groupBy("question_id", "method").agg(F.max("place").alias("listed"), F.min(F.when((F.col("is_gold") == 1) & (F.col("place") <= 10), F.col("place"))).alias("first_gold"), *got).join(counts, "question_id")
    columns = [c for k in cuts for c in ((F.col(f"found_{k}") > 0).cast("double").alias(f"hit_{k}"), (F.col(f"found_{k}") / F.col("n_gold")).alias(f"recall_{k}"), (F.col(f"found_{k}") / F.least(F.lit(k), F.col("listed"))).alias(f"precision_{k}"))]
    return per.select("question_id", "method", *columns, F.coalesce(1.0 / F.col("first_gold"), F.lit(0.0)).alias("mrr_10"))
