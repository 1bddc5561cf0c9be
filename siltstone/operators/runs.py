"""Latency, throughput, cost and schedule operators over measured runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.stats import percentile_nearest
from siltstone.runtime import numbered


def latency_summary(value: str = "value") -> list[Column]:
    """n, min, mean, median, nearest-rank p95 and max; 3 digits, the mean 6."""
    v = F.col(value)
    return [F.count("*").alias("n"), F.round(F.min(v), 3).alias("min_ms"), F.round(F.avg(v), 6).alias("mean_ms"), F.round(F.median(v), 3).alias("median_ms"), F.round(percentile_nearest(value, 0.95), 3).alias("p95_ms"), F.round(F.max(v), 3).alias("max_ms")]


def throughput(value: str = "value") -> list[Column]:
    """Population deviation and sequential queries a second."""
    return [F.round(F.stddev_pop(value), 6).alias("sd_ms"), F.round(1000.0 / F.avg(value), 6).alias("per_second")]


def poisoned_sum(value: Column, valid: Column) -> Column:
    """Sum that is null as soon as one row is not valid, never a part of it."""
    return F.when(F.bool_and(F.coalesce(valid, F.lit(False))), F.sum(value))


def median_of_medians(runs: DataFrame, value: Column, by: list[str], question: str) -> DataFrame:
    """Median for each question, then the median, p95 and mean of those."""
    per = runs.groupBy(*by, question).agg(F.median(value).alias("m"))
    return per.groupBy(*by).agg(F.round(F.median("m"), 6).alias("median"), F.round(F.expr("percentile(m, 0.95)"), 6).alias("p95"), F.round(F.avg("m"), 6).alias("mean_of_medians"))


def consistency(rankings: DataFrame, expected: int, keys: list[str]) -> DataFrame:
    """Whether all repetitions are there and gave one ordered id list: rows (keys, repetition, rank, chunk_id)."""
    lists = rankings.groupBy(*keys, "repetition").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return lists.groupBy(*keys).agg((F.count("*") == expected).alias("complete"), (F.countDistinct("ids") == 1).alias("identical"))


def hash_schedule(runs: DataFrame, seed: str, parts: list[str], name: str = "place") -> DataFrame:
    """A reproducible order of all runs, by the SHA-256 of seed and key."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)
    return numbered(runs.withColumn("digest", digest), ["digest", *parts], name)


def list_cost(prompt: Column, cached: Column, completion: Column, available: Column, prices: tuple[float, float, float]) -> Column:
    """Cost at list prices per million tokens; null where usage is not available."""
    fresh, kept, out = prices
    return F.when(available, ((prompt - cached) * fresh + cached * kept + completion * out) / 1e6)


def cost_envelope(chars: Column, low_price: float, high_price: float) -> tuple[Column, Column]:
    """ceil(chars / 4) + 300 to ceil(chars / 3) + 500 tokens, priced per million."""
    return (F.ceil(chars / 4.0) + 300) * low_price / 1e6, (F.ceil(chars / 3.0) + 500) * high_price / 1e6
