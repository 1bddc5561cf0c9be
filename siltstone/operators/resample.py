"""Bootstrap by counts: resamples without a row per draw.

A resample of n rows gives every part of the rows a number of draws. These numbers are binomial splits down a
binary tree whose leaves are LEAF rows each: a node's draws go to its left half with the share of rows
that this holds. Each split has a random sequence of its own, seeded by the node, for all resamples at
once, so any task finds the numbers of its leaf by the splits on the way down from the root, and two
tasks agree on every node that they share without a message. A leaf then draws among its own rows and
sends one sum a resample, so what is shuffled is leaves times resamples, whatever the number of rows.

Strata are trees of their own and pooled, as their sizes are fixed. Variants of the same rows can share the
draws, so that their differences are paired. The draws are those of numpy's PCG64 and the same at each
run, for any number of partitions.

Defined cases: null values are left out before rows are counted, and rows with a null key with them; a group without rows has no result; one
row gives its own value in every resample; ``order`` must be unique in a stratum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import running, stage_table

#: Rows of a leaf, and draws that are made at a time.
LEAF, DRAWS = 4096, 1 << 20


def _random(*parts) -> np.random.Generator:
    digest = hashlib.sha256("|".join(map(str, parts)).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "big")))


def leaf_draws(name: str, n: int, leaf: int, resamples: int, seed: int) -> np.ndarray:
    """Draws that a leaf of a tree of n rows gets in each resample."""
    low, high = 0, -(-n // LEAF)
    draws = np.full(resamples, n, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rows, left = min(n, high * LEAF) - low * LEAF, (middle - low) * LEAF
        part = _random(seed, name, low, high).binomial(draws, left / rows)
        low, high, draws = (low, middle, part) if leaf < middle else (middle, high, draws - part)
    return draws


def leaf_sums(name: str, values: np.ndarray, n: int, leaf: int, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (resamples x columns) of a leaf's drawn rows, and the numbers of draws."""
    draws = leaf_draws(name, n, leaf, resamples, seed)
    random, out = _random(seed, name, "leaf", leaf), np.zeros((resamples, values.shape[1]))
    ends = np.cumsum(draws)
    first = 0
    while first < resamples:
        start = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + DRAWS, side="right")))
        drawn = values[random.integers(0, len(values), int(ends[last - 1]) - start)]
        upto = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(drawn, axis=0)])
        cuts = np.append(start, ends[first:last]) - start
        out[first:last] = upto[cuts[1:]] - upto[cuts[:-1]]
        first = last
    return out, draws


def means(rows: DataFrame, values: list[str], order: list[str], strata: list[str], resamples: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(by..., resample, values...): the means of each column in each resample, drawn inside strata and pooled; all columns share the draws."""
    by = by or []
    keys = [*by, *strata]
    good = rows
    for v in values:
        good = good.where(F.col(v).isNotNull())
    slim = good.select(*dict.fromkeys([*keys, *order]), *[F.col(v).cast("double").alias(f"_v{k}") for k, v in enumerate(values)]).withColumn("_one", F.lit(1))
    placed = stage_table(running(slim, [*keys, *order], {"_upto": "_one"}), "placed")
    groups = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_upto").alias("_first"))
    joined = placed.join(groups, keys) if keys else placed.crossJoin(groups)  # one row
    leafed = joined.withColumn("_leaf", F.floor((F.col("_upto") - F.col("_first")) / LEAF).cast("int")).withColumn("_name", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit(""))
    columns = [f"_v{k}" for k in range(len(values))]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    schema = (kinds + ", " if by else "") + "resample int, _draws long, " + ", ".join(f"{c} double" for c in columns)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_upto")
        matrix = np.stack([table.column(c).to_numpy() for c in columns], 1)
        sums, draws = leaf_sums(table.column("_name")[0].as_py(), matrix, table.column("_n")[0].as_py(), table.column("_leaf")[0].as_py(), resamples, seed)
        keep = [pa.repeat(table.column(k)[0], resamples) for k in by]
        return pa.Table.from_arrays([*keep, pa.array(np.arange(1, resamples + 1), pa.int32()), pa.array(draws), *[pa.array(sums[:, k]) for k in range(len(columns))]], names=[*by, "resample", "_draws", *columns])

    parts = leafed.select(*dict.fromkeys([*keys, "_leaf"]), "_name", "_n", "_upto", *columns).groupBy(*keys, "_leaf").applyInArrow(run, schema)
    return parts.groupBy(*by, "resample").agg(*[(F.sum(c) / F.sum("_draws")).alias(v) for c, v in zip(columns, values, strict=True)])


def intervals(found: DataFrame, values: list[str], resamples: int, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """(by..., value_low, value_high...) at the places floor(a n) and floor((1 - a) n) - 1 of the sorted means."""
    tail = (1 - level) / 2
    low, high = int(np.floor(round(tail * resamples, 9))), int(np.floor(round((1 - tail) * resamples, 9))) - 1
    # The number of resamples is a parameter, so the means of one group are a list of fixed size.
    sides = [F.round(F.get(F.array_sort(F.collect_list(v)), F.lit(place)), 6).alias(f"{v}_{side}") for v in values for side, place in (("low", low), ("high", high))]
    return found.groupBy(*(by or [])).agg(*sides)
