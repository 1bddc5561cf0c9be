"""Statistics of paired runs: ranks, resampling, exact tests, agreement and multiple testing.

Resampling draws by hash, not by a sequential generator: draw i of resample b is row
``sha256(seed|stratum|b|i)`` modulo the stratum's size. Draws are made where they are needed, in
parallel, and any SQL engine with SHA-256 can replay them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import draws
from siltstone.runtime import running, session_partitions, stage_table


def average_ranks(rows: DataFrame, value: str, by: list[str], name: str, ties: str | None = None) -> DataFrame:
    """``rows`` with the 1-based rank of ``value`` inside ``by``, ties sharing their mean, and the number of ties if it is named.

    Equal values are counted first; the counts are summed over ranges of (by, value) and the ranks joined
    to the rows, so no task sees a whole group, nor the rows of one value but as a count. Nulls rank first.
    The rows are staged, as they are read twice: a mean of doubles follows the order in which a shuffle
    arrives, and a value that came out another way the second time would find no rank and lose its row.
    """
    rows = stage_table(rows, "valued")
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_ties"))
    upto = stage_table(running(counts, [*by, value], {"_upto": "_ties"}), "ranks")
    starts = upto.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_ties")).alias("_start"))
    keys = {c: f"_key_{k}" for k, c in enumerate(by)}
    starts = starts.select(*[F.col(c).alias(f"{k}s") for c, k in keys.items()], "_start")
    same = F.lit(True)
    for c, k in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(f"{k}s"))
    placed = upto.join(starts, same) if by else upto.crossJoin(starts)  # one row
    rank = F.col("_upto") - F.col("_ties") - F.col("_start") + (F.col("_ties") + 1) / 2.0
    ranks = placed.select(*[F.col(c).alias(k) for c, k in keys.items()], F.col(value).alias("_value"), rank.alias(name), *([F.col("_ties").alias(ties)] if ties else []))
    met = F.col(value).eqNullSafe(F.col("_value"))
    for c, k in keys.items():
        met = met & F.col(c).eqNullSafe(F.col(k))
    return rows.join(ranks, met).drop("_value", *keys.values())


def percentile_nearest(value: str, q: float) -> Column:
    """Nearest-rank percentile: the value at place ceil(q n)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def percentile_linear(value: str, q: float) -> Column:
    return F.expr(f"percentile({value}, {q})")


def draw(seed: Column, parts: list[Column], size: Column) -> Column:
    """0-based row drawn: the first 8 hex digits of a SHA-256 modulo the size."""
    digest = F.sha2(F.concat_ws("|", seed, *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size


#: Rows up to which a task makes whole resamples of packed values, rows of one packed piece, and draws of a task.
HELD, PIECE, TASK_DRAWS = 1 << 22, 1 << 16, 1 << 26


def bootstrap(values: DataFrame, value: str, order: list[str], strata: list[str], resamples: int, seed: int, by: list[str] | None = None, statistic: Callable[[str], Column] = F.avg) -> DataFrame:
    """(by..., resample, mean): the mean, or another statistic, of resamples drawn with replacement inside each stratum and pooled.

    ``order`` numbers the rows of a stratum and must be unique in it; ``by`` are keys of separate bootstraps.
    Rows with a null key are left out; null values are drawn but not counted.
    Means and medians of up to HELD rows are made where the packed values lie (``operators/draws.py``), so
    no draw is a row; more rows, and other statistics, take a row a draw and a shuffle.
    """
    by = by or []
    keys = [*by, *strata]
    known = values
    for c in keys:
        known = known.where(F.col(c).isNotNull())
    slim = known.select(*dict.fromkeys([*keys, *order]), F.col(value).alias("_v"), F.lit(1).alias("_one"))
    placed = stage_table(running(slim, [*keys, *order], {"_upto": "_one"}), "placed")
    groups = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_upto").alias("_first"))
    joined = placed.join(groups, keys) if keys else placed.crossJoin(groups)  # one row
    names = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    rows = joined.select(*keys, names.alias("_name"), (F.col("_upto") - F.col("_first")).alias("_i"), "_n", "_v")
    replay = {F.avg: draws.means, F.median: draws.medians}.get(statistic)
    if replay and (held := placed.count()) <= HELD:
        return _replayed(rows, keys, by, resamples, seed, replay, held)
    # A row becomes as many draws as there are resamples, so rows of one stratum are dealt out first.
    dealt = rows.select(*keys, "_name", "_i", "_n").repartition(session_partitions(rows.sparkSession), *keys, "_i")
    drawn = dealt.select(*keys, "_name", "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    drawn = drawn.select(*keys, "resample", draw(F.lit(str(seed)), [F.col("_name"), F.col("resample"), F.col("_i")], F.col("_n")).alias("_i"))
    return drawn.join(rows.select(*keys, "_i", "_v"), [*keys, "_i"]).groupBy(*by, "resample").agg(statistic("_v").alias("mean"))


def _replayed(rows: DataFrame, keys: list[str], by: list[str], resamples: int, seed: int, replay: Callable, held: int) -> DataFrame:
    """Resamples of (keys..., _name, _i, _n, _v) by ``replay``: a group's values in packed pieces, and a row for each unit of resamples."""
    spark = rows.sparkSession
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in by)

    def pack(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("_i")
        column = piece.column("_v")
        bits = [pa.array([x.tobytes()], pa.binary()) for x in (pc.fill_null(column, 0.0).to_numpy().astype("<f8"), pc.is_valid(column).to_numpy())]
        return pa.Table.from_arrays([*[piece.column(k).slice(0, 1) for k in (*by, "_name", "_piece")], *bits], names=[*by, "_name", "_piece", "_values", "_known"])

    pieces = rows.select(*keys, "_name", "_i", F.col("_v").cast("double").alias("_v"), F.floor(F.col("_i") / PIECE).alias("_piece"))
    pieces = pieces.groupBy(*keys, "_piece").applyInArrow(pack, kinds + "_name string, _piece long, _values binary, _known binary")
    packed = pieces.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_name", "_piece", "_values", "_known"))).alias("_pieces")).where(F.size("_pieces") > 0)
    units = min(resamples, max(4 * spark.sparkContext.defaultParallelism, -(-held * resamples // TASK_DRAWS)))
    dealt = packed.withColumn("_unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1)))).repartition(units)
    schema = kinds + "resample int, mean double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                unit, strata = batch.column("_unit")[at].as_py(), {}
                for piece in batch.column("_pieces")[at].as_py():
                    strata.setdefault(piece["_name"], []).append(piece)
                packs = [(name, np.frombuffer(b"".join(p["_values"] for p in ps), "<f8"), np.frombuffer(b"".join(p["_known"] for p in ps), np.bool_)) for name, ps in strata.items()]
                first, end = 1 + unit * resamples // units, 1 + (unit + 1) * resamples // units
                found = replay(packs, str(seed), first, end)
                yield pa.RecordBatch.from_arrays([*[pa.repeat(batch.column(k)[at], end - first) for k in by], pa.array(range(first, end), pa.int32()), pa.array(found, pa.float64())], names=[*by, "resample", "mean"])

    return dealt.mapInArrow(run, schema)


def interval(means: DataFrame, by: list[str], resamples: int, level: float = 0.95, last: bool = True, places: tuple[int, int] | None = None) -> DataFrame:
    """Bounds at the places floor(a n) and floor((1 - a) n) - 1 (or without the - 1) of the sorted means, or at ``places``."""
    tail = (1 - level) / 2
    low, high = places or (math.floor(round(tail * resamples, 9)), math.floor(round((1 - tail) * resamples, 9)) - int(last))
    ordered = means.withColumn("_p", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("mean", "resample")) - 1)
    return ordered.groupBy(*by).agg(F.round(F.max(F.when(F.col("_p") == low, F.col("mean"))), 6).alias("ci_low"), F.round(F.max(F.when(F.col("_p") == high, F.col("mean"))), 6).alias("ci_high"))


def wilcoxon(differences: DataFrame, value: str, by: list[str], least: int = 0) -> DataFrame:
    """W+, non-zero n, tie-corrected variance and continuity-corrected z of the signed-rank test; z is null below ``least`` pairs."""
    d = differences.where(F.col(value) != 0).withColumn("_a", F.round(F.abs(F.col(value)), 9))
    ranked = average_ranks(d, "_a", by, "_r", "_t")
    g = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum((F.col("_t") * F.col("_t") - 1) / 48.0).alias("ties"))
    n = F.col("n").cast("double")
    mean, variance = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties")
    gap = F.col("w_plus") - mean
    z = F.when((variance > 0) & (F.col("n") >= least), (gap - F.signum(gap) * 0.5) / F.sqrt(variance))
    return g.select(*by, "n", (F.rint(F.col("w_plus") * 1e6) / 1e6).alias("w_plus"), (F.rint(variance * 1e6) / 1e6).alias("variance"), F.round(z, 6).alias("z"))


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def two_sided_binomial(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Exact sign test of a fair coin; null without trials or where a count is null."""

    def tail(a: float, b: float) -> float | None:
        if pd.isna(a) or pd.isna(b) or a + b == 0:
            return None
        n, low = int(a + b), np.arange(int(min(a, b)) + 1)
        steps = np.log((n - low[1:] + 1) / low[1:])  # of one binomial coefficient to the next
        logs = np.concatenate([[0.0], np.cumsum(steps)]) - n * math.log(2)
        return min(1.0, 2 * float(np.exp(logs).sum()))

    return pd.Series([tail(a, b) for a, b in zip(wins, losses, strict=True)], dtype=object)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    bottom = 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (centre - half) / bottom), F.when(n > 0, (centre + half) / bottom)


def holm(tests: DataFrame, p: str, by: list[str], key: str) -> DataFrame:
    """Step-down adjusted p: running maximum of min(1, (m - i) p); null stays null."""
    known = Window.partitionBy(*by, F.col(p).isNull())
    ordered = known.orderBy(p, key)
    scaled = F.least(F.lit(1.0), (F.count("*").over(known) - F.row_number().over(ordered) + 1) * F.col(p))
    stepped = tests.withColumn("_s", F.when(F.col(p).isNotNull(), scaled))
    return stepped.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.max("_s").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def spearman(pairs: DataFrame, a: str, b: str, by: list[str], least: int = 3) -> DataFrame:
    """Pearson correlation of average ranks; null under ``least`` rows or without variance."""
    ranked = average_ranks(average_ranks(pairs, a, by, "_x"), b, by, "_y")
    return correlation(ranked, "_x", "_y", by, least, "spearman")


def correlation(pairs: DataFrame, a: str, b: str, by: list[str], least: int = 2, name: str = "pearson") -> DataFrame:
    good = (F.count("*") >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.when(good, F.corr(a, b)), 6).alias(name))


def kappa(pairs: DataFrame, a: str, b: str, quadratic_over: int | None = None) -> DataFrame:
    """One row (n, kappa): Cohen's, or with weights (i - j)^2 / k^2 for scores 0..k.

    The table of counts is as large as the number of scores squared, whatever the number of pairs.
    """
    cells = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    xs = cells.groupBy("x").agg(F.sum("c").alias("cx"))
    ys = cells.groupBy("y").agg(F.sum("c").alias("cy"))
    total = cells.agg(F.sum("c").alias("n"))
    k = quadratic_over or 1
    miss = (lambda: (F.col("x") - F.col("y")) * (F.col("x") - F.col("y")) / float(k * k)) if quadratic_over else (lambda: (F.col("x") != F.col("y")).cast("double"))
    seen = cells.crossJoin(total).agg(F.max("n").alias("n"), (F.sum(miss() * F.col("c")) / F.max("n")).alias("seen"))
    chance = xs.crossJoin(ys).crossJoin(total).agg((F.sum(miss() * F.col("cx") * F.col("cy")) / F.max(F.col("n") * F.col("n"))).alias("chance"))
    return seen.crossJoin(chance).select("n", F.round(F.when(F.col("chance") > 0, 1 - F.col("seen") / F.col("chance")), 6).alias("kappa"))


def paired_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, mean difference, effect size, and wins, ties and losses of (a, b)."""
    d = F.round(F.col("a") - F.col("b"), 9)
    rows = pairs.withColumn("d", d)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_difference"), F.round(F.avg("d") / F.nullif(F.stddev_samp("d"), F.lit(0.0)), 6).alias("dz"),
        F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"),
    )


def terciles(rows: DataFrame, order: list[str], by: list[str], name: str = "tercile") -> DataFrame:
    """0, 1, 2 by place, n // 3 rows each and the rest in the last."""
    w = Window.partitionBy(*by)
    third = F.floor(F.count("*").over(w) / 3)
    place = F.row_number().over(w.orderBy(*order)) - 1
    return rows.withColumn(name, F.when(place < third, 0).when(place < 2 * third, 1).otherwise(2))


#: Numbers of differences up to which the sign patterns are listed; points of one task row and of one table in the sum over frequencies.
LISTED, UNIT, POINTS = 20, 1 << 20, 8192
#: From this number of differences on, frequencies are passed over in blocks of a BLOCK_PARTth of that number.
BLOCKED, BLOCK_PART = 257, 6


def _tail_part(d: list[int], unit: int) -> float:
    """The share of one unit of frequencies in P(T <= K), see ``sign_flip``."""
    sizes = np.sort(np.abs(np.array([x for x in d if x], np.int64)))[::-1]
    sizes //= max(1, np.gcd.reduce(sizes))
    whole, seen = int(sizes.sum()), abs(sum(d)) // max(1, math.gcd(*d))
    k, m = (whole - seen) // 2, whole + 1 + whole % 2
    step = np.arange(POINTS, dtype=np.int64)

    def angles(factor: int) -> np.ndarray:
        return np.array([factor * int(j) % (2 * m) for j in step]) * (np.pi / m)

    tables = [(np.cos(a), np.sin(a)) for a in (angles(int(x)) for x in sizes)]
    parts, end = [(k + 1) / m] if unit == 0 else [], min((unit + 1) * UNIT, (m - 1) // 2 + 1)
    for low in range(max(1, unit * UNIT), end, POINTS):
        n = min(POINTS, end - low)
        value = np.ones(n)
        for i, (x, (c, s)) in enumerate(zip(sizes, tables, strict=True)):
            a = int(x) * low % (2 * m) * (math.pi / m)
            value *= math.cos(a) * c[:n] - math.sin(a) * s[:n]
            # All that is passed over adds up to under 1e-16 (ln m + 1).
            if i % 16 == 15 and np.abs(value).max() < 1e-16:
                break
        else:
            at = [int(f) * low % (2 * m) for f in (whole - k, k + 1, 1)]
            top, over, under = [(a + f * step[:n] % (2 * m)) % (2 * m) * (np.pi / m) for a, f in zip(at, (whole - k, k + 1, 1), strict=True)]
            parts.append(float((value * np.cos(top) * np.sin(over) / np.sin(under)).sum()) * 2 / m)
    return math.fsum(parts)


def _blocked_tail_part(d: list[int], unit: int) -> float:
    """``_tail_part`` of a unit of UNIT blocks of frequencies.

    In a block the angle of a size x moves by up to pi x width / M, so its cosine stays under exp(-r^2 / 2)
    where r is the least distance from a multiple of pi. Blocks whose product of these bounds is under 1e-16 are
    passed over; the frequencies of the others are summed as in ``_tail_part``.
    """
    sizes, times = np.unique(np.abs(np.array([x for x in d if x], np.int64)), return_counts=True)
    sizes //= max(1, np.gcd.reduce(sizes))
    whole, seen = int((sizes * times).sum()), abs(sum(d)) // max(1, math.gcd(*d))
    k, m = (whole - seen) // 2, whole + 1 + whole % 2
    width, last = len(d) // BLOCK_PART, (m - 1) // 2
    # Sizes about the mean first: they turn fast enough, and their angles move little in a block.
    middle = np.argsort(np.abs(sizes - whole / len(d)) / times, kind="stable")
    sizes, times = sizes[middle], times[middle]
    parts, bar = [(k + 1) / m] if unit == 0 else [], -2 * math.log(1e-16)

    def angles(factor: int, low: int, block: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Of the frequencies low + block * width + inside; block by block, so that no product overflows."""
        return (factor * low % (2 * m) + factor * width % (2 * m) * block % (2 * m) + factor % (2 * m) * inside % (2 * m)) % (2 * m) * (np.pi / m)

    for low in range(unit * UNIT * width, min((unit + 1) * UNIT * width, last + 1), POINTS * width):
        block = np.arange(min(POINTS, -(-(last + 1 - low) // width)))
        gap = np.zeros(len(block))
        for i, (x, c) in enumerate(zip(sizes, times, strict=True)):
            x = int(x)
            turn = (2 * x * low + x * (width - 1)) % (2 * m) / (2 * m) + block * (x * width % m / m)
            r = np.maximum(0, np.abs(turn - np.rint(turn)) * np.pi - (x * (width - 1) / (2 * m) * np.pi + 1e-9))
            gap += int(c) * r * r
            if i % 16 == 15:
                alive = gap < bar
                block, gap = block[alive], gap[alive]
                if not len(block):
                    break
        f = (block[gap < bar, None] * width + np.arange(width)).ravel()
        f = f[(f + low > 0) & (f + low <= last)]
        for start in range(0, len(f), POINTS):
            part = np.divmod(f[start : start + POINTS], width)
            value = np.ones(len(part[0]))
            for i, (x, c) in enumerate(zip(sizes, times, strict=True)):
                value *= np.cos(angles(int(x), low, *part)) ** int(c)
                if i % 16 == 15 and np.abs(value).max() < 1e-16:
                    break
            else:
                top, over, under = (angles(factor, low, *part) for factor in (whole - k, k + 1, 1))
                parts.append(float((value * np.cos(top) * np.sin(over) / np.sin(under)).sum()) * 2 / m)
    return math.fsum(parts)


@F.pandas_udf(T.DoubleType())
def tail_part(d: pd.Series, unit: pd.Series) -> pd.Series:
    return pd.Series([(_tail_part if len(one) < BLOCKED else _blocked_tail_part)([int(x) for x in one], int(u)) for one, u in zip(d, unit, strict=True)])


def sign_flip(differences: DataFrame, value: str) -> DataFrame:
    """Two-sided exact paired sign-flip test over all 2^n sign patterns, for any n: (n, observed, p).

    Up to LISTED differences the patterns are listed. For more, the differences are integers (6
    digits) and T, the sum of the sizes whose sign is flipped, has the tail P(T <= K) = sum over
    the frequencies f < M, M > sum of the sizes, of prod cos(pi f d / M) times a Dirichlet kernel:
    an identity, with no error but that of the arithmetic (under 1e-12). The frequencies are dealt
    out in units. With BLOCKED differences and more they are passed over in blocks that widen with the number
    of differences, so the work follows the size of the mean difference and not the sum. At most 36 differences, the result is set to the multiple of 2^-n that it must be.
    """
    ordered = F.sort_array(F.collect_list(F.round(F.col(value), 6)))
    one = differences.agg(ordered.alias("d")).withColumn("n", F.size("d"))
    flips = one.where(f"n between 1 and {LISTED}").select("d", "n", F.explode(F.expr("sequence(0L, shiftleft(1L, n) - 1)")).alias("mask"))
    total = F.expr("aggregate(sequence(0, n - 1), cast(0 as double), (s, i) -> s + if((mask >> i) & 1 = 1, -d[i], d[i]))")
    sums = flips.select("n", F.abs(F.expr("aggregate(d, cast(0 as double), (s, x) -> s + x)")).alias("seen"), F.abs(total).alias("flipped"))
    listed = sums.groupBy("n").agg(F.round(F.max("seen") / F.max("n"), 6).alias("observed"), F.round(F.avg((F.col("flipped") >= F.col("seen") - 1e-9).cast("double")), 6).alias("p"))

    many = one.where(f"n > {LISTED}").select("n", F.transform("d", lambda x: F.round(x * 1e6).cast("long")).alias("d"))
    many = many.withColumn("seen", F.abs(F.aggregate("d", F.lit(0).cast("long"), lambda s, x: s + x))).withColumn("whole", F.aggregate("d", F.lit(0).cast("long"), lambda s, x: s + F.abs(x)))
    width = F.when(F.col("n") < BLOCKED, 1).otherwise(F.floor(F.col("n") / BLOCK_PART))
    units = many.select("n", "d", "seen", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") + 2) / (2 * UNIT * width)))).alias("unit"))
    units = units.repartition(session_partitions(differences.sparkSession), "unit")
    tails = units.groupBy("n", "seen").agg(F.sum(tail_part("d", "unit")).alias("tail"))
    exact = F.when(F.col("seen") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.col("tail"))))
    exact = F.when(F.col("n") <= 36, F.round(exact * F.pow(F.lit(2.0), "n")) / F.pow(F.lit(2.0), "n")).otherwise(exact)
    return listed.unionByName(tails.select("n", F.round(F.col("seen") / 1e6 / F.col("n"), 6).alias("observed"), F.round(exact, 6).alias("p")))
