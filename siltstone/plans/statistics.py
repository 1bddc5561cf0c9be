"""Paired statistics over the event table: event types are arms, users are questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import resample, stats
from siltstone.plans.standins import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ARMS = ("view", "click")
PAIRS = "p AS (SELECT user_id, user_id % 4 AS stratum, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS a, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS b FROM events GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"


def pairs(spark, sf):
    """Mean value of both arms for users who have both."""
    events = table(spark, sf, "events")
    mean = [F.round(F.avg(F.when(F.col("event_type") == arm, F.col("value"))), 6).alias(name) for arm, name in zip(ARMS, "ab", strict=True)]
    return events.groupBy("user_id").agg(*mean).where("a IS NOT NULL AND b IS NOT NULL").withColumn("stratum", F.col("user_id") % 4)


BOOT = """, rows_ AS (SELECT {keys}, row_number() OVER (PARTITION BY {part} ORDER BY user_id) - 1 AS i, count(*) OVER (PARTITION BY {part}) AS n, {value} AS v FROM {source}),
d AS (SELECT {keys}, resample, CAST(('0x' || substr(sha256('{seed}|' || {name} || '|' || resample || '|' || i), 1, 8)) AS BIGINT) % n AS i FROM rows_ CROSS JOIN range(1, {b} + 1) r(resample)),
m AS (SELECT {out} resample, avg(rows_.v) AS mean FROM d JOIN rows_ USING ({keys}, i) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY mean, resample) - 1 AS k FROM m)"""


def full_bootstrap(keys: str, part: str, value: str, source: str, seed: int, name: str, b: int, low: int, high: int) -> str:
    return BOOT.format(keys=keys, part=part, value=value, source=source, seed=seed, name=name, b=b, out="") + f" SELECT round(max(CASE WHEN k = {low} THEN mean END), 6) AS ci_low, round(max(CASE WHEN k = {high} THEN mean END), 6) AS ci_high FROM o"


@query(f"WITH {PAIRS}, x AS (SELECT *, 0 AS one FROM p)" + full_bootstrap("one", "one", "a - b", "x", 20260930, "''", 20000, 500, 19499))
def bootstrap_mean_ci_full(spark, sf):
    """Plain bootstrap of the mean difference, 20,000 resamples."""
    d = pairs(spark, sf).withColumn("d", F.col("a") - F.col("b"))
    return stats.interval(stats.bootstrap(d, "d", ["user_id"], [], 20000, 20260930), [], 20000)


@query(f"WITH {PAIRS}" + full_bootstrap("stratum", "stratum", "a - b", "p", 20260930, "stratum", 20000, 500, 19499))
def bootstrap_stratified_full(spark, sf):
    """Resampled within strata, pooled, 20,000 resamples."""
    d = pairs(spark, sf).withColumn("d", F.col("a") - F.col("b"))
    return stats.interval(stats.bootstrap(d, "d", ["user_id"], ["stratum"], 20000, 20260930), [], 20000)


@query(f"WITH {PAIRS}, x AS (SELECT user_id // 5 AS user_id, 0 AS one, avg(a - b) AS v FROM p GROUP BY ALL)" + full_bootstrap("one", "one", "v", "x", 2601, "''", 10000, 249, 9749))
def bootstrap_cluster_full(spark, sf):
    """Means of clusters of five users, 10,000 resamples; the bounds are at the fixed places 249 and 9,749."""
    c = pairs(spark, sf).groupBy(F.floor(F.col("user_id") / 5).alias("user_id")).agg(F.avg(F.col("a") - F.col("b")).alias("v"))
    return stats.interval(stats.bootstrap(c, "v", ["user_id"], [], 10000, 2601), [], 10000, places=(249, 9749))


@query(f"WITH {PAIRS}, x AS (SELECT *, 0 AS one FROM p)" + full_bootstrap("one", "one", "a - b", "x", 7, "''", 5000, 125, 4875))
def bootstrap_dev_full(spark, sf):
    """The variant whose upper bound lies one place further, 5,000 resamples."""
    d = pairs(spark, sf).withColumn("d", F.col("a") - F.col("b"))
    return stats.interval(stats.bootstrap(d, "d", ["user_id"], [], 5000, 7), [], 5000, last=False)


@query(None)
def bootstrap_by_counts(spark, sf):
    """Both arms and their difference, resampled within strata by shared counts, so that the difference is paired; 20,000 resamples."""
    d = pairs(spark, sf).withColumn("difference", F.col("a") - F.col("b"))
    values = ["a", "b", "difference"]
    return resample.intervals(resample.means(d, values, ["user_id"], ["stratum"], 20000, 20260930), values, 20000)


WILCOXON = f"""WITH {PAIRS}, d AS (SELECT stratum, round(a - b, 9) AS d, round(abs(round(a - b, 9)), 9) AS m FROM p WHERE round(a - b, 9) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY m) + (count(*) OVER (PARTITION BY stratum, m) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY stratum, m) AS t FROM d),
g AS (SELECT stratum, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum((t * t - 1) / 48.0) AS ties FROM r GROUP BY ALL),
z AS (SELECT *, CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties AS variance, w_plus - CAST(n AS DOUBLE) * (n + 1) / 4 AS gap FROM g)
SELECT stratum, n, round(w_plus, 6) AS w_plus, round(variance, 6) AS variance, round((gap - sign(gap) * 0.5) / sqrt(variance), 6) AS z FROM z"""


@query(WILCOXON)
def wilcoxon_stats(spark, sf):
    return stats.wilcoxon(pairs(spark, sf).withColumn("d", F.round(F.col("a") - F.col("b"), 9)), "d", ["stratum"])


@query(f"WITH {PAIRS} SELECT stratum, count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses, count(*) FILTER (WHERE a = b) AS ties FROM p GROUP BY ALL")
def sign_counts(spark, sf):
    return pairs(spark, sf).groupBy("stratum").agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))


@query(f"WITH {PAIRS} SELECT count(*) FILTER (WHERE a > 50 AND NOT b > 50) AS only_a, count(*) FILTER (WHERE b > 50 AND NOT a > 50) AS only_b FROM p")
def mcnemar_counts(spark, sf):
    a, b = F.col("a") > 50, F.col("b") > 50
    return pairs(spark, sf).agg(F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))


@query(None)
def exact_p_values(spark, sf):
    """Exact sign-test and normal tail probabilities, which SQL engines lack functions for."""
    w = stats.wilcoxon(pairs(spark, sf).withColumn("d", F.round(F.col("a") - F.col("b"), 9)), "d", ["stratum"]).select("stratum", "z")
    return sign_counts(spark, sf).join(w, "stratum").select("stratum", F.round(stats.two_sided_binomial("wins", "losses"), 9).alias("sign_p"), F.round(stats.two_sided_normal("z"), 9).alias("wilcoxon_p"))


@query("""WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS h FROM events GROUP BY ALL)
SELECT event_type, h AS hits, n, round((h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low,
round((h / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM (SELECT event_type, h, CAST(n AS DOUBLE) AS n FROM c)""")
def wilson_interval(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("hits"), F.count("*").cast("double").alias("n"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return c.select("event_type", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


RANKS = "x AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY a) + (count(*) OVER (PARTITION BY stratum, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY stratum ORDER BY b) + (count(*) OVER (PARTITION BY stratum, b) - 1) / 2.0 AS rb FROM p)"


@query(f"WITH {PAIRS}, {RANKS} SELECT stratum, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM x GROUP BY ALL")
def spearman(spark, sf):
    return stats.spearman(pairs(spark, sf), "a", "b", ["stratum"])


@query(f"WITH {PAIRS} SELECT stratum, count(*) AS n, round(corr(a, b), 6) AS pearson FROM p GROUP BY ALL")
def pearson(spark, sf):
    return stats.correlation(pairs(spark, sf), "a", "b", ["stratum"])


@query(f"WITH {PAIRS}, {RANKS} SELECT user_id, stratum, ra AS rank_a, rb AS rank_b FROM x")
def average_ranks(spark, sf):
    ranked = stats.average_ranks(stats.average_ranks(pairs(spark, sf), "a", ["stratum"], "rank_a"), "b", ["stratum"], "rank_b")
    return ranked.select("user_id", "stratum", "rank_a", "rank_b")


KAPPA = """, c AS (SELECT x, y, count(*) AS c FROM s GROUP BY ALL), n AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM c), mx AS (SELECT x, CAST(sum(c) AS DOUBLE) AS cx FROM c GROUP BY x), my AS (SELECT y, CAST(sum(c) AS DOUBLE) AS cy FROM c GROUP BY y)
SELECT (SELECT CAST(n AS BIGINT) FROM n) AS n, round(1 - (SELECT sum({w} * c) / max(n) FROM c, n) / (SELECT sum({w} * cx * cy) / max(n * n) FROM mx, my, n), 6) AS kappa"""


@query("WITH s AS (SELECT quality AS x, toxic AS y FROM labels)" + KAPPA.format(w="CAST(x <> y AS INT)"))
def cohen_kappa(spark, sf):
    """Agreement of the two label columns as raters."""
    return stats.kappa(table(spark, sf, "labels"), "quality", "toxic")


SCORES = "s AS (SELECT user_id, CAST(least(10, floor(max(CASE WHEN event_type = 'view' THEN value END) / 30)) AS INT) AS x, CAST(least(10, floor(max(CASE WHEN event_type = 'click' THEN value END) / 30)) AS INT) AS y FROM events GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL)"


def scores(spark, sf):
    """Scores 0 to 10 of two raters for each user."""
    def score(arm):
        return F.least(F.lit(10), F.floor(F.max(F.when(F.col("event_type") == arm, F.col("value"))) / 30)).cast("int")

    return table(spark, sf, "events").groupBy("user_id").agg(score("view").alias("x"), score("click").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


@query(f"WITH {SCORES}" + KAPPA.format(w="(x - y) * (x - y) / 100.0"))
def quadratic_kappa(spark, sf):
    return stats.kappa(scores(spark, sf), "x", "y", 10)


@query(f"WITH {SCORES} SELECT count(*) AS n, count(*) FILTER (WHERE x = y) AS equal, round(avg(CASE WHEN x = y THEN 1.0 ELSE 0 END), 6) AS share FROM s")
def exact_agreement(spark, sf):
    equal = F.col("x") == F.col("y")
    return scores(spark, sf).agg(F.count("*").alias("n"), F.count_if(equal).alias("equal"), F.round(F.avg(equal.cast("double")), 6).alias("share"))


@query(f"WITH {SCORES}, x AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s) SELECT round(corr(rx, ry), 6) AS spearman, round(avg(abs(x - y)), 6) AS mean_abs_difference FROM x")
def reliability(spark, sf):
    """Rank correlation and mean distance of two passes."""
    one = scores(spark, sf).withColumn("g", F.lit(0))
    gap = one.groupBy("g").agg(F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mean_abs_difference"))
    return stats.spearman(one, "x", "y", ["g"]).join(gap, "g").select("spearman", "mean_abs_difference")


@query("""WITH t AS (SELECT label AS test_id, CASE WHEN label = 9 THEN NULL ELSE round((count(*) % 17) / 100.0 + label / 1000.0, 6) END AS p FROM embeddings GROUP BY label),
k AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, test_id) + 1) * p) AS s FROM t WHERE p IS NOT NULL),
a AS (SELECT test_id, p, max(s) OVER (ORDER BY p, test_id ROWS UNBOUNDED PRECEDING) AS adjusted FROM k)
SELECT t.test_id, t.p, round(a.adjusted, 6) AS adjusted FROM t LEFT JOIN a USING (test_id)""")
def holm_adjust(spark, sf):
    """Holm adjustment; a null p stays null."""
    p = F.when(F.col("test_id") == 9, None).otherwise(F.round((F.col("n") % 17) / 100.0 + F.col("test_id") / 1000.0, 6))
    tests = table(spark, sf, "embeddings").groupBy(F.col("label").alias("test_id")).agg(F.count("*").alias("n")).select("test_id", p.alias("p"))
    return stats.holm(tests, "p", [], "test_id").withColumn("adjusted", F.round("adjusted", 6))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL")
def percentile_interpolated(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(stats.percentile_linear("value", 0.5), 6).alias("median"), F.round(stats.percentile_linear("value", 0.95), 6).alias("p95"))


@query(f"""WITH {PAIRS}, d AS (SELECT stratum, round(a - b, 9) AS d FROM p) SELECT stratum, count(*) AS n, round(avg(d), 6) AS mean_difference, round(avg(d) / stddev_samp(d), 6) AS dz,
count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d = 0) AS ties, count(*) FILTER (WHERE d < 0) AS losses FROM d GROUP BY ALL""")
def paired_summary(spark, sf):
    return stats.paired_summary(pairs(spark, sf), ["stratum"])


DECIDE_FULL = f"WITH {PAIRS}" + BOOT.format(keys="stratum", part="stratum", value="a - b", source="p", seed=11, name="stratum", b=20000, out="") + ", c AS (SELECT max(CASE WHEN k = 250 THEN mean END) AS low FROM o)"


@query(DECIDE_FULL + " SELECT round(low, 6) AS ci_low, low > 0 AS superior, low > -20 AS non_inferior FROM c")
def superiority_decision_full(spark, sf):
    """The same decision by 20,000 resamples."""
    d = pairs(spark, sf).withColumn("d", F.col("a") - F.col("b"))
    bounds = stats.interval(stats.bootstrap(d, "d", ["user_id"], ["stratum"], 20000, 11), [], 20000, 0.975)
    return bounds.select("ci_low", (F.col("ci_low") > 0).alias("superior"), (F.col("ci_low") > -20).alias("non_inferior"))


@query(f"WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY a, user_id) - 1 AS k, count(*) OVER (PARTITION BY stratum) // 3 AS third FROM p), u AS (SELECT stratum, CAST(CASE WHEN k < third THEN 0 WHEN k < 2 * third THEN 1 ELSE 2 END AS INT) AS tercile, a - b AS d FROM t) SELECT stratum, tercile, count(*) AS n, round(avg(d), 6) AS mean_difference FROM u GROUP BY ALL")
def terciles(spark, sf):
    t = stats.terciles(pairs(spark, sf), ["a", "user_id"], ["stratum"])
    return t.groupBy("stratum", "tercile").agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("mean_difference"))


FLIP = f"""WITH {PAIRS}, c AS (SELECT user_id // 15 AS cluster, round(avg(a - b), 6) AS d FROM p GROUP BY ALL), l AS (SELECT list(d ORDER BY d) AS d, count(*) AS n FROM c),
f AS (SELECT n, abs(list_sum(d)) AS seen, abs(list_sum(list_transform(range(0, n), lambda i: CASE WHEN (mask >> CAST(i AS INT)) & 1 = 1 THEN -d[i + 1] ELSE d[i + 1] END))) AS flipped FROM l, range(0, CAST(1 << CAST((SELECT n FROM l) AS INT) AS BIGINT)) r(mask))
SELECT CAST(n AS INT) AS n, round(max(seen) / max(n), 6) AS observed, round(avg(CASE WHEN flipped >= seen - 1e-9 THEN 1.0 ELSE 0 END), 6) AS p FROM f GROUP BY n"""


@query(FLIP)
def sign_flip_test(spark, sf):
    """Exact paired sign-flip test over clusters of 15 users."""
    c = pairs(spark, sf).groupBy(F.floor(F.col("user_id") / 15).alias("cluster")).agg(F.round(F.avg(F.col("a") - F.col("b")), 6).alias("d"))
    return stats.sign_flip(c, "d")


@query("SELECT round(max(abs(list_max(list_transform(range(1, 65), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))))), 6) AS max_abs_difference, count(*) AS pairs FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.label = b.label")
def vector_determinism(spark, sf):
    """Largest difference of two calls' vectors."""
    from siltstone.functions.vectors import doubles, max_abs_difference

    v = table(spark, sf, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("embedding").alias("other"))
    return v.join(b, ["vec_id", "label"]).agg(F.round(F.max(max_abs_difference(doubles(F.col("embedding")), doubles(F.col("other")))), 6).alias("max_abs_difference"), F.count("*").alias("pairs"))
