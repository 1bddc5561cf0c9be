"""From rankings and expected citations to the tables of a study: records, metrics, labels, cases, transitions, gates.

``records`` has one row for every question and method: question_id, method, first_rank, n_expected,
found_k and recall_k at DEPTHS, failed, and the columns of the questions (language, repository, category,
pair_id, side: en or fa). All functions below take such a table; a miss is a null first_rank.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import metrics as m

DEPTHS = (1, 3, 5, 10, 20)
METRICS = ("top_1", "top_3", "mrr_at_10", "evidence_recall_at_3", "evidence_recall_at_10")
GATES = ("quality", "threshold_transitions", "bilingual_stability", "multi_symbol", "performance_screen")


def records(questions: DataFrame, methods: Iterable[str], ranking: DataFrame, expected: DataFrame, failed: Column | None = None) -> DataFrame:
    """``ranking``: (question_id, method, rank, chunk_id); ``expected``: (question_id, chunk_id), each once."""
    marked = ranking.select("question_id", "method", "rank", "chunk_id").join(expected.select("question_id", "chunk_id", F.lit(True).alias("is_gold")), ["question_id", "chunk_id"], "left")
    found = [F.count_if(F.col("is_gold") & (F.col("rank") <= k)).alias(f"found_{k}") for k in DEPTHS]
    per = marked.groupBy("question_id", "method").agg(F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first_rank"), *found)
    runs = questions.select("*", F.explode(F.array(*map(F.lit, methods))).alias("method")).join(expected.groupBy("question_id").agg(F.count("*").alias("n_expected")), "question_id", "left")
    runs = runs.join(per, ["question_id", "method"], "left").withColumn("failed", F.lit(False) if failed is None else failed)
    runs = runs.withColumn("n_expected", F.coalesce("n_expected", F.lit(0))).withColumn("first_rank", F.when(~F.col("failed"), F.col("first_rank")))
    runs = runs.withColumns({f"found_{k}": F.when(F.col("failed"), 0).otherwise(F.coalesce(f"found_{k}", F.lit(0))) for k in DEPTHS})
    return runs.withColumns({f"recall_{k}": F.when(F.col("n_expected") > 0, F.col(f"found_{k}") / F.col("n_expected")).otherwise(0.0) for k in DEPTHS})


def five() -> list[Column]:
    """The five metrics that gates and comparisons look at."""
    r = F.col("first_rank")
    return [m.rate(r <= 1).alias("top_1"), m.rate(r <= 3).alias("top_3"), m.mrr(10).alias("mrr_at_10"), m.rounded(F.avg("recall_3")).alias("evidence_recall_at_3"), m.rounded(F.avg("recall_10")).alias("evidence_recall_at_10")]


def retrieval_metrics(r: DataFrame, by: list[str]) -> DataFrame:
    """Hit rates and recall at four cut-offs, MRR, rank distribution and failures."""
    at = F.col("first_rank")
    spread = {"rank_1": at == 1, "rank_2_5": at.between(2, 5), "rank_6_20": at.between(6, 20), "not_found": at.isNull() | (at > 20)}
    columns = [m.rate(at <= k).alias(f"top_{k}") for k in (1, 3, 5, 20)] + [m.rounded(F.avg(f"recall_{k}")).alias(f"recall_{k}") for k in (1, 3, 5, 20)]
    return r.groupBy(*by).agg(F.count("*").alias("questions"), F.count_if("failed").alias("failures"), *columns, m.mrr().alias("mrr"), *[F.count_if(c).alias(k) for k, c in spread.items()])


def baseline_slices(r: DataFrame, keys: list[str]) -> DataFrame:
    """The baseline row with evidence recall and failures for ``keys`` and every slice below them."""
    sets = [[], ["language"], ["repository"], ["category"], ["repository", "language"]]
    return r.groupingSets([[*keys, *s] for s in sets], *keys, "language", "repository", "category").agg(F.count("*").alias("questions"), F.count_if("failed").alias("failures"), *five())


def reached(rank: Column, at: Column | int) -> Column:
    return F.coalesce(rank <= at, F.lit(False))


def change(before: Column, after: Column, at: Column | int) -> Column:
    """repair, regression, unchanged_success or unchanged_fail at a threshold."""
    a, b = reached(before, at), reached(after, at)
    return F.when(~a & b, "repair").when(a & ~b, "regression").when(a & b, "unchanged_success").otherwise("unchanged_fail")


def sides(en: Column, fa: Column, at: Column | int) -> Column:
    a, b = reached(en, at), reached(fa, at)
    return F.when(a & b, "both").when(a, "english_only").when(b, "persian_only").otherwise("neither")


def by_threshold(rows: DataFrame) -> DataFrame:
    return rows.withColumn("threshold", F.explode(F.array(*map(F.lit, m.THRESHOLDS))))


def moved(r: DataFrame, before: Column, after: Column) -> DataFrame:
    """(question_id, method, x, y): ranks of the rows that ``after`` chooses beside those that ``before`` does."""
    x = r.where(before).select("question_id", F.col("first_rank").alias("x"))
    return r.where(after).select("question_id", "method", F.col("first_rank").alias("y")).join(x, "question_id")


def transitions(r: DataFrame, control: str) -> DataFrame:
    """How many questions every other method repairs or loses against the control, by threshold."""
    p = by_threshold(moved(r, F.col("method") == control, F.col("method") != control))
    return p.groupBy(F.col("method").alias("configuration"), "threshold", change(F.col("x"), F.col("y"), F.col("threshold")).alias("outcome")).agg(F.count("*").alias("n"))


def arm_transitions(r: DataFrame, control: str) -> DataFrame:
    """How many questions each arm recovers, improves, keeps, worsens or loses."""
    x, y = F.col("x"), F.col("y")
    kind = F.when(x.isNull() & y.isNotNull(), "recovered").when(x.isNull(), "stable").when(y.isNull(), "lost").when(y < x, "improved").when(y > x, "regressed").otherwise("stable")
    return moved(r, F.col("method") == control, F.col("method") != control).groupBy("method", kind.alias("transition")).agg(F.count("*").alias("n"))


def arm_slices(r: DataFrame, control: str, treatment: str) -> DataFrame:
    """Control, treatment and difference of the five metrics in every slice."""
    keys = ("language", "repository", "category")
    g = r.groupingSets([["method"], *[["method", k] for k in keys]], "method", *keys).agg(F.count("*").alias("questions"), *five())
    a, b = g.where(F.col("method") == control).alias("a"), g.where(F.col("method") == treatment).alias("b")
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]))
    columns = [c for x in METRICS for c in (F.col(f"a.{x}").alias(f"local_{x}"), F.col(f"b.{x}").alias(f"treatment_{x}"), (m.rounded(F.col(f"b.{x}") - F.col(f"a.{x}")) + 0.0).alias(f"delta_{x}"))]
    return both.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.questions").alias("questions"), *columns)


def pairs(r: DataFrame) -> DataFrame:
    """Both questions of each pair side by side, for every method."""
    english = F.col("side") == "en"
    side = [F.max(F.when(c, F.col(v))).alias(n) for c, v, n in ((english, "question_id", "en_id"), (~english, "question_id", "fa_id"), (english, "first_rank", "en"), (~english, "first_rank", "fa"))]
    return r.groupBy("pair_id", "method").agg(*side).where("en_id IS NOT NULL AND fa_id IS NOT NULL")


def uneven_pairs(r: DataFrame) -> DataFrame:
    """Pairs of which one question alone succeeds at some threshold."""
    return by_threshold(pairs(r)).where(sides(F.col("en"), F.col("fa"), F.col("threshold")).isin("english_only", "persian_only"))


def covered() -> Column:
    return F.when(F.col("recall_10") >= 1, "complete_evidence_coverage").when(F.col("recall_10") > 0, "partial_evidence_coverage").otherwise("complete_evidence_miss")


def hybrid_changes(r: DataFrame, hybrid: str) -> DataFrame:
    """(question_id, threshold, repaired, regressed): whether the hybrid repairs or loses a hit of any other method."""
    p = by_threshold(moved(r, F.col("method") != hybrid, F.col("method") == hybrid)).withColumn("t", change(F.col("x"), F.col("y"), F.col("threshold")))
    return p.groupBy("question_id", "threshold").agg(F.bool_or(F.col("t") == "repair").alias("repaired"), F.bool_or(F.col("t") == "regression").alias("regressed"))


def labels(r: DataFrame, hybrid: str) -> DataFrame:
    """(method, question_id, label): every diagnostic label of every record."""
    rank = F.col("first_rank")
    own = F.array_compact(F.array(
        F.when(~reached(rank, 1), "top1_miss"), F.when(~reached(rank, 3), "top3_miss"), F.when(rank.between(4, 10), "late_relevant"),
        F.when(~reached(rank, 10), "miss_at_10"), F.when(F.col("n_expected") > 1, covered()),
    ))
    changed = hybrid_changes(r, hybrid)
    parts = [
        r.select("method", "question_id", F.explode(own).alias("label")),
        uneven_pairs(r).select("method", F.explode(F.array("en_id", "fa_id")).alias("question_id"), F.lit("bilingual_disagreement").alias("label")),
        *[changed.where(c).select(F.lit(hybrid).alias("method"), "question_id", F.concat(F.lit(f"hybrid_{n}_top_"), F.col("threshold").cast("string")).alias("label")) for c, n in (("repaired", "repair"), ("regressed", "regression"))],
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def bilingual_change(r: DataFrame, candidate: str, control: str) -> DataFrame:
    """(pair_id, threshold, label) of a candidate against the control; labels may overlap."""
    p = pairs(r)
    a = p.where(F.col("method") == control).select("pair_id", F.col("en").alias("en_a"), F.col("fa").alias("fa_a"))
    b = p.where(F.col("method") == candidate).select("pair_id", F.col("en").alias("en_b"), F.col("fa").alias("fa_b"))
    t = F.col("threshold")
    x = by_threshold(a.join(b, "pair_id")).withColumns({"te": change(F.col("en_a"), F.col("en_b"), t), "tf": change(F.col("fa_a"), F.col("fa_b"), t), "before": sides(F.col("en_a"), F.col("fa_a"), t), "after": sides(F.col("en_b"), F.col("fa_b"), t)})
    te, tf, one, two = F.col("te"), F.col("tf"), F.col("before").endswith("_only"), F.col("after").endswith("_only")
    still_e, still_f = te.startswith("unchanged"), tf.startswith("unchanged")
    found = F.array_compact(F.array(
        F.when((te == "repair") & (tf == "repair"), "both_repaired"), F.when((tf == "repair") & still_e, "fa_repaired_en_unchanged"), F.when((te == "repair") & still_f, "en_repaired_fa_unchanged"),
        F.when(one & ~two, "resolved_disagreement"), F.when(~one & two, "new_disagreement"),
        F.when((te == "regression") & (tf == "regression"), "both_regression").when(te == "regression", "en_regression").when(tf == "regression", "fa_regression"),
        F.when((F.col("before") == F.col("after")) & still_e & still_f, "unchanged_agreement"),
    ))
    return x.select("pair_id", "threshold", F.explode(found).alias("label"))


def review_cases(r: DataFrame, hybrid: str) -> DataFrame:
    """The five types of cases that a reviewer has to look at, with composite ids."""

    def case(rows: DataFrame, kind: str, identity: str, scope: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("review_type"), F.col(identity).cast("string").alias("identity"), scope.alias("scope"))

    method = F.col("method")
    late = r.where("first_rank BETWEEN 4 AND 10").withColumn("worst", F.max("first_rank").over(Window.partitionBy("repository", "method"))).where("first_rank = worst")
    late = late.groupBy("repository", "method").agg(F.min("question_id").alias("question_id"))
    parts = [
        case(r.where(~reached(F.col("first_rank"), 10)), "miss_at_10", "question_id", method), case(hybrid_changes(r, hybrid).where("regressed").select("question_id").distinct(), "hybrid_regression", "question_id", F.lit("hybrid")),
        case(uneven_pairs(r).select("pair_id", "method").distinct(), "bilingual_disagreement", "pair_id", method), case(r.where("n_expected > 1 AND recall_10 < 1"), "incomplete_multi_symbol", "question_id", method),
        case(late, "representative_late_relevant", "question_id", method),
    ]
    return reduce(DataFrame.unionByName, parts).select(F.concat_ws(":", "review_type", "identity", "scope").alias("review_case_id"), "review_type", "scope")


def gates(r: DataFrame, candidate: str, control: str) -> DataFrame:
    """One row: the five gates of a candidate against the control (needs latency_ms). Each side is one aggregated row, so the joins are of single rows."""

    def at(name: str, side: str) -> Column:
        return F.max(F.when(F.col("method") == side, F.col(name)))

    g = r.groupBy("method").agg(*five(), F.round(F.avg("latency_ms"), 3).alias("mean_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms"))
    keeps = reduce(lambda a, b: a & b, [at(x, candidate) >= at(x, control) for x in METRICS])
    gains = reduce(lambda a, b: a | b, [at(x, candidate) > at(x, control) for x in METRICS])
    one = g.agg((keeps & gains).alias("quality"), ((at("mean_ms", candidate) <= 1.25 * at("mean_ms", control)) & (at("p95_ms", candidate) <= 1.5 * at("p95_ms", control))).alias("performance_screen"))
    t = by_threshold(moved(r, F.col("method") == control, F.col("method") == candidate)).withColumn("t", change(F.col("x"), F.col("y"), F.col("threshold")))
    two = t.groupBy("threshold").agg((F.count_if(F.col("t") == "repair") >= F.count_if(F.col("t") == "regression")).alias("ok")).agg(F.bool_and("ok").alias("threshold_transitions"))
    language = r.groupBy("language").agg(*[m.rounded(F.avg(F.when(F.col("method") == s, reached(F.col("first_rank"), 3).cast("double")))).alias(n) for n, s in (("k", candidate), ("c", control))])
    three = language.agg(F.bool_and(F.col("k") >= F.col("c")).alias("stable"))
    four = bilingual_change(r, candidate, control).agg((F.count_if(F.col("label") == "new_disagreement") <= F.count_if(F.col("label") == "resolved_disagreement")).alias("settled"))
    several = r.where("n_expected > 1").withColumn("c", covered()).groupBy("method").agg(F.count_if(F.col("c") == "complete_evidence_coverage").alias("complete"), F.count_if(F.col("c") == "complete_evidence_miss").alias("missed"), m.rounded(F.avg("recall_10")).alias("mean_recall"))
    holds = (at("complete", candidate) >= at("complete", control)) & (at("missed", candidate) <= at("missed", control)) & (at("mean_recall", candidate) >= at("mean_recall", control))
    fifth = several.agg(F.coalesce(holds, F.lit(True)).alias("multi_symbol"))
    rows = reduce(lambda a, b: a.crossJoin(b), [one, two, three, four, fifth])
    judged = rows.select(F.lit(candidate).alias("configuration"), "quality", "threshold_transitions", (F.col("stable") & F.col("settled")).alias("bilingual_stability"), "multi_symbol", "performance_screen")
    return judged.withColumn("passes_all", reduce(lambda a, b: a & b, [F.col(x) for x in GATES]))


def study(r: DataFrame, control: str, hybrid: str) -> dict[str, DataFrame]:
    """All tables of a study out of its records."""
    return {
        "records": r, "metrics": retrieval_metrics(r, ["method"]), "slices": baseline_slices(r, ["method"]), "labels": labels(r, hybrid), "transitions": transitions(r, control), "arms": arm_slices(r, control, hybrid),
        "arm_transitions": arm_transitions(r, control), "pairs": pairs(r), "bilingual_labels": bilingual_change(r, hybrid, control), "review_cases": review_cases(r, hybrid),
    }
