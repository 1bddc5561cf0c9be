"""Whole assessments of retrieval runs: all metrics, labels, cases and gates of a study, out of one table of records.

Questions, slices and rankings are those of ``standins``. The expected citations of a question are
the vectors of its label among the 60 ids before and behind it; ``l2`` runs of every seventh question
count as failed. ``cosine`` stands for the lexical method and control, ``l2`` for the semantic, ``fused``
for the hybrid method and candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import assess, rank, variants
from siltstone.operators import metrics as m
from siltstone.operators.assess import DEPTHS, GATES, METRICS
from siltstone.plans.standins import OUTCOMES, RANKINGS, judged, questions, table, vectors
from siltstone.runtime import stage_table

QUERIES, SQL = {}, {}
NEAR = 60


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, chunk_id) of the expected citations."""
    near = questions(spark, sf_dir).select("question_id", "label", F.explode(F.sequence(F.col("question_id") - NEAR, F.col("question_id") + NEAR)).alias("chunk_id")).where("chunk_id <> question_id")
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return near.join(labels, ["chunk_id", "label"]).select("question_id", "chunk_id")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the three methods, with a made-up latency."""
    asked = questions(spark, sf_dir).withColumn("side", F.when(F.col("question_id") % 40 == 0, "en").otherwise("fa"))
    failed = (F.col("method") == "l2") & (F.col("question_id") % 140 == 20)
    r = assess.records(asked, ("cosine", "l2", "fused"), judged(spark, sf_dir), expected(spark, sf_dir), failed)
    return r.withColumn("latency_ms", 10.0 + (F.col("question_id") / 20 * 7).cast("long") % 23 + F.length("method"))


RECORDS = f"""{OUTCOMES},
gold AS (SELECT q.vec_id AS question_id, e.vec_id AS chunk_id FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id AND e.vec_id BETWEEN q.vec_id - {NEAR} AND q.vec_id + {NEAR} WHERE q.vec_id % 20 = 0),
n AS (SELECT question_id, count(*) AS n_expected FROM gold GROUP BY ALL),
per AS (SELECT r.question_id, r.method, min(r.rank) AS first_rank, {", ".join(f"count(*) FILTER (WHERE r.rank <= {k}) AS found_{k}" for k in DEPTHS)} FROM r JOIN gold USING (question_id, chunk_id) GROUP BY ALL),
runs AS (SELECT qs.*, x.method, coalesce(n_expected, 0) AS n_expected, x.method = 'l2' AND qs.question_id % 140 = 20 AS failed, p.first_rank AS fr, {", ".join(f"coalesce(p.found_{k}, 0) AS f{k}" for k in DEPTHS)}
  FROM qs CROSS JOIN (VALUES ('cosine'), ('l2'), ('fused')) x(method) LEFT JOIN n USING (question_id) LEFT JOIN per p ON p.question_id = qs.question_id AND p.method = x.method),
rec AS (SELECT * EXCLUDE (fr, {", ".join(f"f{k}" for k in DEPTHS)}), CASE WHEN NOT failed THEN fr END AS first_rank, {", ".join(f"CASE WHEN failed OR n_expected = 0 THEN 0.0 ELSE f{k} / CAST(n_expected AS DOUBLE) END AS recall_{k}" for k in DEPTHS)},
  CAST(10 + question_id // 20 * 7 % 23 + length(method) AS DOUBLE) AS latency_ms FROM runs)"""

SHARE = "round(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0 END), 6) AS top_{k}"
FIVE = f"{SHARE.format(k=1)}, {SHARE.format(k=3)}, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0 END), 6) AS mrr_at_10, round(avg(recall_3), 6) AS evidence_recall_at_3, round(avg(recall_10), 6) AS evidence_recall_at_10"


@query(f"""WITH {RECORDS} SELECT method, count(*) AS questions, count(*) FILTER (WHERE failed) AS failures, {", ".join(SHARE.format(k=k) for k in (1, 3, 5, 20))}, {", ".join(f"round(avg(recall_{k}), 6) AS recall_{k}" for k in (1, 3, 5, 20))},
round(avg(CASE WHEN first_rank IS NOT NULL THEN 1.0 / first_rank ELSE 0 END), 6) AS mrr, count(*) FILTER (WHERE first_rank = 1) AS rank_1, count(*) FILTER (WHERE first_rank BETWEEN 2 AND 5) AS rank_2_5, count(*) FILTER (WHERE first_rank BETWEEN 6 AND 20) AS rank_6_20, count(*) FILTER (WHERE first_rank IS NULL OR first_rank > 20) AS not_found FROM rec GROUP BY method""")
def retrieval_metrics_full(spark, sf):
    """Hit rates and recall at four cut-offs, MRR, rank distribution and failures of each method."""
    return assess.retrieval_metrics(records(spark, sf), ["method"])


CONFIGURED = f"WITH {RECORDS}, cfg AS (SELECT 'depth_20' AS configuration, * FROM rec UNION ALL SELECT 'depth_5', * REPLACE (CASE WHEN first_rank <= 5 THEN first_rank END AS first_rank, recall_5 AS recall_10) FROM rec)"


@query(f"""{CONFIGURED} SELECT configuration, method, language, repository, category, count(*) AS questions, count(*) FILTER (WHERE failed) AS failures, {FIVE} FROM cfg
GROUP BY GROUPING SETS ((configuration, method), (configuration, method, language), (configuration, method, repository), (configuration, method, category), (configuration, method, repository, language))""")
def baseline_by_configuration(spark, sf):
    """The baseline row with evidence recall and failures, for all slices of every configuration and method."""
    r = records(spark, sf)
    shallow = r.withColumn("first_rank", F.when(F.col("first_rank") <= 5, F.col("first_rank"))).withColumn("recall_10", F.col("recall_5"))
    both = r.withColumn("configuration", F.lit("depth_20")).unionByName(shallow.withColumn("configuration", F.lit("depth_5")))
    return assess.baseline_slices(both, ["configuration", "method"])


CHANGE = "CASE WHEN NOT coalesce({a} <= {t}, false) AND coalesce({b} <= {t}, false) THEN 'repair' WHEN coalesce({a} <= {t}, false) AND NOT coalesce({b} <= {t}, false) THEN 'regression' WHEN coalesce({a} <= {t}, false) THEN 'unchanged_success' ELSE 'unchanged_fail' END"
SIDES = "CASE WHEN coalesce({a} <= {t}, false) AND coalesce({b} <= {t}, false) THEN 'both' WHEN coalesce({a} <= {t}, false) THEN 'english_only' WHEN coalesce({b} <= {t}, false) THEN 'persian_only' ELSE 'neither' END"


@query(f"""WITH {RECORDS}, p AS (SELECT b.method AS configuration, a.first_rank AS x, b.first_rank AS y FROM rec a JOIN rec b USING (question_id) WHERE a.method = 'cosine' AND b.method <> 'cosine')
SELECT configuration, threshold, {CHANGE.format(a="x", b="y", t="threshold")} AS outcome, count(*) AS n FROM p CROSS JOIN (VALUES (1), (3), (10)) v(threshold) GROUP BY ALL""")
def experiment_transitions_full(spark, sf):
    """Transitions of every configuration against the control at each threshold."""
    return assess.transitions(records(spark, sf), "cosine")


PAIRS = """pr AS (SELECT pair_id, method, max(CASE WHEN question_id % 40 = 0 THEN question_id END) AS en_id, max(CASE WHEN question_id % 40 <> 0 THEN question_id END) AS fa_id,
  max(CASE WHEN question_id % 40 = 0 THEN first_rank END) AS en, max(CASE WHEN question_id % 40 <> 0 THEN first_rank END) AS fa FROM rec GROUP BY ALL HAVING en_id IS NOT NULL AND fa_id IS NOT NULL)"""


COVERAGE = "CASE WHEN recall_10 >= 1 THEN 'complete_evidence_coverage' WHEN recall_10 > 0 THEN 'partial_evidence_coverage' ELSE 'complete_evidence_miss' END"


BASES = "hy AS (SELECT h.question_id, threshold, bool_or(t = 'repair') AS repaired, bool_or(t = 'regression') AS regressed FROM (SELECT b.question_id, threshold, " + CHANGE.format(a="a.first_rank", b="b.first_rank", t="threshold") + " AS t FROM rec a JOIN rec b USING (question_id) CROSS JOIN (VALUES (1), (3), (10)) v(threshold) WHERE a.method <> 'fused' AND b.method = 'fused') h GROUP BY ALL)"


@query(f"""WITH {RECORDS}, {PAIRS}, {BASES}, l AS (
SELECT method, question_id, unnest(list_filter([CASE WHEN first_rank IS NULL OR first_rank > 1 THEN 'top1_miss' END, CASE WHEN first_rank IS NULL OR first_rank > 3 THEN 'top3_miss' END, CASE WHEN first_rank BETWEEN 4 AND 10 THEN 'late_relevant' END,
  CASE WHEN first_rank IS NULL OR first_rank > 10 THEN 'miss_at_10' END, CASE WHEN n_expected > 1 THEN {COVERAGE} END], lambda x: x IS NOT NULL)) AS label FROM rec
UNION SELECT method, unnest([en_id, fa_id]), 'bilingual_disagreement' FROM pr CROSS JOIN (VALUES (1), (3), (10)) v(threshold) WHERE {SIDES.format(a="en", b="fa", t="threshold")} IN ('english_only', 'persian_only')
UNION SELECT 'fused', question_id, 'hybrid_repair_top_' || threshold FROM hy WHERE repaired
UNION SELECT 'fused', question_id, 'hybrid_regression_top_' || threshold FROM hy WHERE regressed)
SELECT method, label, count(*) AS n FROM l GROUP BY ALL""")
def diagnostic_labels_full(spark, sf):
    """Every diagnostic label of a record, counted by method."""
    return assess.labels(records(spark, sf), "fused").groupBy("method", "label").agg(F.count("*").alias("n"))


BILINGUAL_LABELS = f"""bp AS (SELECT a.pair_id, threshold, {CHANGE.format(a="a.en", b="b.en", t="threshold")} AS te, {CHANGE.format(a="a.fa", b="b.fa", t="threshold")} AS tf, {SIDES.format(a="a.en", b="a.fa", t="threshold")} AS before, {SIDES.format(a="b.en", b="b.fa", t="threshold")} AS after
  FROM pr a JOIN pr b USING (pair_id) CROSS JOIN (VALUES (1), (3), (10)) v(threshold) WHERE a.method = 'cosine' AND b.method = '{{candidate}}'),
bl AS (SELECT pair_id, threshold, unnest(list_filter([CASE WHEN te = 'repair' AND tf = 'repair' THEN 'both_repaired' END, CASE WHEN tf = 'repair' AND te LIKE 'unchanged%' THEN 'fa_repaired_en_unchanged' END, CASE WHEN te = 'repair' AND tf LIKE 'unchanged%' THEN 'en_repaired_fa_unchanged' END,
  CASE WHEN before LIKE '%_only' AND after NOT LIKE '%_only' THEN 'resolved_disagreement' END, CASE WHEN before NOT LIKE '%_only' AND after LIKE '%_only' THEN 'new_disagreement' END,
  CASE WHEN te = 'regression' AND tf = 'regression' THEN 'both_regression' WHEN te = 'regression' THEN 'en_regression' WHEN tf = 'regression' THEN 'fa_regression' END,
  CASE WHEN before = after AND te LIKE 'unchanged%' AND tf LIKE 'unchanged%' THEN 'unchanged_agreement' END], lambda x: x IS NOT NULL)) AS label FROM bp)"""


@query(f"WITH {RECORDS}, {PAIRS}, {BILINGUAL_LABELS.format(candidate='fused')} SELECT threshold, label, count(*) AS n FROM bl GROUP BY ALL")
def bilingual_labels_full(spark, sf):
    """All labels of what a candidate changes for pairs of questions, by threshold."""
    return assess.bilingual_change(records(spark, sf), "fused", "cosine").groupBy("threshold", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {RECORDS}, {PAIRS}, {BASES}, c AS (
SELECT 'miss_at_10' AS review_type, CAST(question_id AS VARCHAR) AS identity, method AS scope FROM rec WHERE first_rank IS NULL OR first_rank > 10
UNION ALL SELECT 'hybrid_regression', CAST(question_id AS VARCHAR), 'hybrid' FROM hy GROUP BY question_id HAVING bool_or(regressed)
UNION ALL SELECT 'bilingual_disagreement', CAST(pair_id AS VARCHAR), method FROM pr CROSS JOIN (VALUES (1), (3), (10)) v(threshold) GROUP BY pair_id, method HAVING bool_or({SIDES.format(a="en", b="fa", t="threshold")} IN ('english_only', 'persian_only'))
UNION ALL SELECT 'incomplete_multi_symbol', CAST(question_id AS VARCHAR), method FROM rec WHERE n_expected > 1 AND recall_10 < 1
UNION ALL SELECT 'representative_late_relevant', CAST(question_id AS VARCHAR), method FROM (SELECT *, row_number() OVER (PARTITION BY repository, method ORDER BY first_rank DESC, question_id) AS k FROM rec WHERE first_rank BETWEEN 4 AND 10) WHERE k = 1)
SELECT review_type || ':' || identity || ':' || scope AS review_case_id, review_type, scope FROM c""")
def review_cases_full(spark, sf):
    """The five types of cases that a reviewer has to look at, with composite ids."""
    return assess.review_cases(records(spark, sf), "fused")


MULTI = f"mu AS (SELECT method, count(*) AS n, count(*) FILTER (WHERE {COVERAGE} = 'complete_evidence_coverage') AS complete, count(*) FILTER (WHERE {COVERAGE} = 'complete_evidence_miss') AS missed, round(avg(recall_10), 6) AS mean_recall FROM rec WHERE n_expected > 1 GROUP BY method)"


def gate_sql(candidate: str) -> str:
    return f"""WITH {RECORDS}, {PAIRS}, {BILINGUAL_LABELS.format(candidate=candidate)}, {MULTI},
g AS (SELECT method, {FIVE}, round(avg(latency_ms), 3) AS mean_ms, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_ms FROM rec GROUP BY method),
tr AS (SELECT threshold, {CHANGE.format(a="a.first_rank", b="b.first_rank", t="threshold")} AS t FROM rec a JOIN rec b USING (question_id) CROSS JOIN (VALUES (1), (3), (10)) v(threshold) WHERE a.method = 'cosine' AND b.method = '{candidate}'),
la AS (SELECT method, language, {SHARE.format(k=3)} FROM rec GROUP BY ALL)
SELECT '{candidate}' AS configuration, {" AND ".join(f"k.{x} >= c.{x}" for x in METRICS)} AND ({" OR ".join(f"k.{x} > c.{x}" for x in METRICS)}) AS quality,
 (SELECT bool_and(up >= down) FROM (SELECT count(*) FILTER (WHERE t = 'repair') AS up, count(*) FILTER (WHERE t = 'regression') AS down FROM tr GROUP BY threshold)) AS threshold_transitions,
 (SELECT bool_and(b.top_3 >= a.top_3) FROM la a JOIN la b USING (language) WHERE a.method = 'cosine' AND b.method = '{candidate}') AND (SELECT count(*) FILTER (WHERE label = 'new_disagreement') <= count(*) FILTER (WHERE label = 'resolved_disagreement') FROM bl) AS bilingual_stability,
 coalesce(km.complete >= cm.complete AND km.missed <= cm.missed AND km.mean_recall >= cm.mean_recall, true) AS multi_symbol, k.mean_ms <= 1.25 * c.mean_ms AND k.p95_ms <= 1.5 * c.p95_ms AS performance_screen
FROM g k JOIN g c ON k.method = '{candidate}' AND c.method = 'cosine' LEFT JOIN mu km ON km.method = '{candidate}' LEFT JOIN mu cm ON cm.method = 'cosine'"""


@query("SELECT *, " + " AND ".join(GATES) + " AS passes_all FROM (" + gate_sql("fused") + ") UNION ALL SELECT *, " + " AND ".join(GATES) + " FROM (" + gate_sql("l2") + ")")
def selection_gates_full(spark, sf):
    """Five gates of each candidate: quality, transitions, bilingual stability, several symbols, latency."""
    r = records(spark, sf)
    return assess.gates(r, "fused", "cosine").unionByName(assess.gates(r, "l2", "cosine"))


@query(f"""WITH {RECORDS}, g AS (SELECT method, language, repository, category, count(*) AS questions, {FIVE} FROM rec GROUP BY GROUPING SETS ((method), (method, language), (method, repository), (method, category)))
SELECT a.language, a.repository, a.category, a.questions, {", ".join(f"a.{x} AS local_{x}, b.{x} AS treatment_{x}, round(b.{x} - a.{x}, 6) + 0.0 AS delta_{x}" for x in METRICS)}
FROM g a JOIN g b ON a.language IS NOT DISTINCT FROM b.language AND a.repository IS NOT DISTINCT FROM b.repository AND a.category IS NOT DISTINCT FROM b.category WHERE a.method = 'cosine' AND b.method = 'fused'""")
def arm_slices(spark, sf):
    """Control, treatment and difference of the five metrics in every slice."""
    return assess.arm_slices(records(spark, sf), "cosine", "fused")


@query(f"""WITH {RECORDS}, p AS (SELECT b.method, a.first_rank AS x, b.first_rank AS y FROM rec a JOIN rec b USING (question_id) WHERE a.method = 'cosine' AND b.method <> 'cosine')
SELECT method, CASE WHEN x IS NULL THEN CASE WHEN y IS NOT NULL THEN 'recovered' ELSE 'stable' END WHEN y IS NULL THEN 'lost' WHEN y < x THEN 'improved' WHEN y > x THEN 'regressed' ELSE 'stable' END AS transition, count(*) AS n FROM p GROUP BY ALL""")
def arm_transitions(spark, sf):
    """How many questions each arm recovers, improves, keeps, worsens or loses."""
    return assess.arm_transitions(records(spark, sf), "cosine")


@query(f"""WITH {RECORDS} SELECT method AS arm, count(*) AS runs, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE NOT failed) AS ok, CAST(sum(n_expected * 100) AS BIGINT) AS tokens, round(sum(n_expected) * CAST(0.25 AS DOUBLE), 6) AS cost,
round(median(latency_ms), 6) AS median_ms, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_ms, round(avg(CASE WHEN NOT failed AND n_expected > 0 THEN recall_10 END), 6) AS mean_gold_recall FROM rec GROUP BY method""")
def ablation_arm_full(spark, sf):
    """Status counts, tokens, cost, latency and mean gold recall of each arm."""
    recall = F.avg(F.when(~F.col("failed") & (F.col("n_expected") > 0), F.col("recall_10")))
    return records(spark, sf).groupBy(F.col("method").alias("arm")).agg(
        F.count("*").alias("runs"), F.count_if("failed").alias("failed"), F.count_if(~F.col("failed")).alias("ok"), F.sum(F.col("n_expected") * 100).alias("tokens"), F.round(F.sum("n_expected") * 0.25, 6).alias("cost"),
        F.round(F.median("latency_ms"), 6).alias("median_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms"), m.rounded(recall).alias("mean_gold_recall"),
    )


SOURCES = (("top_1", "e1"), ("top_3", "e2"), ("top_10", "e3"))


@query(f"WITH {RECORDS}, {PAIRS} " + " UNION ALL ".join(f"SELECT '{name}' AS source_experiment_id, pair_id, method, {SIDES.format(a='en', b='fa', t=threshold[4:])} AS outcome FROM pr" for threshold, name in SOURCES))
def transform_union(spark, sf):
    """The pair records of three experiments in one table, with where they come from."""
    p = assess.pairs(records(spark, sf))
    parts = [p.select(F.lit(name).alias("source_experiment_id"), "pair_id", "method", assess.sides(F.col("en"), F.col("fa"), int(threshold[4:])).alias("outcome")) for threshold, name in SOURCES]
    return reduce(DataFrame.unionByName, parts)


# Context variants over the first 50 rows by cosine; blocks are the documents, gold files the sources of a question and of the next two documents

STORED = f"""{RANKINGS.replace("WHERE rank <= 20)", "WHERE rank <= 50)", 1)},
k AS (SELECT question_id, rank, chunk_id, d.source AS file, CAST(length(coalesce(d.text, '')) AS BIGINT) AS chars FROM two JOIN documents d ON d.doc_id = chunk_id WHERE method = 'cosine'),
g AS (SELECT DISTINCT e.vec_id AS question_id, d.source AS file FROM embeddings e JOIN documents d ON d.doc_id BETWEEN e.vec_id AND e.vec_id + 2 WHERE e.vec_id % 20 = 0 AND d.source IS NOT NULL)"""


def _stored(spark, sf):
    """The ranking (question_id, rank, chunk_id, file, chars) of depth 50, staged once, and the gold files."""
    v = vectors(spark, sf).select("chunk_id", "vector")
    found = rank.semantic(v.where("chunk_id % 20 = 0"), v, 50).select("question_id", "rank", "chunk_id")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    near = F.explode(F.array(*[F.col("chunk_id") + k for k in range(3)])).alias("near")
    gold = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("question_id"), near).join(d.select(F.col("chunk_id").alias("near"), "file"), "near").select("question_id", "file")
    return stage_table(found.join(d, "chunk_id"), "ranking"), gold


@query(f"""WITH {STORED}, vs(variant, depth, per_file, budget) AS (VALUES {", ".join(f"('{v.name}', {v.depth}, {v.per_file}, {v.budget})" for v in variants.GATE)}),
m AS (SELECT vs.*, k.*, row_number() OVER (PARTITION BY question_id, variant, coalesce(file, chr(1) || chunk_id) ORDER BY rank) AS turn FROM k JOIN vs ON rank <= depth),
f AS (SELECT question_id, variant, list_reduce(list_transform(list({{'r': rank, 'c': chars, 'f': file}} ORDER BY rank), lambda b: {{'used': b.c, 'n': CAST(1 AS BIGINT), 'files': [b.f], 'budget': CAST(0 AS BIGINT)}}),
 lambda s, b: CASE WHEN s.used + b.used <= s.budget THEN {{'used': s.used + b.used, 'n': s.n + 1, 'files': list_concat(s.files, b.files), 'budget': s.budget}} ELSE s END,
 {{'used': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'files': CAST([] AS VARCHAR[]), 'budget': CAST(any_value(budget) AS BIGINT)}}) AS p FROM m WHERE per_file = 0 OR turn <= per_file GROUP BY question_id, variant),
w AS (SELECT question_id, list(file) AS files FROM g GROUP BY question_id),
u AS (SELECT w.question_id, vs.variant, len(w.files) AS gold, len(list_intersect(w.files, coalesce(f.p.files, []))) AS found, coalesce(f.p.n, 0) AS blocks, coalesce(f.p.used, 0) AS total FROM w CROSS JOIN vs LEFT JOIN f ON f.question_id = w.question_id AND f.variant = vs.variant)
SELECT variant, count(*) AS questions, round(avg(found / gold), 6) AS mean_coverage, count(*) FILTER (WHERE found = gold) AS complete, round(avg(blocks), 6) AS mean_blocks, round(avg(total), 6) AS mean_chars FROM u GROUP BY variant""")
def context_variants(spark, sf):
    """Coverage of eight packings of one stored ranking."""
    return variants.summary(variants.coverage(*_stored(spark, sf)))


@query(None)
def context_variant_gate(spark, sf):
    """Differences of seven variants from the control, with paired intervals of 20,000 resamples."""
    return variants.differences(stage_table(variants.coverage(*_stored(spark, sf)), "units"), "control")
