"""Context packing over documents: sources are questions, document ids ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import context as cx
from siltstone.plans.standins import OUTCOMES, judged, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def blocks(spark, sf):
    return table(spark, sf, "documents").select("source", F.col("doc_id").alias("rank"), F.col("doc_id").alias("chunk_id"), F.length("text").cast("long").alias("chars"))


FOLD = """list_reduce(list_transform(list({{'r': doc_id, 'c': CAST(length(text) AS BIGINT)}} ORDER BY doc_id), lambda b: {{'used': b.c, 'omitted': CAST(0 AS BIGINT), 'ids': [b.r]}}),
 lambda s, b: CASE WHEN s.used + b.used <= {budget} THEN {{'used': s.used + b.used, 'omitted': s.omitted, 'ids': list_concat(s.ids, b.ids)}} ELSE {{'used': s.used, 'omitted': s.omitted + 1, 'ids': s.ids}} END,
 {{'used': CAST(0 AS BIGINT), 'omitted': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[])}})"""


@query(f"WITH p AS (SELECT source, {FOLD.format(budget=6000)} AS p FROM documents GROUP BY source) SELECT source, p.used AS total_chars, array_to_string(p.ids, ',') AS chunk_ids, p.omitted AS omitted FROM p")
def context_pack(spark, sf):
    """Greedy packing under 6000 characters that skips what does not fit."""
    return cx.pack(blocks(spark, sf), "source").withColumn("chunk_ids", F.array_join(F.col("chunk_ids").cast("array<string>"), ","))


@query(" UNION ALL ".join(f"SELECT {b} AS budget, source, p.used AS total_chars, CAST(len(p.ids) AS INT) AS n_blocks, p.omitted AS omitted FROM (SELECT source, {FOLD.format(budget=b)} AS p FROM documents GROUP BY source)" for b in (6000, 8000, 10000)))
def budget_sweep(spark, sf):
    """The same packing at three budgets."""
    from functools import reduce

    packs = [cx.pack(blocks(spark, sf), "source", b).select(F.lit(b).alias("budget"), "source", "total_chars", F.size("chunk_ids").alias("n_blocks"), "omitted") for b in (6000, 8000, 10000)]
    return reduce(lambda a, b: a.unionAll(b), packs)


@query("""WITH c AS (SELECT source, doc_id, least(length(text), 1400) AS capped FROM documents), s AS (SELECT *, 6000 - coalesce(sum(capped) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM c)
SELECT source, doc_id AS chunk_id, CAST(greatest(least(capped, rest), 0) AS BIGINT) AS taken FROM s WHERE least(capped, rest) > 0""")
def quota_pack(spark, sf):
    return cx.quota_pack(blocks(spark, sf), "source", 1400).select("source", "chunk_id", "taken")


@query("""WITH n AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, source FROM documents) SELECT source, md5(string_agg('[S' || n || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY n)) AS prompt_md5 FROM n WHERE n <= 5 GROUP BY source""")
def prompt_blocks(spark, sf):
    """The first five blocks of each source as a labelled prompt."""
    from pyspark.sql import Window

    first = table(spark, sf, "documents").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("k <= 5")
    return cx.prompt_blocks(first.withColumnRenamed("doc_id", "rank"), "source", "text").select("source", F.md5("prompt").alias("prompt_md5"))


@query(f"WITH {OUTCOMES} SELECT question_id, chunk_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY hit DESC, rank) AS INT) AS place FROM j WHERE method = 'cosine'")
def soft_focus(spark, sf):
    return cx.soft_focus(judged(spark, sf).where("method = 'cosine'"), F.col("hit")).select("question_id", "chunk_id", "place")


@query(f"""WITH {OUTCOMES}, f AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_label ORDER BY rank) AS f FROM j WHERE method = 'cosine' AND NOT hit), k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k FROM f WHERE f = 1)
SELECT question_id, chunk_id, CAST(rank AS INT) AS rank, true AS matched FROM j WHERE method = 'cosine' AND hit UNION ALL SELECT question_id, chunk_id, CAST(rank AS INT), false FROM k WHERE k <= 2""")
def soft_focus_rescue(spark, sf):
    return cx.soft_focus_rescue(judged(spark, sf).where("method = 'cosine'"), F.col("hit"), "chunk_label", 2).select("question_id", "chunk_id", "rank", "matched")


@query(f"""WITH {OUTCOMES}, t AS (SELECT question_id, chunk_id, CASE WHEN hit AND rank <= 5 THEN 3 WHEN hit THEN 2 WHEN chunk_label % 2 = label % 2 THEN 1 ELSE 0 END AS tier FROM j WHERE method = 'cosine') SELECT question_id, chunk_id, tier FROM t QUALIFY tier = max(tier) OVER (PARTITION BY question_id)""")
def named_symbol_focus(spark, sf):
    """Only rows of the best tier that a question has."""
    hit, near = F.col("hit"), F.col("chunk_label") % 2 == F.col("label") % 2
    tier = F.when(hit & (F.col("rank") <= 5), 3).when(hit, 2).when(near, 1).otherwise(0)
    return cx.best_tier(judged(spark, sf).where("method = 'cosine'"), "question_id", tier).select("question_id", "chunk_id", "tier")


@query("SELECT doc_id FROM documents WHERE NOT (length(text) > 2400 AND lang = 'en')")
def hub_filter(spark, sf):
    """Drop class overviews (English texts here) over 2400 characters."""
    return table(spark, sf, "documents").where(~((F.col("lang") == "en") & (F.length("text") > cx.HUB))).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(spark, sf):
    """The first document of each text."""
    return cx.dedupe_first(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h")), ["h"], [F.asc("doc_id")]).select("doc_id")


@query(f"""WITH {OUTCOMES}, d AS (SELECT question_id, count(DISTINCT CASE WHEN hit THEN chunk_label END) AS found, count(*) AS n_blocks FROM j WHERE method = 'cosine' AND rank <= 5 GROUP BY ALL), p AS (SELECT CASE WHEN question_id % 3 = 0 THEN NULL ELSE found / 1.0 END AS coverage, n_blocks FROM d)
SELECT count(*) AS questions, count(coverage) AS scored, round(avg(coverage), 6) AS gold_file_coverage, round(avg(n_blocks), 6) AS mean_blocks FROM p""")
def delivered_evidence_coverage(spark, sf):
    """Coverage is null, not zero, where a question has no gold (every third)."""
    d = judged(spark, sf).where("method = 'cosine' AND rank <= 5").groupBy("question_id").agg(F.countDistinct(F.when(F.col("hit"), F.col("chunk_label"))).alias("found"), F.count("*").alias("n_blocks"))
    p = d.withColumn("coverage", F.when(F.col("question_id") % 3 != 0, F.col("found") / 1.0))
    return p.agg(F.count("*").alias("questions"), F.count("coverage").alias("scored"), F.round(F.avg("coverage"), 6).alias("gold_file_coverage"), F.round(F.avg("n_blocks"), 6).alias("mean_blocks"))


@query(f"""WITH a AS (SELECT source, {FOLD.format(budget=6000)} AS p FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5 GROUP BY source), b AS (SELECT source, {FOLD.format(budget=6000)} AS p FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 10 GROUP BY source)
SELECT source, CAST(CASE WHEN len(a.p.ids) < 3 OR a.p.omitted >= 3 THEN 10 ELSE 5 END AS INT) AS depth, CAST(CASE WHEN len(a.p.ids) < 3 OR a.p.omitted >= 3 THEN len(b.p.ids) ELSE len(a.p.ids) END AS INT) AS n_blocks FROM a JOIN b USING (source)""")
def adaptive_depth(spark, sf):
    """Depth 10 where depth 5 packs under three blocks or leaves out three."""
    from pyspark.sql import Window

    ranked = blocks(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("rank")))
    a, b = cx.pack(ranked.where("k <= 5"), "source"), cx.pack(ranked.where("k <= 10"), "source").select("source", F.size("chunk_ids").alias("deep"))
    more = (F.size("chunk_ids") < 3) | (F.col("omitted") >= 3)
    return a.join(b, "source").select("source", F.when(more, 10).otherwise(5).alias("depth"), F.when(more, F.col("deep")).otherwise(F.size("chunk_ids")).alias("n_blocks"))


@query("""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, CAST(1 + floor(value / 10) AS BIGINT) AS chars, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 ELSE 0 END AS score FROM events),
s AS (SELECT *, sum(chars) OVER (PARTITION BY user_id ORDER BY line) AS c, sum(score) OVER (PARTITION BY user_id ORDER BY line) AS s FROM l),
w AS (SELECT a.user_id, a.line AS start_line, b.line AS end_line, b.s - a.s + a.score AS score, b.c - a.c + a.chars AS chars FROM s a JOIN s b ON a.user_id = b.user_id AND b.line >= a.line AND b.c - a.c + a.chars <= 40)
SELECT user_id, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, CAST(score AS BIGINT) AS score, CAST(chars AS BIGINT) AS chars FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, chars, start_line) = 1""")
def sliding_budget_window(spark, sf):
    """Best contiguous lines under a budget of 40."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    lines = e.select("user_id", line.alias("line"), (F.floor(F.col("value") / 10) + 1).cast("long").alias("chars"), F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 1).otherwise(0).cast("long").alias("score"))
    return cx.best_window(lines, "user_id", 40).select("user_id", "start_line", "end_line", "score", "chars")
