"""The driver's tables in the roles of the engine's tables, and the same as SQL fragments.

Queries of a search are the rows whose id is divisible by 20, against all rows; gold is the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import rank
from siltstone.operators.metrics import first_relevant


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def rankings(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """(question_id, method, rank, chunk_id, score) of cosine and l2 search and their fusion."""
    v = vectors(spark, sf_dir)
    q = v.where("chunk_id % 20 = 0")
    cosine, l2 = rank.semantic(q, v, k, "cosine"), rank.semantic(q, v, k, "l2")
    named = [r.select("question_id", F.lit(m).alias("method"), "rank", "chunk_id", "score") for m, r in (("cosine", cosine), ("l2", l2), ("fused", rank.fuse(cosine, l2, k)))]
    return named[0].unionAll(named[1]).unionAll(named[2])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their slices."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("question_id"), "label", F.when(label % 2 == 0, "en").otherwise("fa").alias("language"),
        F.concat(F.lit("r"), (label % 3).cast("string")).alias("repository"), F.concat(F.lit("c"), (label % 4).cast("string")).alias("category"),
        (F.col("vec_id") / 40).cast("long").alias("pair_id"),
    )


def judged(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Rankings with whether the row is relevant."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("chunk_label"))
    asked = questions(spark, sf_dir)
    return rankings(spark, sf_dir, k).join(labels, "chunk_id").join(asked, "question_id").withColumn("hit", F.col("chunk_label") == F.col("label"))


def outcomes(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """One row for every question and method, with first_rank and slices."""
    methods = F.explode(F.array(F.lit("cosine"), F.lit("l2"), F.lit("fused")))
    return first_relevant(judged(spark, sf_dir, k), F.col("hit"), questions(spark, sf_dir).withColumn("method", methods))


RANKINGS = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
sim AS (
  SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.e, v.e), 9) AS cosine, round(-list_distance(q.e, v.e), 9) AS l2
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
one AS (
  SELECT question_id, 'cosine' AS method, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, chunk_id) AS rank, chunk_id, cosine AS score FROM sim
  UNION ALL SELECT question_id, 'l2', row_number() OVER (PARTITION BY question_id ORDER BY l2 DESC, chunk_id), chunk_id, l2 FROM sim),
two AS (SELECT * FROM one WHERE rank <= 20),
fus AS (
  SELECT question_id, chunk_id, round(coalesce(max(CASE WHEN method = 'cosine' THEN 1.0 / (60 + rank) END), 0) + coalesce(max(CASE WHEN method = 'l2' THEN 1.0 / (60 + rank) END), 0), 12) AS score
  FROM two GROUP BY ALL),
r AS (
  SELECT * FROM two UNION ALL
  SELECT * FROM (SELECT question_id, 'fused' AS method, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM fus) WHERE rank <= 20)"""

OUTCOMES = (
    RANKINGS
    + """,
qs AS (
  SELECT vec_id AS question_id, label, CASE WHEN label % 2 = 0 THEN 'en' ELSE 'fa' END AS language, 'r' || (label % 3) AS repository, 'c' || (label % 4) AS category, vec_id // 40 AS pair_id
  FROM embeddings WHERE vec_id % 20 = 0),
j AS (SELECT r.*, e.label AS chunk_label, qs.label, qs.language, qs.repository, qs.category, e.label = qs.label AS hit FROM r JOIN embeddings e ON e.vec_id = r.chunk_id JOIN qs USING (question_id)),
o AS (
  SELECT qs.*, m.method, (SELECT min(j.rank) FROM j WHERE j.question_id = qs.question_id AND j.method = m.method AND j.hit) AS first_rank
  FROM qs CROSS JOIN (VALUES ('cosine'), ('l2'), ('fused')) m(method))"""
)
