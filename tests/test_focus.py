from pyspark.sql import functions as F

from siltstone.plans import reviews


def test_names_are_matched_once_and_not_once_a_chunk(spark):
    counted = spark.sparkContext.accumulator(0)

    def mentions(question, name, case_sensitive=False):
        def one(q, n):
            counted.add(1)
            return n.lower() in q.lower() if not case_sensitive else n in q

        return F.udf(one, "boolean").asNondeterministic()(question, name)

    s = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("g"), F.concat(F.lit("a.f"), (F.col("id") % 4).cast("string")).alias("name"), F.lit("a.").alias("root"), F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("short"))
    q = spark.createDataFrame([(k, ["see A.F1 now", "is f2 here", "no more"][k % 3], 0) for k in range(30)], "question_id long, text string, g int")
    plain, reviews.tx.mentions = reviews.tx.mentions, mentions
    try:
        got = reviews.focus(q, s).groupBy("question_id", "tier").agg(F.count("*").alias("n"), F.min("chunk_id").alias("low")).collect()
    finally:
        reviews.tx.mentions = plain
    assert {r["question_id"]: (r["tier"], r["n"], r["low"]) for r in got} == {k: [(3, 500, 1), (1, 500, 2), (0, 2000, 0)][k % 3] for k in range(30)}
    assert counted.value <= 3 * 4 * 3
