import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from siltstone.operators import rank
from siltstone.plans import registry

SCHEMA = T.StructType([T.StructField("question_id", T.LongType()), T.StructField("chunk_id", T.LongType()), T.StructField("score", T.DoubleType())])


def peak(run, batches):
    tracemalloc.start()
    rows = [r for b in run(iter(batches)) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most


def test_matches_of_frequent_terms_are_counted_in_parts():
    words = [f"w{k}" for k in range(100)]
    run = rank._term_scores([(q, words[: 50 + q % 50]) for q in range(300)], [1], ["chunk_id"], 3, SCHEMA)
    batch = pa.record_batch({"chunk_id": pa.array(range(1000)), "terms": pa.array([words[c % 10 :] for c in range(1000)])})
    rows, most = peak(run, [batch])
    assert most < 100 << 20 and len(rows) == 900
    assert {(r["question_id"], r["chunk_id"], r["score"]) for r in rows if r["question_id"] == 7} == {(7, 0, 57.0), (7, 10, 57.0), (7, 20, 57.0)}


def test_tables_of_scores_are_bounded_and_keep_the_best():
    random = np.random.default_rng(3)
    block, rows = random.normal(size=(4096, 4)), random.normal(size=(4000, 4))
    run = rank._block_scores(list(range(4096)), block, "dot", 2, ["chunk_id"], SCHEMA)
    batches = [pa.record_batch({"chunk_id": pa.array(range(a, a + 2000)), "vector": pa.array(list(rows[a : a + 2000]))}) for a in (0, 2000)]
    found, most = peak(run, batches)
    assert most < 120 << 20
    want = np.sort(np.round(block @ rows.T, 9), axis=1)[:, ::-1][:, :3]
    assert np.array_equal(np.array([r["score"] for r in found]).reshape(4096, 3), want)


def test_queries_send_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    registry.queries()["tokenize"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
