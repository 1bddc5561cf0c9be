"""Retrieval at depths beyond 20."""

import math

from siltstone.plans import registry


def test_a_hit_between_21_and_50_counts(spark, tmp_path):
    # Only vector 0 is a question; number k is its k-th nearest by both measures, and only number 30 has its label.
    rows = [(20 * k + (k > 0), [math.cos(k / 100), math.sin(k / 100)], 1 if k in (0, 30) else 2) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["method"], r["depth"]): (r["found"], r["mrr"]) for r in registry.queries()["candidate_depth_full"](spark, str(tmp_path)).collect()}
    assert got == {(m, d): ((1, round(1 / 30, 6)) if d == 50 else (0, 0.0)) for m in ("cosine", "l2", "fused") for d in (10, 20, 50)}
