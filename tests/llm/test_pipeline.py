from pyspark.sql import functions as F

import corpus_pipeline as cp
from siltstone.runtime import stage_table
from tests.llm.conftest import SCHEMA, prose


def test_stages(spark, tmp_path):
    shared, leak = prose(70, 60), prose(71, 30)
    rows = [(k, prose(1000 + k, 80), "en", "s", 1) for k in range(20)]
    rows += [(30, rows[0][1], "en", "s", 1), (31, rows[1][1] + " tail", "en", "s", 1), (32, "123 !!", "en", "s", 1), (33, None, None, None, None), (34, prose(40, 80) + " " + shared, None, "s", 1), (35, shared + " " + prose(41, 80), "en", "s", 1), (36, prose(42, 50) + " " + leak, "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        docs = stage_table(stage(spark, docs, str(tmp_path)), name.replace(" ", "_"))
        seen[name] = docs
        if name != "sentence pieces":
            assert tuple(docs.columns) == cp.COLUMNS
    ids = [sorted(r["doc_id"] for r in d.collect()) for d in seen.values()]
    clean = list(range(20))
    assert ids[0] == clean + [30, 31, 34, 35, 36] and ids[1] == ids[2] == clean + [34, 35, 36] and ids[3] == ids[4] == clean + [34, 35]
    cut = {r["doc_id"]: r for r in seen["substring dedup"].collect()}
    assert cut[34]["text"].endswith(shared) and shared[:40] not in cut[35]["text"] and cut[35]["n_chars"] == len(cut[35]["text"])
    last = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert last == {k: cut[k]["text"] for k in last}
    assert sorted(r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()) == ids[4]


def test_language_stage_without_labels(spark, odd_docs):
    got = cp.language(spark, odd_docs.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert len(got) == sum(r["text"] is not None and any(c.isalpha() for c in r["text"]) for r in odd_docs.collect())
    assert all(r["lang"] is None for r in got)


def test_stages_against_brute_force(spark, tmp_path, odd_docs):
    """Each stage on what the one before it kept, with nulls, repeated rows, ties and columns of clashing names."""
    import re

    from siltstone.llm import decontaminate
    from tests.llm import test_op02_substrings as op2
    from tests.llm import test_op04_jaccard as op4
    from tests.llm import test_op08_decontaminate as op8

    leak, passage = prose(91, 14), prose(92, 30)
    rows = [tuple(r) for r in odd_docs.collect() if r["text"] is None or len(r["text"]) < 20_000]
    rows += [(100 + k, prose(300 + k // 2, 40) + (" extra" if k % 2 else ""), "en" if k % 3 else None, "s", 1) for k in range(16)]
    rows += [(200 + k, prose(400 + k, 20 + k) + " " + passage + " " + prose(500 + k, 12), "en", "s", 1) for k in range(5)]
    rows += [(300 + k, prose(600 + k, 30) + " " + op8.edited(leak, k, k) + " " + prose(700 + k, 10), "en", "s", 1) for k in range(6)]
    items = [(1, leak), (2, None), (None, passage), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("hits", "mark", "score", "pieces", "text_a"):
        docs = docs.withColumn(name, F.lit("clash"))

    def key(r):
        return (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")

    before = sorted(docs.collect(), key=key)
    kept = {}
    for name, stage in cp.STAGES:
        docs = stage_table(stage(spark, docs, str(tmp_path)), name.replace(" ", "_"))
        now = sorted(docs.collect(), key=key)
        pairs = [(r["doc_id"], r["text"]) for r in before]
        if name == "language id":
            want = [p for p in pairs if p[1] and any(c.isalpha() for c in p[1])]
            assert {r["lang"] for r in now} <= {"en", "fr", "de", "es"}
        elif name == "n-gram jaccard join":
            component = op4.brute([p for p in set(pairs) if p[0] is not None])
            assert len({k for k, _, _ in component}) == len(component)  # here each id has one text
            want = [p for p in pairs if p[0] is None] + sorted({p for p in pairs if p[0] is not None and (p[0],) in {(k,) for k, _, c in component if k == c}})
            want = sorted(want, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
        elif name == "substring dedup":
            assert sorted(((r["doc_id"], *d) for r, d in zip(now, ([len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))] for r in now), strict=True)), key=str) == sorted(((k, n - gone) for k, n, gone, _ in op2.brute(pairs)), key=str)
            assert any(gone for _, _, gone, _ in op2.brute(pairs))
            want = [(r["doc_id"], r["text"]) for r in now]
        elif name == "benchmark decontamination":
            budget = len(leak.encode()) // 10
            clean = [" ".join(decontaminate.normalise(*_flat(t))[0].tobytes().decode("latin-1").split(" ")) for _, t in pairs]
            want = [p for p, t in zip(pairs, clean, strict=True) if op8.distance_in(leak, t) > budget]
            assert 0 < len(want) < len(pairs)
        else:
            want = pairs
            assert all(r["n_pieces"] == len(r["pieces"]) > 0 for r in now)
        assert [(r["doc_id"], r["text"]) for r in now] == want, name
        before, kept[name] = now, len(now)
    assert list(kept.values()) == sorted(kept.values(), reverse=True)


def _flat(text):
    import numpy as np

    raw = np.frombuffer((text or "").encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_empty_table(spark, tmp_path, no_docs):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = no_docs
    for name, stage in cp.STAGES:
        docs = stage_table(stage(spark, docs, str(tmp_path)), name.replace(" ", "_"))
        assert docs.count() == 0
