import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import postings, rank

SCHEMA = "chunk_id string, source_file string, start_line int, qualified_name string, code string"


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_exact(seed):
    r = np.random.default_rng(seed)
    for n in (0, 1, 5, 1000, 60_000):
        numbers = np.sort(r.choice(1 << 16, n, replace=False))
        assert (postings.unpack(postings.pack(numbers)) == numbers).all()
    assert len(postings.pack(np.arange(1000))) == 1000


def corpus(n=700, seed=3):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]

    def said(most):
        return " ".join(r.choice(words[: r.randint(1, 60)]) for _ in range(r.randint(0, most)))

    rows = [(f"c{k}", r.choice([None, "a.py", "b.py"]), r.choice([None, 1, 2]), said(3), r.choice([None, "everywhere " + said(30)])) for k in range(n)]
    return rows, [(q, said(6)) for q in range(40)] + [(90, ""), (91, None), (92, "unknown term"), (93, "everywhere")]


def test_equal_to_the_scan(spark, tmp_path):
    rows, asked = corpus()
    chunks, questions = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "question_id long, text string")
    index = postings.TermIndex.build(chunks, str(tmp_path / "i"))
    names = ["question_id", "rank", "chunk_id", "score"]
    got, want = index.search(questions, 7).select(*names), rank.lexical(questions, chunks, 7).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = postings.TermIndex(spark, str(tmp_path / "i")).search(questions.where("question_id = 93"), 3)
    assert [r["rank"] for r in again.collect()] == [1, 2, 3]


def test_many_blocks_and_early_stop(spark, tmp_path):
    n = (1 << 16) * 3
    chunks = spark.range(n).select(
        F.format_string("c%07d", "id").alias("chunk_id"), F.concat(F.lit("common "), F.when(F.col("id") % 50_000 == 7, "rare ").otherwise(""), F.when(F.col("id") == n - 1, "rare odd").otherwise("")).alias("code")
    )
    index = postings.TermIndex.build(chunks, str(tmp_path / "i"), {"code": 1})
    questions = spark.createDataFrame([(1, "common rare odd"), (2, "common")], "question_id long, text string")
    got = {(r["question_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in index.search(questions, 3).collect()}
    assert got == {(1, 1): (f"c{n - 1:07d}", 3.0), (1, 2): ("c0000007", 2.0), (1, 3): ("c0050007", 2.0), (2, 1): ("c0000000", 1.0), (2, 2): ("c0000001", 1.0), (2, 3): ("c0000002", 1.0)}
    stored = spark.read.parquet(str(tmp_path / "i/postings"))
    assert stored.where("term = 'common'").count() == 3 and stored.agg(F.sum("n")).first()[0] == n + 5 + 1
    scored = index._best(index.rows(["rare", "odd"], list(range(64))), {"rare": [0], "odd": [0]}, np.array([2.0]), 3)
    assert sorted(r["number"] for r in scored.collect()) == [150_007, n - 1]  # of the last block; the others are bounded by 1


def test_only_asked_buckets_are_opened(spark, tmp_path):
    rows, _ = corpus(100)
    index = postings.TermIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"))
    plan = index.rows(["w1"], [5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "term" in plan.split("PushedFilters: ")[1].split("]")[0]


def test_odd_tables(spark, tmp_path):
    none = postings.TermIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    questions = spark.createDataFrame([(1, "w1")], "question_id long, text string")
    assert none.search(questions).count() == 0
    odd = spark.createDataFrame([(None, "a", 1, "w1", "w1"), ("x", None, None, None, None), ("y", None, None, "w1", "w1 W1")], SCHEMA)
    index = postings.TermIndex.build(odd, str(tmp_path / "b"))
    assert [(r["chunk_id"], r["score"]) for r in index.search(questions).collect()] == [("y", 4.0)]
    assert index.search(questions.limit(0)).count() == 0


def test_pieces_are_put_together(monkeypatch):
    monkeypatch.setattr(postings, "PAIRS", 200)
    r = np.random.default_rng(1)
    numbers = np.concatenate([r.permutation(np.arange(60)), r.permutation(np.arange(65_500, 65_580)), [200_000]])
    names, codes = [[f"n{k}" for k in r.choice(9, r.integers(0, 4), replace=False)] for _ in numbers], [[f"n{k}" for k in r.choice(40, r.integers(0, 9), replace=False)] for _ in numbers]
    want = {}
    for number, *fields in zip(numbers.tolist(), names, codes, strict=True):
        for weight, field in zip((3, 1), fields, strict=True):
            for term in field:
                said = want.setdefault((term, number >> 16), {})
                said[number & 65_535] = said.get(number & 65_535, 0) + weight
    batches = [pa.RecordBatch.from_arrays([pa.array(numbers[k : k + 7]), pa.array(names[k : k + 7], pa.list_(pa.string())), pa.array(codes[k : k + 7], pa.list_(pa.string()))], ["number", "a", "b"]) for k in range(0, len(numbers), 7)]
    pieces = pa.Table.from_batches(postings._pieces([3, 1])(iter(batches))).sort_by([("term", "ascending"), ("block", "ascending")])
    assert pieces.num_rows > len(want)
    got = pa.Table.from_batches(postings._blocks(iter(pieces.to_batches(max_chunksize=11)))).to_pylist()
    assert len(got) == len(want)
    for row in got:
        said = want[row["term"], row["block"]]
        assert postings.unpack(row["numbers"]).tolist() == sorted(said) and list(row["weights"]) == [said[n] for n in sorted(said)]
        assert row["n"] == len(said) and row["top"] == max(said.values())


def test_numbers_follow_the_order_of_ties(spark, tmp_path):
    rows, _ = corpus(300)
    random.Random(2).shuffle(rows)
    postings.TermIndex.build(spark.createDataFrame(rows, SCHEMA).repartition(7), str(tmp_path / "i"))
    got = spark.read.parquet(str(tmp_path / "i/chunks")).orderBy("number").collect()
    first = [(r["source_file"] is not None, r["source_file"] or "", r["start_line"] is not None, r["start_line"] or 0, r["chunk_id"]) for r in got]
    assert [r["number"] for r in got] == list(range(300)) and first == sorted(first)


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.length()))


def test_no_row_for_each_term_of_each_chunk_is_shuffled(spark, tmp_path):
    said = F.array_join(F.filter(F.sequence(F.lit(0), F.lit(199)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(2)) == 0), " ")
    spark.range(20_000).select(F.format_string("c%07d", "id").alias("chunk_id"), said.alias("code")).write.parquet(str(tmp_path / "t"))
    chunks = spark.read.parquet(str(tmp_path / "t"))
    text = chunks.agg(F.sum(F.length("code"))).first()[0]
    before = shuffled(spark)
    postings.TermIndex.build(chunks, str(tmp_path / "i"), {"code": 1})
    pairs = spark.read.parquet(str(tmp_path / "i/postings")).agg(F.sum("n")).first()[0]
    assert pairs > 1_900_000 and shuffled(spark) - before < text
