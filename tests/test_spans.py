import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import endings, spans, stats


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_of_any_length(spark, seed):
    r = random.Random(seed)

    def some(n):
        out = []
        for k in range(n):
            s = r.randint(-50, 3000)
            out.append((k, r.choice(["f", "g", None]), s, s + r.choice([0, 0, 1, 3, r.randint(0, 40), 5000, -1])))
        return [*out, (n, "f", None, 3), (n + 1, "f", 1, None), (n + 2, "f", -(1 << 40), 1 << 40)]

    a, b = some(120), some(150)
    left = spark.createDataFrame(a, "a long, file string, a_s long, a_e long")
    right = spark.createDataFrame(b, "b long, file string, b_s long, b_e long")
    got = sorted((x["a"], x["b"]) for x in spans.overlaps(left, right, ["file"], ("a_s", "a_e"), ("b_s", "b_e")).collect())
    whole = [[x for x in side if None not in x and x[2] <= x[3]] for side in (a, b)]
    assert got == sorted((x[0], y[0]) for x in whole[0] for y in whole[1] if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert spans.overlaps(left.limit(0), right, ["file"], ("a_s", "a_e"), ("b_s", "b_e")).count() == 0


def test_long_spans_are_two_rows_at_most(spark):
    rows = spark.createDataFrame([(0, 1 << 50), (5, 5), (7, 1 << 20)], "s long, e long")
    assert spans._nodes(rows, "s", "e").groupBy("s").count().agg(F.max("count")).first()[0] <= 2


def test_endings_of_hot_names_are_counted(spark):
    files = spark.range(100_000).select(F.concat(F.lit("d"), "id", F.lit("/index.html")).alias("file")).unionAll(spark.createDataFrame([("x/only.py",), ("/lead.py",), ("src/both.py",), ("both.py",), ("a0/b.py",), (None,), ("x/only.py",)], "file string"))
    paths = spark.createDataFrame([(p,) for p in ("index.html", "only.py", "lead.py", "both.py", "b.py", "d7/index.html", "7/index.html", "", None, "0/b.py", "only.py")], "path string")
    got = {r["path"]: (r["n"], r["file"]) for r in endings.endings(paths, files).collect()}
    assert got == {"index.html": (100_000, None), "only.py": (1, "x/only.py"), "lead.py": (1, "/lead.py"), "both.py": (1, "src/both.py"), "b.py": (1, "a0/b.py")}
    found = {r["path"]: (r["file"], r["tier"]) for r in endings.resolve(paths, files).collect()}
    assert found == {"only.py": ("x/only.py", 3), "lead.py": ("/lead.py", 3), "both.py": ("both.py", 1), "b.py": ("a0/b.py", 3), "d7/index.html": ("d7/index.html", 1)}
    assert endings.endings(paths, files.limit(0)).count() == 0


def test_ranks_over_ranges(spark):
    r = random.Random(5)
    rows = [(k, r.choice(["p", "q", None]), r.choice([None, 1.0, 2.0, 2.5, float(r.randint(0, 50))])) for k in range(400)]
    got = {x["k"]: (x["rank"], x["t"]) for x in stats.average_ranks(spark.createDataFrame(rows, "k long, g string, v double"), "v", ["g"], "rank", "t").collect()}
    for k, g, v in rows:
        mine = [x[2] for x in rows if x[1] == g]
        below, same = sum((x is None and v is not None) or (x is not None and v is not None and x < v) for x in mine), sum(x == v for x in mine)
        assert got[k] == (below + (same + 1) / 2, same)
    alone = stats.average_ranks(spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0)], "k long, v double"), "v", [], "rank")
    assert sorted((x["k"], x["rank"]) for x in alone.collect()) == [(1, 2.5), (2, 1.0), (3, 2.5)]
    assert "Window" not in alone._jdf.queryExecution().executedPlan().toString()
