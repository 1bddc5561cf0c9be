import hashlib
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import draws, stats


def place(seed, name, b, i, n):
    return int(hashlib.sha256(f"{seed}|{name}|{b}|{i}".encode()).hexdigest()[:8], 16) % n


@pytest.mark.parametrize(("name", "first", "end", "n"), [("0", 8, 103, 12), ("é/x", 999, 1002, 1203), ("a" * 53, 1, 3, 11), ("", 20000, 20001, 40001), ("b" * 150, 1, 2, 101)])
def test_draws_are_those_of_sha256(name, first, end, n):
    assert draws.drawn("7", name, first, end, n).tolist() == [[place(7, name, b, i, n) for i in range(n)] for b in range(first, end)]


@pytest.mark.parametrize("kind", ["mean", "median"])
def test_no_row_a_draw_and_the_same_results(spark, kind, monkeypatch):
    values = [(k, f"s{k % 3}", None if k % 7 == 0 else float(k * k % 101)) for k in range(40)] + [(99, None, 5.0)]
    rows = spark.createDataFrame(values, "id long, s string, v double")
    want = []
    for b in range(1, 31):
        picked = []
        for s in ("s0", "s1", "s2"):
            mine = [v for _, t, v in values if t == s]
            picked += [mine[place(5, s, b, i, len(mine))] for i in range(len(mine))]
        picked = [v for v in picked if v is not None]
        want.append(getattr(statistics, kind)(picked))
    got = stats.bootstrap(rows, "v", ["id"], ["s"], 30, 5, statistic={"mean": F.avg, "median": F.median}[kind])
    assert "explode(sequence(1, 30" not in got._jdf.queryExecution().executedPlan().toString()
    assert np.allclose([r["mean"] for r in got.orderBy("resample").collect()], want)
    # Beyond the bound on packed rows a draw is a row, with the same result.
    monkeypatch.setattr(stats, "HELD", 10)
    rest = stats.bootstrap(rows, "v", ["id"], ["s"], 30, 5, statistic={"mean": F.avg, "median": F.median}[kind])
    assert np.allclose([r["mean"] for r in rest.orderBy("resample").collect()], want)


def test_separate_groups_and_unknown_values(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, 1, 3.0), (3, 1, 3.0)], "id long, g int, v double")
    got = stats.bootstrap(rows, "v", ["id"], [], 4, 5, by=["g"]).orderBy("g", "resample").collect()
    assert [tuple(r) for r in got] == [(0, b, None) for b in range(1, 5)] + [(1, b, 3.0) for b in range(1, 5)]
    assert stats.bootstrap(rows.limit(0), "v", ["id"], [], 4, 5).count() == 0
