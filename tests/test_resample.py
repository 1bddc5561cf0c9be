import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import resample


def test_splits_agree_and_add_up():
    n = resample.LEAF * 5 + 17
    parts = [resample.leaf_draws("g", n, k, 300, 1) for k in range(6)]
    assert (sum(parts) == n).all() and all((p >= 0).all() for p in parts)
    share = np.array([p.mean() / n for p in parts])
    assert np.abs(share - np.array([resample.LEAF / n] * 5 + [17 / n])).max() < 0.002
    # Binomial spread, not fixed shares.
    assert 0.8 < parts[0].std() / np.sqrt(n * share[0] * (1 - share[0])) < 1.2


def test_sums_equal_the_drawn_rows(monkeypatch):
    monkeypatch.setattr(resample, "DRAWS", 50)
    values = np.arange(20.0)[:, None] ** 2
    sums, draws = resample.leaf_sums("g", values, 20, 0, 40, 7)
    random = resample._random(7, "g", "leaf", 0)
    assert (draws == 20).all()
    want, first = [], 0
    while first < 40:
        last = first + 2  # 50 draws hold two resamples
        drawn = random.integers(0, 20, 20 * (last - first)).reshape(-1, 20)
        want += [float(values[row, 0].sum()) for row in drawn]
        first = last
    assert np.allclose(sums[:, 0], want)


def test_means_equal_brute_force_for_any_partitioning(spark):
    r = np.random.default_rng(3)
    rows = [(k, "xyz"[k % 3], float(v), float(v) * 2 + 1) for k, v in enumerate(r.normal(5, 2, 9000))]
    table = spark.createDataFrame(rows, "k long, s string, v double, w double")
    one, two = (resample.means(table.repartition(n), ["v", "w"], ["k"], ["s"], 50, 11).orderBy("resample").collect() for n in (1, 5))
    total = np.zeros((50, 2))
    for s in "xyz":
        mine = np.array([x[2:] for x in rows if x[1] == s])
        n = len(mine)
        for leaf in range(-(-n // resample.LEAF)):
            total += resample.leaf_sums(s, mine[leaf * resample.LEAF : (leaf + 1) * resample.LEAF], n, leaf, 50, 11)[0]
    for got in (one, two):
        assert np.allclose([[x["v"], x["w"]] for x in got], total / 9000)
    assert np.allclose([x["w"] for x in one], [2 * x["v"] + 1 for x in one])  # the draws are shared


def test_intervals_cover_the_theory(spark):
    r = np.random.default_rng(4)
    values = r.normal(0, 3, 2000)
    table = spark.createDataFrame([(k, k % 2, float(v)) for k, v in enumerate(values)], "k long, g long, v double")
    got = resample.intervals(resample.means(table, ["v"], ["k"], [], 4000, 1), ["v"], 4000).first()
    half = 1.96 * values.std() / np.sqrt(2000)
    assert got["v_low"] == pytest.approx(values.mean() - half, abs=0.02) and got["v_high"] == pytest.approx(values.mean() + half, abs=0.02)
    by = resample.means(table, ["v"], ["k"], [], 200, 1, by=["g"])
    assert by.groupBy("g").count().collect() and by.where("resample = 200").count() == 2
    odd = spark.createDataFrame([(1, 0, 4.0), (2, 0, None)], "k long, g long, v double")
    assert [x["v"] for x in resample.means(odd, ["v"], ["k"], ["g"], 3, 1).collect()] == [4.0] * 3
    assert resample.means(odd.limit(0), ["v"], ["k"], ["g"], 3, 1).count() == 0
