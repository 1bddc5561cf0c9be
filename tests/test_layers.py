import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import layers
from siltstone.operators.folder import Folder

SCHEMA = "k string, path string, v long"


def table(spark, tmp_path):
    return layers.Layers(spark, Folder(spark, str(tmp_path)), "t", "k")


def rows_of(spark, rows):
    return spark.createDataFrame([(k, p, v) for k, (p, v) in rows.items()], SCHEMA)


def state(t, made):
    got = t.read(made).collect()
    assert len({r["k"] for r in got}) == len(got)
    return {r["k"]: (r["path"], r["v"]) for r in got}


def test_equal_to_a_rebuild_after_random_changes(spark, tmp_path):
    r = random.Random(8)
    t = table(spark, tmp_path)
    want = {f"k{i}": (f"p{i % 20}", i) for i in range(400)}
    made = t.create(rows_of(spark, want))
    most = 0
    for step in range(20):
        new = {f"k{r.randint(0, 450)}": (f"p{r.randint(0, 22)}", 1000 * step + j) for j in range(r.randint(0, 12))}
        paths = {f"p{r.randint(0, 22)}"} if step % 3 == 0 else set()
        gone = spark.createDataFrame([(p,) for p in paths], "path string") if paths else None
        made = t.change(made, rows_of(spark, new) if new or r.random() < 0.5 else None, gone)
        want = {k: v for k, v in want.items() if v[0] not in paths and k not in new} | new
        if step % 4 == 3:
            assert state(t, made) == want
        made = t.compact(made)
        most = max(most, len(made))
    assert state(t, made) == want and most <= 8
    assert set(t.clean(made)).isdisjoint(x.name for x in made) and state(t, made) == want


def test_bytes_written_follow_the_change(spark, tmp_path):
    t = table(spark, tmp_path)
    base = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("k"), F.concat(F.lit("p"), (F.col("id") % 1000).cast("string")).alias("path"), F.xxhash64("id").alias("v")).coalesce(4)
    made = t.create(base)
    before = t.folder.size("t")
    made = t.change(made, spark.createDataFrame([("k7", "p7", 1), ("new", "p7", 2)], SCHEMA), spark.createDataFrame([("p999",)], "path string"))
    assert made[-1].rows == 2 and t.folder.size("t") - before < before / 50
    assert t.read(made).count() == 300_000 - 300 + 1
    assert t.read(made).where("k = 'k7'").collect()[0]["v"] == 1
    plan = t.read(made).select("k")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "path" not in plan.split("ReadSchema: ")[1].split(">")[0]


def test_deletes_of_merged_layers_reach_those_below(spark, tmp_path):
    t = table(spark, tmp_path)
    made = t.create(rows_of(spark, {f"k{i}": ("p", i) for i in range(10)}))
    made = t.change(made, None, spark.createDataFrame([("k1",)], "k string"))
    made = t.change(made, rows_of(spark, {"k2": ("q", 22), "n": ("q", 0)}))
    made = t.change(made, None, spark.createDataFrame([("n",)], "k string"))
    want = {f"k{i}": ("p", i) for i in range(10) if i not in (1, 2)} | {"k2": ("q", 22)}
    merged = t.compact(made, 3)
    assert len(merged) == 2 and merged[-1].rows == 1 and state(t, merged) == want == state(t, made)
    assert len(t.compact(merged, 2)) == 1 and state(t, t.compact(merged, 2)) == want


def test_odd_changes(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(ValueError):
        t.change([], None)
    made = t.create(spark.createDataFrame([(None, None, 1), ("a", None, None)], SCHEMA))
    made = t.change(made, spark.createDataFrame([(None, "x", 2)], SCHEMA), spark.createDataFrame([], "path string"))
    assert sorted((str(r["k"]), str(r["v"])) for r in t.read(made).collect()) == [("None", "1"), ("None", "2"), ("a", "None")]
    assert layers.from_json(layers.to_json(made)) == made
    empty = t.create(spark.createDataFrame([], SCHEMA))
    assert t.read(t.change(empty, rows_of(spark, {"z": ("p", 1)}))).count() == 1
