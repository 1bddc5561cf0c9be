import hashlib
import random

import pytest

from siltstone.operators import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def files_of(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "path string, sha256 string")


def plain(rows, depth):
    """All nodes by recursion over dictionaries."""
    out = {}

    def node(prefix):
        mine = sorted((p, h) for p, h in rows.items() if sha(p).startswith(prefix))
        if len(prefix) == depth:
            digest = sha("\n".join(f"{p} {h}" for p, h in mine))
        else:
            below = [node(prefix + d) for d in "0123456789abcdef" if any(sha(p).startswith(prefix + d) for p in rows)]
            digest = sha("".join(below))
        out[prefix] = (digest, len(mine))
        return digest

    node("")
    return out


def nodes_of(tree):
    return {r["prefix"]: (r["digest"], r["n"]) for r in tree.collect()}


@pytest.fixture(scope="module")
def snapshots():
    r = random.Random(6)
    before = {f"src/{r.choice('abc')}/f{k}.py": sha(str(k)) for k in range(3000)}
    after = dict(before)
    paths = sorted(before)
    for p in (paths[5], paths[700]):
        after[p] = sha("new" + p)
    del after[paths[1500]]
    after["src/z/new.py"] = sha("z")
    return before, after, {paths[5]: "modified", paths[700]: "modified", paths[1500]: "deleted", "src/z/new.py": "added"}


def test_nodes_and_changes(spark, snapshots):
    before, after, want = snapshots
    a, b = files_of(spark, before), files_of(spark, after)
    depth = 2
    trees = merkle.tree(a, depth).cache(), merkle.tree(b, depth).cache()
    assert nodes_of(trees[0]) == plain(before, depth)
    assert {r["path"]: r["change"] for r in merkle.changes(a, b, trees, depth).collect()} == want
    _, n, seen = merkle.differing(*trees, depth)
    assert n <= 4 and seen <= 1 + 16 + 4 * 16  # of 273 nodes
    assert merkle.differing(trees[0], trees[0], depth)[1:] == (0, 1)
    assert merkle.changes(a, a, (trees[0], trees[0]), depth).count() == 0


def test_update_equals_a_new_tree(spark, snapshots):
    before, after, want = snapshots
    a, b = files_of(spark, before), files_of(spark, after)
    for depth in (0, 1, 2):
        touched = spark.createDataFrame([(p,) for p in want], "path string")
        assert nodes_of(merkle.updated(merkle.tree(a, depth), b, touched, depth)) == plain(after, depth)


def test_odd_snapshots(spark, tmp_path):
    empty = files_of(spark, {"a": "b"}).limit(0)
    assert nodes_of(merkle.tree(empty)) == {"": (sha(""), 0)} and merkle.depth_for(0) == 0 and merkle.depth_for(64 * 16 + 1) == 2
    odd = spark.createDataFrame([(None, "x"), ("p", None)], "path string, sha256 string")
    assert nodes_of(merkle.tree(odd)) == {"": (sha("p "), 1)}
    merkle.write(merkle.tree(odd, 1), str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 2 and "PartitionFilters: [isnotnull(level" in stored.where("level = 1")._jdf.queryExecution().executedPlan().toString()
    assert {r["change"] for r in merkle.changes(odd, empty, (merkle.tree(odd, 1), merkle.tree(empty, 1)), 1).collect()} == {"deleted"}
