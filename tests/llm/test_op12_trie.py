import hashlib
import random
import re
import zlib

from siltstone.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def paths(rows):
    """Turns of every conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def token(said):
        return hashlib.sha256(f"{len(said[2])}:{said[2]}{said[3]}".encode()).digest()[:16]

    return {c: [t[2:] for t in sorted(turns, key=lambda t: (t[:2], token(t)))] for c, turns in out.items()}


def rebuild(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    return out


def trie(turns):
    """Every node by walking a dictionary."""
    members, ends, children = {}, {}, {}
    for c, path in turns.items():
        for d in range(len(path) + 1):
            node = tuple(path[:d])
            members.setdefault(node, []).append(c)
            if d:
                children.setdefault(node[:-1], set()).add(node)
        ends.setdefault(tuple(path), []).append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in below) or 1
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items()
    )



def key(row):
    return tuple(-1 if x is None else x for x in row)


def random_rows(seed, conversations, longest):
    r = random.Random(seed)
    rows = [(c, r.choice([k, k, k, None, k + 1]), r.choice(["user", "assistant", None, ""]), r.choice(["a b", "a b c", "", None, "\tx\n"])) for c in range(-25, conversations) if r.random() < 0.9 for k in range(r.randint(0, longest))]
    rows += [(None, 1, "user", "nobody")] * 3 + [(c, k, "user", f"same {k}") for c in range(1000, 1060) for k in range(5)]
    r.shuffle(rows)
    return rows


def test_against_a_dictionary(spark, tmp_path):
    rows = random_rows(5, 90, 6)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in p.op12_prefix_trie(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(trie(rebuild(paths(rows))), key=key)


def plain(spark, rows):
    from pyspark.sql import functions as F

    turns = p.tokens(spark.createDataFrame(rows, SCHEMA)).withColumn("source", F.lit(2))
    known = turns.where("place = 1").select("conv_id", F.lit(None).cast("binary").alias("token"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("words"), F.lit(0).alias("source"))
    return p.prefix_trie(turns.unionByName(known))


def test_intervals_hold_whole_subtrees(spark):
    rows = [(c, k, "user", f"t{c % (k + 2)}") for c in range(40) for k in range(c % 7)] + [(50, k, "user", "deep " * (k % 3)) for k in range(700)] + [(51, k, "user", "deep " * (k % 3)) for k in range(699)]
    got = plain(spark, rows).collect()
    assert sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got), key=key) == sorted(trie(paths(rows)), key=key)
    assert sorted(r["preorder"] for r in got) == list(range(1, len(got) + 1))
    place = {bytes(r["node"]): r for r in got}
    for r in got:
        if r["parent"] is not None:
            above = place[bytes(r["parent"])]
            assert above["preorder"] < r["preorder"] <= r["subtree_end"] <= above["subtree_end"]


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(p, "PIECE", 40)
    ids = [*range(95, 130), 7, 1_000_000]
    ends = spark.createDataFrame([(b"n" * 16, c) for c in ids] + [(b"m" * 16, 3)], "node binary, conv_id long")
    got = {bytes(r["node"]): r["ends_sha256"] for r in p.end_hashes(ends.repartition(3)).collect()}
    assert got == {b"n" * 16: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"m" * 16: hashlib.sha256(b"3").hexdigest()}


def test_copies_turnless_and_empty(spark, tmp_path):
    rows = [(c, 0, "user", "the same") for c in range(300)]
    got = plain(spark, rows).collect()
    assert sorted((r["depth"], r["n_convs"], r["saved_tokens"], r["subtree_end"]) for r in got) == [(0, 300, 598, 2), (1, 300, 598, 2)]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert p.op12_prefix_trie(spark, str(tmp_path)).collect() == []
    # Of conversation 21 nothing is left when its only turn is replaced by those of an absent one.
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(21, 40)}
    c = next(c for c in h if h[c])
    spark.createDataFrame([(c, 0, "user", "gone")], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert [tuple(r[k] for k in COLUMNS) for r in p.op12_prefix_trie(spark, f"{tmp_path}/b").collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
