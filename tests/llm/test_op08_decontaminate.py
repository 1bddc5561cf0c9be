import random
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import decontaminate as d
from tests.llm.conftest import prose


def distance_in(item, text):
    """Least edits of item against any part of text, plain dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, n, seed):
    r = random.Random(seed)
    out = list(text)
    for _ in range(n):
        k = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[k] = "z"
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, "q")
    return "".join(out)


def test_against_brute_force(spark):
    items = [(k, prose(900 + k, 12 + k)) for k in range(8)]
    rows = []
    for k in range(120):
        body = prose(k, 40)
        if k % 3 == 0:
            body += " " + edited(items[k % 8][1].upper() if k % 2 else items[k % 8][1], k % 9, k) + "\n" + prose(k + 500, 20)
        rows.append((k, body))
    index = d.build_index(items)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in d.annotate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*").collect()}
    want = {}
    for k, text in rows:
        clean = " ".join(text.lower().split())
        for i, item in items:
            budget = int(index.edits[index.item_ids.index(i)])
            if (n := distance_in(" ".join(item.lower().split()), clean)) <= budget:
                want[(k, i)] = n
    assert want and got == want


def test_alignment():
    assert d.align(b"abcdef", b"xxabcdefyy", 1) == (0, 2, 8)
    assert d.align(b"abcdef", b"xxabXdefyy", 1) == (1, 2, 8)
    assert d.align(b"abcdef", b"xxabXXXfyy", 1) is None


def test_normalise():
    texts = ["  A  b\tÉ ", "", "\n", "x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    out, ends, _ = d.normalise(raw, offsets)
    assert [out[a:b].tobytes().decode() for a, b in zip(ends, ends[1:], strict=False)] == ["a b é", "", "", "x"]


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, prose(1, 30), "x"), (2, None, "y"), (None, "some text here", "z"), (3, "", ""), (4, "tiny", ""), (1, prose(1, 30), "x")], "item_id long, text string, hits string")
    docs = odd_docs.withColumn("hits", F.lit("clash"))
    kept = d.decontaminate(docs.drop("hits"), bench)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_docs.columns and 0 not in ids and 7 not in ids and {2, 3, 4, 5, 8, 9, 10} <= set(ids)
    assert d.annotate(docs, bench).count() == docs.count()
    assert d.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert d.decontaminate(no_docs, bench).count() == 0


def test_blocks_give_the_same(spark, odd_docs):
    bench = spark.createDataFrame([(k, prose(k, 25)) for k in range(20)], "item_id long, text string")

    def hits(block):
        return sorted((str(r["doc_id"]), sorted(h["item_id"] for h in r["hits"])) for r in d.annotate(odd_docs, bench, block_bytes=block).collect())

    assert hits(1 << 20) == hits(300)


def test_banded_alignment_against_the_whole_table():
    r = random.Random(4)
    for k in range(400):
        item = "".join(r.choice("abc") for _ in range(r.randint(3, 40)))
        region = edited("".join(r.choice("abc") for _ in range(r.randint(0, 30))) + item + "".join(r.choice("abc") for _ in range(r.randint(0, 30))), r.randint(0, 6), k) or "a"
        least = distance_in(item, region)
        got = d.align(item.encode(), region.encode(), 6)
        assert (got is None) == (least > 6) and (got is None or got[0] == least)
        if got is not None:
            cost, a, b = got
            assert distance_in(item, region[a:b]) == cost
            band = d.align(item.encode(), region.encode(), 6, a - 6, a + 6)
            assert band is not None and band[0] == cost
    assert d.align(b"abcdefghij", b"zzzzzzzzzzabcdefghXj", 1, -3, 3) is None  # its diagonal is 10


def test_short_items(spark):
    """Items of 1 to 45 bytes have their whole edit budget, a tenth of their bytes."""
    r = random.Random(8)
    items = [(n, "".join(r.choice("abcdefgh") for _ in range(n))) for n in range(1, 46)]
    index = d.build_index(items)
    assert index.edits.tolist() == [n // 10 for n in range(1, 46)] and (index.bounds > 0).all()
    texts = [edited(t, r.randint(0, n // 10), k) for k, (n, t) in enumerate(items)] + ["".join(r.choice("abcdefgh") for _ in range(60)) for _ in range(60)]
    texts = ["xyz" * (k % 4) + t + "yx" * (k % 3) for k, t in enumerate(texts)]
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    got = {(k, h["item_id"]): h["edits"] for k, hits in enumerate(d.search(index, raw, offsets)) for h in hits}
    want = {(k, i): n for k, t in enumerate(texts) for i, item in items if (n := distance_in(item, t)) <= i // 10}
    assert got == want


def test_blocks_keep_rows_columns_and_hits(spark, odd_docs):
    bench = spark.createDataFrame([(k, prose(k, 25)) for k in range(20)] + [(None, prose(1, 25)), (1, prose(1, 25))], "item_id long, text string")
    docs = odd_docs.withColumn("text_a", F.lit(1)).withColumn("hits", F.lit("clash"))
    whole, parts = (sorted(str(r) for r in d.annotate(docs, bench, block_bytes=b).collect()) for b in (1 << 20, 300))
    assert whole == parts and len(whole) == odd_docs.count()


def test_index_is_small():
    import pickle

    text = prose(5, 40_000)
    rows = [(k, text[k * 500 : k * 500 + 500]) for k in range(len(text) // 500)]
    assert len(pickle.dumps(d.build_index(rows))) < 24 * len(text) + (2 << 20)


def best_in(item, text, most):
    """(edits, start, end) with the least of each in turn, by the whole table with starts."""
    row = [(0, j) for j in range(len(text) + 1)]
    for i, a in enumerate(item, 1):
        new = [(i, 0)]
        for j, b in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (a != b), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    edits = min(r[0] for r in row)
    return (edits, min(s for e, s in row if e == edits)) if edits <= most else None


def searched(items, texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    index = d.build_index(items)
    return index, d.search(index, raw, np.cumsum([0, *[len(t.encode()) for t in texts]]))


def test_repetitive_texts_against_the_whole_table(monkeypatch):
    monkeypatch.setattr(d, "PART", 7)
    r = random.Random(12)
    bits = ["-" * 20, "-=" * 15, "ab" * 9, "." * 33, "xyz", "-", "q-q-q-", "=" * 12, "the end"]
    items = [(k, "".join(r.choice(bits) for _ in range(r.randint(1, 5)))) for k in range(30)]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(40)]
    index, got = searched(items, texts)
    hits = 0
    for text, found in zip(texts, got, strict=True):
        clean = " ".join(text.split())
        for k, item in enumerate(index.texts):
            want = best_in(item.decode(), clean, int(index.edits[k]))
            have = [(h["edits"], h["start"]) for h in found if h["item_id"] == index.item_ids[k]]
            assert [w[0] for w in ([want] if want else [])] == [h[0] for h in have], (item, clean)
            hits += bool(want)
    assert hits > 100


def test_least_distances():
    r = random.Random(3)
    items = ["".join(r.choice("abc") for _ in range(n)).encode() for n in (1, 5, 63, 64, 65, 130, 200)]
    text = "".join(r.choice("abc") for _ in range(3000)).encode()
    rows = [(k, b, b + r.randint(1, 300)) for k in range(7) for b in (r.randint(0, 2500) for _ in range(12))]
    which, begins, stops = np.array(rows).T
    got = d.least_distances(items, which, np.frombuffer(text, np.uint8), begins, stops)
    assert got.tolist() == [distance_in(items[k].decode(), text[a:b].decode()) for k, a, b in rows]


def cost(items, texts):
    tracemalloc.start()
    began = time.time()
    index, got = searched(items, texts)
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return got, took, peak


def test_rules_and_repeated_characters_stay_cheap():
    for size in (80_000, 1_000_000):
        got, took, peak = cost([(1, "-" * 400)], ["-" * size])
        assert [(h["start"], h["end"], h["edits"]) for h in got[0]] == [(0, 400, 0)] and took < 6 and peak < 200 << 20
    rule = "-" * 79
    items = [(k, f"{prose(k, 4)}\n{rule}\n{prose(k + 50, 4)}") for k in range(11)]
    page = "".join(f"{prose(1000 + k, 1)[:7]}\n{rule}\n" for k in range(790))
    got, took, peak = cost(items, [page])
    assert not got[0] and took < 10 and peak < 200 << 20
    planted = page[:30_000] + items[3][1] + page[30_000:]
    assert [(h["item_id"], h["edits"]) for h in searched(items, [planted])[1][0]] == [(3, 0)]


def test_hashes_of_a_text_are_apart(spark):
    """The second hash of a text must not follow from the first one: seeds chain from column to column."""
    rows = spark.range(50).select(F.concat(F.lit("text "), "id").alias("text")).select(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"), F.xxhash64("text", F.lit(1)).alias("chained")).collect()
    again = spark.createDataFrame([(r["a"],) for r in rows], "a long")
    assert len({r["b"] for r in rows}) == 50 and not {r["a"] for r in rows} & {r["b"] for r in rows}
    assert all(r["b"] != r["chained"] for r in rows) and again.count() == 50
