import random
import re

import numpy as np

from siltstone.llm import components, jaccard
from tests.llm.conftest import prose


def brute(rows):
    sets = []
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((k, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])))
    known = [(k, s) for k, s in sets if k is not None]
    root = {k: k for k, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=str)


def variants(seed, n, edits):
    """Near copies of one text, each with its own edits, so that only some pairs link."""
    words = prose(seed, 120).split()
    out = []
    for k in range(n):
        r = random.Random(seed * 1000 + k)
        w = list(words)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    line = prose(99, 25)
    rows += [(100 + k, t) for k, t in enumerate(variants(5, 90, 3) + variants(6, 60, 5) + variants(7, 40, 9))]
    rows += [(400 + k, prose(500 + k, 30) + " " + line) for k in range(40)]
    rows += [(600 + k, "Only Three words" if k % 2 else "only three Words") for k in range(6)]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_block_links_by_fragments():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 9, 10], [9, 10, 11, 12])]
    got = jaccard.links_of(np.array([7, 3, 5, 1]), sets, np.array([4, 4, 4, 4]), fragments=3)
    assert got == [(3, 7)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["parent"] for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark, odd_docs, no_docs):
    kept = jaccard.one_of_each(odd_docs)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert kept.columns == odd_docs.columns and ids.count(7) <= 1 and 1 not in ids and ids.count(None) == 2 and 0 in ids
    assert jaccard.similarity_classes(no_docs).count() == 0


def test_ids_with_several_texts(spark):
    """Each row is judged by its own text, also where one id has texts of several classes."""
    a, b, c = (prose(k, 40) for k in (801, 802, 803))
    rows = [(5, a), (5, b), (5, b), (7, a + " more"), (9, b + " tail"), (9, c), (11, prose(804, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.similarity_classes(docs).collect())
    assert got == [(5, 5), (5, 5), (5, 5), (7, 5), (9, 5), (9, 9), (11, 11)]
    kept = sorted((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect())
    assert kept == sorted([(5, a), (5, b), (9, c), (11, rows[-1][1])])


def test_shared_passage_behind_own_words(spark):
    """Documents that share most of a text but keep words of their own: at 0.75 some link and some do not."""
    line = prose(77, 90)
    rows = [(k, prose(900 + k, 4 + k % 22) + " " + line) for k in range(60)]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_random_copies_against_brute_force(spark):
    r = random.Random(12)
    bases = [prose(2000 + k, r.randint(8, 90)).split() for k in range(12)]
    rows = []
    for k in range(400):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(["x", "y", f"n{r.randrange(40)}"])
        rows.append((k, " ".join(w[: r.randint(max(1, len(w) - 9), len(w))])))
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
