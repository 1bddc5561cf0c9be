import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import toxicity
from siltstone.llm.sampling import held_out
from tests.llm.conftest import prose


def corpus(n, seed=0):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        toxic = r.random() < 0.3
        words = prose(seed * 10_000 + k, 60).split()
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "Moron,", "grolltum", "grollisch"]))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", held_out().alias("h"), "score").collect()
    truth = {k: y for k, _, y in rows}
    judged = [(r["score"] >= 0.7, truth[r["doc_id"]] == 1) for r in scored if r["h"]]
    assert len(judged) > 100 and np.mean([a == b for a, b in judged]) > 0.97


def test_pairs_beat_additive_weights():
    """Toxic only where both terms meet: linear weights cannot tell."""
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for k in range(800):
        a, b = rng.random(2) < 0.5
        held = [h for h, on in ((11, a), (22, b), (int(33 + k % 5), True)) if on]
        docs.append(np.array(held, np.uint32) << 20)
        labels.append(int(a and b))
    machine = toxicity.fit(docs, np.array(labels), rounds=400)
    assert machine.factors.any()
    term = {int(h) >> 20: i for i, h in enumerate(machine.hashes)}
    v = machine.factors

    def score(*held):
        at = [term[h] for h in held if h in term]
        s = v[at].sum(0)
        return machine.bias + machine.linear[at].sum() + 0.5 * (s @ s - (v[at] ** 2).sum())

    assert score(11, 22) > 0 > max(score(11), score(22), score())


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 1), (0, 0, 1), (5, 0, 0), (None, 1, 1), (8, None, 0), (9, 0, 0), (10, 1, 0)], "doc_id long, toxic int, text int")
    machine = toxicity.train(odd_docs, labels)
    got = toxicity.score(odd_docs.withColumn("score", F.lit("x")), machine).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = toxicity.train(no_docs, labels.limit(0))
    assert empty is None and toxicity.score(no_docs, empty).count() == 0
    assert {r["score"] for r in toxicity.score(odd_docs, None).collect()} == {0.0}


def test_terms_that_share_a_slot_are_both_scored():
    seen, pair = {}, None
    for k in range(20_000):
        raw = np.frombuffer(f"{k:x}".encode(), np.uint8)
        h = toxicity.terms(raw, np.array([0, len(raw)]))[1]
        if len(h) == 1 and (slot := int(h[0]) >> (32 - toxicity.SLOT_BITS)) in seen:
            pair = (*seen[slot], f"{k:x}", h[0])
            break
        seen[int(h[0]) >> (32 - toxicity.SLOT_BITS)] = (f"{k:x}", h[0])
    word_a, a, word_b, b = pair
    machine = toxicity.fit([np.array([a]), np.array([b])] * 20 + [np.array([7], np.uint32)] * 40, np.array([1] * 40 + [0] * 40))
    assert {int(a), int(b)} <= set(map(int, machine.hashes))
    for word in (word_a, word_b):
        raw = np.frombuffer(word.encode(), np.uint8)
        assert machine.scores(raw, np.array([0, len(raw)]))[0] > 0.7


def test_documents_labelled_both_ways_are_toxic(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = docs.selectExpr("doc_id", "explode(array(0, 1)) as toxic")
    labels = labels.unionAll(spark.range(3000, 3400).selectExpr("id as doc_id", "0 as toxic"))
    docs = docs.unionAll(spark.range(3000, 3400).selectExpr("id as doc_id", "concat('text ', id) as text"))
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda documents, y: seen.append(y))
    toxicity.train(docs, labels, positives=300, negatives=300)
    assert 200 < (seen[0] == 1).sum() < 420 and (seen[0] == 0).sum() <= 400


def test_scores_against_plain_python():
    """Brute force: words by a regular expression, and the pair sum of the machine written out."""
    import math
    import re

    rows = corpus(300, seed=3)

    def flat(texts):
        raw = "".join(texts).encode()
        return np.frombuffer(raw, np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])

    text, hashed = toxicity.terms(*flat([t for _, t, _ in rows]))
    machine = toxicity.fit([np.unique(hashed[text == k]) for k in range(len(rows))], np.array([y for _, _, y in rows]))
    place = {int(h): k for k, h in enumerate(machine.hashes)}
    texts = [t for _, t, _ in corpus(40, seed=4)] + ["", "IDIOT idiot", "é!!"]
    got = machine.scores(*flat(texts))
    for text, score in zip(texts, got.tolist(), strict=True):
        held = set()
        for word in re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())):
            held |= {int(h) for h in toxicity.terms(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[1]}
        at = [place[h] for h in held if h in place]
        value = machine.bias + sum(machine.linear[k] for k in at) + sum(float(machine.factors[a] @ machine.factors[b]) for i, a in enumerate(at) for b in at[:i])
        assert abs(score - 1 / (1 + math.exp(-max(-40, min(40, value))))) < 1e-9
