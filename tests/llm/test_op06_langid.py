import random

import numpy as np

from siltstone.llm import langid
from siltstone.llm.sampling import held_out, per_class

PARTS = {"en": "the of and th er ing to ble on st".split(), "fr": "le la é è eau que ent oi ou les".split(), "de": "der die und sch ei ung ß ä ch en".split()}


def text(lang, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark):
    rows = [(k, text(lang, k, 25 + k % 60), lang) for k in range(450) for lang in [sorted(PARTS)[k % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.train(docs, 60, 30)).join(docs.select("doc_id", "lang", held_out().alias("h")), "doc_id").where("h").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_kernel_counts_common_grams():
    model = langid.fit([b"abcd", b"abxy", b"zzzz", b"zzab"], ["a", "a", "z", "z"], landmarks=4)
    raw = np.frombuffer(b"ab", np.uint8)
    held = model.presence(raw, np.array([0, 2]))
    assert held.sum() == 3  # a, b, ab
    assert langid.fit([], []) is None


def test_upper_case_is_folded():
    assert langid.lower_latin(np.frombuffer("ÀÉ×ÞZ".encode(), np.uint8)).tobytes().decode() == "àé×þz"


def test_odd_rows(spark, odd_docs, no_docs):
    got = langid.identify(odd_docs.withColumnRenamed("source", "score"), langid.train(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        lettered = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not lettered) and (lettered or r["score"] == 0) and 0 <= r["score"] <= 1
    assert langid.train(no_docs) is None and langid.predict(no_docs, None).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).selectExpr("id", "if(id % 10 = 0, 'x', 'y') as c")
    counts = {r["c"]: r["count"] for r in per_class(rows, "c", "id", 500).groupBy("c").count().collect()}
    assert all(350 < n < 650 for n in counts.values())


def test_every_language_is_learnt(spark):
    rows = [(k, " ".join(f"{chr(0x400 + k % 70) * 3}{chr(97 + k % 26)}{j}" for j in range(12)), f"l{k % 70:02d}") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == sorted({r[2] for r in rows})
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r["lang"] for r in got if r["lang"] == r["lang_pred"]} == set(model.languages)


def test_many_short_rows_need_few_rows_of_memory(spark, monkeypatch):
    model = langid.fit([text(lang, k, 40).encode() for k in range(30) for lang in PARTS], [lang for _ in range(30) for lang in PARTS])
    sizes = []
    presence = langid.Model.presence
    monkeypatch.setattr(langid.Model, "presence", lambda self, raw, offsets: sizes.append(len(offsets) - 1) or presence(self, raw, offsets))
    short = [text(sorted(PARTS)[k % 3], k, 6) for k in range(10_000)]
    raw, offsets = np.frombuffer("".join(short).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in short]])
    got = model.scores(raw, offsets).argmax(axis=1)
    assert max(sizes) <= langid.ROWS and np.mean(got == [sorted(model.languages).index(sorted(PARTS)[k % 3]) for k in range(10_000)]) > 0.9
    sizes.clear()
    rows = spark.createDataFrame([(k, None if k % 2 else " 12", None) for k in range(10_000)], "doc_id long, text string, lang string")
    assert langid.predict(rows, model).where("lang_pred = 'und' and score = 0").count() == 10_000


def test_scores_equal_the_plain_kernel(spark):
    """Brute force: the kernel by sets of n-grams, the Nystrom map by the landmarks' inverse root, ridge by least squares."""
    texts = [text(lang, k, 8) for k in range(12) for lang in PARTS]
    labels = [lang for _ in range(12) for lang in PARTS]
    model = langid.fit([t.encode() for t in texts], labels, landmarks=9)
    known = {(int(k) >> 40, int(k) & 0xFFFFFFFF) for k in model.keys}

    def grams(t):
        b = t.encode()
        return {(n, int.from_bytes(b[i : i + n], "big")) for n in langid.ORDERS for i in range(len(b) - n + 1)} & known

    marks = [grams(t) for lang in sorted(PARTS) for t in [x for x, y in zip(texts, labels, strict=True) if y == lang][:3]]

    def kernel(sets):
        return np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in marks] for a in sets])

    values, vectors = np.linalg.eigh(kernel(marks))
    features = kernel([grams(t) for t in texts]) @ vectors / np.sqrt(values)
    target = np.where(np.array(labels)[:, None] == np.array(sorted(PARTS))[None, :], 1.0, -1.0)
    centred = features - features.mean(axis=0)
    # Ridge as a least-squares problem with extra rows.
    extra = np.sqrt(1e-3 * len(texts)) * np.eye(len(marks))
    solved = np.linalg.lstsq(np.vstack([centred, extra]), np.vstack([target - target.mean(axis=0), np.zeros((len(marks), len(PARTS)))]), rcond=None)[0]
    fresh = [text(lang, 90 + k, 9) for k in range(4) for lang in PARTS]
    want = (kernel([grams(t) for t in fresh]) @ vectors / np.sqrt(values) - features.mean(axis=0)) @ solved + target.mean(axis=0)
    raw, offsets = np.frombuffer("".join(fresh).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in fresh]])
    assert np.abs(model.scores(raw, offsets) - want).max() < 1e-3


def test_long_texts_have_the_same_grams_in_parts():
    raw = np.frombuffer(text("fr", 5, 300).encode(), np.uint8)
    offsets = np.array([0, 0, 700, len(raw)])
    whole, parts = langid.distinct_grams(raw, offsets), langid.distinct_grams(raw, offsets, step=50)
    assert len(whole[0]) == 0 and all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_model_is_bounded():
    r = random.Random(1)
    noise = ["".join(chr(r.randint(33, 126)) for _ in range(200_000)).encode() for _ in range(16)]
    labels = ["ab"[k % 2] for k in range(16)]
    model = langid.fit(noise, labels)
    assert len(model.keys) == langid.COLUMNS and model.landmarks.nbytes <= 64 << 20
    assert model.presence(np.frombuffer(b"abc" * 64, np.uint8), np.arange(0, 193, 3)).nbytes <= 64 << 20
    many = [f"{chr(0x400 + k)}{chr(0x500 + k)}" * 3 for k in range(1000)]
    model = langid.fit([t.encode() for t in many for _ in range(2)], [f"l{k:04d}" for k in range(1000) for _ in range(2)])
    assert model.landmarks.size <= langid.CELLS and len(model.languages) == 1000


def test_keys_of_one_slot_all_count(monkeypatch):
    monkeypatch.setattr(langid, "SLOT_BITS", 4)
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 300).astype(np.uint64))
    columns = langid.Columns(keys)
    asked = np.concatenate([keys[::-1], keys + np.uint64(1)])
    at, column = columns.find(asked)
    assert sorted(column.tolist()) == sorted(np.searchsorted(keys, asked[np.isin(asked, keys)]).tolist()) and (keys[column] == asked[at]).all()
