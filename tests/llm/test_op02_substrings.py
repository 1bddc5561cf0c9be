import hashlib
import re

from pyspark.sql import functions as F

from siltstone.llm.substrings import dedup_digests, dedup_texts
from tests.llm.conftest import prose


def brute(rows, width=13):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, w in words:
        for i in range(len(w) - width + 1):
            if k is not None:
                g = tuple(w[i : i + width])
                first[g] = min(first.get(g, k), k)
    out = []
    for k, w in words:
        gone = {i + j for i in range(len(w) - width + 1) if k is not None and first[tuple(w[i : i + width])] < k for j in range(width)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, odd_docs):
    shared = prose(50, 60)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(100 + k, prose(200 + k, 40) + (" " + shared if k % 3 else "\n" + shared[:150]) + " " + prose(300 + k, 20 + k)) for k in range(40)]
    got = dedup_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_texts_keep_columns(spark, odd_docs):
    docs = odd_docs.withColumn("grp", F.lit(1)).withColumn("hash", F.lit("x"))
    got = dedup_texts(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    by = {r["doc_id"]: r["text"] for r in got.where("doc_id < 5").collect()}
    assert by[1] == "" and len(by[0]) > 100 and by[2] is None


def test_second_hash(spark, monkeypatch):
    from siltstone.llm import exchange

    monkeypatch.setattr(exchange, "hash_width", lambda n: 3)
    rows = [(k, prose(7, 30) if k % 2 else prose(k, 30)) for k in range(12)]
    got = dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty(no_docs):
    assert dedup_digests(no_docs).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64 for every base."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(k, " ".join([*prose(9, 12).split(), word if k % 2 else other])) for k in range(4)]
    assert sorted((tuple(r) for r in dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


def test_span_hashes():
    """Every span of 1 to 80 bytes of a noisy text: equal hashes only for equal bytes, other salts other hashes."""
    import numpy as np

    from siltstone.llm.textbytes import span_hashes

    raw = np.random.default_rng(3).integers(0, 3, 3000).astype(np.uint8)
    starts = np.repeat(np.arange(2900), 80)
    ends = starts + np.tile(np.arange(1, 81), 2900)
    for salt in (0, 7):
        seen = {}
        for a, b, h in zip(starts.tolist(), ends.tolist(), span_hashes(raw, starts, ends, salt).tolist(), strict=True):
            assert seen.setdefault(h, raw[a:b].tobytes()) == raw[a:b].tobytes()
    assert not (span_hashes(raw, starts, ends) == span_hashes(raw, starts, ends, 7)).any()


def test_groups_of_bytes_and_a_frequent_id(spark, monkeypatch):
    """Ranges are cut by bytes; an id with a third of the rows is dealt over several groups."""
    from siltstone.llm import exchange

    shared = prose(50, 60)
    rows = [(k if k % 3 else 40, prose(k, 30) + " " + shared + " " + prose(k // 2, 30) * (40 if 60 < k < 70 else 1)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(exchange, "GROUP_BYTES", 4000)
    monkeypatch.setattr(exchange, "UNIT_BYTES", 256)
    groups = exchange.group_count(sum(len(t) for _, t in rows))
    points = exchange.range_points(docs, groups)
    assert (points == 40).sum() > 3
    got = dedup_digests(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    import pyarrow as pa

    held = exchange.assignment(points)(pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in rows], "text": [t for _, t in rows]}))
    assert len(set(held[[k == 40 for k, _ in rows]])) > 3


def test_hash_order():
    import numpy as np

    from siltstone.llm.textbytes import hash_order

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000, 70_000):
        for most in (1 << 63, 50, 1 << 20):  # the small ones differ in low bits alone
            h = rng.integers(0, most, n, dtype=np.uint64)
            assert (hash_order(h) == np.argsort(h, kind="stable")).all()
