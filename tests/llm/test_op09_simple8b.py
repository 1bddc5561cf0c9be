import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from siltstone.llm import simple8b as s
from siltstone.runtime import shared_dir


@settings(max_examples=150, deadline=None)
@given(hnp.arrays(np.uint64, st.integers(0, 3000), elements=st.one_of(st.integers(0, 3), st.integers(0, 1 << 20), st.integers(0, (1 << 64) - 1))))
def test_round_trip(values):
    assert (s.decode(*s.encode(values), len(values)) == values).all()


def test_words_are_packed_tightly():
    words, offsets, escapes = s.encode(np.zeros(2400, np.uint64))
    assert len(words) == 5 + 5 + 2 and len(escapes) == 0 and offsets.tolist() == [0, 5, 10, 12]
    assert len(s.encode(np.full(60, 1, np.uint64))[0]) == 1


def test_pieces_equal_whole_texts():
    encoder = s.encoder(s.tokenizer_path("byte_bpe_50k.json"))
    texts = ["a  b", " a", "a ", "x\n\ny", "a\n b", "it's 'tis a 's b", "", "\n", "a\nb c\td", "é\xa0b c", "a\x1cb <|endoftext|> d<|endoftext|>e f,", "12 34 !! ?x", "one, two. three!, 4, ñ, x,", "a b　c"]
    whole = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder(texts) == whole == encoder(texts)


def test_files(spark, odd_docs, no_docs):
    files = s.write_files(odd_docs, shared_dir(spark, "t9"))
    got = [tuple(r) for r in s.read_files(files).collect()]
    encoder = s.encoder(s.tokenizer_path("byte_bpe_50k.json"))
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for key, text in rows:
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert s.read_files(s.write_files(no_docs, shared_dir(spark, "t9"))).count() == 0


def test_any_text_against_the_library():
    """Brute force: random mixtures of words, marks and white space, and a table so small that it starts anew."""
    import random

    encoder = s.Encoder(s.tokenizer_path("byte_bpe_50k.json"))
    parts = ["a", "Zb", "'s", "ß", "日本", "1", "22", ",", ".", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", "\x0b", "\xa0", "<|endoftext|>", "<|end", "x" * 20, "ing", "　", "\x1d", "🎉"]
    r = random.Random(11)
    for round_ in range(300):
        if round_ == 150:
            encoder.SLOTS = 64
            encoder._clear()
        texts = ["".join(r.choice(parts[: 18 if round_ % 3 else None]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 12))]
        assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_another_tokenizer_takes_whole_texts():
    encoder = s.Encoder(s.tokenizer_path("word_bpe_49k.json"))
    texts = ["One, two  three\n\nfour's", "", " x "]
    assert not encoder.by_words
    assert encoder(texts) == [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_order_of_one_id_over_partitions(spark):
    from pyspark.sql import functions as F

    texts = [f"{k % 7} word {k * k}" for k in range(400)]
    docs = spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string").repartition(4)
    got = [r["n_tokens"] for r in s.read_files(s.write_files(docs, shared_dir(spark, "t9"))).orderBy("start").collect()]
    order = [r["text"] for r in docs.orderBy(F.substring("text", 1, 64), F.xxhash64("text")).collect()]
    encoder = s.encoder(s.tokenizer_path("byte_bpe_50k.json"))
    assert got == [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in order]
