import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.model_path("piece_bpe_32k.model"))


def brute(model, word):
    """Best total by trying every cut."""
    known = {s: i for i, s in enumerate(model.spelt) if s and model.byte_ids[s[0]] != i and model.scores[i] < 0}
    best = [0.0] + [-math.inf] * len(word)
    for i in range(len(word)):
        width = 1 if word[i] < 0x80 else 2 if word[i] < 0xE0 else 3 if word[i] < 0xF0 else 4
        if best[i] > -math.inf:
            for j in range(i + 1, len(word) + 1):
                if word[i:j] in known:
                    best[j] = max(best[j], best[i] + model.scores[known[word[i:j]]])
            if word[i : i + width] not in known:
                best[i + width] = max(best[i + width], best[i] + model.unknown)
    return best[-1]


def total(model, ids, word):
    out, at, k = 0.0, 0, 0
    while k < len(ids):
        if model.byte_ids[word[at]] == ids[k]:
            width = 1 if word[at] < 0x80 else 2 if word[at] < 0xE0 else 3 if word[at] < 0xF0 else 4
            out, at, k = out + model.unknown, at + width, k + width
        else:
            out, at, k = out + model.scores[ids[k]], at + len(model.spelt[ids[k]]), k + 1
    return out


def test_viterbi_is_best(model):
    r = random.Random(3)
    words = [" ".join(["", "".join(r.choice("thenioréñ日sq,") for _ in range(r.randint(1, 10)))]).encode() for _ in range(200)]
    many = pieces.viterbi_many(model, words)
    for w, ids in zip(words, many, strict=True):
        got = np.frombuffer(ids, model.kind).tolist()
        assert got == pieces.viterbi_one(model, w)
        assert total(model, got, w) == pytest.approx(brute(model, w))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n▁ab")), max_size=40), max_size=5))
def test_round_trip(model, texts):
    codec = pieces.Codec(model)
    assert [codec.decode(x) for x in codec.encode(texts)] == texts


def test_cached_words_equal_whole_texts(model):
    codec = pieces.Codec(model)
    codec.LIMIT = 5
    for text in ("the quick brown fox\njumps, over", "a b", "x"):
        for _ in range(3):
            assert np.frombuffer(codec.encode([text])[0], model.kind).tolist() == pieces.viterbi_one(model, (" " + text).encode())


def test_double_array():
    words = [b"a", b"ab", b"abc", b"b", b"ba", "é".encode()]
    base, check, value = pieces.double_array(words)
    for k, w in enumerate(words):
        state = 0
        for c in w:
            to = base[state] + c + 1
            assert check[to] == state
            state = to
        assert value[state] == k


def test_table(spark, odd_docs, no_docs):
    rows = sorted((str(r["doc_id"]), r["text"] or "") for r in odd_docs.collect())
    for done in (pieces.decode(pieces.encode(odd_docs)), pieces.round_trip(odd_docs.withColumnRenamed("source", "pieces"))):
        assert sorted((str(r["doc_id"]), r["text"]) for r in done.collect()) == rows
    assert pieces.decode(pieces.encode(no_docs)).count() == 0


def test_decoding_of_any_ids(spark, model):
    """Null lists, unknown and null ids, and pieces that do not begin a text or cut a character."""
    ids = {s: i for i, s in enumerate(model.spelt) if s and model.byte_ids[s[0]] != i}
    rows = [(1, [ids[b"ing"]]), (2, [ids[b" the"], ids[b"re"]]), (3, [int(model.byte_ids[0xC3])]), (4, None), (5, []), (6, [-5, 1 << 30, None, ids[b"re"]]), (7, [0, 1, 2])]
    got = {r["doc_id"]: r["text"] for r in pieces.decode(spark.createDataFrame(rows, "doc_id long, pieces array<int>")).collect()}
    assert got == {1: "ing", 2: "there", 3: "�", 4: None, 5: "", 6: "re", 7: ""}


def test_public_library_agrees_on_the_pieces(model):
    """Every piece of a text is one that the public model file spells, and the library decodes them alike."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path("piece_bpe_32k.model"))
    codec = pieces.Codec(model)
    texts = ["the quick brown fox, jumps over", "ñandú 日本 🎉", "it is 12 34"]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert library.decode(np.frombuffer(ids, model.kind).tolist()) == text
