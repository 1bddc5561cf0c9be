"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and scores of a public model file are put into a double-array trie over their UTF-8
bytes (``base``/``check``), with the whitespace marker stored as a plain space. A text gets one
space in front; of all its segmentations the one with the greatest sum of log scores is taken, and
characters that no piece covers cost the least score minus 10 and become byte pieces. Decoding
joins the pieces' bytes and drops the space in front, which gives back every text exactly, marker
characters included. Files whose scores are whole numbers (merge ranks) get Zipf log scores by rank,
-ln(rank) - ln(H), so that sums of them are log probabilities.

No piece holds a space behind another character, so a text falls into independent words; each
distinct word of a batch is segmented once, thousands in step with array operations, and kept in a
bounded cache. Defined cases: null and empty texts have no pieces; ties take the longer last
piece; very long words are segmented alone; repeated rows are encoded each; extra columns are not
looked at. In decoding, null pieces give a null text; null and unknown ids and control pieces spell
nothing; a space is dropped in front only where there is one; bytes that are no UTF-8 become
replacement characters.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.textbytes import lean, slices, trim
from siltstone.runtime import small_batches

MARKER = "▁"
PENALTY = 10.0
LONG = 64


def double_array(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value (place in ``words`` or -1) of a trie; state 0 is the root, byte b is code b + 1."""
    order = sorted(range(len(words)), key=words.__getitem__)
    size = 1 << 12
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    begin = 1  # where the search for room starts; moves on once what lies behind is nearly full
    queue = [(0, 0, len(order), 0)]  # state, its range of sorted words, depth
    for state, low, high, depth in queue:
        children: list[list[int]] = []
        for k in range(low, high):
            word = words[order[k]]
            if len(word) == depth:
                value[state] = order[k]
                continue
            if not children or children[-1][0] != word[depth] + 1:
                children.append([word[depth] + 1, k, k + 1])
            else:
                children[-1][2] = k + 1
        if not children:
            continue
        first = children[0][0]
        at, seen, full = max(1, begin - first), 0, 0
        while True:
            seen += 1
            if at + 257 >= size:
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
                size *= 2
            if check[at + first] >= 0:
                full += 1
            elif all(check[at + c] < 0 for c, _, _ in children):
                break
            at += 1
        if full > 0.9 * seen:
            begin = at + first
        base[state] = at
        for code, a, b in children:
            check[at + code] = state
            queue.append((at + code, a, b, depth + 1))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


@dataclass
class Pieces:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id or -1
    scores: np.ndarray
    byte_ids: np.ndarray
    spelt: list[bytes]
    unknown: float
    cut_spaces: bool
    cut_feeds: bool

    @property
    def kind(self) -> str:
        return "<u2" if len(self.spelt) <= 1 << 16 else "<u4"


def load(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal, spelt, byte_ids = [], [b""] * n, np.full(256, -1, np.int64)
    for k in range(n):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            spelt[k] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            normal.append(k)
            spelt[k] = piece.replace(MARKER, " ").encode()
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces to fall back on")
    scores = np.zeros(n)
    given = np.array([model.get_score(k) for k in normal])
    if len(given) and (given == np.round(given)).all():
        rank = np.empty(len(given))
        rank[np.argsort(-given, kind="stable")] = np.arange(1, len(given) + 1)
        given = -np.log(rank) - math.log((1.0 / rank).sum())
    scores[normal] = given
    base, check, value = double_array([spelt[k] for k in normal])
    ids = np.append(np.array(normal, np.int32), -1)  # -1 stays -1
    texts = [spelt[k].decode() for k in normal]
    return Pieces(base, check, ids[value], scores, byte_ids, spelt, float(given.min()) - PENALTY, not any(re.search("[^ ] ", t) for t in texts), not any("\n" in t for t in texts))


def _char_bytes(first: np.ndarray) -> np.ndarray:
    return np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))


def viterbi_one(model: Pieces, word: bytes) -> list[int]:
    """Best segmentation of one word, of any length."""
    n = len(word)
    best, back = [-math.inf] * (n + 1), [(0, 0)] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = model.base, model.check, model.value, model.scores
    for i in range(n):
        here = best[i]
        if here == -math.inf:
            continue
        width = 1 if word[i] < 0x80 else 2 if word[i] < 0xE0 else 3 if word[i] < 0xF0 else 4
        state, single = 0, False
        for j in range(i, n):
            to = int(base[state]) + word[j] + 1
            if check[to] != state:
                break
            state = to
            piece = int(value[state])
            if piece >= 0:
                single |= j + 1 - i == width
                if (total := here + float(scores[piece])) > best[j + 1]:
                    best[j + 1], back[j + 1] = total, (i, piece)
        if not single and (total := here + model.unknown) > best[min(n, i + width)]:
            best[min(n, i + width)], back[min(n, i + width)] = total, (i, -1)
    out, at = [], n
    while at > 0:
        i, piece = back[at]
        out += [piece] if piece >= 0 else [int(model.byte_ids[b]) for b in reversed(word[i:at])]
        at = i
    return out[::-1]


def viterbi_many(model: Pieces, words: list[bytes]) -> list[bytes]:
    """Best segmentations of many short words, all positions in step; ids as bytes of ``model.kind``."""
    count = len(words)
    sizes = np.array([len(w) for w in words])
    top = int(sizes.max())
    text = np.zeros((count, top + 4), np.int32)
    flat = np.frombuffer(b"".join(words), np.uint8)
    rows = np.repeat(np.arange(count), sizes)
    text[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    best = np.full((count, top + 5), -np.inf)
    best[:, 0] = 0
    back = np.zeros((count, top + 5), np.int16)
    piece = np.full((count, top + 5), -1, np.int32)
    for i in range(top):
        live = np.flatnonzero((sizes > i) & (best[:, i] > -np.inf))
        width = _char_bytes(text[live, i])
        single = np.zeros(len(live), bool)
        who, state, k = np.arange(len(live)), np.zeros(len(live), np.int64), i
        while len(who) and k < top:
            to = model.base[state] + text[live[who], k] + 1
            ok = (model.check[to] == state) & (sizes[live[who]] > k)
            who, state = who[ok], to[ok].astype(np.int64)
            k += 1
            found = model.value[state]
            at = np.flatnonzero(found >= 0)
            if len(at):
                w, p = who[at], found[at]
                single[w] |= width[w] == k - i
                r = live[w]
                total = best[r, i] + model.scores[p]
                win = total > best[r, k]
                r, p = r[win], p[win]
                best[r, k], back[r, k], piece[r, k] = total[win], i, p
        r, end = live[~single], i + width[~single]
        end = np.minimum(end, sizes[r])
        total = best[r, i] + model.unknown
        win = total > best[r, end]
        r, end = r[win], end[win]
        best[r, end], back[r, end], piece[r, end] = total[win], i, -1
    at, live, steps = sizes.copy(), np.arange(count), []
    column = np.full((count, top), -2, np.int32)
    plain = np.ones(count, bool)
    place = 0
    while len(live):
        here = at[live]
        p = piece[live, here]
        plain[live] &= p >= 0
        column[live, top - 1 - place] = p
        at[live] = back[live, here]
        live, place = live[at[live] > 0], place + 1
    used = column != -2
    ends = np.cumsum(used.sum(axis=1)).tolist()
    data = column[used].astype(model.kind).tobytes()
    step = int(model.kind[2])
    out = [data[step * a : step * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    for k in np.flatnonzero(~plain):
        out[k] = np.array(viterbi_one(model, words[k]), model.kind).tobytes()
    return out


class Codec:
    """Encodes and decodes texts; remembers the words it has seen, twice LIMIT at most."""

    LIMIT = 100_000
    EDGES = ("  ", " \n", "\n ", "\n\n")
    CHUNK = re.compile(" +[^ ]*")

    def __init__(self, model: Pieces):
        self.model, self.cache, self.older = model, {}, {}

    def _segment(self, words: list[str]) -> list[bytes]:
        """Ids of words as they are spelt, with their spaces."""
        spelt = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(words)
        order = sorted((k for k in range(len(words)) if len(spelt[k]) <= LONG), key=lambda k: len(spelt[k]))
        for a in range(0, len(order), 20_000):
            part = order[a : a + 20_000]
            for k, ids in zip(part, viterbi_many(self.model, [spelt[k] for k in part]), strict=True):
                out[k] = ids
        for k, w in enumerate(spelt):
            if len(w) > LONG:
                out[k] = np.array(viterbi_one(self.model, w), self.model.kind).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.LIMIT:
            self.older, self.cache = self.cache, {}
        # A piece of a plain text has lost its space, or begins with the line feed before it.
        pieces, odd = [], {}
        for k, t in enumerate(texts):
            if not t:
                pieces.append([])
            elif self.model.cut_spaces and self.model.cut_feeds and not (any(e in t for e in self.EDGES) or t[0] in " \n" or t[-1] in " \n"):
                pieces.append(t.replace("\n", " \n").split(" "))
            else:
                pieces.append([])
                odd[k] = self.CHUNK.findall(" " + t) if self.model.cut_spaces else [" " + t]
        missing = set().union(*pieces).difference(self.cache)
        if missing:
            new = missing.difference(self.older)
            for x in missing.difference(new):
                self.cache[x] = self.older[x]
            learn = list(new)
            self.cache.update(zip(learn, self._segment([x if x[0] == "\n" else " " + x for x in learn]), strict=True))
        find = self.cache.__getitem__
        out = [b"".join(map(find, p)) for p in pieces]
        if odd:
            words = list({w for ws in odd.values() for w in ws})
            table = dict(zip(words, self._segment(words), strict=True))
            for k, ws in odd.items():
                out[k] = b"".join(map(table.__getitem__, ws))
        return out

    def decode(self, ids: bytes) -> str:
        return self.spell(np.frombuffer(ids, self.model.kind))

    def spell(self, ids: np.ndarray) -> str:
        """The text of piece ids; unknown ones are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.model.spelt))]
        joined = b"".join(map(self.model.spelt.__getitem__, ids.tolist()))
        return joined.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    lean()
    model = shared.value
    if id(model) not in _CODECS:
        _CODECS.clear()
        _CODECS[id(model)] = Codec(model)
    return _CODECS[id(model)]


def _send(spark, model: str):
    """The model for the workers."""
    small_batches(spark)
    return spark.sparkContext.broadcast(load(model_path(model)))


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = codec.encode([t or "" for t in part.column("text").to_pylist()])
                numbers = [np.frombuffer(x, codec.model.kind) for x in ids]
                ends = np.cumsum([0, *map(len, numbers)])
                flat = np.concatenate(numbers) if numbers else np.empty(0)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "pieces"])
        trim()

    return run


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, pieces) with the piece ids of every text."""
    shared = _send(docs.sparkSession, model)
    return docs.select("doc_id", "text").mapInArrow(_encoder(shared), "doc_id long, pieces array<int>")


def _ids(pieces: pa.ListScalar) -> np.ndarray:
    """The ids of one list; null ids as -1."""
    return pieces.values.fill_null(-1).to_numpy(zero_copy_only=False)


def _decoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                column = part.column("pieces")
                texts = [codec.spell(_ids(x)) if x.is_valid else None for x in column]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, pa.array(texts, pa.string())], ["doc_id", "pieces", "text"])
        trim()

    return run


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, pieces, text) with the text that the piece ids spell."""
    shared = _send(encoded.sparkSession, model)
    return encoded.select("doc_id", "pieces").mapInArrow(_decoder(shared), "doc_id long, pieces array<int>, text string")


def _both(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in _encoder(shared)(batches):
            texts = [codec.spell(_ids(x)) for x in batch.column("pieces")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "pieces", "text"])
        trim()

    return run


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, pieces, text): every text encoded and decoded again, in one pass and one Python worker."""
    shared = _send(docs.sparkSession, model)
    return docs.select("doc_id", "text").mapInArrow(_both(shared), "doc_id long, pieces array<int>, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for pieces, text in zip(batch.column("pieces"), batch.column("text"), strict=True):
            ids = np.asarray(pieces.values.to_numpy(zero_copy_only=False)).astype("<u4").tobytes()
            rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(text.as_py().encode()).hexdigest()))
        n, crc, sha = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_pieces", "pieces_crc32", "decoded_sha256"])
    trim()


def op7_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """Encode every text of ``documents``, decode it again, and return digests of both."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs)).mapInArrow(_digests, "doc_id long, n_pieces long, pieces_crc32 long, decoded_sha256 string")
