"""Token-id files in Simple-8b: a 4-bit selector and 60 bits of equally wide values per 64-bit word.

A file image holds documents in order, cut into blocks of 1,024 values whose word offsets are
listed, so blocks decode on their own and all words of one selector decode as one array operation.
Token ids are stored as their rank in the file's own list of ids by falling frequency, which keeps
common ids narrow. Values of 60 bits or more are escapes: a word with selector 1 holds the place
of the full value in a table at the end of the file.

Layout, little-endian: magic "S8B1"; u32 documents, u32 blocks, u32 words, u32 list length,
u32 escapes, u64 values; then i64 document ids, u32 values per document, u32 word offset per block
(and the end), u64 listed ids, u64 escapes, u64 words.

The writer sorts documents by id over all partitions and streams each partition into images of
about a million values; Spark's Parquet writer carries the images as binary rows, so that they
land in any store that Spark can write and survive lost executors. Defined cases: null or empty
texts have the end id alone; null ids come first; documents with one id are ordered by the first 64
characters of their text, null first, and then by its hash; very long texts are encoded whole;
repeated rows are written each; extra columns are not looked at; an empty table gives an empty file
set.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.textbytes import HEADS, eights, flatten, lean, mix, slices, trim, word_spans
from siltstone.runtime import partitions_for, shared_dir, small_batches

#: Selector -> (values per word, bits per value), the published table but for selector 1, the escape.
LAYOUTS = ((240, 0), (1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([c for c, _ in LAYOUTS])
ESCAPE = 1
BLOCK = 1024
HEADER = struct.Struct("<4sIIIIIQ")
IMAGE_VALUES = 1 << 20
END_ID = 2


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    small = values < (np.uint64(1) << np.uint64(52))  # exact in a double
    out = np.frexp(np.where(small, values, 0).astype(np.float64))[1].astype(np.uint8)
    if not small.all():
        out[~small] = 52 + _widths(values[~small] >> np.uint64(52))
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offset of each block (and the end), and escaped values, of u64 values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32), np.empty(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + 240), np.uint64)
    grid[:, :BLOCK] = np.pad(values, (0, blocks * BLOCK - n)).reshape(blocks, BLOCK)
    width = np.zeros(grid.shape, np.uint8)
    width[:, :BLOCK] = _widths(grid[:, :BLOCK])
    # Greatest width of the next c values, for the counts in rising order; the last that fits wins.
    choice = np.where(width[:, :BLOCK] > 60, ESCAPE, 15).astype(np.uint8)
    reach, most = 1, width
    for selector in range(14, -1, -1):
        count, bits = LAYOUTS[selector]
        if selector == ESCAPE:
            continue
        while reach < count:
            step = min(reach, count - reach)
            most = np.maximum(most[:, : most.shape[1] - step], most[:, step:])
            reach += step
        choice[most[:, :BLOCK] <= bits] = selector
    # All blocks advance in step, a word at a time.
    lengths = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    live, place = np.arange(blocks), np.zeros(blocks, np.int64)
    steps = []
    while len(live):
        s = choice[live, place]
        steps.append((live, place, s))
        place = place + COUNTS[s]
        going = place < lengths[live]
        live, place = live[going], place[going]
    block = np.concatenate([x[0] for x in steps])
    start = np.concatenate([x[1] for x in steps])
    selector = np.concatenate([x[2] for x in steps])
    order = np.argsort(block * BLOCK + start)
    block, start, selector = block[order], start[order], selector[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    flat, base = grid.ravel(), block * grid.shape[1] + start
    for s, (count, bits) in enumerate(LAYOUTS):
        if bits and len(at := np.flatnonzero(selector == s)):
            cells = flat[base[at][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[at] |= np.bitwise_or.reduce(cells, axis=1)
    at = np.flatnonzero(selector == ESCAPE)
    words[at] |= np.arange(len(at), dtype=np.uint64)
    return words, np.searchsorted(block, np.arange(blocks + 1)).astype(np.uint32), flat[base[at]]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n values of all blocks, one array operation per selector."""
    if n == 0:
        return np.empty(0, np.uint64)
    # A block's last word may hold padding behind the block's end, for which each has room.
    room = BLOCK + 240
    out = np.zeros((len(offsets) - 1) * room, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    total = np.concatenate([[0], np.cumsum(counts)])
    firsts = offsets[:-1].astype(np.int64)
    block = np.repeat(np.arange(len(firsts)), np.diff(offsets.astype(np.int64)))
    start = block * room + total[:-1] - total[firsts][block]
    for s, (count, bits) in enumerate(LAYOUTS):
        at = np.flatnonzero(selector == s)
        if not bits or not len(at):
            continue
        mask = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
        cells = (words[at][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & mask
        out[start[at][:, None] + np.arange(count)] = cells
    at = np.flatnonzero(selector == ESCAPE)
    out[start[at]] = escapes[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out.reshape(-1, room)[:, :BLOCK].ravel()[:n]


def write_image(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: documents in the given order."""
    ids = ids.astype(np.uint64)
    if len(ids) and ids.max() < 1 << 24:
        tally = np.bincount(ids.astype(np.int64))
        listed = np.argsort(-tally, kind="stable")[: np.count_nonzero(tally)].astype(np.uint64)
        rank = np.zeros(len(tally), np.uint64)
        rank[listed.astype(np.int64)] = np.arange(len(listed), dtype=np.uint64)
        values = rank[ids.astype(np.int64)]
    else:
        listed, values = np.empty(0, np.uint64), ids
    words, offsets, escapes = encode(values)
    head = HEADER.pack(b"S8B1", len(doc_ids), len(offsets) - 1, len(words), len(listed), len(escapes), len(ids))
    parts = (doc_ids.astype("<i8"), lengths.astype("<u4"), offsets.astype("<u4"), listed.astype("<u8"), escapes.astype("<u8"), words.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def read_image(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, values per document, and all ids."""
    magic, docs, blocks, n_words, n_listed, n_escapes, n = HEADER.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b file")
    at, out = HEADER.size, []
    for count, kind in ((docs, "<i8"), (docs, "<u4"), (blocks + 1, "<u4"), (n_listed, "<u8"), (n_escapes, "<u8"), (n_words, "<u8")):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    doc_ids, lengths, offsets, listed, escapes, words = out
    values = decode(words, offsets, escapes, n)
    return doc_ids, lengths, listed[values.astype(np.int64)] if n_listed else values


class Encoder:
    """Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

    A byte-level BPE of this kind cuts a text before it merges: of a run of white space in front of
    a word, all but the last character are one piece, the last is a piece of its own unless it is a
    space, and a space opens the word's first piece. So a word has the same ids wherever it stands,
    with a space before it or without. ``_cuts_words`` checks the file for this rule; with another
    tokenizer, and for texts with other white space or an added token in them, whole texts go to
    the library.

    Words of up to 16 bytes are held in a table of SLOTS places that array operations search, by all
    their bytes, so equal entries are equal words; longer ones in a dict. A full table starts anew.
    """

    SLOTS = 1 << 21
    SHORT = 16
    JOINED = 200

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = self._cuts_words(json.loads(self.tokenizer.to_str()))
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = {" ": np.zeros(max(vocabulary.values(), default=0) + 1, bool), "\n": np.zeros(max(vocabulary.values(), default=0) + 1, bool)}
        for token, number in vocabulary.items():  # byte-level names of the space and the line feed
            self.opens[" "][number], self.opens["\n"][number] = token[:1] == "\u0120", token[:1] == "\u010a"
        single = [(c, self._library([c])[0]) for c in (",", ".")]
        self.marks = {c.encode(): int(ids[0]) for c, ids in single if len(ids) == 1}
        self._clear()

    @staticmethod
    def _cuts_words(file: dict) -> bool:
        cut, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
        plain = not (file.get("normalizer") or file.get("truncation") or file.get("padding"))
        level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        return bool(plain and level and model.get("type") == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")))

    def _clear(self) -> None:
        self.first, self.last = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.kind = np.zeros(self.SLOTS, np.uint8)  # 0 is a free place
        self.begin, self.count = np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.int32)
        self.pool, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0
        self.long: dict[tuple[bool, bytes], tuple[int, int]] = {}
        self.gaps: dict[tuple[bytes, bool], tuple[int, int]] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, ids: np.ndarray) -> tuple[int, int]:
        """Put ids into the pool: their place and number."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids), len(ids)

    def _words(self, words: list[str], opening: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words that follow a space or a line feed, and their numbers; many words are encoded at a time.

        Only the first token of each begins with the opening character, which marks where a word starts.
        """
        out, numbers, opens, skip = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], self.opens[opening], int(opening != " ")
        runs = [words[k : k + self.JOINED] for k in range(0, len(words), self.JOINED)]
        for run, ids in zip(runs, self._library([opening + opening.join(r) for r in runs]), strict=True):
            first = opens[ids]
            cuts = np.flatnonzero(first)
            if len(cuts) == len(run):
                out.append(ids[~first] if skip else ids)
                numbers.append(np.diff(cuts, append=len(ids)) - skip)
            else:
                single = [x[skip:] for x in self._library([opening + w for w in run])]
                out += single
                numbers.append(np.array([len(x) for x in single], np.int64))
        return np.concatenate(out), np.concatenate(numbers)

    def _find(self, first: np.ndarray, last: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Place of each word in the table, -1 where it is not in it."""
        out = np.full(len(first), -1, np.int64)
        live, place = np.arange(len(first)), self._place(first, last, kind)
        while len(live):
            there = self.kind[place]
            hit = (there == kind[live]) & (self.first[place] == first[live]) & (self.last[place] == last[live])
            out[live[hit]] = place[hit]
            on = np.flatnonzero(~hit & (there > 0))
            live, place = live[on], (place[on] + 1) % self.SLOTS
        return out

    def _place(self, first: np.ndarray, last: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return (mix(first ^ mix(last + kind.astype(np.uint64))) >> np.uint64(64 - (self.SLOTS.bit_length() - 1))).astype(np.int64)

    def _enter(self, first: np.ndarray, last: np.ndarray, kind: np.ndarray, number: np.ndarray, ids: np.ndarray) -> None:
        """Put words that are not in the table, each given once, into it with their ids."""
        live, place = np.arange(len(first)), self._place(first, last, kind)
        entry = np.empty(len(first), np.int64)
        while len(live):
            free, winner = np.unique(np.where(self.kind[place] == 0, place, -1), return_index=True)
            winner = winner[free >= 0]
            at = place[winner]
            entry[live[winner]] = at
            self.first[at], self.last[at], self.kind[at] = first[live[winner]], last[live[winner]], kind[live[winner]]
            left = np.ones(len(live), bool)
            left[winner] = False
            live, place = live[left], (place[left] + 1) % self.SLOTS
        self.held += len(first)
        self.begin[entry], self.count[entry] = self._keep(ids)[0] + np.cumsum(number) - number, number

    def _keys(self, chunks: np.ndarray, begin: np.ndarray, size: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of short words as two integers, and their length with the space in front."""
        n = size.astype(np.uint64)
        first = chunks[begin] & HEADS[np.minimum(n, np.uint64(8))]
        last = np.zeros(len(begin), np.uint64)
        over = np.flatnonzero(n > 8)
        last[over] = chunks[begin[over] + 8] & HEADS[n[over] - np.uint64(8)]
        return first, last, (n + np.uint64(self.SHORT) * spaced).astype(np.uint8)

    @staticmethod
    def _once(*keys: np.ndarray) -> np.ndarray:
        """The place of one word of each key."""
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        return order[new]

    def _learn(self, raw: np.ndarray, chunks: np.ndarray, begin: np.ndarray, size: np.ndarray, spaced: np.ndarray) -> None:
        """Enter words at places of a text that are not in the table, each given once."""
        end = raw[begin + size - 1]
        letter = raw[begin + np.maximum(size, 2) - 2] | 32
        # A comma or full stop behind a letter, at a word's end, is a token of its own.
        mark = np.full(len(begin), -1, np.int64)
        for sign, number in self.marks.items():
            mark[(end == sign[0]) & (size > 1) & (letter >= 97) & (letter <= 122)] = number
        ended = np.flatnonzero(mark >= 0)
        if len(ended):  # their stems are words, known ones or not
            rest = np.flatnonzero(mark < 0)
            if len(rest):
                self._learn(raw, chunks, begin[rest], size[rest], spaced[rest])
            stem = self._keys(chunks, begin[ended], size[ended] - 1, spaced[ended])
            place = self._find(*stem)
            if len(missing := np.flatnonzero(place < 0)):
                once = ended[missing[self._once(*(k[missing] for k in stem))]]
                self._learn(raw, chunks, begin[once], size[once] - 1, spaced[once])
                place[missing] = self._find(*(k[missing] for k in stem))
            count = self.count[place].astype(np.int64) + 1
            pick = np.repeat(self.begin[place] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            ids = self.pool[np.minimum(pick, self.used - 1)]
            ids[np.cumsum(count) - 1] = mark[ended]
            self._enter(*self._keys(chunks, begin[ended], size[ended], spaced[ended]), count, ids)
            return
        data = raw.tobytes()
        for side in (True, False):
            rows = np.flatnonzero(spaced == side)
            words = [data[i:j].decode() for i, j in zip(begin[rows].tolist(), (begin[rows] + size[rows]).tolist(), strict=True)]
            ids, number = self._words(words, " " if side else "\n")
            self._enter(*self._keys(chunks, begin[rows], size[rows], spaced[rows]), number, ids)

    def _gap(self, gap: bytes, closing: bool) -> tuple[int, int]:
        """Ids of a run of white space that are not the next word's; ``closing`` where no word follows."""
        if (gap, closing) not in self.gaps:
            text = gap.decode()
            parts = [text] if closing else [text[:-1], text[-1:].rstrip(" ")]
            self.gaps[gap, closing] = self._keep(np.concatenate([np.empty(0, np.uint32), *self._library([p for p in parts if p])]))
        return self.gaps[gap, closing]

    def _odd(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text has to go to the library whole."""
        odd = np.full(len(offsets) - 1, not self.by_words)
        if odd.all():
            return odd
        at = np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F) | (raw == 0xC2) | (raw >= 0xE1) & (raw <= 0xE3))
        if len(at):  # white space beyond ASCII
            wide = np.pad(raw, (0, 2))
            a, b, c = raw[at], wide[at + 1], wide[at + 2]
            general = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            at = at[(a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | general | (a == 0xE3) & (b == 0x80) & (c == 0x80)]
            odd[np.searchsorted(offsets, at, side="right") - 1] = True
        data = raw.tobytes() if self.added else b""
        for token in self.added:
            place = data.find(token)
            while place >= 0:  # across two texts it marks the first, which does no harm
                odd[np.searchsorted(offsets, place, side="right") - 1] = True
                place = data.find(token, place + 1)
        return odd

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with ``end`` behind it, and their numbers."""
        if len(self.long) > self.SLOTS // 16 or self.used > 1 << 23:
            self._clear()
        rows = len(offsets) - 1
        odd = self._odd(raw, offsets)
        starts, ends, text = word_spans(raw, offsets)
        if odd.any():
            keep = ~odd[text]
            starts, ends, text = starts[keep], ends[keep], text[keep]
        size = ends - starts
        # The gap before each word reaches back to the word before it in the text, or to the text's start.
        opening = offsets[:-1][text]
        if len(text):
            same = np.flatnonzero(text[1:] == text[:-1])
            opening[same + 1] = ends[same]
        spaced = np.zeros(len(starts), bool)
        behind = np.flatnonzero(starts > opening)
        spaced[behind] = raw[starts[behind] - 1] == 32
        short = np.flatnonzero(size <= self.SHORT)
        chunks, begin = eights(raw), starts[short]
        first, last, kind = self._keys(chunks, begin, size[short], spaced[short])
        place = self._find(first, last, kind)
        if len(missing := np.flatnonzero(place < 0)):
            keys = first[missing], last[missing], kind[missing]
            once = self._once(*keys)
            if self.held + len(once) > self.SLOTS * 5 // 8:
                if not self.held:  # more new words than there is room for
                    return self._halves(raw, offsets, end)
                self._clear()
                return self.encode(raw, offsets, end)
            chosen = short[missing[once]]
            self._learn(raw, chunks, starts[chosen], size[chosen], spaced[chosen])
            place[missing] = self._find(*keys)
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[short], count[short] = self.begin[place], self.count[place]
        for k in np.flatnonzero(size > self.SHORT).tolist():
            key = (bool(spaced[k]), raw[starts[k] : ends[k]].tobytes())
            if key not in self.long:
                self.long[key] = self._keep(self._words([key[1].decode()], " " if key[0] else "\n")[0])
            at[k], count[k] = self.long[key]
        # What stands between the words, as (word that follows, text, place in the pool, number of ids).
        rest = np.searchsorted(text, np.arange(rows), side="right")
        between = [np.empty((0, 4), np.int64)]
        one = np.flatnonzero((starts - opening == 1) & ~spaced)
        for byte in np.unique(raw[starts[one] - 1]).tolist():
            where = one[raw[starts[one] - 1] == byte]
            between.append(np.stack([where, text[where], *(np.full(len(where), x) for x in self._gap(bytes([byte]), False))], axis=1))
        wide = np.flatnonzero(starts - opening > 1).tolist()
        more = [(k, text[k], *self._gap(raw[opening[k] : starts[k]].tobytes(), False)) for k in wide]
        tail = offsets[:-1].copy()
        full = np.unique(text)
        tail[full] = ends[rest[full] - 1]
        more += [(rest[k], k, *self._gap(raw[tail[k] : offsets[k + 1]].tobytes(), True)) for k in np.flatnonzero((tail < offsets[1:]) & ~odd).tolist()]
        closing = self._keep(np.array(end, np.uint32))
        whole, base = np.flatnonzero(odd).tolist(), self.used
        extra = self._library([raw[offsets[k] : offsets[k + 1]].tobytes().decode() for k in whole])
        for k, ids in zip(whole, extra, strict=True):
            more.append((rest[k], k, base, len(ids)))
            base += len(ids)
        between += [np.array(more, np.int64).reshape(-1, 4), np.stack([rest, np.arange(rows), *(np.full(rows, x) for x in closing)], axis=1)]
        between = np.concatenate(between)
        between = between[np.lexsort((np.arange(len(between)), between[:, 1], between[:, 0]))]
        at, count, text = (np.insert(x, between[:, 0], between[:, k]) for x, k in ((at, 2), (count, 3), (text, 1)))
        pick = np.repeat(at - np.cumsum(count) + count, count)
        pick += np.arange(len(pick))
        pool = self.pool[: self.used]
        return (np.concatenate([pool, *extra]) if extra else pool)[pick], np.bincount(text, count, rows).astype(np.int64)

    def _halves(self, raw: np.ndarray, offsets: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` by halves of the texts; one text alone goes to the library."""
        rows = len(offsets) - 1
        if rows == 1:
            ids = np.append(self._library([raw.tobytes().decode()])[0], np.array(end, np.uint32)).astype(np.uint32)
            return ids, np.array([len(ids)])
        cut = offsets[rows // 2]
        a, b = self.encode(raw[:cut], offsets[: rows // 2 + 1], end), self.encode(raw[cut:], offsets[rows // 2 :] - cut, end)
        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        ids, sizes = self.encode(*flatten(pa.array(texts, pa.large_string())), [])
        ends = np.cumsum(sizes).tolist()
        return [ids[i:j].astype("<u4").tobytes() for i, j in zip([0, *ends[:-1]], ends, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _writer(name: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encode_texts, part, before, number = encoder(tokenizer_path(name)).encode, TaskContext.get().partitionId(), 0, 0
        keys, known, lengths, ids, size = [], [], [], [], 0

        def image() -> pa.RecordBatch:
            nonlocal before, number, size
            file = write_image(np.concatenate(keys), np.concatenate(lengths), np.concatenate(ids))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([np.packbits(np.concatenate(known)).tobytes()], pa.binary()), pa.array([file], pa.binary())],
                ["part", "number", "ids_before", "n_ids", "known", "file"],
            )
            before, number, size = before + size, number + 1, 0
            for held in (keys, known, lengths, ids):
                held.clear()
            return row

        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                got, sizes = encode_texts(*flatten(piece.column("text")), [end_id])
                column = piece.column("doc_id")
                keys.append(column.fill_null(0).to_numpy())
                known.append(column.is_valid().to_numpy(zero_copy_only=False))
                lengths.append(sizes)
                ids.append(got)
                size += len(got)
                if size >= IMAGE_VALUES:
                    yield image()
        trim()
        if keys:
            yield image()

    return write


def write_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Write the file set of (doc_id, text) under ``path`` and return its table (part, number, ids_before, n_ids, known, file).

    Parts follow each other in id order, as do the numbers in a part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select("doc_id", "text")
    order = ["doc_id", F.substring("text", 1, 64), F.xxhash64("text")]  # whole texts would be sampled to the driver
    ordered = narrow.repartitionByRange(partitions_for(narrow), *order).sortWithinPartitions(*order)
    schema = "part int, number int, ids_before long, n_ids long, known binary, file binary"
    ordered.mapInArrow(_writer(tokenizer, end_id), schema).write.option("compression", "uncompressed").parquet(path)  # the words hardly compress
    return spark.read.schema(schema).parquet(path)


def _reader(starts: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part, before, known, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                doc_ids, lengths, ids = read_image(file.as_buffer())
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths.astype(np.int64))
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                valid = np.unpackbits(np.frombuffer(known.as_buffer(), np.uint8), count=len(doc_ids)).astype(bool)
                first = starts[part] + before
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=~valid), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        trim()

    return read


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    The driver sees one number per part of the file set, independent of the documents in it.
    """
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sums):
        starts[part], total = total, total + sums[part]
    return files.select("part", "ids_before", "known", "file").mapInArrow(_reader(starts), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_id_files(spark, sf_dir: str) -> DataFrame:
    """Write the token ids of ``documents`` as Simple-8b files and return what the files hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_files(write_files(docs, shared_dir(spark, "simple8b")))
