"""Texts of an Arrow batch as one byte buffer, and vectorised words, hashes and windows over it.

All functions work on a slice of a few MB at a time, so memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Fixed odd multiplier of the polynomial (Rabin-Karp) window hash; arithmetic is modulo 2**64.
WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
SEED = np.uint64(0x9E3779B97F4A7C15)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64
#: Of a u64 that holds eight bytes, the bits of the first 0 to 8 of them.
HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean() -> None:
    """Let Arrow use the allocator that ``trim`` can empty."""
    pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Give freed memory back to the system (glibc; elsewhere no change), as idle workers stay."""
    if _trim is not None:
        _trim(0)


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, starts, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(starts, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text, at least one row each."""
    _, offsets = flatten(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_order(hashes: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit hashes, by sorting their high bits with the places in the low ones.

    A sort of plain values takes a fraction of one that yields places. Different hashes of equal high
    bits are rare; where they come out in the wrong order the plain way is taken.
    """
    n = len(hashes)
    bits = np.uint64(max(1, n.bit_length()))
    kind = np.int32 if n < 1 << 31 else np.int64
    key = hashes >> bits
    key <<= bits
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    key &= (np.uint64(1) << bits) - np.uint64(1)
    order = key.astype(kind)
    found = hashes[order]
    return np.argsort(hashes, kind="stable").astype(kind) if (found[1:] < found[:-1]).any() else order


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (and from the end on), as one integer; zeros follow the last byte."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; another salt gives an independent hash.

    The length and then every eight bytes are mixed into the hash by a bijection, so spans of up to
    eight bytes never collide; longer ones do like random numbers. Spans over LONG_SPAN bytes take XXH3.
    """
    size = (ends - starts).astype(np.uint64)
    seed = mix(SEED[None] + np.uint64(salt))[0]
    chunks = eights(raw)
    out = mix(size + seed)
    out = mix(out ^ (chunks[starts] & HEADS[np.minimum(size, np.uint64(8))]))
    live, at = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(live):
        left = np.minimum(size[live] - np.uint64(at), np.uint64(8))
        out[live] = mix(out[live] ^ (chunks[starts[live] + at] & HEADS[left]))
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]], int(seed))
    return out


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Rolling hash of the ``width`` words from each position on; the last width - 1 positions are cut off."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = WINDOW_BASE ^ np.uint64(salt << 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= base
        total += words[k : k + n]
    return mix(total + np.uint64(width))
