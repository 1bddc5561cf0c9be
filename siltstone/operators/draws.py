"""Resamples replayed by SHA-256 where the values lie, without a row a draw.

Draw i of resample b is row ``sha256(seed|stratum|b|i)`` modulo the stratum's size, so n rows and B
resamples take n B digests; nothing else of that number is kept. The digests of many draws are computed
side by side in numpy; a task makes some resamples whole, of packed values, and returns one number each.
"""

from __future__ import annotations

import numpy as np

#: Draws that are hashed side by side.
LANES = 1 << 15

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, int(p**0.5) + 1))]


def _root_bits(p: int, power: int) -> int:
    """The first 32 bits behind the point of the square or cube root of a prime."""
    scaled, low, high = p << (32 * power), 0, 1 << 40
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle)
    return low & 0xFFFFFFFF


K = [np.uint32(_root_bits(p, 3)) for p in _PRIMES[:64]]
START = [np.uint32(_root_bits(p, 2)) for p in _PRIMES[:8]]


def _rotations(x: np.ndarray, first: int, second: int, third: int, shift: bool = False) -> np.ndarray:
    """The xor of three rotations to the right, the last one only a shift if so asked."""
    out = x >> first
    out ^= x << (32 - first)
    out ^= x >> second
    out ^= x << (32 - second)
    out ^= x >> third
    if not shift:
        out ^= x << (32 - third)
    return out


def _compress(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """One block of SHA-256; words that all messages share have one lane."""
    w = list(words)
    a, b, c, d, e, f, g, h = state
    met = b ^ c
    for k in range(64):
        if k >= 16:
            near, far = w[k - 2], w[k - 15]
            w.append(_rotations(near, 17, 19, 10, True) + w[k - 7] + _rotations(far, 7, 18, 3, True) + w[k - 16])
        one = _rotations(e, 6, 11, 25) + (h + K[k]) + (g ^ (e & (f ^ g))) + w[k]
        both = a ^ b
        two = _rotations(a, 2, 13, 22) + (b ^ (both & met))
        a, b, c, d, e, f, g, h, met = one + two, a, b, c, d + one, e, f, g, both
    return [x + y for x, y in zip(state, (a, b, c, d, e, f, g, h), strict=True)]


def first_words(columns: list[np.ndarray | int]) -> np.ndarray:
    """The first 32 bits of the digests of messages of equal length, given byte by byte: one number, or one a message."""
    n = len(columns)
    padded = [*columns, 128, *([0] * ((55 - n) % 64)), *(8 * n).to_bytes(8, "big")]
    words = []
    for k in range(0, len(padded), 4):
        word = np.zeros(1, np.uint32)
        for byte in padded[k : k + 4]:
            word = (word << 8) | (np.array([byte], np.uint32) if isinstance(byte, int) else byte.astype(np.uint32))
        words.append(word)
    state = [np.array([x]) for x in START]
    for k in range(0, len(words), 16):
        state = _compress(state, words[k : k + 16])
    return state[0]


def _digits(numbers: np.ndarray, count: int) -> list[np.ndarray]:
    out = []
    for _ in range(count):
        rest = numbers // 10
        out.append((numbers - 10 * rest + 48).astype(np.uint8))
        numbers = rest
    return out[::-1]


def _spans(low: int, high: int) -> list[tuple[int, int, int]]:
    """(first, end, digits) of the numbers low to high - 1."""
    return [(max(low, 10**k if k else 0), min(high, 10 ** (k + 1)), k + 1) for k in range(19) if max(low, 10**k if k else 0) < min(high, 10 ** (k + 1))]


def drawn(seed: str, name: str, first: int, end: int, n: int) -> np.ndarray:
    """(resamples first to end - 1) x (draws 0 to n - 1): the 0-based rows drawn."""
    out = np.empty((end - first, n), np.int32 if n < 1 << 31 else np.int64)
    head, bar = list(f"{seed}|{name}|".encode()), [124]
    for low, high, size in _spans(first, end):
        for left, right, width in _spans(0, n):
            step = min(right - left, LANES)
            rows = max(1, LANES // step)
            for b in range(low, high, rows):
                last = min(high, b + rows)
                for i in range(left, right, step):
                    stop = min(right, i + step)
                    resample, place = np.repeat(np.arange(b, last), stop - i), np.tile(np.arange(i, stop), last - b)
                    # A single resample is the same in all lanes.
                    middle = list(b"%d" % b) if last - b == 1 else _digits(resample, size)
                    got = first_words([*head, *middle, *bar, *_digits(place, width)])
                    out[b - first : last - first, i:stop] = (got % np.uint32(n) if n < 1 << 32 else got).reshape(last - b, stop - i)
    return out


def _picked(strata: list[tuple[str, np.ndarray]], seed: str, first: int, end: int):
    """For each block of resamples its first one and, for each stratum, the values drawn."""
    whole = sum(len(v) for _, v in strata)
    step = max(1, (1 << 20) // max(1, whole))
    for low in range(first, end, step):
        high = min(end, low + step)
        yield low, high, [values[drawn(seed, name, low, high, len(values))] for name, values in strata]


def means(strata: list[tuple[str, np.ndarray, np.ndarray]], seed: str, first: int, end: int) -> list[float | None]:
    """Means of resamples pooled over strata of (name, values, which are known)."""
    out: list[float | None] = []
    # An unknown value adds nothing to the sum and nothing to the number.
    both = [(name, np.stack([np.where(known, v, 0.0), known], 1)) for name, v, known in strata]
    if all(known.all() for _, _, known in strata):
        both = [(name, v) for name, v, _ in strata]
    for _, _, parts in _picked(both, seed, first, end):
        for picked in zip(*parts, strict=True):
            n = sum(len(p) if p.ndim == 1 else int(p[:, 1].sum()) for p in picked)
            out.append(float(sum((p if p.ndim == 1 else p[:, 0]).sum() for p in picked)) / n if n else None)
    return out


def medians(strata: list[tuple[str, np.ndarray, np.ndarray]], seed: str, first: int, end: int) -> list[float | None]:
    """Medians of resamples pooled over strata, halfway between the two middle values of an even number."""
    known_values = [v[known] for _, v, known in strata]
    ordered = np.unique(np.concatenate(known_values)) if known_values else np.zeros(0)
    # Places among the distinct values; unknown ones lie behind all of them and are not counted.
    codes = [(name, np.where(known, np.searchsorted(ordered, v), len(ordered)).astype(np.int32)) for name, v, known in strata]
    out: list[float | None] = []
    for low, high, parts in _picked(codes, seed, first, end):
        for row in range(high - low):
            counts = sum(np.bincount(p[row], minlength=len(ordered) + 1) for p in parts)
            upto = np.cumsum(counts[:-1])
            n = int(upto[-1]) if len(upto) else 0
            if n:
                lower, upper = (ordered[np.searchsorted(upto, k, side="right")] for k in ((n - 1) // 2, n // 2))
                out.append(float(lower) if lower == upper else float(lower + (upper - lower) * 0.5))
            else:
                out.append(None)
    return out
