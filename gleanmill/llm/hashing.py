"""Words and word shingles of whole texts as 64-bit hashes, computed for many texts at once with numpy.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; ASCII letters can be folded to lower case. Every byte
maps to a fixed random 64-bit value; a word's hash is the polynomial of those values modulo 2**64, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once (one longer text goes alone).
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, U64(base), U64)
            steps[0] = U64(1)
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, bytes, bounds)``: rows first..end-1 lie in ``bytes`` between consecutive ``bounds``. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, bounds: np.ndarray, spaces: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a text's end ends its last word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~spaces[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | list[np.ndarray], fold: bool = True) -> np.ndarray | list[np.ndarray]:
    """Hashes of stretches of bytes; for a list of ends, a list of hashes."""
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[_FOLD[data] if fold else data] * power, out=total[1:])
    ends = ends if isinstance(ends, list) else [ends]
    out = [mix(((total[e] - total[starts]) * inverse[starts]) ^ (e - starts).astype(U64)) if len(starts) else np.zeros(0, U64) for e in ends]
    return out if len(out) > 1 else out[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray, fold: bool = True, spaces: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the index of each text's first word (one more entry at the end)."""
    starts, ends = word_spans(data, bounds, spaces)
    return span_hashes(data, starts, ends, fold), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, ascending; a text of 1 to k-1 words is one shingle by itself."""
    n = len(words)
    acc = words
    for step in range(1, k):
        acc = mix(acc[: n - step] * U64(0xD6E8FEB86659FD93) + words[step:]) if n > step else np.zeros(0, U64)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        m = b - a
        if m >= k:
            s = acc[a : b - k + 1].copy()
            s.sort()
            if m > k:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif m:
            h = U64(m)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = mix(np.array([h * U64(0xD6E8FEB86659FD93) + w], U64))[0]
            out.append(np.array([h ^ U64(0xA5A5A5A5A5A5A5A5)], U64))
        else:
            out.append(np.zeros(0, U64))
    return out
