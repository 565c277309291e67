"""Words, shingles and their 64-bit hashes on UTF-8 bytes; helpers that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# White space between words is blank and \x09 to \x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wrapping arithmetic)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def utf8_rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each text of an Arrow column, without copying; None where null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid[i] else None


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~IS_SPACE[raw]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each byte span: a polynomial over per-byte values, from one running sum."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, lower: bool = True) -> np.ndarray:
    raw = LOWER[raw] if lower else raw
    return span_hashes(raw, *word_bounds(raw))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n word hashes, in order; empty if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(_ODD) + words[i : i + count] + np.uint64(i + 1))
    return out


def shingle_set(raw: np.ndarray | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; a shorter text is one shingle, no words give none."""
    if raw is None:
        return np.empty(0, np.uint64)
    words = word_hashes(raw)
    if 0 < len(words) < n:
        return gram_hashes(words, len(words)) + np.uint64(len(words))
    return np.unique(gram_hashes(words, n))
