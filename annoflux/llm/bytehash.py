"""Vectorised Rabin-Karp hashing of words, word windows and byte grams in Arrow batches.

All hashes are polynomials modulo 2**64 over random byte codes, finished by a
mixing step. A batch is handled in pieces of about ``PIECE`` bytes so that the
work arrays stay small; a document is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[str(base)] = have
    return have[:n]


_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing permutation on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offs[0] : offs[-1]], offs - offs[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold about ``limit`` bytes, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and row of every maximal run of non-space bytes."""
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[flat]
    first = np.zeros(len(flat) + 1, bool)
    first[offsets] = True  # a row begins here, so no word goes on
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    starts = np.flatnonzero(begin)
    stop = solid
    stop[:-1] &= ~solid[1:] | first[1:-1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_CODES[flat] * _power(_BASE, len(flat)), out=total[1:])
    inverse = _power(_INVERSE, len(flat) + 1)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` values inside one row, and the index of its first value."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled *= np.uint64(_BASE)
        rolled += hashes[i : i + n]
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(rolled[at]), at


def lower_ascii(flat: np.ndarray) -> np.ndarray:
    return _LOWER[flat]


def gram_hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from every position; rows are not told apart."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_CODES[flat] * _power(_BASE, len(flat)), out=total[1:])
    out = total[width:] - total[:n]
    out *= _power(_INVERSE, n)
    return mix(out)
