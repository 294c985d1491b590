"""Suffix arrays of byte regions in numpy: Larsson-Sadakane refinement and Kasai common prefixes."""

from __future__ import annotations

import numpy as np

_FIRST = 7  # bytes that the first sort looks at; 9 bits each


def larsson_sadakane(text: np.ndarray, limit: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, by ``depth`` bytes at least.

    ``limit[i]`` is the end of the region that holds position i; suffixes end there. Groups of
    equal prefixes of length h are refined by the rank of the suffix h further on, and h doubles;
    groups of one are left alone.
    """
    n = len(text)
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    padded = np.r_[text, np.zeros(_FIRST, np.uint8)]
    for j in range(_FIRST):
        code = padded[j : j + n].astype(np.uint64) + np.uint64(1)
        code[at + j >= limit] = 0
        key = (key << np.uint64(9)) | code
    order = np.argsort(key)
    ordered = key[order]
    start = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(start, at, 0))
    rank[order] = group
    h = _FIRST
    while h < depth:
        alone = start & np.r_[start[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        part = order[open_]
        following = part + h
        inside = following < limit[part]
        second = np.zeros(len(part), np.int64)
        second[inside] = rank[following[inside]] + 1
        key2 = (group[open_] << 32) | second
        turn = np.argsort(key2)
        order[open_] = part[turn]
        key2 = key2[turn]
        start[open_] = np.r_[True, key2[1:] != key2[:-1]]
        group = np.maximum.accumulate(np.where(start, at, 0))
        rank[order[open_]] = group[open_]
        h *= 2
    return order


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as one number; the text must be followed by 8 bytes more."""
    return np.ndarray((len(text) - 8,), "<u8", buffer=text, strides=(1,))


def kasai(text: np.ndarray, limit: np.ndarray, order: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``cap`` bytes.

    Kasai's walk over the text - the common prefix shrinks by one byte at most from a position
    to the next - runs over many stretches of the text at once, a lane each, and compares eight
    bytes a step. Where the suffixes one further on stand the other way round (the order is by a
    depth only), a lane starts anew.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    word = words_at(np.r_[text, np.zeros(cap + 16, np.uint8)])
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n)
    place[n] = -1
    along = np.zeros(n, np.int64)
    stretch = -(-n // lanes)
    i = np.arange(0, n, stretch)
    end = np.minimum(i + stretch, n)
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        most = np.where(j >= 0, np.minimum(np.minimum(limit[i] - i, limit[j] - j), cap), 0)
        unlike = word[i + h] ^ word[np.maximum(j, 0) + h]
        low = unlike & (~unlike + np.uint64(1))
        # equal leading bytes: the exponent of the lowest different bit, by eight
        equal = np.where(unlike == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
        h = np.minimum(h + equal, most)
        done = (equal < 8) | (h >= most)
        along[i[done]] = h[done]
        follows = place[np.where(j >= 0, j + 1, n)] < place[np.minimum(i + 1, n - 1)]
        h = np.where(done, np.where(follows, np.maximum(h - 1, 0), 0), h)
        i = i + done
        stay = i < end
        if not stay.all():
            i, end, h = i[stay], end[stay], h[stay]
    return along[order]


def equal_prefix_classes(text: np.ndarray, limit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and in that order the start of every class of suffixes with equal first ``width`` bytes."""
    order = larsson_sadakane(text, limit, width)
    common = kasai(text, limit, order, width)
    return order, np.flatnonzero(common < width)
