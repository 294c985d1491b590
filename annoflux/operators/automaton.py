"""One scan for many sequence patterns: seeds of all patterns are looked up together, then only what can match is matched.

A pattern is a row of letter classes, some repeated. Its longest informative stretch without a
variable gap must occur in a match. Of that stretch three classes near each other, the most
telling ones, are the pattern's seed; patterns with the same distances between them share a table of
letter triples, so a sequence is read once for each of at most 21 pairs of distances, whatever the number of patterns.
Where a seed occurs the whole stretch is tested, position by position for all places at
once, and only sequences that pass meet the regular expression, which decides and gives the matches.

Patterns beyond this form (groups, alternatives, optional parts, escapes) are matched everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: Letters, then any other character, then the end of a sequence.
LETTERS, OTHER, END = 26, 26, 27
CODES = 28
#: Furthest that the classes of a seed lie apart.
SPAN = 8
#: A seed that more than this share of places is expected to have tells too little.
TELLING = 0.25
_TOKEN = re.compile(r"(\^|\$|\.|\[\^?[A-Za-z]+\]|[A-Za-z])(?:\{(\d+)(?:(,)(\d*))?\}|(\+))?")


@dataclass(frozen=True)
class Stretch:
    """Classes in a row as sets of codes, and the offsets of the seed's three among them."""

    classes: tuple[frozenset[int], ...]
    seed: tuple[int, int, int]


def classes(token: str) -> frozenset[int]:
    """The codes that a class of a pattern takes."""
    if token == ".":
        return frozenset(range(LETTERS + 1))
    letters = frozenset(ord(c) - 65 for c in token.strip("[^]") if c.isupper())
    return frozenset(range(LETTERS + 1)) - letters if token.startswith("[^") else letters


def stretches(pattern: str) -> list[list[frozenset[int]]] | None:
    """The rows of classes between variable gaps; None for a pattern of another form."""
    rows: list[list[frozenset[int]]] = [[]]
    at = 0
    while at < len(pattern):
        m = _TOKEN.match(pattern, at)
        if m is None or m[1] in "^$" and (m[2] or m[5]):
            return None
        at = m.end()
        if m[1] in "^$":
            continue
        least = int(m[2]) if m[2] else 1
        rows[-1] += [classes(m[1])] * least
        if m[5] or m[3] and m[4] != m[2]:
            rows.append([])
    return rows


def _seed(row: list[frozenset[int]]) -> tuple[float, tuple[int, int, int]] | None:
    """Share of places expected to have the best seed of a row, and its offsets."""
    if len(row) < 3:
        return None
    share = [min(1.0, len(c) / 20) for c in row]
    best = None
    for i in range(len(row) - 2):
        near = sorted(range(i + 1, min(len(row), i + SPAN)), key=lambda k: (share[k], k))[:2]
        found = (share[i] * share[near[0]] * share[near[1]], (i, *sorted(near)))
        if best is None or found < best:
            best = found
    return best


def telling(pattern: str) -> Stretch | None:
    """The stretch by which a pattern is looked for; None if it must be matched everywhere."""
    rows = stretches(pattern)
    found = [(seed, row) for row in rows or [] if (seed := _seed(row)) is not None]
    if not found:
        return None
    (share, seed), row = min(found, key=lambda x: x[0])
    return Stretch(tuple(row), seed) if share <= TELLING else None


class Automaton:
    """All patterns, ready to say which of them can match which sequences."""

    def __init__(self, patterns: list[str]):
        found = [telling(p) for p in patterns]
        self.everywhere = [i for i, s in enumerate(found) if s is None]
        kinds: dict[frozenset[int], int] = {}
        groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
        rows, self.first, self.size, self.begin = [], np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        for i, s in enumerate(found):
            if s is None:
                continue
            self.first[i], self.size[i], self.begin[i] = len(rows), len(s.classes), s.seed[0]
            rows += [kinds.setdefault(c, len(kinds)) for c in s.classes]
            a, b, c = s.seed
            own = groups.setdefault((b - a, c - a), [])
            own += [((x * CODES + y) * CODES + z, i) for x in s.classes[a] for y in s.classes[b] for z in s.classes[c]]
        self.rows = np.array(rows, np.int64)
        self.member = np.zeros((max(1, len(kinds)), CODES), bool)
        for c, k in kinds.items():
            self.member[k, list(c)] = True
        # of each pair of distances: where a triple's patterns begin, and the patterns
        self.groups = []
        for distance, own in sorted(groups.items()):
            code, pattern = np.array(sorted(own), np.int64).T
            self.groups.append((distance, np.searchsorted(code, np.arange(CODES**3 + 1)).astype(np.int64), pattern))

    @staticmethod
    def coded(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the sequences, each behind the other with ends between, and the sequence of each place."""
        text = "\n".join(sequences) + "\n"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where((points >= 65) & (points < 91), points - 65, OTHER).astype(np.int64)
        sizes = np.array([len(s) for s in sequences], np.int64)
        code[np.cumsum(sizes + 1) - 1] = END
        return np.r_[code, np.full(SPAN, END)], np.r_[np.repeat(np.arange(len(sequences)), sizes + 1), np.full(SPAN, len(sequences))]

    def candidates(self, sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (sequence, pattern) that can match, by sequence, then pattern; none of the rest matches."""
        every = np.array(self.everywhere, np.int64)
        pairs = [np.repeat(np.arange(len(sequences)), len(every)) * max(1, len(self.size)) + np.tile(every, len(sequences))]
        code, of = self.coded(sequences)
        n = len(code) - SPAN
        for (b, c), start, patterns in self.groups:
            triple = (code[:n] * CODES + code[b : n + b]) * CODES + code[c : n + c]
            lo, count = start[triple], start[triple + 1] - start[triple]
            at = np.flatnonzero(count)
            count, lo = count[at], lo[at]
            pattern = patterns[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            begin = np.repeat(at, count) - self.begin[pattern]
            k = 0
            keep = (begin >= 0) & (begin + self.size[pattern] <= n)
            begin, pattern = begin[keep], pattern[keep]
            done_begin, done_pattern = [], []
            while len(begin):  # an end between sequences is in no class
                ended = self.size[pattern] <= k
                done_begin.append(begin[ended])
                done_pattern.append(pattern[ended])
                begin, pattern = begin[~ended], pattern[~ended]
                keep = self.member[self.rows[self.first[pattern] + k], code[begin + k]]
                begin, pattern, k = begin[keep], pattern[keep], k + 1
            if done_begin:
                pairs.append(of[np.concatenate(done_begin)] * len(self.size) + np.concatenate(done_pattern))
        found = np.unique(np.concatenate(pairs))
        return found // max(1, len(self.size)), found % max(1, len(self.size))
