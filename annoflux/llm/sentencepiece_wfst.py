"""SentencePiece encoding and decoding by weighted finite-state transduction.

Three transducers are compiled from a model file: the normaliser (white space becomes
the mark U+2581, one is put in front), the pieces (a trie whose accepting states write a piece),
and the byte fallback (a character that no piece spells becomes its UTF-8 bytes). ``compose``
composes them with an input: a lattice whose states are (position, last piece). The weight of a
transition in the tropical semiring is 0 if the two pieces it joins stay apart under the model's
merges, infinite if not; of the segmentations of an input exactly one has a finite weight, and the
shortest path finds it. For a model of unigram scores the weights are the scores.

No piece holds a mark anywhere but in front, apart from runs of marks, so the shortest
path of a text is the concatenation of its words' paths; each task keeps the paths of
words that it has met, in two generations: a word that comes again moves to the younger, and the
older is forgotten as a whole, so frequent words stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose paths a task keeps, parts of words, and weights of transitions; beyond that it forgets the older half, and all weights.
KEPT = 800_000
PARTS = 50_000
WEIGHTS = 400_000

# Wire format of the model file (fixed values): field numbers of ModelProto and of its messages.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_MODEL_TYPE = 3
_CHARSMAP, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 2, 3, 4, 5
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        field, wire = tag >> 3, tag & 7
        if wire == 0:
            yield field, varint()
        else:
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield field, data[at : at + size]
            at += size


def _keep(known: dict, key: object, value: object, most: int) -> None:
    if len(known) >= most:
        for old in list(known)[: most // 2]:
            del known[old]
    known[key] = value


class Transducer:
    """Normaliser, pieces and byte fallback of one model."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for field, value in _fields(model):
            if field == _PIECES:
                own = dict(_fields(value))
                self.pieces.append(own[_PIECE].decode())
                self.scores.append(float(np.frombuffer(own.get(_SCORE, b"\0\0\0\0"), "<f4")[0]))
                self.types.append(own.get(_TYPE, _NORMAL))
            elif field == _TRAINER:
                trainer = dict(_fields(value))
            elif field == _NORMALIZER:
                normalizer = dict(_fields(value))
        self.merges = trainer.get(_MODEL_TYPE, _UNIGRAM) == _BPE
        if normalizer.get(_CHARSMAP) or normalizer.get(_REMOVE_EXTRA, 1) or not normalizer.get(_ESCAPE, 1):
            raise ValueError("only the identity normaliser with escaped white space is compiled")
        if not normalizer.get(_DUMMY_PREFIX, 1):
            raise ValueError("only models that put a mark in front of a text are compiled")
        self.prefix = MARK
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (_NORMAL, _USER)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(self.types) if t == _BYTE}
        self.unknown = self.types.index(_UNKNOWN)
        self.trie: dict = {}  # by character the next state; a state that writes a piece has the key ""
        for piece in self.ids:
            state = self.trie
            for char in piece:
                state = state.setdefault(char, {})
            state[""] = True
        # by id the text it stands for; bytes of longer characters as lone surrogates until they meet
        self.texts = [p.replace(MARK, " ") for p in self.pieces]
        for i, kind in enumerate(self.types):
            if kind == _BYTE:
                byte = int(self.pieces[i][3:5], 16)
                self.texts[i] = chr(byte) if byte < 128 else chr(0xDC00 + byte)
            elif kind == _CONTROL:
                self.texts[i] = ""
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("a piece runs over a word's end")
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.apart: dict[str, dict[str, bool]] = {}  # by piece before, by piece
        self.weights = 0
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    # -- the transducers ---------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        """Input side of the first transducer; the empty text stays empty."""
        return self.prefix + text.replace(" ", MARK) if text else ""

    def fallback(self, char: str) -> tuple[int, ...]:
        """Byte ids of a character without a piece."""
        if not self.byte_ids:
            return (self.unknown,)
        return tuple(self.byte_ids[b] for b in char.encode())

    def _merged(self, symbols: list[str]) -> list[str]:
        """The model's merges on a short string: the best-scored pair first, the leftmost of equals."""
        while len(symbols) > 1:
            best, where = -math.inf, -1
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, where = self.scores[piece], i
            if where < 0:
                break
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
        return symbols

    def weight(self, before: str, piece: str) -> float:
        """Tropical weight of ``piece`` after ``before`` (``""`` at the start)."""
        if not self.merges:
            return -self.scores[self.ids[piece]] if piece in self.ids else 10.0 - min(self.scores)
        apart = self.apart.get(before, {}).get(piece)
        if apart is None:
            whole = before + piece
            apart = self._merged(list(whole)) == ([before, piece] if before else [piece])
            if self.weights >= WEIGHTS:
                self.apart.clear()
                self.weights = 0
            self.apart.setdefault(before, {})[piece] = apart
            self.weights += 1
        return 0.0 if apart else math.inf

    def compose(self, word: str) -> list[list[int]]:
        """The lattice of a normalised word: by position the ends of the arcs that leave it, longest first.

        An arc is a piece, or a single character that the fallback spells.
        """
        return [self.arcs(word, at) for at in range(len(word))]

    def arcs(self, word: str, at: int) -> list[int]:
        """Ends of the arcs that leave one position, longest first."""
        n, state, end, ends = len(word), self.trie, at, []
        while end < n and word[end] in state:
            state = state[word[end]]
            end += 1
            if "" in state:
                ends.append(end)
        if not ends or ends[0] > at + 1:
            ends.insert(0, at + 1)
        ends.reverse()
        return ends

    def _only_path(self, word: str) -> list[str]:
        """The shortest path where weights are 0 or infinite: arcs are tried longest first, dead states once.

        Of the lattice only the positions that the search reaches are composed.
        """
        lattice: dict[int, list[int]] = {}
        apart, none = self.apart, {}
        n, at, before, arc = len(word), 0, "", 0
        out: list[str] = []
        tried: list[int] = []  # arc from which the state before each piece of ``out`` goes on trying
        dead: set[tuple[int, str]] = set()  # states from which the end can't be reached
        while at < n:
            ends, follow = lattice.get(at), apart.get(before, none)
            if ends is None:
                ends = lattice[at] = self.arcs(word, at)
            while arc < len(ends):
                piece = word[at : ends[arc]]
                arc += 1
                good = follow.get(piece)
                if good is None:
                    good = self.weight(before, piece) == 0.0
                if good and not (dead and (at + len(piece), piece) in dead):
                    out.append(piece)
                    tried.append(arc)
                    at, before, arc = at + len(piece), piece, 0
                    break
            else:
                dead.add((at, before))
                at, arc = at - len(out.pop()), tried.pop()
                before = out[-1] if out else ""
        return out

    def _best_path(self, word: str) -> list[str]:
        """The shortest path where a piece's weight doesn't depend on the one before it."""
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * len(word)  # by end: weight, start of its last arc
        for at, ends in enumerate(self.compose(word)):
            for end in ends:
                total = best[at][0] + self.weight("", word[at:end])
                if total < best[end][0]:
                    best[end] = (total, at)
        out, end = [], len(word)
        while end:
            out.append(word[best[end][1] : end])
            end = best[end][1]
        return out[::-1]

    def shortest_path(self, word: str) -> list[str]:
        """Pieces (or single characters without one) on the lattice's path of least weight."""
        return self._only_path(word) if self.merges else self._best_path(word)

    # -- use ---------------------------------------------------------------------------------

    def _keep_path(self, word: str, ids: bytes) -> None:
        if len(self.paths) >= KEPT // 2:
            self.older, self.paths = self.paths, {}
        self.paths[word] = ids

    def known_path(self, word: str) -> bytes:
        """Packed ids of a mark and ``word``, searched if neither generation has them."""
        ids = self.paths.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = self.path(MARK + word)
            if len(word) <= 64:
                self._keep_path(word, ids)
        return ids

    def searched(self, part: str) -> bytes:
        """Packed ids of a part's shortest path."""
        spelled: list[int] = []
        for piece in self.shortest_path(part):
            own = self.ids.get(piece)
            if own is None:
                spelled.extend(self.fallback(piece))
            else:
                spelled.append(own)
        return pack(f"<{len(spelled)}i", *spelled)

    def path(self, word: str) -> bytes:
        """Packed ids of a word: the lattice falls apart where no piece joins two characters, and each part has its own path."""
        joins = self.joins  # pairs of characters inside pieces
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joins]
        if not cuts:
            return self.searched(word)
        # the first part is a word itself, the others follow inside one
        first, found = word[: cuts[0]], []
        found.append(self.known_path(first[1:]) if first[0] == MARK else self.searched(first))
        for begin, end in zip(cuts, [*cuts[1:], len(word)], strict=True):
            part = word[begin:end]
            ids = self.parts.get(part)
            if ids is None:
                ids = self.searched(part)
                if len(part) <= 64:
                    _keep(self.parts, part, ids, PARTS)
            found.append(ids)
        return b"".join(found)

    def packed(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        if not text:
            return b""
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            words = text.split(" ")  # each word of the normalised text is a mark and one of these
        else:
            words = [w[1:] for w in self.words.findall(self.normalise(text))]
        out = list(map(self.paths.get, words))
        if None in out:
            for i, word in enumerate(words):
                if out[i] is None:
                    out[i] = self.known_path(word)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and runs of bytes; marks become spaces and the one in front goes."""
        text = "".join(map(self.texts.__getitem__, ids))
        if text[:1] == " ":
            text = text[1:]
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text


_loaded: dict[bytes, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """Compiled once in each process."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded[key] = Transducer(model)
    return _loaded[key]


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The driver's read of the model file; its bytes (0.5 MB, whatever the corpus) go to the tasks."""
    with open(path, "rb") as f:
        return f.read()


OUT = "ids array<int>, n_tokens long, decoded string, round_trip boolean"


def encode_decode(docs: DataFrame, model: bytes, with_decoded: bool = True) -> DataFrame:
    """The rows of ``docs`` with ids, n_tokens, decoded (the text of the ids) and round_trip (decoded equals the text).

    Null texts give null ids, 0 tokens, null decoded and round_trip true; empty texts no ids. Texts with the
    mark U+2581 itself come back with a space for it, and so with round_trip false. All columns of ``docs``
    stay, also when they bear the names of new ones: those are then replaced. Rows are independent of each other.
    """
    new = [x.split()[0] for x in OUT.split(", ")]
    others = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema.fields] + [OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                flat, ends, decoded, whole = [], [0], [], []
                for text in part["text"].to_pylist():
                    ids = np.frombuffer(fst.packed(text or ""), np.int32)
                    back = fst.decode(ids.tolist()) if text is not None else None
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids))
                    decoded.append(back)
                    whole.append(back == text)
                offsets = pa.array([e if d is not None else None for e, d in zip(ends[:-1], decoded, strict=True)] + [ends[-1]], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat)) if flat else pa.array([], pa.int32()))
                counts = pa.array(np.diff(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, counts, pa.array(decoded, pa.string()), pa.array(whole)], names=[*part.schema.names, *new])

    out = others.mapInArrow(run, out_schema)
    return out if with_decoded else out.drop("decoded")
