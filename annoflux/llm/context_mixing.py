"""Language-model scores by online logistic context mixing, in bits of bytes.

A byte is eight binary choices. For each, predictors look up how often 0 and 1 followed in their
context - the last 1 to 5 bytes and the word so far - in hashed tables of counts, which
Spark gathers from every training text. The logits of the predictors are summed with weights that are
gated: by how many predictors have seen their context, and by how often each has seen it. The weights
are learned online, one small step after another; an adaptive map of the result then
refines it. Texts end in the byte 255, which UTF-8 never has, so the probabilities of all texts sum to at most one.

Counts (contexts, words), weights and map are all learned from every training text. The mixer, a logistic classifier, learns
in a second pass, in each task from heaps of texts: what it sees of a heap is its different windows and how often they
occur, and the heap's own counts are taken out of the tables. A heap is about ``HELD`` different windows at most, and no more than a
quarter of the training bytes (or one text). The tasks' weights are averaged, each weight by the task's sum of squared
gradients; what the maps count is summed.

Tables grow with the training bytes up to ``BITS[1]``, so a task's and the model's memory is bounded. All contexts
are functions of the last five bytes: a task counts and scores each different window of six bytes once.

Words are split, counted and looked up by Arrow, a batch at once, and summed by word in a shuffle. For the score the texts are dealt into pieces of about ``PIECE``
bytes; a piece asks for each of its words once, whatever the number of texts that have it, and
answers meet texts in the piece. Rows equal in id and text share a piece.

Rows: a null text is empty; a null doc_id counts as the empty string for the fold. Equal texts have equal
scores. Without training texts every predictor knows nothing: a bit costs a bit. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoflux.llm.storage import cut

ORDERS = (1, 2, 3, 4, 5)
#: Bytes of a window: the longest context and the byte that it predicts.
WIDE = 6
#: The orders and the word so far.
PREDICTORS = len(ORDERS) + 1
END = 255
#: Least and most bits of a table's slots.
BITS = (16, 20)
RANGE = 1 << 16
#: Bytes that one learning task reads at least, so that its weights can settle.
LEARN = 4 << 20
PIECE = 4 << 20
#: Bytes that one counting task reads at least, where there are more tasks than cores.
TASK = 256 << 20
#: Windows evaluated at once, and those whose different ones are found at once.
BLOCK, NEAR = 1 << 15, 1 << 19
#: Bytes of text that a task turns into windows at once, and different windows that it holds before it counts them or learns from them.
CHUNK, HELD = 4 << 20, 1 << 21
#: Counts from which a context has been seen more often: 0, 1, 2, 3-4, ...
SEEN = np.array([1, 2, 3, 5, 9, 17, 65])
#: Steps of the adaptive map between logits of -12 and 12, and steps of its interpolation.
STEPS, FINE = 24, 384
#: Least and most windows of a learning step.
STEP = (256, 4096)
#: Times the mean count from which a window comes in more than one learning step.
OFTEN = 8
LN2, LN10 = np.log(2), np.log(10)

COUNTED = "predictor int, part int, small binary, far binary, size int"
LEARNED = "kind string, place int, a double, b double"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_LETTER = np.array([chr(c).isalpha() if c < 128 else c != END for c in range(256)])


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that end at each byte of each text and at its end, and the texts' lengths in windows."""
    pad = b"\0" * (WIDE - 1)
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    out = np.zeros(len(data), np.uint64)
    for j in range(WIDE):
        out[j:] |= data[: len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    own = np.ones(len(data), bool)
    starts = np.r_[0, np.cumsum(sizes + WIDE - 1)[:-1]]
    own[(starts[:, None] + np.arange(WIDE - 1)).ravel()] = False
    return out[own], sizes


def contexts(w: np.ndarray) -> np.ndarray:
    """A hash of each predictor's context: rows are predictors."""
    past = w >> np.uint64(8)
    out = np.empty((PREDICTORS, len(w)), np.uint64)
    for i, k in enumerate(ORDERS):
        out[i] = past & np.uint64((1 << 8 * k) - 1)
    word, alive = np.zeros(len(w), np.uint64), np.ones(len(w), bool)
    for j in range(WIDE - 1):
        c = ((past >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64)
        alive &= _LETTER[c]
        word = np.where(alive, word * np.uint64(509) + c.astype(np.uint64) + np.uint64(1), word)
    out[-1] = word
    out = out * _M1 + (np.arange(PREDICTORS, dtype=np.uint64) + np.uint64(1))[:, None] * _M2
    return out ^ (out >> np.uint64(29))


def nodes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits so far of each byte, with a leading 1, and the bit that follows: columns are bits."""
    byte = (w & np.uint64(255)).astype(np.int64)[:, None]
    j = np.arange(8)
    return (256 | byte) >> (8 - j), (byte >> (7 - j)) & 1


def slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    return (((context + node.astype(np.uint64) * _M2) * _M3) >> np.uint64(64 - bits)).astype(np.int64)


def quantised(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A slot's logit in 13 bits and how often it was seen in 3."""
    logit = np.where(zeros + ones > 0, np.log((ones + 0.1) / (zeros + 0.1)), 0)
    return ((np.clip(np.rint(250 * logit), -2000, 2000).astype(np.int16) << 3) | np.searchsorted(SEEN, zeros + ones, "right").astype(np.int16)).astype(np.int16)


def distinct(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values and the place of each value among them: those of ``NEAR`` values at a time, then those of what is left."""
    if len(w) <= NEAR:
        return _distinct(w)
    code, held, n = np.empty(len(w), np.int32), [], 0
    for at in range(0, len(w), NEAR):
        different, own = _distinct(w[at : at + NEAR])
        code[at : at + NEAR] = own + np.int32(n)
        held.append(different)
        n += len(different)
    different, own = _distinct(np.concatenate(held))
    return different, own.take(code)


def _distinct(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By rounds of a hash table in which the last writer stays."""
    code, todo = np.empty(len(w), np.int32), np.arange(len(w), dtype=np.int32)
    bits = max(8, int(len(w)).bit_length())
    held = np.empty(1 << bits, np.int32)
    salt = np.array([_M1])
    while len(todo):
        own = w[todo]
        slot = ((own * salt) >> np.uint64(64 - bits)).astype(np.int32)
        held[slot] = todo
        stayed = held.take(slot)
        same = w.take(stayed) == own
        code[todo[same]] = stayed[same]
        todo, salt = todo[~same], salt * _M3
    first = np.zeros(len(w), bool)
    first[code] = True
    return w[first], (np.cumsum(first, dtype=np.int32) - 1).take(code)


#: Logit of what a slot holds, by its 16 bits.
_LOGIT = ((np.arange(1 << 16, dtype=np.uint16).view(np.int16) >> 3) / 250).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def refined(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The map by node and step from how often each was met and followed by a 1."""
    prior = _sigmoid(np.arange(STEPS + 1) * 24 / STEPS - 12)
    return (ones.reshape(256, -1) + 20 * prior) / (total.reshape(256, -1) + 20)


class Mixer:
    """Gated weights over the predictors of a table, and the map that refines their sum."""

    def __init__(self, table: np.ndarray, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.table, self.bits = table, int(table.shape[1]).bit_length() - 1
        self.weights = np.full((PREDICTORS + 1, PREDICTORS, len(SEEN) + 1), 0.3) if weights is None else weights
        self.refine = refine
        self.square = np.full(self.weights.size, 1e-4)
        self.ones, self.total = np.zeros(256 * (STEPS + 1)), np.zeros(256 * (STEPS + 1))

    def inputs(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits, places of their weights, nodes and bits of windows; the first two by (predictor, window, bit)."""
        node, bit = nodes(w)
        context = contexts(w)
        found = np.stack([self.table[i].take(slots(context[i][:, None], node, self.bits)) for i in range(PREDICTORS)])
        seen = found & 7
        gate = (seen > 0).sum(0, dtype=np.int16)
        place = (gate[None] * np.int16(PREDICTORS) + np.arange(PREDICTORS, dtype=np.int16)[:, None, None]) * np.int16(len(SEEN) + 1) + seen
        return _LOGIT.take(found.view(np.uint16)), place, node, bit

    def mixed(self, logit: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.clip((self.weights.astype(np.float32).ravel().take(place) * logit).sum(0), -11, 11)

    def learn(self, w: np.ndarray, times: np.ndarray | None = None, step: int = STEP[0], rate: float = 0.08) -> None:
        """One pass in order, ``step`` windows at a time, each as often as ``times`` says; then the map of what came out."""
        times = np.ones(len(w)) if times is None else times.astype(np.float64)
        flat, cells = self.weights.reshape(-1), STEPS + 1
        for at in range(0, len(w), step):
            logit, place, node, bit = self.inputs(w[at : at + step])
            n = times[at : at + step, None]
            x = self.mixed(logit, place)
            cell = (node * cells + np.rint((x + 12) * STEPS / 24).astype(np.int64)).ravel()
            self.total += np.bincount(cell, np.broadcast_to(n, bit.shape).ravel(), minlength=256 * cells)
            self.ones += np.bincount(cell, (n * bit).ravel(), minlength=256 * cells)
            slope = np.bincount(place.ravel(), (logit * (n * (bit - _sigmoid(x)))[None]).ravel(), minlength=flat.size)
            self.square += slope**2
            flat += rate * slope / np.sqrt(self.square)
        self.refine = refined(self.ones, self.total)

    def prices(self) -> np.ndarray:
        """Bits that a 0 and a 1 cost, by node and by the mixed logit in ``FINE`` steps."""
        x = np.arange(FINE + 1) * 24 / FINE - 12
        p = np.repeat(_sigmoid(x)[None], 256, 0)
        if self.refine is not None:
            at = np.arange(FINE + 1) * STEPS / FINE
            p = (p + np.stack([np.interp(at, np.arange(STEPS + 1), own) for own in self.refine])) / 2
        p = np.clip(p, 2**-16, 1 - 2**-16)
        return -np.log2(np.stack([1 - p, p]))

    def cost(self, w: np.ndarray) -> np.ndarray:
        """Bits that each window's last byte costs after the others."""
        out, prices = np.empty(len(w)), self.prices().ravel()
        for at in range(0, len(w), BLOCK):
            logit, place, node, bit = self.inputs(w[at : at + BLOCK])
            near = np.rint((self.mixed(logit, place) + 12) * (FINE / 24)).astype(np.int64)
            out[at : at + BLOCK] = prices.take((bit * 256 + node) * (FINE + 1) + near).sum(1)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text."""
        if not texts:
            return np.zeros(0)
        w, sizes = windows(texts)
        different, code = distinct(w)
        return np.add.reduceat(self.cost(different).take(code), np.r_[0, np.cumsum(sizes)[:-1]])


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    w, n = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(w)
    w, n = w[order], n[order]
    first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    return w[first], np.add.reduceat(n, first)


def heaps(batches: Iterator[pd.DataFrame | pa.RecordBatch], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of a task's texts in heaps of at most ``most`` bytes or one text: the different ones, in order, and how often they occur."""
    chunk, held, size = min(CHUNK, max(1, most or CHUNK)), [], 0
    for batch in batches:
        texts = pa.array(batch["text"], pa.string())
        ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64) + 1)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chunk, "right")))
            own = int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
            if held and most is not None and size + own > most:
                yield _together(held)
                held, size = [], 0
            held.append(np.unique(windows(texts[lo:hi].cast(pa.binary()).to_pylist())[0], return_counts=True))
            size += own
            if sum(len(w) for w, _ in held) > HELD:
                held = [_together(held)]
                if len(held[0][0]) > HELD // 2:
                    yield held.pop()
                    size = 0
            lo = hi
    if held:
        yield _together(held)


def add(table: np.ndarray, w: np.ndarray, times: np.ndarray, bits: int) -> None:
    """Counts the bits of windows in their slots."""
    for at in range(0, len(w), BLOCK):
        node, bit = nodes(w[at : at + BLOCK])
        context, n = contexts(w[at : at + BLOCK]), np.repeat(times[at : at + BLOCK].astype(np.uint32), 8)
        for i in range(PREDICTORS):
            np.add.at(table[i], (slots(context[i][:, None], node, bits) * 2 + bit).ravel(), n)


def counted(bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts of bits by slot of all texts of a task, packed by range of slots; an entry is a byte, larger ones follow apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = None
        for w, times in heaps(batches):
            if table is None:
                table = np.zeros((PREDICTORS, 2 << bits), np.uint32)
            add(table, w, times, bits)
        if table is None:
            return
        for i in range(PREDICTORS):
            for part, lo in enumerate(range(0, 2 << bits, 2 * RANGE)):
                own = table[i, lo : lo + 2 * RANGE]
                far = np.flatnonzero(own >= 255)
                row = (i, part, zlib.compress(np.minimum(own, 255).astype(np.uint8).tobytes(), 1), zlib.compress(np.stack([far.astype(np.uint32), own[far]]).tobytes(), 1), len(own))
                yield pd.DataFrame([row], columns=[c.split()[0] for c in COUNTED.split(", ")])

    return run


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of the counts over all training texts."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row in batch.itertuples(index=False):
            total = sums.setdefault((row.predictor, row.part), np.zeros(row.size, np.int64))
            own = np.frombuffer(zlib.decompress(row.small), np.uint8).astype(np.int64)
            far, value = np.frombuffer(zlib.decompress(row.far), np.uint32).reshape(2, -1)
            own[far] = value
            total += own
    for (predictor, part), total in sums.items():
        yield pd.DataFrame([(predictor, part, zlib.compress(total.astype(np.float32).tobytes(), 1))], columns=["predictor", "part", "counts"])


def held_back(counts: np.ndarray, w: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The table of ``counts`` without those of the windows ``w``."""
    bits = int(counts.shape[1]).bit_length() - 2
    own = np.zeros(counts.shape, np.uint32)
    add(own, w, times, bits)
    table = np.empty((PREDICTORS, 1 << bits), np.int16)
    for i in range(PREDICTORS):
        left = np.maximum(counts[i] - own[i], 0)
        table[i] = quantised(left[::2], left[1::2])
    return table


def in_steps(w: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a heap in a mixed order; frequent ones come in several steps, so that none outweighs the others of its step."""
    share = -(-times // max(1, OFTEN * int(times.sum()) // len(times)))
    again = np.repeat(np.arange(len(w), dtype=np.int32), share)
    salted = (w[again] + np.arange(len(again), dtype=np.uint64) * _M2) * _M3
    salted ^= salted >> np.uint64(31)
    again = again[np.argsort(salted, kind="stable")]
    return w[again], times[again] / share[again]


def by_arrow(run: Callable, columns: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` on Arrow's batches, whose texts are made Python's only a chunk at a time."""
    kinds = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, columns.split(", "))])
        for found in run(batches):
            yield pa.RecordBatch.from_pandas(found, schema, preserve_index=False)

    return on


def learned(counts: Broadcast, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What a task learns from all its texts: squared gradients and their products with the weights, and the counts of the map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer = None
        for w, times in heaps(batches, most):
            table = held_back(counts.value, w, times)
            if mixer is None:
                mixer = Mixer(table)
            mixer.table = table
            w, times = in_steps(w, times)
            mixer.learn(w, times, step=min(STEP[1], max(STEP[0], len(w) >> 8)))
            # the next heap is gathered without this one in memory
            del w, times, table
            mixer.table = None
        if mixer is not None:
            flat = mixer.weights.reshape(-1)
            yield pd.DataFrame({"kind": "weights", "place": np.arange(flat.size), "a": mixer.square, "b": mixer.square * flat})
            yield pd.DataFrame({"kind": "refine", "place": np.arange(mixer.ones.size), "a": mixer.total, "b": mixer.ones})

    return run


def words(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array | pa.ChunkedArray, np.ndarray]:
    """The words of all texts, A-Z in lower case, text by text, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, sizes = pc.list_flatten(lists), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    # splitting leaves an empty word where a text begins or ends with a space
    size = pc.binary_length(flat)
    empty = np.flatnonzero(np.asarray(size) == 0)
    if len(empty):
        sizes -= np.bincount(np.searchsorted(np.cumsum(sizes), empty, "right"), minlength=len(sizes))
        flat = flat.filter(pc.greater(size, 0))
    return flat.cast(pa.binary()), sizes


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = words(batch["text"])[0].value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "c"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each piece in each batch."""
    for batch in batches:
        pieces = np.asarray(batch["piece"])
        for piece in np.unique(pieces):
            found = words(batch["text"].filter(pa.array(pieces == piece)))[0].unique()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), piece)), found], ["piece", "word"])


def counts_of(texts: pa.ChunkedArray, known: pa.Table, n_train: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: tokens, those known and the sum of log10(c + 1), the end included, by the table ``known`` of word and c."""
    own, sizes = words(texts)
    place = np.asarray(pc.index_in(own, value_set=known["word"]).fill_null(len(known)))
    logs = np.log10(np.r_[np.asarray(known["c"]), 0] + 1)
    sums, n_known, some = np.full(len(sizes), np.log10(n_train + 1)), np.full(len(sizes), int(n_train > 0)), sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        sums[some] += np.add.reduceat(logs.take(place), starts)
        n_known[some] += np.add.reduceat((place < len(known)).astype(np.int64), starts)
    return sizes + 1, n_known, sums


def fit(train: DataFrame, n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Table, weights and map from the column ``text`` of all rows of ``train``, of ``n_bytes`` together."""
    spark = train.sparkSession
    bits = int(np.clip(np.ceil(np.log2(max(n_bytes, 1) / 64)), *BITS))
    tasks = max(spark.sparkContext.defaultParallelism, n_bytes // TASK)
    texts = train.select("text")
    merged = texts.coalesce(tasks).mapInArrow(by_arrow(counted(bits), COUNTED), COUNTED).repartition(PREDICTORS * max(1, (1 << bits) // RANGE), "predictor", "part").mapInPandas(_merged, "predictor int, part int, counts binary")
    counts = np.zeros((PREDICTORS, 2 << bits), np.float32)
    for row in merged.toLocalIterator():  # at most PREDICTORS tables of 2**BITS[1] slots of two counts
        own = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.float32)
        counts[row["predictor"], row["part"] * 2 * RANGE : row["part"] * 2 * RANGE + len(own)] = own
    table = np.stack([quantised(own[::2], own[1::2]) for own in counts])
    shared = spark.sparkContext.broadcast(counts)
    # sums in a fixed order, a number for each task
    total = lambda c: F.aggregate(F.array_sort(F.collect_list(c)), F.lit(0.0), lambda x, y: x + y).alias(c)
    found = texts.coalesce(min(tasks, max(1, n_bytes // LEARN))).mapInArrow(by_arrow(learned(shared, max(1, n_bytes // 4)), LEARNED), LEARNED).groupBy("kind", "place").agg(total("a"), total("b")).toPandas()
    shared.destroy()
    mixer = Mixer(table)
    if not len(found):
        return table, mixer.weights, None
    by_kind = {kind: own.sort_values("place") for kind, own in found.groupby("kind")}
    weights, refine = by_kind["weights"], by_kind["refine"]
    return table, (weights["b"] / weights["a"]).to_numpy().reshape(mixer.weights.shape), refined(refine["b"].to_numpy(), refine["a"].to_numpy())


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores every whole text of ``docs`` (doc_id, text), learning from the rows where ``held_out`` is not true.

    Returned, a row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10 by
    counts of words plus one), score (log10 of the text's probability by the mixed contexts), n_bytes (with the end) and bits_per_byte.
    """
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNotNull().alias("has_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    train = texts.where(~F.col("held_out")).select("text")
    size = F.octet_length("text") + 1
    n_train, train_bytes, all_bytes = texts.agg(F.count_if(~F.col("held_out")), F.sum(F.when(~F.col("held_out"), size)), F.sum(size)).first()
    table, weights, refine = fit(train, train_bytes or 0)
    model = spark.sparkContext.broadcast((table, weights, refine))

    vocabulary = cut(train.mapInArrow(_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n_words, different = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, kinds = n_words + n_train, different + (n_train > 0)
    unit = np.log10(tokens + kinds + 1)

    pieces = -(-(all_bytes or 1) // PIECE)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pieces // 4))
    dealt = texts.withColumn("piece", F.pmod(F.xxhash64("doc_id", "has_id", "text"), F.lit(pieces))).repartition(parts, "piece")
    answers = dealt.mapInArrow(_asked, "piece long, word binary").join(vocabulary, "word")

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        data = rows["text"].cast(pa.binary()).to_pylist()
        bits = Mixer(*model.value).score(data)
        n_tokens, n_known, sums = counts_of(rows["text"], known, n_train)
        n_bytes = np.array([len(t) + 1 for t in data], np.int64)
        return pa.table(
            {
                "doc_id": pc.if_else(rows["has_id"], rows["doc_id"], pa.scalar(None, pa.int64())),
                "held_out": rows["held_out"],
                "n_tokens": n_tokens,
                "n_known": n_known,
                "train_tokens": np.full(len(data), tokens),
                "base_score": sums - n_tokens * unit,
                "score": -bits * (LN2 / LN10),
                "n_bytes": n_bytes,
                "bits_per_byte": bits / n_bytes,
            }
        )

    return dealt.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(run, OUT)
