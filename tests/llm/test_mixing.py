"""Operator 12 against plain loops."""

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annoflux.llm import context_mixing as cm
from annoflux.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def base(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens and base score of (doc_id, text) rows."""
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def test_words_and_sums_by_text():
    texts = ["", " ", "A b\x0bC  a", "\t\n\x0b\x0c\r x \x1cy\x85\xa0Z\u2003É \0 ", "a" * 300, "Ａ É", *(f" {n} b" for n in range(9))]
    column = pa.chunked_array([texts[:2], [], texts[2:7], texts[7:]], pa.string())
    want = [WORD.findall(t.translate(LOWER)) for t in texts]
    found, sizes = cm.words(column)
    assert [w.decode() for w in found.to_pylist()] == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]
    known = {"a": 3, "b": 1, "\0": 7, "É": 2, "other": 10**9}
    table = pa.table({"word": [w.encode() for w in known], "c": list(known.values())})
    for n_train in (0, 5):
        tokens, n_known, sums = cm.counts_of(column, table, n_train)
        assert tokens.tolist() == [len(ws) + 1 for ws in want]
        assert n_known.tolist() == [sum(w in known for w in ws) + (n_train > 0) for ws in want]
        assert sums.tolist() == pytest.approx([sum(math.log10(known.get(w, 0) + 1) for w in ws) + math.log10(n_train + 1) for ws in want])


def test_words_of_no_text():
    none = pa.chunked_array([], pa.string())
    known = pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    assert [len(x) for x in cm.words(none)] == [0, 0]
    assert [x.tolist() for x in cm.counts_of(none, known, 3)] == [[], [], []]
    assert [x.tolist() for x in cm.counts_of(pa.chunked_array([["a b", ""]]), known, 0)] == [[3, 1], [0, 0], [0, 0]]


def least(f):
    """CPU seconds, the least of three."""
    took = []
    for _ in range(3):
        start = time.process_time()
        f()
        took.append(time.process_time() - start)
    return min(took)


def test_words_take_less_than_half_of_the_time_of_a_loop():
    """The looking up of words as a loop took a fifth of Python's CPU time, and the query was over its budget."""
    rnd = random.Random(3)
    texts = [" ".join(f"Word{int(rnd.paretovariate(0.6)) % 50_000}" for _ in range(400)) for _ in range(500)]
    count = {w.encode(): c for w, c in Counter(w for t in texts for w in t.lower().split()).items()}
    table, column = pa.table({"word": list(count), "c": list(count.values())}), pa.chunked_array([texts])

    def loop():
        for t in texts:
            c = np.array([7, *(count.get(x, 0) for x in t.encode().lower().split())], np.int64)
            np.count_nonzero(c), np.log10(c + 1).sum()

    assert least(lambda: cm.counts_of(column, table, 7)) < least(loop) / 2


def slow_table(texts, bits):
    """Counts bit by bit."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        for end in range(1, len(t) + 2):
            window = (bytes(cm.WIDE - 1) + t + b"\xff")[end - 1 : end - 1 + cm.WIDE]
            w = np.array([int.from_bytes(window, "big")], np.uint64)
            for i, h in enumerate(cm.contexts(w)[:, 0]):
                so_far = 1
                for j in range(7, -1, -1):
                    bit = window[-1] >> j & 1
                    counts[i, int(cm.slots(np.array([h]), np.array([so_far]), bits)[0])][bit] += 1
                    so_far = so_far * 2 + bit
    table = np.zeros((cm.PREDICTORS, 1 << bits), np.int16)
    for (i, slot), (zeros, ones) in counts.items():
        table[i, slot] = cm.quantised(np.array([zeros]), np.array([ones]))[0]
    return table


def test_rows_against_brute_force(spark, rows, docs):
    pairs = [(r[0], r[1]) for r in rows]
    df = cm.score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)
    found = sorted(df.collect(), key=lambda r: (str(r[0]), r["n_tokens"], r["base_score"]))
    want = sorted(base(pairs), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r)[:5] for r in found] == [r[:5] for r in want]
    assert [r["base_score"] for r in found] == pytest.approx([r[5] for r in want], rel=1e-12)
    assert all(r["score"] < 0 and math.isclose(r["score"], -r["bits_per_byte"] * r["n_bytes"] * math.log10(2)) for r in found)


def test_table_and_score_against_loops(spark):
    texts = [f"the {a} of the {b}, {'and ' * n}é💩{n}" for a in ("cat", "dog") for b in ("hat", "Mat") for n in range(4)]
    df = spark.createDataFrame([(t,) for t in texts] * 3, "text string").repartition(4)
    size = sum(len(t.encode()) + 1 for t in texts) * 3
    table, weights, refine = cm.fit(df, size)
    assert (table == slow_table([t.encode() for t in texts] * 3, cm.BITS[0])).all()
    mixer = cm.Mixer(table, weights, refine)
    some = [b"the cat", b"", "ü the hat of".encode(), b"the cat"]
    w, sizes = cm.windows(some)
    by_byte = np.split(mixer.cost(w), np.cumsum(sizes)[:-1])
    assert mixer.score(some) == pytest.approx([x.sum() for x in by_byte])
    assert mixer.score(some)[0] == mixer.score(some)[3]


def test_distinct():
    rng = np.random.default_rng(2)
    for w in (rng.integers(0, 50, 1000), rng.integers(0, 2**48, 5000), np.zeros(7), np.zeros(0)):
        different, code = cm.distinct(w.astype(np.uint64))
        assert (different[code] == w).all() and len(different) == len(set(w.tolist()))


@pytest.mark.parametrize("near", [1, 7, 1000, 5000])
def test_distinct_by_blocks(monkeypatch, near):
    monkeypatch.setattr(cm, "NEAR", near)
    test_distinct()


def test_distinct_holds_little_at_once():
    """A piece of 4 MB took 190 MB; two tasks of an executor share 1,200 MB beside the JVM's heap."""
    w = (500_000 * np.random.default_rng(5).random(4 << 20) ** 4).astype(np.uint64)
    tracemalloc.start()
    cm.distinct(w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 << 20


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    table = cm.quantised(rng.integers(0, 9, (cm.PREDICTORS, 1 << 16)), rng.integers(0, 9, (cm.PREDICTORS, 1 << 16)))
    mixer = cm.Mixer(table)
    mixer.learn(cm.windows([b"some text to learn from, again and again" * 20])[0])
    past = np.uint64(int.from_bytes(b"the ca\0", "big"))
    cost = mixer.cost((past << np.uint64(8)) | np.arange(256, dtype=np.uint64))
    assert (2.0**-cost).sum() == pytest.approx(1)


def test_counts_take_large_numbers_and_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(cm, "BITS", (18, 18))
    texts = ["aaaa bbbb"] * 700 + ["cccc"]
    table, _, _ = cm.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 10_000)
    assert (table == slow_table([b"aaaa bbbb"] * 700 + [b"cccc"], 18)).all()


def every_window(texts):
    return Counter(w for t in texts for w in cm.windows([t.encode()])[0].tolist())


@pytest.mark.parametrize("most", [None, 1, 100, 10_000])
def test_heaps_hold_every_window(monkeypatch, most):
    monkeypatch.setattr(cm, "CHUNK", 64)
    monkeypatch.setattr(cm, "HELD", 150)
    texts = ["", "a" * 300, *(f"text {n} of {n * n}" for n in range(40)), "", "b", "b"]
    batches = [pd.DataFrame({"text": texts[:17]}), pd.DataFrame({"text": []}), pd.DataFrame({"text": texts[17:]})]
    found, longest = Counter(), max(len(t) + 1 for t in texts)
    for w, times in cm.heaps(iter(batches), most):
        assert len(set(w.tolist())) == len(w)
        assert most is None or times.sum() <= max(most, longest)
        found.update(dict(zip(w.tolist(), times.tolist(), strict=True)))
    assert found == every_window(texts)


def test_heap_is_taken_out_of_the_counts():
    texts = [f"the {a} of {b}" * 3 for a in ("cat", "dog") for b in ("hat", "mat", "hat")]
    bits, counts = 16, np.zeros((cm.PREDICTORS, 2 << 16), np.uint32)
    for w, times in cm.heaps(iter([pd.DataFrame({"text": texts})])):
        cm.add(counts, w, times, bits)
    ((w, times),) = cm.heaps(iter([pd.DataFrame({"text": texts[:2]})]))
    assert (cm.held_back(counts.astype(np.float32), w, times) == slow_table([t.encode() for t in texts[2:]], bits)).all()


@pytest.mark.parametrize("often", [1, 8])
def test_mixer_learns_from_every_bit(monkeypatch, often):
    monkeypatch.setattr(cm, "OFTEN", often)
    texts = [f"text {n % 7} of {n}, " * (1 + n % 3) for n in range(60)] + ["x" * 5000]
    shared = SimpleNamespace(value=np.zeros((cm.PREDICTORS, 2 << 16), np.float32))
    for w, times in cm.heaps(iter([pd.DataFrame({"text": texts})])):
        own = np.zeros(shared.value.shape, np.uint32)
        cm.add(own, w, times, 16)
        shared.value += own
    found = pd.concat(cm.learned(shared, 500)(iter([pd.DataFrame({"text": texts[:20]}), pd.DataFrame({"text": texts[20:]})])))
    own = found[found["kind"] == "refine"]
    every = every_window(texts)
    assert own["a"].sum() == pytest.approx(8 * sum(every.values()))
    assert own["b"].sum() == pytest.approx(sum(n * (w & 255).bit_count() for w, n in every.items()))


def test_learning_holds_one_heap_at_once():
    """Each heap was gathered beside the one before and its sorted copies."""
    rnd = random.Random(4)
    batches = [pd.DataFrame({"text": ["".join(rnd.choices("abcdefgh", k=400_000))]}) for _ in range(3)]
    shared = SimpleNamespace(value=np.full((cm.PREDICTORS, 2 << 16), 50, np.float32))
    tracemalloc.start()
    list(cm.learned(shared, 400_001)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 << 20


def test_mixer_learns_from_long_texts_alone(spark):
    words = [f"word{n % 97} and{n % 13}" for n in range(9000)]
    texts = [" ".join(words[k:] + words[:k]) for k in (0, 3000, 6000)]
    assert min(map(len, texts)) > 64 << 10
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    table, weights, refine = cm.fit(df, sum(len(t) + 1 for t in texts))
    start = cm.Mixer(table).weights
    assert refine is not None and (weights != start).any()
    unseen = [" ".join(words[1500:1700]).encode()]
    assert cm.Mixer(table, weights, refine).score(unseen)[0] < cm.Mixer(table).score(unseen)[0]


def test_weights_are_the_same_again_and_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(cm, "LEARN", 2000)
    df = spark.createDataFrame([(f"text {n % 7} of {n}, {n * n}",) for n in range(600)], "text string").repartition(5).cache()
    size = sum(len(r["text"]) + 1 for r in df.collect())
    first, second = cm.fit(df, size), cm.fit(df, size)
    assert all((a == b).all() for a, b in zip(first, second, strict=True))


def test_learns_from_every_training_text(spark, sf_dir, corpus):
    found = queries.op12_context_mixing(spark, sf_dir).collect()
    want = {r[0]: r for r in base([tuple(r) for r in corpus.select("doc_id", "text").collect()])}
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[:5] == want[r["doc_id"]][:5]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][5], rel=1e-11)
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["bits_per_byte"] * r["n_bytes"] for r in unseen) / sum(r["n_bytes"] for r in unseen) < 3


def test_empty(spark, none):
    assert cm.score(none, F.lit(False)).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    found = {r["n_tokens"]: r for r in cm.score(df, F.lit(True)).collect()}
    assert found[3]["base_score"] == 0 and found[3]["train_tokens"] == 0 and found[3]["bits_per_byte"] == pytest.approx(8)
    assert found[1]["doc_id"] is None and found[1]["n_bytes"] == 1
