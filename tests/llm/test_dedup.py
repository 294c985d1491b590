"""Operators 3, 4 and 8 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from annoflux.llm import jaccard_join, substring_dedup, suffix_dedup

LAST = 2**63 - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs(flags):
    n, before = 0, False
    for f in flags:
        n, before = n + (f and not before), f
    return n


def expected_words(pairs, width):
    tokens = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in pairs]
    least = {}
    for k, w in tokens:
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            least[key] = min(least.get(key, LAST), k)
    out = []
    for (i, _), (k, w) in zip(pairs, tokens, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if least[tuple(w[j : j + width])] < k:
                gone[j : j + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), runs(gone)))
    return Counter(out)


def expected_bytes(pairs, width):
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in pairs]
    least = {}
    for k, b in data:
        for j in range(len(b) - width + 1):
            least[b[j : j + width]] = min(least.get(b[j : j + width], LAST), k)
    out = []
    for (i, _), (k, b) in zip(pairs, data, strict=True):
        gone = bytearray(len(b))
        for j in range(len(b) - width + 1):
            if least[b[j : j + width]] < k:
                gone[j : j + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def expected_components(pairs, similarity=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in pairs:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    holders = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            holders[x].append(n)
    root = list(range(len(sets)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for n, s in enumerate(sets):
        for m, o in Counter(m for x in s for m in holders[x] if m < n).items():
            if 100 * o >= similarity * (len(s) + len(sets[m]) - o):
                root[find(n)] = find(m)
    least = {}
    for n, (i, _) in enumerate(pairs):
        least[find(n)] = min(least.get(find(n), LAST), LAST if i is None else i)
    return Counter((i, len(sets[n]), None if least[find(n)] == LAST else least[find(n)]) for n, (i, _) in enumerate(pairs))


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("width", "bytes_each"), [(13, 1 << 20), (5, 3000)])
def test_substring_dedup(docs, width, bytes_each):
    found = substring_dedup.remove_repeated_windows(docs, width, bytes_each)
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256", "n_intervals") == expected_words(pairs_of(docs), width)


def test_substring_dedup_in_small_shards(docs, monkeypatch):
    """Shards of one document each: nothing is known inside a task."""
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 1)
    found = substring_dedup.remove_repeated_windows(docs, 13, 3000)
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256", "n_intervals") == expected_words(pairs_of(docs), 13)


@pytest.mark.parametrize(("shard", "common"), [(1 << 20, 4096), (4000, 4096), (4000, 2)])
def test_suffix_dedup(docs, shard, common):
    found = suffix_dedup.remove_repeated_strings(docs, shard_bytes=shard, common=common)
    assert got(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected_bytes(pairs_of(docs), 50)


def test_merged_runs_in_ranges():
    import numpy as np

    rnd = np.random.default_rng(0)
    runs_ = []
    for n in range(7):
        key = np.unique(rnd.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2) % np.uint64(2**64 - 59) // np.uint64(2**55) * np.uint64(2**55))
        runs_.append((key, rnd.integers(0, 50, len(key)), np.arange(len(key)) + 1000 * n))
    key, k, place = suffix_dedup.merge_runs(runs_, at_once=16)
    best = {}
    for r in runs_:
        for x, y in zip(r[0].tolist(), r[1].tolist(), strict=True):
            best[x] = min(best.get(x, 99), y)
    assert dict(zip(key.tolist(), k.tolist(), strict=True)) == best
    assert key.tolist() == sorted(best)


@pytest.mark.parametrize("tile", [4096, 2])
def test_jaccard_components(docs, tile):
    found = jaccard_join.similar_documents(docs, tile=tile, part_bytes=4000)
    assert got(found, "doc_id", "n_shingles", "component_id") == expected_components(pairs_of(docs))


@pytest.mark.parametrize("tile", [4096, 3])
def test_jaccard_on_corpus(corpus, tile):
    found = jaccard_join.similar_documents(corpus, tile=tile)
    assert got(found, "doc_id", "n_shingles", "component_id") == expected_components(pairs_of(corpus))


def test_jaccard_chain(spark):
    """Links of a chain whose ends are unlike, at the threshold itself."""
    base = [f"w{i}" for i in range(49)]
    texts = [(n, " ".join(base[:45] + [f"v{n}_{i}" for i in range(4)] if n % 2 else base)) for n in range(6)]
    texts += [(10 + n, " ".join(f"u{i}" for i in range(n, n + 49))) for n in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for tile in (4096, 2):
        assert got(jaccard_join.similar_documents(df, tile=tile), "doc_id", "n_shingles", "component_id") == expected_components(texts)


@pytest.mark.parametrize(("tile", "tile_bytes"), [(4096, 8 << 20), (4096, 20_000), (16, 8 << 20)])
def test_jaccard_large_near_group(spark, tile, tile_bytes):
    """Long near copies of three bases that share most of their words: many pairs pass the bound, blocks are cut by bytes and by sets."""
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(400)]
    texts = []
    for i in range(120):
        words = list(base)
        for at in range(7 * (i % 3), 400, 23 + i % 3):
            words[at] = f"b{i % 3}"
        for _ in range(rnd.randint(0, 12)):
            words[rnd.randrange(400)] = f"own{rnd.randint(0, 50)}"
        texts.append((i, " ".join(words[: 400 - 3 * (i % 7)])))
    texts += [(200 + i, f"short {i} text of six words") for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = jaccard_join.similar_documents(df, tile=tile, tile_bytes=tile_bytes)
    assert got(found, "doc_id", "n_shingles", "component_id") == expected_components(texts)


def test_one_of_each(docs):
    expected = expected_components(pairs_of(docs))
    kept = Counter(r.doc_id for r in jaccard_join.one_of_each(docs).collect())
    classes = Counter((i, c) for i, n, c in expected.elements() if n and i == c and i is not None)
    for i, c in classes:
        assert kept[i] >= 1, (i, c)
    assert kept[1] == 1
    assert kept[3] == 0
    assert jaccard_join.one_of_each(docs).columns == docs.columns


def test_empty_tables(none):
    assert substring_dedup.remove_repeated_windows(none).count() == 0
    assert suffix_dedup.remove_repeated_strings(none).count() == 0
    assert jaccard_join.similar_documents(none).count() == 0
    assert jaccard_join.one_of_each(none).count() == 0


def test_rows_without_ids_keep_their_own_answers(spark):
    """Two texts without ids whose hashes agree in 31 bits: only the one that repeats a passage loses it."""
    from pyspark.sql import functions as F

    passage = " ".join(f"said{i}" for i in range(20))
    other = " ".join(f"else{i}" for i in range(20))
    n = F.col("id")
    texts = spark.range(300_000).select(F.concat(F.when(n % 2 == 0, passage).otherwise(other), F.lit(" no"), n).alias("text"), (n % 2 == 0).alias("repeats"))
    short = texts.withColumn("h", F.xxhash64(F.lit(LAST).cast("long"), "text").bitwiseAND(F.lit(2**31 - 1)))
    pair = short.where("repeats").alias("a").join(short.where("not repeats").alias("b"), "h").select("a.text", "b.text").first()
    assert pair is not None
    rows = [(1, f"{passage} first"), (2, "nothing of that"), (None, pair[0]), (None, pair[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.remove_repeated_windows(df, width=13, with_text=False)
    assert sorted((r.doc_id or 0, r.n_removed) for r in found.collect()) == [(0, 0), (0, 20), (1, 0), (2, 0)]
