"""Operator 11 against SQL and brute force."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from annoflux.llm import hard_negatives, queries

TOP = 2**63 - 1


def expected(rows, anchor, positives=5, negatives=3):
    """Plain Python over (vec_id, label, vector) rows."""
    took = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        took.append((i, label, [math.floor(256 * float(x)) for x in v]))
    out = Counter()
    for n, (i, label, q) in enumerate(took):
        if i is None or not anchor(i):
            continue
        scored = sorted((-max(-TOP, min(TOP, sum(a * b for a, b in zip(q, r, strict=True)))), TOP if k is None else k, other == label) for m, (k, other, r) in enumerate(took) if m != n and len(r) == len(q))
        for s, k, _ in [x for x in scored if x[2]][:positives]:
            band = [(t, j) for t, j, own in scored if not own and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            for rank, (t, j) in enumerate(band, 1):
                out[i, None if k == TOP else k, rank, None if j == TOP else j, -s, -t] += 1
    return out


def mined(spark, rows, schema="vec_id long, label int, embedding array<double>, q string, mark int", **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    return Counter(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 5 == 0, F.col("label"), **more).collect()))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    df = queries.op11_hard_negatives(spark, sf_dir)
    found = con.sql(queries.OP11_SQL)
    assert df.columns == found.columns
    assert Counter(map(tuple, df.collect())) == Counter(found.fetchall())


def test_hard_rows(spark):
    """Nulls, non-finite and huge components, ties, repeated rows and ids, other lengths."""
    rnd = random.Random(5)
    centre = {label: [rnd.gauss(0, 1) for _ in range(12)] for label in range(3)}
    rows = [(i, i % 3, [c / 2 + rnd.gauss(0, 0.6) + 0.5 for c in centre[i % 3]]) for i in range(300)]
    rows += rows[:40] + [(0, 1, rows[7][2]), (5, 2, rows[8][2]), (None, 1, rows[9][2]), (None, 1, rows[9][2]), (None, 2, rows[10][2])]
    rows += [(400 + i, i % 2, [1.0] * 12) for i in range(30)]
    rows += [(500, None, rows[1][2]), (505, 1, None), (510, 1, [None] * 12), (515, 1, [float("nan")] * 12), (520, 2, [math.inf] + [0.0] * 11)]
    rows += [(600 + i, i % 2, [1.0, 2.0]) for i in range(12)] + [(700 + i, i % 2, []) for i in range(12)]
    rows += [(800, 1, [3e15] * 12), (801, 1, [2.9e15] * 12), (802, 2, [2e15] * 12), (805, 0, [1e300] * 12)]
    assert mined(spark, rows) == expected(rows, lambda i: i % 5 == 0)


def test_parts_strands_and_tiles(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, int(rnd.random() < 0.6), [rnd.gauss(0.3, 1) for _ in range(40)]) for i in range(700)]
    want = expected(rows, lambda i: i % 5 == 0, 4, 2)
    for part, strand, tile in ((30, 100, (8, 64)), (65_536, 262_144, (50, 300))):
        monkeypatch.setattr(hard_negatives, "PART", part)
        monkeypatch.setattr(hard_negatives, "STRAND", strand)
        monkeypatch.setattr(hard_negatives, "TILE", tile)
        assert mined(spark, rows, positives=4, negatives=2) == want


@pytest.mark.parametrize("scale", [1, 100])
def test_bounds_hold_and_prune(scale):
    rng = np.random.default_rng(3)
    smooth = np.repeat(rng.normal(0, scale, (400, 8)), 8, 1) + rng.normal(0, 0.05 * scale, (400, 64))
    q = np.floor(256 * smooth)
    a, r = hard_negatives.Summaries(q[:50]), hard_negatives.Summaries(q)
    score, shares = q[:50] @ q.T, []
    low = np.sort(score, 1)[:, -6]
    for (ma, da), (mr, dr) in zip(a.levels, r.levels, strict=True):
        mid, off = ma @ mr.T, da @ dr.T
        assert (mid - off <= score).all() and (score <= mid + off).all()
        shares.append((mid + off >= low[:, None]).mean())
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.1
    ai, ri, found = hard_negatives.survivors(a, r, low, np.full(50, np.inf))
    assert {(i, j) for i, j, s in zip(ai, ri, found, strict=True) if s >= low[i]} == set(zip(*np.nonzero(score >= low[:, None]), strict=True))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def test_batches_end_anywhere(spark):
    rnd = random.Random(8)
    rows = [(i, i % 3, [rnd.gauss(0.4, 1) for _ in range(10)]) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert mined(spark, rows) == expected(rows, lambda i: i % 5 == 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
