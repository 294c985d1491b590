"""The motif automaton against regular expressions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from annoflux.operators import automaton as am
from annoflux.operators import motifs as mt

AA = "ACDEFGHIKLMNPQRSTVWY"


def prosite(rnd):
    """A pattern in PROSITE syntax."""
    parts = []
    for _ in range(rnd.randint(3, 14)):
        kind = rnd.random()
        if kind < 0.35:
            parts.append(rnd.choice(AA))
        elif kind < 0.65:
            parts.append("[" + "".join(rnd.sample(AA, rnd.randint(2, 6))) + "]")
        elif kind < 0.72:
            parts.append("{" + "".join(rnd.sample(AA, rnd.randint(1, 4))) + "}")
        else:
            parts.append("x" + rnd.choice(["", f"({rnd.randint(2, 5)})", "(1,3)", "(2,6)"]))
    return ("<" if rnd.random() < 0.03 else "") + "-".join(parts) + (">" if rnd.random() < 0.03 else "") + "."


def sample(rnd, pattern):
    """A text that a pattern of classes matches."""
    out = ""
    for token, least in re.findall(r"(\.|\[\^?[A-Z]+\]|[A-Z])(?:\{(\d+)[^}]*\})?", pattern):
        letters = AA if token == "." else [c for c in AA if re.match(token, c)]
        out += "".join(rnd.choice(letters) for _ in range(int(least or 1)))
    return out


def matches(patterns, texts):
    return sorted((i, k, m.start(), m.end()) for i, t in enumerate(texts) for k, p in enumerate(patterns) for m in re.finditer(p, t))


@pytest.fixture(scope="module")
def bank(spark):
    rnd = random.Random(7)
    df = spark.createDataFrame([(i, prosite(rnd)) for i in range(1800)], "ord int, p string")
    patterns = [r["r"] for r in df.select("ord", mt.prosite_to_regex(F.col("p")).alias("r")).orderBy("ord").collect()]
    texts = []
    for _ in range(60):
        t = "".join(rnd.choice(AA) for _ in range(rnd.randint(0, 400)))
        for p in rnd.sample(patterns, 3):
            at = rnd.randint(0, len(t))
            t = t[:at] + sample(rnd, p) + t[at:]
        texts.append(t)
    return patterns, texts


def test_equal_to_expressions_on_all_patterns(spark, bank):
    patterns, texts = bank
    odd = ["^M[LIVA]{1,3}", "A|C", "(AC)+D", "A.?C", "[LIVMFYW]{5,}[AGSTC]", "C.{2,4}C", "B", "[^A]{3}", "K$", "a[b]C", r"\w{9}G"]
    texts = [*texts, "", "MLAAB", "ACACD\nK", "ÄCDÖ", "KKKK", "*X*", "MAAAA", texts[0], texts[0]]
    every = [*patterns, *odd]
    rows = [(str(i), t) for i, t in enumerate(texts)] + [("none", None)]
    table = spark.createDataFrame([(i, f"n{i}", p, "d", "c", 0.9) for i, p in enumerate(every)], mt.SCHEMA)
    df = spark.createDataFrame(rows, "gene_id string, protein_seq string").repartition(3)
    expected = matches(every, [t.upper() for t in texts])
    for once in (False, True):
        found = mt.motif_scan(df, table, once=once).collect()
        assert sorted((int(r["gene_id"]), r["ord"], r["start"], r["end"]) for r in found) == expected
        assert all(r["matched"] == texts[int(r["gene_id"])].upper()[r["start"] : r["end"]] for r in found)


def test_few_pairs_are_left(bank):
    patterns, texts = bank
    of, which = am.Automaton(patterns).candidates(texts)
    true = {(i, k) for i, k, _, _ in matches(patterns, texts)}
    pairs = set(zip(of.tolist(), which.tolist(), strict=True))
    assert true <= pairs
    assert len(pairs) < 3 * len(true)


def test_time_grows_less_than_the_patterns(bank):
    patterns, texts = bank
    telling = [p for p in patterns if am.telling(p) is not None]

    def took(n):
        machine = am.Automaton(telling[:n])
        began = time.process_time()
        for _ in range(5):
            machine.candidates(texts)
        return time.process_time() - began

    took(100)
    assert took(1600) < 0.5 * 16 * took(100)


def test_lookup(spark):
    df = spark.createDataFrame([("ABC_1", "PS00001", "Zinc finger"), ("XYZ", "PS00002", "Kinase site")], "id string, accession string, description string")
    assert [r["id"] for r in mt.prosite_lookup(df, description="ZINC").collect()] == ["ABC_1"]
    assert [r["id"] for r in mt.prosite_lookup(df, accession="ps00002", entry_id="xyz").collect()] == ["XYZ"]
    assert mt.prosite_lookup(df, entry_id="abc").count() == 0
