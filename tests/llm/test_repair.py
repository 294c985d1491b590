"""Operator 13 against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from annoflux.llm import conversation_repair as cr

SOLID = re.compile(r"[^\x20\x09-\x0D]")
ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults_):
    """Uniform-cost search over (cost, edits) with whole sequences of initials in the states."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, shape, out = heapq.heappop(heap)
        state = "" if shape == "" else shape[-1]
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, edits, out

        def go(extra, edit, at, role=None, text="", cost=cost, edits=edits, shape=shape, out=out):
            now = shape if role is None else shape + (role[:1] or "?")
            if re.fullmatch("(s?(ua)*u?)?", now):
                heapq.heappush(heap, (cost + extra, edits + edit, at, now, out if role is None else (*out, f"{role}:{text}")))

        for role in ROLE.values():
            go(2, "I", i, role)
        if i < len(rows):
            go(3, "D", i + 1)
            if faults_[i] in ("", "truncated"):
                go(bool(faults_[i]), "K", i + 1, *rows[i])
                for role in ROLE.values():
                    go(2 + bool(faults_[i]), "R", i + 1, role, rows[i][1])
    raise AssertionError


def expected(rows):
    whole = defaultdict(list)
    for conv, *_ in rows:
        whole[conv] = []
    for conv, turn, role, text in damage(rows):
        key = (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())
        whole[conv].append((key, turn, role, text))
    out = {}
    for conv, own in whole.items():
        own.sort(key=lambda x: x[0])
        said = [(r, t) for _, _, r, t in own]
        f = faults(said)
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))
        cost, audit, kept = cheapest(said, f)
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def repaired(spark, rows, schema="conv_id long, turn long, role string, text string, known int, look string, copies string"):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema).repartition(4)
    found = [tuple(r) for r in cr.repaired_conversations(df).collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def talk(rnd, conv, n):
    said = ["Yes.", "No!", "Why?", "And so", "  ", "", "It is so. ", "what now"]
    return [(conv, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rnd.choice(said) + rnd.choice(["", f" {rnd.randint(0, 99)}."])) for t in range(n)]


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [r for conv in range(250) for r in talk(rnd, conv, rnd.randint(1, 9))]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (None, 4, "assistant", "Ho."), (300, None, "user", "A."), (300, None, "assistant", "B."), (300, 9, None, "C."), (301, 1, "user", None)]
    rows += [(302, 5, "user", "Same."), (302, 5, "user", "Same."), (302, 5, "assistant", "Other."), (302, 90, "user", "Late"), (303, -5, "system", "Übung 💩."), (303, 7, "user", "é")]
    assert repaired(spark, rows) == expected(rows)


def test_long_conversations(spark):
    rnd = random.Random(4)
    rows = [r for conv, n in ((1, 32), (2, 33), (3, 64), (4, 700), (5, 3)) for r in talk(rnd, conv, n)]
    rnd.shuffle(rows)
    assert repaired(spark, rows) == expected(rows)


@pytest.mark.parametrize("seed", range(60))
def test_pieces_add_up(monkeypatch, seed):
    rnd = random.Random(seed)
    cells = [rnd.choice("ssuuuaaax") + rnd.choice("...~!") for _ in range(rnd.randint(1, 18))]
    whole = cr.search("".join(cells), 0, frozenset([0, 3]), True)
    for size in (1, 2, 5):
        pieces = ["".join(cells[i : i + size]) for i in range(0, len(cells), size)]
        w = cr.Whole()
        for p in pieces[:-1]:
            w.follow(list(cr.table(p)))
        w.follow([(s, 3, *f) for s in w.ways if (f := cr.search(pieces[-1], s, frozenset([0, 3]), True))])
        assert w.edits() == whole


def test_empty(spark):
    assert repaired(spark, []) == {}


def test_every_conversation_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = {r[0]: tuple(r)[1:] for r in cr.repaired_conversations(df).collect()}
    assert found == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_batches_end_anywhere(spark):
    rnd = random.Random(9)
    rows = [r for conv in range(40) for r in talk(rnd, conv, rnd.choice([1, 3, 8, 40]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert repaired(spark, rows) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
