"""Conversation structure repair: the cheapest edits that give a well-formed sequence of roles.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Edits walk its rows in
order: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty text of user or
assistant) 2; a truncated row that stays adds 1; blank and repeated rows must go. Among the
cheapest the edits whose initials D, I, K, R read least win, so a row's place and the state of
the sequence (nothing yet, after s, after u, after a) fix each edit's role.

``Pieces.search`` is iterative-deepening A*: depth first in ASCII order of the edits under a bound of the
cost, which grows to the least estimate that exceeded it; states that failed with a budget are
kept in a transposition table, and the first accepting path is the answer. Rows that must go and
truncated rows ahead give the estimate.

Two shuffles of what the rows are like (32 bytes of hash, an initial, a fault) find repeated rows
and sort the rows by conversation and turn into ranges, so a conversation with a third of all rows
spreads over many tasks. A conversation of over ``PIECE`` rows is searched in pieces, each from and to every
state; a piece ends with an edit that takes a row, so the pieces' answers add up to the whole's. Texts are
moved once, and streamed behind their conversation's edits; no task holds a conversation's texts.

Rows: nulls in role and text, and in the text that decides a damage, are one space. A null
conv_id is a conversation of its own. Null turns come first; rows of equal turn come by a hash of role
and text. Repeated rows are rows. A role's initial is its first character (none for an empty role).
An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoflux.llm.storage import cut

BLANK = r"[^\x20\x09-\x0D]"
#: Rows of a conversation that are searched at once.
PIECE = 16
#: (state, other): what the rest of a conversation costs more from the state than from the other at most. 3 can do
#: what 1 does, and Delete a row that 0 would Keep as s; an Insert leads from 3 to 2 and back; 0 can do what 1 does.
APART = {(3, 2): 2, (3, 0): 3, (3, 1): 0, (2, 0): 5, (2, 1): 2, (0, 1): 0}
#: States: nothing yet, after s, after u, after a; what may follow in each, and the role that Insert and Rerole give.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = ("user", "user", "assistant", "user")
DROPPED, BLANKED, UNSTOPPED, REPEATED, REROLED = range(5)
LEAST_LONG = -(2**63)

LOOK = "conv_id string, known boolean, piece long, sub long, cells string, blank long, duplicate long, truncated long, own string"
EDITS = "conv_id string, known boolean, cost long, audit string, blank long, duplicate long, truncated long"
REPAIRED = "conv_id string, known boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache(1 << 16)
def search(cells: str, start: int, goals: frozenset[int], last: bool, most: int = 1 << 40) -> tuple[int, str] | None:
    """(cost, edits) from ``start`` to a state of ``goals`` over the rows ``cells``, of at most ``most``; the last piece may insert at its end.

    A row is two characters: its role's initial, and ``!`` if it must go, ``~`` if it is truncated, else ``.``.
    An Insert is followed by Keep, Rerole or the end: Delete would come first at the same cost, and two
    Inserts lead nowhere that is not cheaper to reach.
    """
    rows = [(cells[i], cells[i + 1]) for i in range(0, len(cells), 2)]
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (3 if rows[i][1] == "!" else rows[i][1] == "~")

    def deepen(i: int, state: int, left: int, inserted: bool) -> str | None:
        nonlocal over
        if ahead[i] > left:
            over = min(over, ahead[i] - left)
            return None
        if i == n and state in goals:
            return ""
        here = i, state, inserted
        if failed.get(here, -1) >= left:
            over = min(over, short[here] - left)
            return None
        outer, over = over, 1 << 60
        found = None
        for edit, to, at, cost in moves(i, state, inserted):
            rest = deepen(at, to, left - cost, edit == "I")
            if rest is not None:
                found = edit + rest
                break
        if found is None:
            # the least budget beyond this one with which the state may do better
            failed[here], short[here] = left, left + over
        over = min(outer, over)
        return found

    def moves(i: int, state: int, inserted: bool) -> Iterator[tuple[str, int, int, int]]:
        after = NEXT[state][ROLE[state][0]]
        if i < n:
            initial, fault = rows[i]
        if not inserted:
            if i < n:
                yield "D", state, i + 1, 3
            if i < n or last:
                yield "I", after, i, 2
        if i < n and fault != "!":
            cut_off = fault == "~"
            if initial in NEXT[state]:
                yield "K", NEXT[state][initial], i + 1, int(cut_off)
            yield "R", after, i + 1, 2 + cut_off

    bound, most = ahead[0], min(most, 3 * n + 8)  # all can be deleted, and what must follow inserted
    while bound <= most:
        failed: dict[tuple[int, int, bool], int] = {}
        short: dict[tuple[int, int, bool], int] = {}
        over = 1 << 60
        found = deepen(0, start, bound, False)
        if found is not None:
            return bound, found
        bound += over
    return None


@lru_cache(1 << 12)
def table(cells: str) -> tuple[tuple[int, int, int, str], ...]:
    """(start, end, cost, edits) of a piece that others follow, for every pair of states that the cheapest edits may need."""
    out = []
    for start in range(4):
        most = {end: 1 << 40 for end in range(4)}
        for end in (3, 2, 0, 1):
            if (found := search(cells, start, frozenset([end]), False, most[end])) is not None:
                out.append((start, end, *found))
                for (state, other), more in APART.items():
                    if state == end:
                        most[other] = min(most[other], found[0] + more)
    return tuple(out)


class Whole:
    """The edits of a conversation, piece by piece: for each state the cheapest way there, and of equal cost the least."""

    def __init__(self) -> None:
        # state: (cost, rank of the edits so far, the edits as a chain); of ways to one row none is the beginning of another
        self.ways: dict[int, tuple[int, int, tuple | None]] = {0: (0, 0, None)}

    def follow(self, options: list[tuple[int, int, int, str]]) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for start, end, cost, edits in options:
            if start in self.ways:
                way = (self.ways[start][0] + cost, self.ways[start][1], edits, start)
                if end not in best or way[:3] < best[end][:3]:
                    best[end] = way
        order = {end: k for k, end in enumerate(sorted(best, key=lambda e: best[e][1:3]))}
        self.ways = {end: (cost, order[end], (self.ways[start][2], edits)) for end, (cost, _, edits, start) in best.items()}

    def edits(self) -> tuple[int, str]:
        """Of the way to state 3, which stands for the end."""
        cost, _, chain = self.ways[3]
        parts = []
        while chain is not None:
            chain, edits = chain
            parts.append(edits)
        return cost, "".join(reversed(parts))


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of the conversations of a range: their rows' cells and faults, and the searched table of full pieces."""
    piece, sub, before, cells, counts, opened = 0, 0, None, [], [0, 0, 0], None

    def flush() -> dict:
        text = "".join(cells)
        own = "\n".join(f"{s} {e} {c} {x}" for s, e, c, x in table(text)) if len(cells) == PIECE else ""
        return {"conv_id": opened[0], "known": opened[1], "piece": piece, "sub": sub, "cells": text, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "own": own}

    for batch in batches:
        done = []
        for row in batch.itertuples(index=False):
            conv = (row.conv_id, row.known)
            piece = row.piece
            if conv != opened:
                if opened is not None:
                    done.append(flush())
                opened, sub, before, cells, counts = conv, 0, None, [], [0, 0, 0]
            this = (row.timed, row.turn, row.look)
            for _ in range(row.copies):
                fault = "blank" if row.blank else "duplicate" if not row.first or this == before else "truncated" if row.truncated else ""
                before = this
                if len(cells) == PIECE:
                    done.append(flush())
                    sub, cells, counts = sub + 1, [], [0, 0, 0]
                cells.append((row.initial or "?") + {"": ".", "truncated": "~"}.get(fault, "!"))
                if fault:
                    counts[("blank", "duplicate", "truncated").index(fault)] += 1
        yield pd.DataFrame(done, columns=["conv_id", "known", "piece", "sub", "cells", "blank", "duplicate", "truncated", "own"])
    if opened is not None:
        yield pd.DataFrame([flush()])


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of each conversation, from its pieces in order."""
    opened, whole, held, counts = None, Whole(), None, [0, 0, 0]

    def close() -> dict:
        # no way: only a system row is left, which is cheaper to delete than to follow with two Inserts
        whole.follow([(s, 3, *found) for s in whole.ways if (found := search(held, s, frozenset([0, 3]), True)) is not None])
        cost, audit = whole.edits()
        return {"conv_id": opened[0], "known": opened[1], "cost": cost, "audit": audit, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2]}

    for batch in batches:
        done = []
        for row in batch.itertuples(index=False):
            conv = (row.conv_id, row.known)
            if conv != opened:
                if opened is not None:
                    done.append(close())
                opened, whole, held, counts = conv, Whole(), None, [0, 0, 0]
            if held is not None:
                whole.follow(list(table(held)) if held_own == "" else [(int(s), int(e), int(c), x) for s, e, c, x in (line.split(" ") for line in held_own.split("\n"))])
            held, held_own = row.cells, row.own
            counts = [a + b for a, b in zip(counts, (row.blank, row.duplicate, row.truncated), strict=True)]
        yield pd.DataFrame(done, columns=["conv_id", "known", "cost", "audit", "blank", "duplicate", "truncated"])
    if opened is not None:
        yield pd.DataFrame([close()])


class _Repair:
    """One conversation while its rows pass behind its edits."""

    def __init__(self, conv: tuple):
        self.conv, self.edits, self.at, self.state = conv, None, 0, 0
        self.gap, self.illegal, self.initial, self.sha, self.any = [None, None, None, 0], 0, None, hashlib.sha256(), False

    def head(self, row) -> None:  # noqa: ANN001
        self.edits = row

    def _out(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserts(self) -> None:
        audit = self.edits.audit
        while self.at < len(audit) and audit[self.at] == "I":
            self._out(ROLE[self.state], "")
            self.state, self.at = NEXT[self.state][ROLE[self.state][0]], self.at + 1

    def row(self, timed: bool, turn: int, role: str, text: str) -> None:
        if timed:
            if self.gap[0] is None:
                self.gap[0] = turn
            if turn != self.gap[1]:
                self.gap[3] += 1
            self.gap[1] = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self._inserts()
        edit, self.at = self.edits.audit[self.at], self.at + 1
        if edit == "K":
            self._out(role, text)
            self.state = NEXT[self.state][initial]
        elif edit == "R":
            self._out(ROLE[self.state], text)
            self.state = NEXT[self.state][ROLE[self.state][0]]

    def result(self) -> dict:
        found = {"conv_id": self.conv[0], "known": self.conv[1], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": self.illegal, "cost": 0, "audit": ""}
        if self.edits is not None:
            self._inserts()
            gaps = 0 if self.gap[0] is None else min(2**63 - 1, self.gap[1] - self.gap[0] + 1 - self.gap[3])
            found |= {"gaps": gaps, "blank": self.edits.blank, "duplicate": self.edits.duplicate, "truncated": self.edits.truncated, "cost": self.edits.cost, "audit": self.edits.audit}
        return found | {"repaired_sha256": self.sha.hexdigest()}


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits first, then the conversation's rows: one row of results for each conversation."""
    now: _Repair | None = None
    columns = [c.split()[0] for c in REPAIRED.split(", ")]
    for batch in batches:
        done = []
        for row in batch.itertuples(index=False):
            conv = (row.conv_id, row.known)
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.result())
                now = _Repair(conv)
            if row.kind == 0:
                now.head(row)
            else:
                for _ in range(row.copies):
                    now.row(row.timed, row.turn, row.role, row.text)
        yield pd.DataFrame(done, columns=columns)
    if now is not None:
        yield pd.DataFrame([now.result()])


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id (as text), known, timed, turn, role, text, copies, kind: the rows after damage; dropped rows have no copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    return rows.select(
        text("conv_id").alias("conv_id"),
        F.col("conv_id").isNotNull().alias("known"),
        F.col("turn").isNotNull().alias("timed"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.when(kind == REROLED, "user").otherwise(text("role")).alias("role"),
        F.when(kind == BLANKED, "").when(kind == UNSTOPPED, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(kind == DROPPED, 0).when(kind == REPEATED, 2).otherwise(1).alias("copies"),
    )


def _looks(rows: DataFrame) -> DataFrame:
    """What the search needs of a row: nothing of its text but a hash and its fault."""
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    looked = rows.where("copies > 0").select(
        "conv_id", "known", "timed", "turn", "copies",
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("look"),
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(BLANK)).alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
    )
    when = F.struct("timed", "turn")
    first = looked.groupBy("conv_id", "known", "look").agg(F.min(when).alias("seen"))
    return looked.join(first, ["conv_id", "known", "look"]).withColumn("first", when == F.col("seen")).drop("seen")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text), as they are: conv_id (as text), known, faults, edits, digest.

    ``rows`` as ``damaged`` returns them. Returned: conv_id, known (False: the id is null), gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv, order = ["conv_id", "known"], ["timed", "turn", "look"]
    ranged = _looks(rows).repartitionByRange(tasks, *conv, *order).sortWithinPartitions(*conv, *order).withColumn("piece", F.spark_partition_id().cast("long"))
    pieces = cut(ranged.select(*conv, *order, "copies", "initial", "blank", "truncated", "first", "piece").mapInPandas(_look, LOOK))
    edits = pieces.repartition(tasks, *conv).sortWithinPartitions(*conv, "piece", "sub").mapInPandas(_plan, EDITS)

    heads = edits.select(*conv, F.lit(0).alias("kind"), F.lit(False).alias("timed"), F.lit(0).cast("long").alias("turn"), F.lit(None).cast("binary").alias("look"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), "cost", "audit", "blank", "duplicate", "truncated")
    nothing = [F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), *[F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]]
    look = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    bodies = rows.select(*conv, F.lit(1).alias("kind"), "timed", "turn", look.alias("look"), "role", "text", "copies", *nothing)
    return heads.unionByName(bodies).repartition(tasks, *conv).sortWithinPartitions(*conv, "kind", *order).mapInPandas(_apply, REPAIRED)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage."""
    kind = dict(conversations.dtypes)["conv_id"]
    conv: Column = F.when(F.col("known"), F.col("conv_id")).cast(kind)
    return repair(damaged(conversations.select("conv_id", "turn", "role", "text"))).select(conv.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
