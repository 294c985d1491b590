"""Shuffle of packed hashes: which keys of a document occur elsewhere in the corpus.

A task turns its documents into keys (window or gram hashes). Keys are dealt out
by hash into buckets; a bucket's row holds the keys of one piece of a task as
packed bytes, in document order, so a key costs its own bytes and little more.
Before sending, a task keeps one entry for each key and piece (that of the
smallest document), so the entries of a very common key number the pieces, not
its occurrences. A bucket's task answers with positions, packed by part: the
documents are dealt into parts by ``uid``, and meet their answers there.

Rows are named by ``k`` (doc_id; nulls count as the largest) and ``uid`` (a hash of
id and text, 64 bits), so that repeated and null ids keep their own answers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoflux.llm import bytehash as bh

LAST = 2**63 - 1
PACKED = "bucket int, width int, keys binary, ks binary, uids binary, counts binary, gaps binary, far binary, known binary"
ANSWER = "part int, ks binary, uids binary, counts binary, gaps binary, far binary"


def uid_of(k: Column, text: Column) -> Column:
    """64 bits of a hash of k and text."""
    return F.xxhash64(k, text)


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``docs`` bears, in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def named(docs: DataFrame) -> DataFrame:
    """doc_id and text with ``k`` and ``uid``; null texts are empty."""
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        k.alias("k"),
        uid_of(k, text).alias("uid"),
        text.alias("text"),
    )


def dealt(named_docs: DataFrame, parts: int) -> DataFrame:
    """The documents with the part in which they meet their answers."""
    return named_docs.withColumn("part", F.pmod("uid", F.lit(parts)).cast("int"))


def bucket_count(docs: DataFrame, bytes_each: int) -> int:
    """Buckets for the whole table: one for each ``bytes_each`` of text, a partition's worth at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(total / bytes_each))


def _lead(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def firsts(keys: np.ndarray, rows: np.ndarray, at: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each key and row, and which of them stand for their key.

    ``rows`` index ``ks``. Returned: indexes into keys (key by key, rows by ascending
    k), True for entries with the smallest k of their key, True for entries whose key
    has rows of other k, True for the first entry of each key.
    """
    rank = np.argsort(ks, kind="stable")
    place = np.empty(len(ks), np.int64)
    place[rank] = np.arange(len(ks))
    order = np.lexsort((at, place[rows], keys))
    sk, sr = keys[order], rows[order]
    fresh = np.r_[True, (sk[1:] != sk[:-1]) | (sr[1:] != sr[:-1])] if len(order) else np.zeros(0, bool)
    order, sk, sr = order[fresh], sk[fresh], sr[fresh]
    lead = _lead(sk)
    size = np.diff(np.r_[lead, len(sk)])
    own = ks[sr]
    least = own == np.repeat(own[lead], size)
    several = np.repeat(own[lead] != own[lead + size - 1], size) if len(lead) else np.zeros(0, bool)
    first = np.zeros(len(sk), bool)
    first[lead] = True
    return order, least, several, first


def scattered(keys: np.ndarray, known: np.ndarray, rows: np.ndarray, uids: np.ndarray) -> np.ndarray:
    """Keys to deal out by: entries that aren't counted go by their document, so that no key's bucket fills up."""
    away = np.flatnonzero(known & 2)
    if not len(away):
        return keys
    out = keys.copy()
    out[away] = bh.mix(uids.astype(np.uint64))[rows[away]]
    return out


def _gaps(at: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending positions of each document as steps of a byte; 255 stands for the next of the far steps."""
    step = at.copy()
    step[1:] -= at[:-1]
    step[starts] = at[starts]
    far = step >= 255
    return np.where(far, 255, step).astype(np.uint8).tobytes(), step[far].astype(np.uint32).tobytes()


def _positions(gaps: bytes, far: bytes, counts: np.ndarray) -> np.ndarray:
    step = np.frombuffer(gaps, np.uint8).astype(np.int64)
    step[step == 255] = np.frombuffer(far, np.uint32)
    total = np.cumsum(step)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    return total - np.repeat(total[starts] - step[starts], counts)


def pack(keys: np.ndarray, rows: np.ndarray, at: np.ndarray, known: np.ndarray, ks: np.ndarray, uids: np.ndarray, buckets: int, width: int = 8) -> list[dict]:
    """Packed rows, a bucket each. ``known``: bit 1, answered already; bit 2, not to be counted (only its answer travels).

    Of a key, ``width`` bytes travel; its bucket adds to what tells it from others.
    """
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    keys = keys // np.uint64(buckets)
    order = np.lexsort((at, rows, bucket))
    bucket, keys, rows, at, known = bucket[order], keys[order], rows[order], at[order], known[order]
    edges = np.r_[_lead(bucket), len(bucket)]
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        r = rows[lo:hi]
        starts = _lead(r)
        gaps, far = _gaps(at[lo:hi], starts)
        out.append(
            {
                "bucket": int(bucket[lo]),
                "width": width,
                "keys": np.ascontiguousarray(keys[lo:hi, None].view(np.uint8)[:, :width]).tobytes(),
                "ks": ks[r[starts]].tobytes(),
                "uids": uids[r[starts]].astype(np.int64).tobytes(),
                "counts": np.diff(np.r_[starts, hi - lo]).astype(np.int32).tobytes(),
                "gaps": gaps,
                "far": far,
                "known": known[lo:hi].astype(np.uint8).tobytes() if known[lo:hi].any() else b"",
            }
        )
    return out


def unpack(group: pd.DataFrame) -> dict[str, np.ndarray]:
    """Entries of a bucket: key, doc (index), at, known, and ks and uids by doc."""
    out: dict[str, list] = {n: [] for n in ("key", "doc", "at", "known", "ks", "uids")}
    docs = 0
    for row in group.itertuples(index=False):
        counts = np.frombuffer(row.counts, np.int32)
        n = int(counts.sum())
        key = np.zeros((n, 8), np.uint8)
        key[:, : row.width] = np.frombuffer(row.keys, np.uint8).reshape(n, row.width)
        out["key"].append(key.view(np.uint64)[:, 0])
        out["at"].append(_positions(row.gaps, row.far, counts))
        out["doc"].append(np.repeat(np.arange(docs, docs + len(counts)), counts))
        out["known"].append(np.frombuffer(row.known, np.uint8) if row.known else np.zeros(n, np.uint8))
        out["ks"].append(np.frombuffer(row.ks, np.int64))
        out["uids"].append(np.frombuffer(row.uids, np.int64))
        docs += len(counts)
    return {n: np.concatenate(v) for n, v in out.items()}


def answers(doc: np.ndarray, at: np.ndarray, ks: np.ndarray, uids: np.ndarray, parts: int) -> pd.DataFrame:
    """Positions packed by part and document."""
    part = (uids % parts).astype(np.int32)[doc]
    order = np.lexsort((at, doc, part))
    part, doc, at = part[order], doc[order], at[order]
    edges = np.r_[_lead(part), len(part)]
    rows = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        d = doc[lo:hi]
        starts = _lead(d)
        rows.append((int(part[lo]), ks[d[starts]].tobytes(), uids[d[starts]].tobytes(), np.diff(np.r_[starts, hi - lo]).astype(np.int32).tobytes(), *_gaps(at[lo:hi], starts)))
    return pd.DataFrame(rows, columns=["part", "ks", "uids", "counts", "gaps", "far"])


def answered(rows: list[dict], ks: np.ndarray, uids: np.ndarray) -> dict[int, np.ndarray]:
    """Positions by row of a part's documents, from its answers."""
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for row in rows:
        counts = np.frombuffer(row["counts"], np.int32)
        cuts = np.split(_positions(row["gaps"], row["far"], counts), np.cumsum(counts)[:-1])
        for k, u, at in zip(np.frombuffer(row["ks"], np.int64).tolist(), np.frombuffer(row["uids"], np.int64).tolist(), cuts, strict=True):
            found.setdefault((k, u), []).append(at)
    return {i: np.concatenate(found[n]) for i, n in enumerate(zip(ks.tolist(), uids.tolist(), strict=True)) if n in found}


def answer_later(group: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Positions whose key also occurs in a document with a smaller k."""
    e = unpack(group)
    key, known = e["key"], e["known"]
    k = np.where(known & 2, LAST, e["ks"][e["doc"]])
    order = np.argsort(key)
    lead = _lead(key[order])
    least = np.repeat(np.minimum.reduceat(k[order], lead), np.diff(np.r_[lead, len(key)]))
    hit = (known & 1).astype(bool)
    hit[order] |= (k[order] > least) & (known[order] & 2 == 0)
    return answers(e["doc"][hit], e["at"][hit], e["ks"], e["uids"], parts)


def answer_shared(group: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Positions whose key occurs in another document too."""
    e = unpack(group)
    key, known = e["key"], e["known"]
    order = np.argsort(key)
    lead = _lead(key[order])
    counted = np.add.reduceat((known[order] & 2 == 0).astype(np.int64), lead)
    hit = (known & 1).astype(bool)
    hit[order] |= np.repeat(counted > 1, np.diff(np.r_[lead, len(key)])) & (known[order] & 2 == 0)
    return answers(e["doc"][hit], e["at"][hit], e["ks"], e["uids"], parts)
