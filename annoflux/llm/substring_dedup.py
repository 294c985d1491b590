"""Substring deduplication over word windows.

Rabin-Karp hashes of every fixed-length word window are counted across the corpus
in Spark (``exchange``: packed hashes dealt out by bucket, one entry for each hash
and piece of a task). A window that also starts in a document with a smaller id is
repeated; repeated windows merge into maximal intervals of words, which are removed.

Cost: one shuffle of 8 bytes and a position for each distinct window, one of the
texts for the removal. A very common window costs its bucket one entry for each
piece of input, wherever and how often it occurs. Windows are told apart by ``KEY_BYTES`` of
their hash and their bucket, 60 bits and more, not by their words: of n windows about
n / 2**61 of each is expected to meet a false partner, one in some 2 * 10**6 at 10**12 windows.
Eight bytes make that 256 times rarer, for an eighth more to shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoflux.llm import bytehash as bh
from annoflux.llm import exchange as ex

BUCKET_BYTES = 12 << 20
#: Bytes of a hash that travel; with its bucket, 60 bits and more tell windows apart.
KEY_BYTES = 7
#: Text bytes whose windows a task compares before it sends them.
SHARD_BYTES = 16 << 20


def _windows(width: int, lo: int, hi: int, flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and word number of every window of rows lo..hi."""
    keys, rows, at = [], [], []
    for a, b in bh.pieces(offs[lo : hi + 1]):
        a, b = a + lo, b + lo
        f, o = flat[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        starts, ends, row = bh.words(f, o)
        h, first = bh.window_hashes(bh.word_hashes(f, starts, ends), row, width)
        keys.append(h)
        rows.append(row[first] + a)
        at.append(first - np.searchsorted(row, row[first]))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(at)


def repeated_windows(named: DataFrame, width: int, buckets: int) -> DataFrame:
    """Answers: word numbers of windows that start in a document with a smaller k, first place of each."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offs = bh.text_bytes(batch["text"])
            ks, uids = batch["k"].to_numpy(), batch["uid"].to_numpy()
            for lo, hi in bh.pieces(offs, SHARD_BYTES):
                keys, rows, at = _windows(width, lo, hi, flat, offs)
                pick, least, _, _ = ex.firsts(keys, rows, at, ks)
                # later rows of a key are repeated already here: only their answers travel
                known = np.where(least, 0, 3).astype(np.uint8)
                keys, rows, at = keys[pick], rows[pick], at[pick]
                packed = ex.pack(ex.scattered(keys, known, rows, uids), rows, at, known, ks, uids, buckets, KEY_BYTES)
                if packed:
                    yield pa.RecordBatch.from_pylist(packed, schema=_PACKED)

    sent = named.select("k", "uid", "text").mapInArrow(send, ex.PACKED)
    return sent.groupBy("bucket").applyInPandas(lambda group: ex.answer_later(group, buckets), ex.ANSWER)


_PACKED = pa.schema(
    [("bucket", pa.int32()), ("width", pa.int32()), *[(n, pa.binary()) for n in ("keys", "ks", "uids", "counts", "gaps", "far", "known")]]
)

REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_intervals long, removed array<struct<start:int,end:int>>, kept string"


def _cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of n places covered by a run of ``width`` from one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.r_[0, covered.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeated_windows(docs: DataFrame, width: int = 13, bucket_bytes: int = BUCKET_BYTES, with_text: bool = True) -> DataFrame:
    """Removes each word covered by a ``width``-word window that also starts in a document with a smaller doc_id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Returned, a row for each row of ``docs``: doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space), n_intervals,
    removed (maximal intervals, in words, end exclusive) and, with ``with_text``, kept.

    Null and empty texts: no words, nothing removed, the digest of the empty string. Texts of
    fewer than ``width`` words keep everything. Rows with the same doc_id don't count as earlier
    than each other; a null doc_id counts as the largest. Other columns are ignored.
    """
    named = ex.named(docs)
    buckets = ex.bucket_count(docs, bucket_bytes)
    found = repeated_windows(named, width, buckets)

    def remove(texts: pa.Table, hits: pa.Table) -> pa.Table:
        at = ex.answered(hits.to_pylist(), texts["k"].to_numpy(), texts["uid"].to_numpy())
        flat, offs = bh.text_bytes(texts["text"])
        out = {n: [] for n in ("n_words", "n_removed", "kept_sha256", "n_intervals", "removed", "kept")}
        for a, b in bh.pieces(offs):
            f, o = flat[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            starts, ends, row = bh.words(f, o)
            edges = np.searchsorted(row, np.arange(b - a + 1))
            hashed = bh.word_hashes(f, starts, ends)
            data = f.tobytes()
            for i in range(b - a):
                s, e = starts[edges[i] : edges[i + 1]], ends[edges[i] : edges[i + 1]]
                n = len(s)
                gone = np.zeros(n, bool)
                if a + i in at:
                    window, _ = bh.window_hashes(hashed[edges[i] : edges[i + 1]], np.zeros(n, np.int64), width)
                    gone = _cover(np.flatnonzero(np.isin(window, window[at[a + i]])), width, n)
                stay = ~gone
                kept = b" ".join([data[x:y] for x, y in zip(s[stay].tolist(), e[stay].tolist(), strict=True)])
                lo, hi = runs(gone)
                out["n_words"].append(n)
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["n_intervals"].append(len(lo))
                out["removed"].append([{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
                out["kept"].append(kept.decode() if with_text else None)
        return pa.Table.from_pydict({"doc_id": texts["doc_id"], **out}, schema=_REMOVED)

    result = ex.dealt(named, buckets).groupBy("part").cogroup(found.groupBy("part")).applyInArrow(remove, REMOVED)
    return result if with_text else result.drop("kept")


_REMOVED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("n_intervals", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("kept", pa.string()),
    ]
)
