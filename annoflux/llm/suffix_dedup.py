"""Suffix-array deduplication over byte strings.

Documents are dealt into shards. Content-chosen anchors (the gram of least hash in
every ``WIDTH``-byte string) tell which strings can occur elsewhere at all: a shard
sends its different anchors once, and learns which of them another shard has. Anchors
that repeat inside a shard go into its suffix array (Larsson-Sadakane refinement,
Kasai common prefixes), whose classes of equal ``WIDTH``-byte prefixes show what a
smaller document of the shard already holds. What is left of the anchors that other
shards have travels as short contexts to the merger of the anchor's hash, which
merges the shards' sorted strings by binary search and checks the bytes.

Anchors in very many documents are not dealt out by themselves but by each whole
string around them, so that no merger gathers a context from every document.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from annoflux.llm import bytehash as bh
from annoflux.llm import exchange as ex
from annoflux.llm.substring_dedup import runs
from annoflux.llm.suffix import equal_prefix_classes, words_at

WIDTH = 50
GRAM = 32
SHARD_BYTES = 6 << 20
#: Text whose anchors, and later strings, one merger gets.
MERGE_BYTES = 8 << 20
#: Documents from which an anchor is dealt out by the strings around it.
COMMON = 4096
#: Bytes of an anchor's hash that travel (with its bucket, 46 bits and more; a false partner only costs a look).
ANCHOR_BITS = 40


def anchors(flat: np.ndarray, offs: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, place, first and end start of the strings that an anchor owns; all rows, by place.

    Every ``width``-byte string inside a row is owned by the leftmost gram of least hash in it.
    """
    n = len(flat)
    span = width - gram + 1
    if n < width:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    grams = bh.gram_hashes(flat, gram)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    covers = 1
    while covers * 2 <= span:
        low = np.minimum(low[:-covers], low[covers:])
        covers *= 2
    if covers < span:
        low = np.minimum(low[: len(low) - (span - covers)], low[span - covers :])
    owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(len(owner), bool)
    for end in offs[1:-1]:  # strings that leave their row are no strings
        valid[max(0, end - width + 1) : end] = False
    starts = np.flatnonzero(valid)
    owner = owner[starts]
    lead = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    last = np.r_[lead[1:], len(owner)] - 1
    at = owner[lead]
    return grams[at], at, starts[lead], starts[last] + 1 if len(lead) else np.zeros(0, np.int64)


def _shard_anchors(flat: np.ndarray, offs: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    out: dict[str, list] = {n: [] for n in ("key", "row", "lo", "hi")}
    for a, b in bh.pieces(offs):
        o = offs[a : b + 1] - offs[a]
        key, at, lo, hi = anchors(flat[offs[a] : offs[b]], o, width, gram)
        out["key"].append(key)
        out["row"].append(np.searchsorted(o, at, side="right") - 1 + a)
        out["lo"].append(lo + offs[a])
        out["hi"].append(hi + offs[a])
    return {n: np.concatenate(v) if v else np.zeros(0, np.uint64 if n == "key" else np.int64) for n, v in out.items()}


def _dealt_keys(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (key % np.uint64(buckets)).astype(np.int64), (key // np.uint64(buckets)) & np.uint64((1 << ANCHOR_BITS) - 1)


def _different(key: np.ndarray, row: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shard's different anchors by bucket and key: bucket, short key, rows with it (up to 255), place of every anchor among them."""
    bucket, short = _dealt_keys(key, buckets)
    joint = (bucket.astype(np.uint64) << np.uint64(ANCHOR_BITS)) | short
    order = np.argsort(joint, kind="stable")  # rows ascend under a key
    ordered, rows = joint[order], row[order]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    other = fresh | np.r_[True, rows[1:] != rows[:-1]] if len(rows) else fresh
    lead = np.flatnonzero(fresh)
    place = np.empty(len(joint), np.int64)
    place[order] = np.cumsum(fresh) - 1
    kinds = ordered[lead]
    many = np.add.reduceat(other.astype(np.int64), lead) if len(lead) else np.zeros(0, np.int64)
    return (kinds >> np.uint64(ANCHOR_BITS)).astype(np.int64), kinds & np.uint64((1 << ANCHOR_BITS) - 1), np.minimum(many, 255), place


ASKED = "bucket int, part int, steps binary, far binary, rows binary"
TOLD = "part int, bucket int, flags binary"
FOUND = "part int, rows binary, rows_far binary, counts binary, counts_far binary, gaps binary, far binary"
_ASKED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("steps", pa.binary()), ("far", pa.binary()), ("rows", pa.binary())])
MOVED = f"bucket int, kind int, {FOUND}, ks binary, windows binary, bytes binary"
_MOVED = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), *[(n, pa.binary()) for n in ("rows", "rows_far", "counts", "counts_far", "gaps", "far", "ks", "windows", "bytes")]]
)
_FAR = 2**32 - 1


def _lead(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _listed(part: int, row: np.ndarray, at: np.ndarray) -> dict:
    """Positions of a part's rows, both ascending; rows are counted in the part's order by (k, uid)."""
    starts = _lead(row)
    zero = np.zeros(1, np.int64)
    rows, rows_far = ex._gaps(row[starts], zero)
    counts = np.diff(np.r_[starts, len(row)])
    many = counts >= 255
    gaps, far = ex._gaps(at, starts)
    return {
        "part": part, "rows": rows, "rows_far": rows_far, "counts": np.where(many, 255, counts).astype(np.uint8).tobytes(),
        "counts_far": counts[many].astype(np.uint32).tobytes(), "gaps": gaps, "far": far,
    }


def _rows_of(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions of each and all positions, of what ``_listed`` packed."""
    rows = ex._positions(x["rows"], x["rows_far"], np.array([len(x["rows"])]))
    counts = np.frombuffer(x["counts"], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(x["counts_far"], np.uint32)
    return rows, counts, ex._positions(x["gaps"], x["far"], counts)


def _packed_contexts(part: int, bucket: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, flat: np.ndarray, offs: np.ndarray, ks: np.ndarray, width: int) -> list[dict]:
    """Runs of strings starting at lo..hi-1, in text order, with the bytes that they cover; a row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, row, lo, hi = bucket[order], row[order], lo[order], hi[order]
    edges = np.r_[_lead(bucket), len(bucket)]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        size = hi[a:b] - lo[a:b] + width - 1
        begin = np.cumsum(size) - size
        take = np.arange(int(size.sum())) + np.repeat(lo[a:b] - begin, size)
        r = row[a:b]
        told = _listed(part, r, lo[a:b] - offs[r])
        steps = np.diff(np.r_[0, ks[r[_lead(r)]]])  # ascending, so mostly small numbers
        out.append(told | {"bucket": int(bucket[a]), "kind": 0, "ks": steps.tobytes(), "windows": (hi[a:b] - lo[a:b]).astype(np.uint8).tobytes(), "bytes": flat[take].tobytes()})
    return out


def _local_classes(flat: np.ndarray, offs: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, ks: np.ndarray, width: int) -> np.ndarray:
    """Starts of strings that also start in a document of the shard with a smaller k, by the suffix array of what lo..hi cover."""
    if not len(lo):
        return np.zeros(0, np.int64)
    order = np.argsort(lo)
    row, lo, end = row[order], lo[order], hi[order] + width - 1
    fresh = np.r_[True, (lo[1:] > end[:-1]) | (row[1:] != row[:-1])]  # regions that touch are one; owned runs ascend
    first = np.flatnonzero(fresh)
    begin, stop, owner = lo[first], np.maximum.reduceat(end, first), row[first]
    size = stop - begin
    base = np.cumsum(size) - size
    origin = np.arange(int(size.sum())) + np.repeat(begin - base, size)
    text = flat[origin]
    limit = np.repeat(base + size, size)
    suffixes, lead = equal_prefix_classes(text, limit, width)
    k = np.repeat(ks[owner], size)[suffixes]
    least = np.repeat(np.minimum.reduceat(k, lead), np.diff(np.r_[lead, len(k)]))
    return origin[suffixes[k > least]]


def merge_runs(runs_: list[tuple[np.ndarray, np.ndarray, np.ndarray]], at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted runs of (key, smallest k, place), one from each shard, as one run.

    Splitters cut the keys into ranges; binary search finds the cuts in every run, and the runs'
    pieces of a range - about ``at_once`` keys, whatever the number of shards - are merged.
    """
    total = sum(len(x[0]) for x in runs_)
    parts = max(1, total // at_once)
    splitters = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)
    cuts = [np.r_[0, np.searchsorted(x[0], splitters), len(x[0])] for x in runs_]
    out = []
    for r in range(parts):
        pieces = [[x[column][c[r] : c[r + 1]] for x, c in zip(runs_, cuts, strict=True)] for column in range(3)]
        key, k, place = (np.concatenate(p) for p in pieces)
        order = np.argsort(key, kind="stable")
        key, k, place = key[order], k[order], place[order]
        lead = _lead(key)
        if not len(lead):
            continue
        size = np.diff(np.r_[lead, len(key)])
        least = np.minimum.reduceat(k, lead)
        holder = np.where(k == np.repeat(least, size), np.arange(len(k)), len(k))
        out.append((key[lead], least, place[np.minimum.reduceat(holder, lead)]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else runs_[0]


def _merged(group: pd.DataFrame, width: int) -> pd.DataFrame:
    """Strings of a bucket that start in a document with a smaller k, as answers by part; removals pass through."""
    columns = [x.split()[0] for x in FOUND.split(", ")]
    through = group[group["kind"] == 1][columns]
    sent = group[group["kind"] == 0]
    if not len(sent):
        return through
    kept, runs_, n_bytes = [], [], 0
    blob = np.frombuffer(b"".join(sent["bytes"]) + b"\0" * 8, np.uint8)
    word = words_at(blob)
    for x in sent.itertuples(index=False):
        rows, counts, begin = _rows_of(x._asdict())
        windows = np.frombuffer(x.windows, np.uint8).astype(np.int64)
        size = windows + width - 1
        base = np.cumsum(size) - size
        step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        spot = np.repeat(base, windows) + step
        ks = np.cumsum(np.frombuffer(x.ks, np.int64))
        doc = np.repeat(np.repeat(np.arange(len(counts), dtype=np.int32), counts), windows)
        at = (np.repeat(begin, windows) + step).astype(np.int32)
        key = bh.gram_hashes(np.frombuffer(x.bytes, np.uint8), width)[spot]
        order = np.argsort(key, kind="stable").astype(np.int32)  # documents of a part ascend by k, so a key's first is its least
        first = order[_lead(key[order])]
        runs_.append((key[first], ks[doc[first]], spot[first] + n_bytes))
        kept.append((x.part, key[order], order, (spot + n_bytes).astype(np.int32), doc, at, ks, rows))
        n_bytes += len(x.bytes)
    keys, least, place = merge_runs(runs_)
    del runs_
    out = []
    while kept:
        part, ordered, order, spot, doc, at, ks, rows = kept.pop()
        found = np.searchsorted(keys, ordered)
        late = np.flatnonzero(ks[doc[order]] > least[found])
        mine, other = spot[order[late]], place[found[late]]
        same = np.ones(len(late), bool)
        for j in [*range(0, width - 7, 8), width - 8]:  # the bytes themselves
            same &= word[mine + j] == word[other + j]
        hit = np.sort(order[late[same]])
        if len(hit):
            # by document and place; a document's contexts ascend, so its strings do
            out.append(_listed(part, rows[doc[hit]], at[hit]))
    return pd.concat([through, pd.DataFrame(out, columns=columns)], ignore_index=True)


def repeated_strings(dealt: DataFrame, width: int, gram: int, buckets: int, common: int = COMMON) -> DataFrame:
    """By part: starts of ``width``-byte strings that also start in a document with a smaller k."""

    def ask(texts: pa.Table) -> pa.Table:
        flat, offs = bh.text_bytes(texts["text"])
        found = _shard_anchors(flat, offs, width, gram)
        bucket, short, rows, _ = _different(found["key"], found["row"], buckets)
        part, out = texts["part"][0].as_py(), []
        edges = np.r_[_lead(bucket), len(bucket)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            step = np.diff(np.r_[np.uint64(0), short[a:b]])
            far = step >= _FAR
            out.append({"bucket": int(bucket[a]), "part": part, "steps": np.where(far, _FAR, step).astype(np.uint32).tobytes(), "far": step[far].tobytes(), "rows": rows[a:b].astype(np.uint8).tobytes()})
        return pa.Table.from_pylist(out, schema=_ASKED)

    def tell(group: pd.DataFrame) -> pd.DataFrame:
        keys, rows = [], []
        for x in group.itertuples(index=False):
            step = np.frombuffer(x.steps, np.uint32).astype(np.uint64)
            step[step == _FAR] = np.frombuffer(x.far, np.uint64)
            keys.append(np.cumsum(step))
            rows.append(np.frombuffer(x.rows, np.uint8).astype(np.int64))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        lead = _lead(key[order])
        size = np.diff(np.r_[lead, len(key)])
        flags = np.zeros(len(key), np.uint8)
        flags[order] = np.repeat((size > 1) * 1 + (np.add.reduceat(np.concatenate(rows)[order], lead) >= common) * 2, size)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        return pd.DataFrame({"part": group["part"], "bucket": group["bucket"], "flags": [x.tobytes() for x in np.split(flags, cuts)]})

    def move(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_pylist([], schema=_MOVED)
        texts = _in_order(texts)
        part = texts["part"][0].as_py()
        flat, offs = bh.text_bytes(texts["text"])
        ks = texts["k"].to_numpy()
        found = _shard_anchors(flat, offs, width, gram)
        bucket, _, _, place = _different(found["key"], found["row"], buckets)
        flags = np.zeros(len(bucket), np.uint8)
        begin = np.searchsorted(bucket, np.arange(buckets + 1))
        for x in told.to_pylist():
            flags[begin[x["bucket"]] : begin[x["bucket"] + 1]] = np.frombuffer(x["flags"], np.uint8)
        flag = flags[place]
        row = found["row"]
        low, high = np.full(len(bucket), ex.LAST), np.full(len(bucket), -ex.LAST)
        np.minimum.at(low, place, ks[row])
        np.maximum.at(high, place, ks[row])
        here = (low < high)[place]
        gone = np.zeros(len(flat), bool)
        gone[_local_classes(flat, offs, row[here], found["lo"][here], found["hi"][here], ks, width)] = True
        starts = np.flatnonzero(gone)
        owner = np.searchsorted(offs, starts, side="right") - 1
        out = [_listed(part, owner, starts - offs[owner]) | {"bucket": part % buckets, "kind": 1}] if len(starts) else []
        # what is left of each anchor that other shards have
        far = np.flatnonzero(flag & 1)
        size = found["hi"][far] - found["lo"][far]
        window = np.arange(int(size.sum())) + np.repeat(found["lo"][far] - (np.cumsum(size) - size), size)
        anchor = np.repeat(far, size)
        left = ~gone[window]
        window, anchor = window[left], anchor[left]
        single = (flag[anchor] & 2).astype(bool)
        if len(window):
            cut = np.r_[True, (np.diff(window) != 1) | (np.diff(anchor) != 0) | single[1:]]
            first = np.flatnonzero(cut)
            last = np.r_[first[1:], len(window)] - 1
            lo, hi, who = window[first], window[last] + 1, anchor[first]
            deal = found["key"][who]
            alone = single[first]
            if alone.any():
                deal = deal.copy()
                deal[alone] = _string_hashes(flat, lo[alone], width)
            out += _packed_contexts(part, (deal % np.uint64(buckets)).astype(np.int32), row[who], lo, hi, flat, offs, ks, width)
        return pa.Table.from_pylist(out, schema=_MOVED)

    by_part = dealt.groupBy("part")
    told = by_part.applyInArrow(ask, ASKED).groupBy("bucket").applyInPandas(tell, TOLD)
    moved = by_part.cogroup(told.groupBy("part")).applyInArrow(move, MOVED)
    return moved.groupBy("bucket").applyInPandas(lambda group: _merged(group, width), FOUND)


def _in_order(texts: pa.Table) -> pa.Table:
    """A part's rows in the order in which they are counted; rows that tie are equal."""
    return texts.sort_by([("k", "ascending"), ("uid", "ascending")])


def _string_hashes(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += flat[at + j]
    return bh.mix(out)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>, kept binary"
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
     ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())]
)


def remove_repeated_strings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, common: int = COMMON, with_text: bool = True) -> DataFrame:
    """Removes each byte covered by a ``width``-byte string that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes; matches stay inside documents. Returned, a row for each row of ``docs``: doc_id,
    n_bytes, n_removed, n_spans and removed (maximal removed runs, in bytes, end exclusive), kept_sha256 (of the
    bytes that remain) and, with ``with_text``, kept: bytes, as a cut may fall inside a character.

    Null texts are empty; texts shorter than ``width`` keep everything. Rows with the same doc_id don't count
    as earlier than each other; a null doc_id counts as the largest. Other columns are ignored.
    """
    parts = ex.bucket_count(docs, shard_bytes)
    buckets = max(1, -(-parts * shard_bytes // MERGE_BYTES))
    dealt = ex.dealt(ex.named(docs), parts)
    found = repeated_strings(dealt, width, gram, buckets, common)

    def remove(texts: pa.Table, hits: pa.Table) -> pa.Table:
        texts = _in_order(texts)
        at: dict[int, list] = {}
        for x in hits.to_pylist():
            rows, counts, places = _rows_of(x)
            for row, some in zip(rows.tolist(), np.split(places, np.cumsum(counts)[:-1]), strict=True):
                at.setdefault(row, []).append(some)
        flat, offs = bh.text_bytes(texts["text"])
        out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")}
        for i in range(len(offs) - 1):
            data = flat[offs[i] : offs[i + 1]]
            gone = np.zeros(len(data), bool)
            if i in at:
                places = np.concatenate(at[i])
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, places, 1)
                np.add.at(step, places + width, -1)
                gone = np.cumsum(step[:-1]) > 0
            kept = data[~gone].tobytes()
            lo, hi = runs(gone)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(len(lo))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["removed"].append([{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
            out["kept"].append(kept if with_text else None)
        return pa.Table.from_pydict({"doc_id": texts["doc_id"], **out}, schema=_OUT)

    result = dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(remove, OUT)
    return result if with_text else result.drop("kept")
