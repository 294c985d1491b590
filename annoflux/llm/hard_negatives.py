"""Hard negatives for anchors: close rows of other labels, found by segment summary filtering.

A vector is cut into segments; of each segment its mean and deviation are kept. The inner
product of two segments of length n lies between n (m m' - d d') and n (m m' + d d'), so the
summaries of two vectors bound their score from both sides. Pairs are tested with few long
segments first and with shorter ones while the bounds leave them in question; what is left is
scored exactly, in whole numbers. The bounds never drop a row that belongs to the answer.

``mine`` finds an anchor's positives, the best rows of its own label, and for each positive the best rows
of other labels whose score lies in the band below the positive's.

Anchors are a stated share of the rows, held against all rows in blocks: rows are dealt into
strands, anchors into parts of at most ``PART``; a task holds the anchors of a part and streams
the rows of a strand past them. A task's memory is its anchors and one Arrow batch, its result a
few rows for each anchor. Strands are dealt by row number, so a hot label or a vector with many
copies spreads.

Rows: a null label or vector, or a null or non-finite component, takes no part. Vectors of other
lengths are never held against each other; empty vectors score 0. A null vec_id is no anchor, and
comes last in ties. Repeated rows are rows: an anchor that stands twice is answered twice, and is
the other's positive. Scores beyond 64 bits are cut to the largest long. An empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoflux.llm.storage import cut

#: Segments by level; levels of a vector's length and more are left out.
LEVELS = (1, 4, 16, 32)
#: Anchors a task holds at most, and rows of a strand beyond which there are more strands than partitions.
PART, STRAND = 65_536, 262_144
#: Anchors and rows of a tile of bounds.
TILE = (1_024, 4_096)
#: Share of a tile's pairs beyond which a level is computed for the whole tile at once.
DENSE = 0.1
LAST, LEAST = 2**63 - 1, -(2**63) + 1

PREPARED = "vec_id long, label int, dim int, q binary"
FOUND = "anchor_id long, mark long, copies long, {}score long, id long, other long"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(256 x) of every component, in two bytes each where they fit, else as doubles."""
    for batch in batches:
        lengths = pa.compute.list_value_length(batch["embedding"]).to_numpy(zero_copy_only=False)
        flat = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            flat = np.nan_to_num(np.floor(256 * flat))
        packed = [(v.astype("<i2") if len(v) == 0 or np.abs(v).max() < 2**15 else v).tobytes() for v in np.split(flat, np.cumsum(lengths)[:-1])] if len(lengths) else []
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["label"], pa.array(lengths, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "label", "dim", "q"]
        )


def prepare(rows: DataFrame, label: Column) -> DataFrame:
    """Rows that take part: vec_id, label, dim and the whole-numbered vector q."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    took = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), "embedding").where(F.col("label").isNotNull() & x.isNotNull() & ~bad)
    return took.mapInArrow(_whole, PREPARED)


def _matrix(q: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<i2" if len(b) == 2 * dim else "<f8").astype(np.float64) for b in q]) if dim else np.zeros((len(q), 0))


class Summaries:
    """Vectors with their segments' means and deviations, both times the root of the segment's length."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.levels = vectors, []
        dim = vectors.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            square = vectors**2
            norm = np.sqrt(square.sum(1, keepdims=True))
            for n in (n for n in LEVELS if n < dim):
                edges = np.linspace(0, dim, n + 1).astype(int)
                length = np.diff(edges)
                total = np.add.reduceat(vectors, edges[:-1], 1)
                rest = np.maximum(np.add.reduceat(square, edges[:-1], 1) - total**2 / length, 0)
                # more than rounding can take away, so that the bounds hold
                self.levels.append((total / np.sqrt(length), np.sqrt(rest) + 1e-6 * norm))
        #: rows whose products with each other are exact in doubles
        self.plain = (np.abs(vectors).max(1) if dim else np.zeros(len(vectors))) < np.sqrt(2.0**52 / max(dim, 1))

    def take(self, at: np.ndarray | slice) -> Summaries:
        out = object.__new__(Summaries)
        out.vectors, out.plain = self.vectors[at], self.plain[at]
        out.levels = [(m[at], d[at]) for m, d in self.levels]
        return out


def survivors(a: Summaries, r: Summaries, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (index in a, index in r, score) whose bounds leave a score between ``low`` and ``high`` of the anchor."""
    ai = ri = None
    for (ma, da), (mr, dr) in zip(a.levels, r.levels, strict=True):
        if ai is None:
            mid, off = ma @ mr.T, da @ dr.T
            open_ = (mid + off >= low[:, None]) & (mid - off <= high[:, None])
            if np.count_nonzero(open_) <= DENSE * open_.size:
                ai, ri = np.nonzero(open_)
        else:
            mid, off = np.einsum("ij,ij->i", ma[ai], mr[ri]), np.einsum("ij,ij->i", da[ai], dr[ri])
            keep = (mid + off >= low[ai]) & (mid - off <= high[ai])
            ai, ri = ai[keep], ri[keep]
    if ai is not None:
        return ai, ri, np.einsum("ij,ij->i", a.vectors[ai], r.vectors[ri])
    score = a.vectors @ r.vectors.T
    ai, ri = np.nonzero((score >= low[:, None]) & (score <= high[:, None]))
    return ai, ri, score[ai, ri]


def _large(a: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs by whole numbers of any size, a row at a time."""
    left = [[int(x) for x in v] for v in a]
    out = []
    for i, v in enumerate(r):
        other = [int(x) for x in v]
        out += [(k, i, max(LEAST, min(LAST, sum(x * y for x, y in zip(u, other, strict=True))))) for k, u in enumerate(left)]
    ai, ri, score = zip(*out, strict=True) if out else ((), (), ())
    return np.array(ai, np.int64), np.array(ri, np.int64), np.array(score, np.int64)


class Best:
    """The best entries of each key: higher scores first, ties by id."""

    def __init__(self, keys: int, size: int):
        self.size, self.least = size, np.full(keys, LEAST)
        self.key, self.score, self.id, self.other = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, other: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids, other = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids), (self.other, other)))
        order = np.lexsort((ids, -score, key))
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        order, rank = order[rank < self.size], rank[rank < self.size]
        self.key, self.score, self.id, self.other = key[order], score[order], ids[order], other[order]
        full = order[rank == self.size - 1]
        self.least[key[full]] = score[full]


class Search:
    """The anchors of a part with what they have found so far; with ``bands`` an entry for each band of an anchor."""

    def __init__(self, anchors: pd.DataFrame, dim: int, size: int, banded: bool):
        self.anchors, self.banded = anchors, banded
        self.blocks = []
        for at in range(0, len(anchors), TILE[0]):
            block = anchors.iloc[at : at + TILE[0]]
            bands = [np.asarray(p, np.int64) for p in block["scores"]] if banded else [np.zeros(1, np.int64)] * len(block)
            count = np.array([len(p) for p in bands])
            of, p = np.repeat(np.arange(len(block)), count), np.concatenate(bands)
            # ceil(p / 2) and floor(19 p / 20); nothing fits below 0
            low, high = (-(-p // 2), p + -p // 20) if banded else (np.full(len(p), LEAST), np.full(len(p), LAST))
            self.blocks.append((at, Summaries(_matrix(block["q"], dim)), of, low, high, np.r_[0, np.cumsum(count)], Best(len(p), size)))
        self.dim, self.labels = dim, anchors["label"].to_numpy()

    def pass_by(self, rows: pd.DataFrame) -> None:
        """Holds rows against the anchors; with bands only rows of other labels count."""
        ids = rows["vec_id"].to_numpy(np.int64)
        marks, labels, every = rows["mark"].to_numpy(np.int64), rows["label"].to_numpy(), Summaries(_matrix(rows["q"], self.dim))
        # a short first tile gives the bounds something to hold against
        edges = [0, *range(min(256, len(rows)), len(rows), TILE[1]), len(rows)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            tile = every.take(slice(lo, hi))
            for at, a, of, low, high, first, best in self.blocks:
                need = np.maximum(low, best.least)
                floor_, ceil_ = np.full(len(a.vectors), LAST), np.full(len(a.vectors), LEAST)
                np.minimum.at(floor_, of, need)
                np.maximum.at(ceil_, of, high)
                for pa_, pr in ((True, True), (True, False), (False, True), (False, False)):
                    us, them = np.flatnonzero(a.plain == pa_), np.flatnonzero(tile.plain == pr)
                    if not len(us) or not len(them):
                        continue
                    ai, ri, score = survivors(a.take(us), tile.take(them), floor_[us].astype(float), ceil_[us].astype(float)) if pa_ and pr else _large(a.vectors[us], tile.vectors[them])
                    ai, ri, score = us[ai], them[ri], score.astype(np.int64)
                    if self.banded:
                        keep = self.labels[at + ai] != labels[lo + ri]
                        ai, ri, score = ai[keep], ri[keep], score[keep]
                    each = first[ai + 1] - first[ai]
                    key = np.repeat(first[ai], each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
                    ri, score = np.repeat(ri, each), np.repeat(score, each)
                    keep = (score >= need[key]) & (score <= high[key])
                    best.add(key[keep], score[keep], ids[lo:hi][ri[keep]], marks[lo:hi][ri[keep]])

    def found(self) -> Iterator[pd.DataFrame]:
        for at, _, of, _, _, first, best in self.blocks:
            if len(best.key):
                who = self.anchors.iloc[at + of[best.key]]
                ids = pd.Series(best.id).astype("Int64").mask(best.id == LAST)
                yield pd.DataFrame(
                    {"anchor_id": who["vec_id"].to_numpy(np.int64), "mark": who["mark"].to_numpy(), "copies": who["copies"].to_numpy(), "band": best.key - first[of[best.key]] + 1, "score": best.score, "id": ids, "other": best.other}
                )


def _streamed(size: int, banded: bool):  # noqa: ANN202
    names = ["anchor_id", "mark", "copies", *["band"] * banded, "score", "id", "other"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting, search = None, [], None
        for batch in batches:
            keys = batch[["dim", "own", "part", "strand"]].to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]), len(batch)] if len(batch) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                piece, key = batch.iloc[lo:hi], tuple(keys[lo])
                if key != now:
                    if search is not None:
                        yield from (x[names] for x in search.found())
                    now, waiting, search = key, [], None
                is_row = piece["is_row"].to_numpy()
                if not is_row.all():
                    waiting.append(piece[~is_row])
                if is_row.any() and waiting:
                    if search is None:
                        search = Search(pd.concat(waiting, ignore_index=True), int(key[0]), size, banded)
                    search.pass_by(piece[is_row])
        if search is not None:
            yield from (x[names] for x in search.found())

    return run


def _held(rows: DataFrame, anchors: DataFrame, parts: int, strands: int, size: int, banded: bool) -> DataFrame:
    """What each anchor finds in each strand; without bands among rows of its own label."""
    own = F.lit(0) if banded else F.col("label")
    scores = ["scores"] if banded else []
    a = anchors.select(
        "dim", own.alias("own"), F.pmod(F.xxhash64("vec_id", "mark"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(strands - 1))).alias("strand"),
        F.lit(False).alias("is_row"), "vec_id", "label", "mark", "copies", "q", *scores,
    )
    r = rows.withColumn("strand", F.pmod(F.monotonically_increasing_id(), F.lit(strands)).cast("int")).select(
        "dim", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "strand",
        F.lit(True).alias("is_row"), F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), "label", "mark", F.lit(0).cast("long").alias("copies"), "q", *[F.lit(None).cast("array<long>").alias(x) for x in scores],
    )
    at = ["dim", "own", "part", "strand"]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts * strands)
    return a.unionByName(r).repartition(tasks, *at).sortWithinPartitions(*at, "is_row").mapInPandas(_streamed(size, banded), FOUND.format("band int, " if banded else ""))


def mine(rows: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors, over vec_id; ``label`` is the label to go by, over all
    columns of ``rows``. A negative's score lies between 50 and 95 hundredths of the positive's.
    """
    spark = rows.sparkSession
    ready = cut(prepare(rows, label).withColumn("mark", F.xxhash64("label", "q")))
    anchors = ready.where(F.coalesce(anchor, F.lit(False))).groupBy("vec_id", "label", "dim", "mark", "q").agg(F.count("*").alias("copies"))
    n_rows, n_anchors = ready.agg(F.count("*"), F.count_if(F.coalesce(anchor, F.lit(False)))).first()
    parts = -(-n_anchors // PART) or 1
    strands = max(-(-n_rows // STRAND), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts))

    # one more than asked for, as an anchor finds itself
    by_anchor = Window.partitionBy("anchor_id", "mark")
    best = by_anchor.orderBy(F.desc("score"), F.asc_nulls_last("id"))
    itself = F.col("id").eqNullSafe(F.col("anchor_id")) & (F.col("other") == F.col("mark"))
    found = _held(ready, anchors, parts, strands, positives + 1, banded=False).withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives + 1)
    found = found.withColumn("itself", itself).withColumn("at", F.row_number().over(Window.partitionBy("anchor_id", "mark", "itself").orderBy("n"))).where(~(F.col("itself") & (F.col("at") == 1)))
    found = found.withColumn("n", F.row_number().over(by_anchor.orderBy("n"))).where(F.col("n") <= positives)
    pairs = cut(found.groupBy("anchor_id", "mark").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found")))

    asked = anchors.join(pairs.select(F.col("anchor_id").alias("vec_id"), "mark", F.col("found.score").alias("scores")), ["vec_id", "mark"])
    close = _held(ready, asked, parts, strands, negatives, banded=True)
    close = close.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "mark", "band").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= negatives)
    out = close.join(pairs, ["anchor_id", "mark"]).withColumn("positive", F.element_at("found", F.col("band")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
