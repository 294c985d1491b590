"""Numbers and islands of sorted rows, without a task for each key.

Rows are sorted into ranges; a key with a third of all rows covers many of them. A first pass
tells of each range how its last key ends, a row a range; these rows are added up on the driver (as many as
partitions), and a second pass goes through the ranges again with what the ones before hand on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from annoflux.operators.lineage import cut


def _edges(batch: pa.RecordBatch, keys: tuple[str, ...], before: tuple | None) -> tuple[np.ndarray, list[tuple]]:
    """Where each key of a batch begins (0 is left out if it goes on from before), and the keys."""
    fresh = np.zeros(batch.num_rows, bool)
    columns = [batch[k].to_pylist() for k in keys]
    fresh[0] = before != tuple(c[0] for c in columns)
    for c in columns:
        own = np.array(c, dtype=object)
        fresh[1:] |= own[1:] != own[:-1]
    at = np.flatnonzero(fresh)
    return at, [tuple(c[i] for c in columns) for i in at]


def _sorted(df: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_range", F.spark_partition_id().cast("long")))


def _with_long(df: DataFrame, name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]]) -> DataFrame:
    """Adds a long column that ``run`` makes for each batch; column _range goes."""
    schema = StructType([*[f for f in df.schema.fields if f.name != "_range"], StructField(name, LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in run(batches):
            kept = [c for c in batch.schema.names if c != "_range"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(values, pa.int64())], names=[*kept, name])

    return df.mapInArrow(add, schema)


def numbered(df: DataFrame, keys: tuple[str, ...], order: list, name: str) -> DataFrame:
    """Adds ``name``: the row's number within its key, from 1, by ``order``; ties are numbered in any order. Keys are not null."""
    ranged = _sorted(df, keys, order)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, alone, part = None, 0, True, None
        for batch in batches:
            if batch.num_rows:
                part = batch["_range"][0].as_py()
                at, found = _edges(batch, keys, key)
                alone &= len(at) == (1 if key is None else 0)
                key, n = (found[-1], batch.num_rows - int(at[-1])) if len(at) else (key, n + batch.num_rows)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([repr(key)]), pa.array([n]), pa.array([alone])], names=["part", "key", "n", "alone"])

    handed, key, n = {}, None, 0
    for row in sorted(ranged.select(*keys, "_range").mapInArrow(tails, "part long, key string, n long, alone boolean").collect()):
        handed[row.part] = (key, n)
        key, n = row.key, (n if row.alone and row.key == key else 0) + row.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        key, n, first = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            at, found = _edges(batch, keys, key)
            if first:
                before, count = handed[batch["_range"][0].as_py()]
                n, first = (count if before == repr(found[0]) else 0), False
            out = np.arange(1, batch.num_rows + 1)
            starts = np.zeros(batch.num_rows, np.int64)
            starts[at] = at
            out -= np.maximum.accumulate(starts)
            held = batch.num_rows if not len(at) else int(at[1]) if key is None and len(at) > 1 else batch.num_rows if key is None else int(at[0])
            out[:held] += n  # rows of the key that goes on, or of the first key, which a range before may have begun
            key, n = (found[-1] if len(at) else key), int(out[-1])
            yield batch, out

    return _with_long(ranged, name, run)


def islands(df: DataFrame, keys: tuple[str, ...], start: str, end: str, name: str) -> DataFrame:
    """Adds ``name``: where the row's island begins. Spans that overlap, by way of others too, are an island of their key."""
    ranged = _sorted(df, keys, [start])

    def walk(batch: pa.RecordBatch, key: tuple | None, begin: int, reach: int) -> tuple[np.ndarray, tuple, int, int]:
        """The islands of a batch that goes on at ``key``, whose last island began at ``begin`` and reaches to ``reach``."""
        at, found = _edges(batch, keys, key)
        s, e = batch[start].to_numpy().astype(np.int64), batch[end].to_numpy().astype(np.int64)
        out = np.empty(batch.num_rows, np.int64)
        cuts = sorted({0, *at.tolist()})
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            if lo in at:
                begin, reach = int(s[lo]), int(e[lo])
            far = np.maximum.accumulate(np.r_[reach, e[lo:hi]])
            fresh = s[lo:hi] >= far[:-1]
            if lo in at:
                fresh[0] = False
            first = np.where(fresh, np.arange(hi - lo), -1)
            last = np.maximum.accumulate(first)
            out[lo:hi] = np.where(last < 0, begin, s[lo:hi][np.maximum(last, 0)])
            begin, reach = int(out[hi - 1]), int(far[-1])
        return out, (found[-1] if len(found) else key), begin, reach

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begin, reach, alone, part = None, 0, 0, True, None
        for batch in batches:
            if batch.num_rows:
                part = batch["_range"][0].as_py()
                before = key
                _, key, begin, reach = walk(batch, key, begin, reach)
                alone &= len(_edges(batch, keys, before)[0]) == (1 if before is None else 0)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([repr(key)]), pa.array([begin]), pa.array([reach]), pa.array([alone])], names=["part", "key", "begin", "reach", "alone"])

    handed, key, begin, reach = {}, None, 0, 0
    for row in sorted(ranged.select(*keys, start, end, "_range").mapInArrow(tails, "part long, key string, begin long, reach long, alone boolean").collect()):
        handed[row.part] = (key, begin, reach)
        if row.alone and row.key == key:  # the whole range goes on with the key: its last island may be the handed one
            begin, reach = (begin if row.begin < reach else row.begin), max(reach, row.reach)
        else:
            key, begin, reach = row.key, row.begin, row.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        key, begin, reach, first = None, 0, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                before, begin, reach = handed[batch["_range"][0].as_py()]
                own = tuple(batch[k][0].as_py() for k in keys)
                key, first = (own if before == repr(own) else None), False
            out, key, begin, reach = walk(batch, key, begin, reach)
            yield batch, out

    return _with_long(ranged, name, run)
