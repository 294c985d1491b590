"""Jaccard self-join of documents over word shingles, by a count-vector R-tree.

1. ``ask``/``tell``: parts of the corpus send their different shingle hashes once and learn
   in how many documents each occurs. A document with more shingles of its own than
   ``1 - similarity`` allows has no partner and is done.
2. The others are reduced to their different sets (copies are one set). Two similar sets share one
   of their rarest shingles, so the sets with such a shingle form a block. Blocks with the same
   members are one; those of very common shingles are cut by bands of size and into tiles.
3. Shingles are hashed into groups, the group counts of a set are a point, and each block has an
   R-tree of its points: the summed minima of the coordinates (or of a node's upper corner) bound
   the overlap. Only points travel to the blocks, not sets.
4. First each set of a block is verified against the first that the bound leaves, a linear number of
   pairs, which makes classes. Then the sets that the bound leaves partners of another class
   are held against each other inside their blocks; no pairs are written down but links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoflux.llm import bytehash as bh
from annoflux.llm import exchange as ex
from annoflux.llm.graph import components
from annoflux.llm.storage import cut

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 80
PART_BYTES = 8 << 20
GROUPS = 128
FANOUT = 16
#: Sets, and bytes of sets, of one shingle that one task holds against each other; bytes also of small blocks together.
TILE = 4096
TILE_BYTES = 8 << 20
#: Rows of blocks that one task searches.
TASK_ROWS = 10_000
SALTS = 16
SHORT_BITS = 40

ASKED = "bucket int, part int, steps binary, far binary, docs binary"
_ASKED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("steps", pa.binary()), ("far", pa.binary()), ("docs", pa.binary())])
TOLD = "part int, bucket int, docs binary"
DESCRIBED = "doc_id long, k long, uid long, n long, node long, check long, lonely int, shingles binary"
_DESCRIBED = pa.schema(
    [("doc_id", pa.int64()), ("k", pa.int64()), ("uid", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("lonely", pa.int32()), ("shingles", pa.binary())]
)
_FAR = 2**32 - 1


def shingle_sets(flat: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every document's different shingles, row by row."""
    rows, hashes = [], []
    for a, b in bh.pieces(offs):
        f, o = bh.lower_ascii(flat[offs[a] : offs[b]]), offs[a : b + 1] - offs[a]
        starts, ends, row = bh.words(f, o)
        word = bh.word_hashes(f, starts, ends)
        h, first = bh.window_hashes(word, row, width)
        piece_rows, piece_hashes = [row[first]], [h]
        count = np.bincount(row, minlength=b - a)
        for short in range(1, width):  # the whole sequence of a short document
            own = count[row] == short
            if own.any():
                h, first = bh.window_hashes(word[own], row[own], short)
                piece_rows.append(row[own][first])
                piece_hashes.append(bh.mix(h + np.uint64(short)))
        row, h = np.concatenate(piece_rows), np.concatenate(piece_hashes)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        fresh = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        rows.append(row[fresh] + a)
        hashes.append(h[fresh])
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def _lead(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _different(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A part's different hashes: bucket, short key, documents with it (up to 255), place of every hash among them."""
    bucket = hashes % np.uint64(buckets)
    short = (hashes // np.uint64(buckets)) & np.uint64((1 << SHORT_BITS) - 1)
    kinds, place, docs = np.unique((bucket << np.uint64(SHORT_BITS)) | short, return_inverse=True, return_counts=True)
    return (kinds >> np.uint64(SHORT_BITS)).astype(np.int64), kinds & np.uint64((1 << SHORT_BITS) - 1), np.minimum(docs, 255), place


def slack(n: np.ndarray | int, similarity: int) -> np.ndarray | int:
    """Shingles that a set of n may have and a similar set not."""
    return n - -(-similarity * n // 100)


def describe(docs: DataFrame, width: int, similarity: int, buckets: int) -> DataFrame:
    """A row for each document: size and hash of its set; for those that may have a partner the set, rarest first, and how many of it are theirs alone."""

    def ask(texts: pa.Table) -> pa.Table:
        flat, offs = bh.text_bytes(texts["text"])
        _, hashes = shingle_sets(flat, offs, width)
        bucket, short, count, _ = _different(hashes, buckets)
        edges = np.r_[_lead(bucket), len(bucket)]
        part, out = texts["part"][0].as_py(), []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            step = np.diff(np.r_[np.uint64(0), short[a:b]])
            far = step >= _FAR
            out.append({"bucket": int(bucket[a]), "part": part, "steps": np.where(far, _FAR, step).astype(np.uint32).tobytes(), "far": step[far].tobytes(), "docs": count[a:b].astype(np.uint8).tobytes()})
        return pa.Table.from_pylist(out, schema=_ASKED)

    def tell(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for x in group.itertuples(index=False):
            step = np.frombuffer(x.steps, np.uint32).astype(np.uint64)
            step[step == _FAR] = np.frombuffer(x.far, np.uint64)
            keys.append(np.cumsum(step))
            counts.append(np.frombuffer(x.docs, np.uint8).astype(np.int64))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        lead = _lead(key[order])
        total = np.minimum(np.add.reduceat(np.concatenate(counts)[order], lead), 255)
        out = np.zeros(len(key), np.uint8)
        out[order] = np.repeat(total, np.diff(np.r_[lead, len(key)]))
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        return pd.DataFrame({"part": group["part"], "bucket": group["bucket"], "docs": [x.tobytes() for x in np.split(out, cuts)]})

    def gather(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_pylist([], schema=_DESCRIBED)
        flat, offs = bh.text_bytes(texts["text"])
        rows, hashes = shingle_sets(flat, offs, width)
        bucket, _, count, place = _different(hashes, buckets)
        docs_with = count.astype(np.uint8)
        begin = np.searchsorted(bucket, np.arange(buckets + 1))
        for x in told.to_pylist():
            docs_with[begin[x["bucket"]] : begin[x["bucket"] + 1]] = np.frombuffer(x["docs"], np.uint8)
        with_it = docs_with[place]
        n = np.bincount(rows, minlength=texts.num_rows)
        lonely = np.bincount(rows[with_it == 1], minlength=texts.num_rows)
        may = (lonely <= slack(n, similarity)) & (n > 0)
        order = np.lexsort((hashes, with_it, rows))
        rarest = hashes[order]
        edges = np.r_[0, np.cumsum(n)]
        total = np.r_[np.uint64(0), np.cumsum(bh.mix(hashes))]
        other = np.r_[np.uint64(0), np.cumsum(bh.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))]
        node = bh.mix((total[edges[1:]] - total[edges[:-1]]) + n.astype(np.uint64))
        check = other[edges[1:]] - other[edges[:-1]]
        data = [rarest[edges[i] : edges[i + 1]].tobytes() if may[i] else None for i in range(len(n))]
        return pa.Table.from_arrays(
            [texts["doc_id"].combine_chunks(), texts["k"].combine_chunks(), texts["uid"].combine_chunks(), pa.array(n), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(lonely.astype(np.int32)), pa.array(data, pa.binary())],
            schema=_DESCRIBED,
        )

    by_part = ex.dealt(ex.named(docs), buckets).groupBy("part")
    told = by_part.applyInArrow(ask, ASKED).groupBy("bucket").applyInPandas(tell, TOLD)
    return by_part.cogroup(told.groupBy("part")).applyInArrow(gather, DESCRIBED)


class CountTree:
    """R-tree over group counts, packed by size and then by the heaviest coordinates."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, similarity: int):
        self.similarity = similarity
        self.order = np.lexsort((counts.argmax(axis=1), counts.max(axis=1), sizes))
        self.levels = [(counts[self.order], sizes[self.order])]  # points, then the nodes' upper corners and least sizes
        while len(self.levels[-1][1]) > FANOUT:
            upper, least = self.levels[-1]
            cuts = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(upper, cuts, axis=0), np.minimum.reduceat(least, cuts)))

    def near(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Points whose overlap with the given one may reach the similarity."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            bound = np.minimum(upper[at], counts).sum(axis=1)
            # overlap o of sets of a and b: 100 o >= s (a + b - o)
            at = at[(100 + self.similarity) * bound >= self.similarity * (least[at] + size)]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


def group_counts(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount((x >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS) for x in sets]).astype(np.int32)


def overlaps(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of a sorted set with each of others."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    spot = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[spot] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


def similar(overlap: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, similarity: int) -> np.ndarray:
    return 100 * overlap >= similarity * (a + b - overlap)


def _points(column: pd.Series) -> np.ndarray:
    """Group counts of packed points, a row each."""
    data = column.to_list()
    if all(len(x) == GROUPS for x in data):
        return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), GROUPS).astype(np.int32)
    return np.stack([np.frombuffer(x, f"<u{len(x) // GROUPS}") for x in data]).astype(np.int32)


def _packed(counts: np.ndarray) -> list[bytes]:
    """Points with as many bytes a coordinate as the largest needs."""
    return [x.astype("<u1" if x.max() < 1 << 8 else "<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in counts]


class Block:
    """Members of a block that may be found, in an R-tree; a member asks for those before it by size, then node."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, found: np.ndarray, similarity: int):
        rank = np.empty(len(nodes), np.int64)
        rank[np.lexsort((nodes, sizes))] = np.arange(len(nodes))
        self.members = np.flatnonzero(found)
        self.members = self.members[np.argsort(rank[self.members])]
        self.before = np.searchsorted(rank[self.members], rank)
        self.counts, self.sizes = counts, sizes
        self.tree = CountTree(counts[self.members], sizes[self.members], similarity) if len(self.members) else None

    def near(self, q: int) -> np.ndarray:
        """Members before ``q`` that may be similar to it, in order."""
        if self.tree is None or not self.before[q]:
            return np.zeros(0, np.int64)
        at = self.tree.near(self.counts[q], self.sizes[q])
        return self.members[np.sort(at[at < self.before[q]])]


def tie(block: Block, sets: list[np.ndarray], queries: np.ndarray, classes: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Links that tie sets of different classes: each query is held against what the block finds for it."""
    _, first, back = np.unique(classes, return_index=True, return_inverse=True)
    root = first[back].tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes, links = block.sizes, []
    for q in queries.tolist():
        near = [x for x in block.near(q).tolist() if find(x) != find(q)]
        for a in range(0, len(near), 64):
            look = [x for x in near[a : a + 64] if find(x) != find(q)]
            if look:
                good = similar(overlaps(sets[q], [sets[x] for x in look]), sizes[q], sizes[look], similarity)
                for x in np.array(look)[good].tolist():
                    if find(x) != find(q):
                        links.append((q, x))
                        root[find(x)] = find(q)
    return links


def _by_block(group: pd.DataFrame) -> list[pd.DataFrame]:
    group = group.sort_values(["block", "node"], ignore_index=True)
    edges = np.r_[_lead(group["block"].to_numpy()), len(group)]
    return [group.iloc[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _task(n: int) -> Column:
    """Blocks are dealt over ``n`` groups, a task's worth each."""
    return F.pmod(F.col("block"), F.lit(n)).alias("task")


def _tiled(rows: DataFrame, held: DataFrame, similarity: int, tile: int, tile_bytes: int) -> DataFrame:
    """(block, node, n, asks, found): rows (key, node, n, asks, found) of a key as one block, or as tiles.

    ``held`` has the keys to take with their size and total n. Members of a key beyond ``tile`` sets or
    ``tile_bytes`` meet by bands of size (similar sets lie in one band or in neighbours), and each band in tiles.
    """
    strips = F.ceil(F.greatest(F.col("size") / tile, 8 * F.col("total") / tile_bytes)).cast("int")
    salted = held.select("key", strips.alias("strips"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    here = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")
    one = here.where("strips = 1").select(F.xxhash64("key").alias("block"), "node", "n", "asks", "found")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / similarity) + 1e-9).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("strips")).cast("int")
    others = F.sequence(F.lit(0), F.col("strips") - 1)
    many = here.where("strips > 1").withColumns({"band": band, "mine": mine})
    # a tile (found, asking) of a band; askers also look one band below
    finds = many.where("found").select("key", "node", "n", "band", F.col("mine").alias("i"), F.explode(others).alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("found"))
    asks = many.where("asks").withColumn("i", F.explode(others))
    asks = asks.select("key", "node", "n", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "i", F.col("mine").alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("found"))
    tiles = finds.union(asks).groupBy(F.xxhash64("key", "band", "i", "j").alias("block"), "node", "n").agg(F.max("asks").alias("asks"), F.max("found").alias("found"))
    return one.union(tiles)


def _blocks(sets: DataFrame, similarity: int, tile: int, tile_bytes: int) -> DataFrame:
    """(block, node, n, point, asks, found): the sets that have one of their rarest shingles in common.

    Two similar sets share one of as many of their rarest shingles as the one may lack of the other, and one.
    Of shingles with the same members one is kept.
    """

    def rare(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                nodes, keys, sizes = [], [], []
                part = batch.slice(lo, 256)
                for node, n, lonely, data in zip(*(part[c].to_pylist() for c in ("node", "n", "lonely", "shingles")), strict=True):
                    key = np.frombuffer(data, np.int64)[lonely : slack(n, similarity) + 1]
                    keys.append(key)
                    nodes.append(np.full(len(key), node))
                    sizes.append(np.full(len(key), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, sizes)], names=["key", "node", "n"])

    def place(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts = group_counts([np.frombuffer(x, np.uint64) for x in part["shingles"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(_packed(counts), pa.binary())], names=["node", "point"])

    rows = cut(sets.select("node", "n", "lonely", "shingles").mapInArrow(rare, "key long, node long, n long"))
    marks = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    held = rows.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size"), F.sum("n").alias("total"), *marks)
    held = held.where("first < last").groupBy("first", "last", "size", "x", "y").agg(F.min("key").alias("key"), F.first("total").alias("total"))
    both = rows.select("key", "node", "n", F.lit(True).alias("asks"), F.lit(True).alias("found"))
    points = sets.select("node", "shingles").mapInArrow(place, "node long, point binary")
    return cut(_tiled(both, held, similarity, tile, tile_bytes).join(points, "node"))


def _candidates(blocks: DataFrame, similarity: int, tasks: int) -> DataFrame:
    """(a, b, n_a, n_b): each asking set b with the first set of its block that the bound doesn't exclude."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in _by_block(group):
            node, n = g["node"].to_numpy(), g["n"].to_numpy()
            block = Block(_points(g["point"]), n, node, g["found"].to_numpy(), similarity)
            for q in np.flatnonzero(g["asks"]).tolist():
                near = block.near(q)
                if len(near):
                    out.append((node[near[0]], node[q], n[near[0]], n[q]))
        return pd.DataFrame(out, columns=["a", "b", "n_a", "n_b"]).astype("int64")

    return blocks.groupBy(_task(tasks)).applyInPandas(search, "a long, b long, n_a long, n_b long").distinct()


def _open(blocks: DataFrame, classes: DataFrame, similarity: int, tasks: int) -> DataFrame:
    """(key, node, n, asks, found): members with a partner of another class that the bound doesn't exclude.

    They are keyed by the first of them in their block, so that blocks with about the same members become one.
    """

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in _by_block(group):
            root = g["root"].to_numpy()
            if (root == root[0]).all():
                continue
            block = Block(_points(g["point"]), g["n"].to_numpy(), g["node"].to_numpy(), g["found"].to_numpy(), similarity)
            asks, found = np.zeros(len(g), bool), np.zeros(len(g), bool)
            for q in np.flatnonzero(g["asks"]).tolist():
                near = block.near(q)
                near = near[root[near] != root[q]]
                asks[q] = len(near) > 0
                found[near] = True
            left = g[["node", "n"]].assign(asks=asks, found=found)[asks | found]
            out.append(left.assign(key=left["node"].min()))
        columns = ["key", "node", "n", "asks", "found"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns).astype({c: bool if c in ("asks", "found") else "int64" for c in columns})

    known = blocks.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return known.groupBy(_task(tasks)).applyInPandas(search, "key long, node long, n long, asks boolean, found boolean")


def _linked(members: DataFrame, classes: DataFrame | None, sets: DataFrame, similarity: int, tile: int, tile_bytes: int) -> DataFrame:
    """(a, b, root_a, root_b): links that tie the classes of a key's members (key, node, n, asks, found), verified on the sets."""
    members = cut(members.groupBy("key", "node").agg(F.max("n").alias("n"), F.max("asks").alias("asks"), F.max("found").alias("found")))
    held = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    total = members.agg(F.sum("n")).first()[0] or 0

    def join(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g in _by_block(group):
            sets = [np.sort(np.frombuffer(x, np.uint64)) for x in g["shingles"]]
            node, root = g["node"].to_numpy(), g["root"].to_numpy()
            block = Block(group_counts(sets), g["n"].to_numpy(), node, g["found"].to_numpy(), similarity)
            out += [(node[a], node[b], root[a], root[b]) for a, b in tie(block, sets, np.flatnonzero(g["asks"]), root, similarity)]
        return pd.DataFrame(out, columns=["a", "b", "root_a", "root_b"]).astype("int64")

    tiled = _tiled(members, held, similarity, tile, tile_bytes)
    tiled = tiled.withColumn("root", F.col("node")) if classes is None else tiled.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = tiled.join(sets.select("node", "shingles"), "node")
    return whole.groupBy(_task(max(1, 8 * total // tile_bytes))).applyInPandas(join, "a long, b long, root_a long, root_b long")


def _roots(sets: DataFrame, similarity: int, tile: int, tile_bytes: int) -> DataFrame:
    """(node, root) of the sets that are linked with another."""
    blocks = _blocks(sets, similarity, tile, tile_bytes)
    tasks = max(1, blocks.count() // TASK_ROWS)
    # first every set against the first that may be similar: what a large group of near copies has in common is settled here
    pairs = cut(_candidates(blocks, similarity, tasks))
    askers = pairs.select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("n_b").alias("n"), F.lit(True).alias("asks"), F.lit(False).alias("found"))
    hubs = pairs.select(F.col("a").alias("key"), F.col("a").alias("node"), F.col("n_a").alias("n"), F.lit(False).alias("asks"), F.lit(True).alias("found"))
    stars = _linked(askers.union(hubs), None, sets, similarity, tile, tile_bytes)
    classes = cut(components(stars.select("a", "b")))
    # then all that may still tie different classes
    rest = _linked(_open(blocks, classes, similarity, tasks), classes, sets, similarity, tile, tile_bytes)
    joined = components(rest.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("c_node"), F.col("root").alias("c_root"))
    every = classes.join(joined, classes["root"] == joined["c_node"], "full")
    return every.select(F.coalesce("node", "c_node").alias("node"), F.coalesce("c_root", "root").alias("root"))


def _classed(docs: DataFrame, similarity: int, width: int, part_bytes: int, tile: int, tile_bytes: int) -> DataFrame:
    """(doc_id, k, uid, n, node, root, component): a row for each row; root names its component, component is the smallest k of it."""
    described = cut(describe(docs, width, similarity, ex.bucket_count(docs, part_bytes)))
    sets = cut(
        described.where(F.col("shingles").isNotNull())
        .groupBy("node", "check", "n")
        .agg(F.min("k").alias("least"), F.first("lonely").alias("lonely"), F.first("shingles").alias("shingles"))
    )
    roots = _roots(sets, similarity, tile, tile_bytes)
    classes = sets.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = classes.groupBy("root").agg(F.min("least").alias("component"))
    found = classes.join(component, "root").select("node", "root", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = described.select("doc_id", "k", "uid", "n", "node", F.col("shingles").isNotNull().alias("may"))
    tied = out.where("may").withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(found, ["node", "salt"], "left")
    columns = ["doc_id", "k", "uid", "n", "node"]
    every = tied.select(*columns, "root", "component").unionByName(out.where("not may").select(*columns, F.col("node").alias("root"), F.col("k").alias("component")))
    return every.withColumn("component", F.coalesce("component", "k"))


def similar_documents(docs: DataFrame, similarity: int = SIMILARITY, width: int = SHINGLE, part_bytes: int = PART_BYTES, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Components of the documents linked by 100 * intersection >= similarity * union of their shingle sets.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a set holds the different runs of ``width`` words, or
    the whole sequence of a document with fewer. Returned, a row for each row of ``docs``: doc_id, n_shingles,
    component_id (the smallest doc_id that links reach, its own included) and set_id (equal for equal sets).

    Null and empty texts and texts without a word: 0 shingles, linked with nothing. A null doc_id is the
    largest; rows that repeat are linked like any others. Other columns are ignored.
    """
    every = _classed(docs, similarity, width, part_bytes, tile, tile_bytes)
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") < ex.LAST, F.col("component")).alias("component_id"), F.col("node").alias("set_id"))


def one_of_each(docs: DataFrame, similarity: int = SIMILARITY, width: int = SHINGLE, part_bytes: int = PART_BYTES, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """The rows of ``docs`` without all but one document - the smallest - of each component, with all their columns.

    Documents without a word all stay. Of rows equal in id and text one stays, if they have words.
    """
    every = cut(_classed(docs, similarity, width, part_bytes, tile, tile_bytes).select("k", "uid", "n", "root", "component"))
    first = every.where("n > 0 and k = component").groupBy("root").agg(F.min(F.struct("k", "uid")).alias("row")).select("row.k", "row.uid")
    alone = every.where("n = 0").select("k", "uid").distinct()
    own_k, own_uid, each = ex.free(docs, "k", "uid", "each")
    kept = first.union(alone).select(F.col("k").alias(own_k), F.col("uid").alias(own_uid))
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(ex.LAST))
    uid = ex.uid_of(k, F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumns({own_k: k, own_uid: uid}).join(kept, [own_k, own_uid], "left_semi")
    if every.where("n > 0").groupBy("k", "uid").count().where("count > 1").limit(1).count():
        repeated = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
        rows = rows.withColumn(each, repeated).dropDuplicates([own_k, own_uid, each])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
