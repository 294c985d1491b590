"""Open reading frames in six frames.

A small Arrow helper finds the next stop of every start, from the sequence's end to its begin in
tiles, and carries each frame's next stop on; short genomes are scanned many at once. So nothing is shuffled,
and what a task holds besides the sequence is a tile's work and its starts. On request it adds the bases before a start and
the coding sequence, so that no genome is joined to its frames later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoflux.operators.ranges import numbered

STOPS = ("TAA", "TAG", "TGA")
STARTS = ("ATG", "GTG", "TTG")
TILE = 1 << 16
FRAMES = "genome_id string, length long, strand int, frame int, pos long, stop long, whole_end long"
#: Bases before a start that hold its binding motif.
UPSTREAM = 15
#: Between genomes that are scanned at once; its letters are in no codon.
GAP = b"NNNNN"
#: Rows that the helper yields at once.
ROWS = 2048

_CODE = np.full(256, 4, np.int16)
_CODE[np.frombuffer(b"TCAGtcag", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
_COMPLEMENT = np.arange(256, dtype=np.uint8)  # ambiguity codes stay: they are in no start and no stop
_COMPLEMENT[np.frombuffer(b"ATGCN", np.uint8)] = np.frombuffer(b"TACGN", np.uint8)


def _kinds(codons: tuple[str, ...]) -> np.ndarray:
    flags = np.zeros(125, bool)
    for c in codons:
        a, b, d = (_CODE[x] for x in c.encode())
        flags[a * 25 + b * 5 + d] = True
    return flags


def _next_stops(letters: np.ndarray, is_start: np.ndarray, is_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of start codons, ascending, and the end of the next stop codon in frame (-1 without one)."""
    n, none = len(letters) - 2, np.iinfo(np.int64).max
    carried = [none, none, none]
    places, stops = [], []
    for lo in range((max(n, 1) - 1) // TILE * TILE, -1, -TILE):
        code = _CODE[letters[lo : min(lo + TILE, n) + 2]]
        codon = code[:-2] * 25 + code[1:-1] * 5 + code[2:]
        for frame in range(3):
            at = np.arange((frame - lo) % 3, len(codon), 3)
            if not len(at):
                continue
            after = np.where(is_stop[codon[at]], lo + at + 3, none)
            after[-1] = min(after[-1], carried[frame])
            after = np.minimum.accumulate(after[::-1])[::-1]
            carried[frame] = after[0]
            begins = is_start[codon[at]]
            places.append(lo + at[begins])
            stops.append(after[begins])
    place, stop = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, stops))
    order = np.argsort(place, kind="stable")
    return place[order], np.where(stop == none, -1, stop)[order]


def _together(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and sequences in upper case of genomes that are scanned at once, a tile or so; a longer one comes alone. Those below a codon are left out."""
    chosen, raws, size = [], [], 0
    for n, seq in enumerate(batch["sequence"]):
        raw = (seq.as_py() or "").upper().encode()
        if len(raw) < 3:
            continue
        if chosen and size + len(raw) > TILE:
            yield batch["genome_id"].take(pa.array(chosen)), raws
            chosen, raws, size = [], [], 0
        chosen.append(n)
        raws.append(raw)
        size += len(raw)
    if chosen:
        yield batch["genome_id"].take(pa.array(chosen)), raws


def _next_stops_of_many(letters: np.ndarray, ends: np.ndarray, is_start: np.ndarray, is_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_next_stops`` over genomes with a gap around each, which end at ``ends``: no frame goes beyond its genome."""
    code = _CODE[letters]
    codon = code[:-2] * 25 + code[1:-1] * 5 + code[2:]
    event, over = is_stop[codon], np.zeros(len(codon), bool)
    for i in range(3):
        over[ends + i] = True
    n = -(-len(codon) // 3) * 3
    after = np.full(n, n)
    at = np.flatnonzero(event | over)
    after[at] = at
    after = np.minimum.accumulate(after.reshape(-1, 3)[::-1], axis=0)[::-1].reshape(-1)
    place = np.flatnonzero(is_start[codon])
    stop = after[place]
    return place, np.where(over[stop], -1, stop + 3)


def longest_inside(letters: np.ndarray, regions: list[tuple[int, int]], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each region the earliest ATG of each stop codon inside it and the stop's end, ``least`` bases and more.

    The strand is read once: each stop's earliest start is known for all regions, and only the first
    stop of a frame in a region, whose starts the region may cut off, is looked at again.
    """
    code = _CODE[letters]
    codon = code[:-2] * 25 + code[1:-1] * 5 + code[2:]
    by_frame = []
    for frame in range(3):
        at = np.arange(frame, len(codon), 3)
        starts, stops = at[_kinds(("ATG",))[codon[at]]], at[_kinds(STOPS)[codon[at]]]
        starts = np.r_[starts, len(letters)]
        by_frame.append((starts, stops, starts[np.searchsorted(starts, np.r_[0, stops[:-1] + 3])] if len(stops) else stops))
    for number, (a, b) in enumerate(regions):
        for starts, stops, earliest in by_frame:
            lo, hi = np.searchsorted(stops, a), np.searchsorted(stops, b - 3, "right")
            if lo < hi:
                first = earliest[lo:hi].copy()
                first[0] = starts[np.searchsorted(starts, a)]
                keep = stops[lo:hi] + 3 - first >= least
                if keep.any():
                    yield number, first[keep], stops[lo:hi][keep] + 3


def frames(genomes: DataFrame, starts: tuple[str, ...] = STARTS, least: int = 0, earliest: bool = False, partial: bool = False, context: bool = False) -> DataFrame:
    """Start codons of both strands with the next stop in frame, ``least`` bases and more.

    pos and stop count on the scanned strand, whole_end ends its frame's last codon. ``partial``: starts
    without a stop have a null one and reach to whole_end. ``earliest``: of the starts of a stop only the first.
    ``context`` adds upstream and sequence, in upper case. Null and short sequences have none.
    """
    is_start, is_stop = _kinds(starts), _kinds(STOPS)

    def rows(ids: pa.Array, letters: np.ndarray, first: np.ndarray, lengths: np.ndarray, strand: int, place: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.searchsorted(first, place, "right") - 1
        pos, size = place - first[own], lengths[own]
        whole = pos % 3 + (size - pos % 3) // 3 * 3
        keep = np.where(stop < 0, whole, stop - first[own]) - pos >= least
        if not partial:
            keep &= stop >= 0
        if earliest:
            one = np.zeros(len(pos), bool)
            one[np.unique(np.where(stop < 0, -1 - place, stop), return_index=True)[1]] = True
            keep &= one
        own, place, pos, size, whole, stop = (x[keep] for x in (own, place, pos, size, whole, stop))
        for lo in range(0, len(pos), ROWS):
            o, at, p, w, q = (x[lo : lo + ROWS] for x in (own, place, pos, whole, stop))
            begin, n = first[o], len(p)
            columns = [
                ids.take(pa.array(o)), pa.array(size[lo : lo + ROWS]), pa.array(np.full(n, strand, np.int32)),
                pa.array((p % 3).astype(np.int32)), pa.array(p), pa.array(q - begin, mask=q < 0), pa.array(w),
            ]
            if context:
                columns.append(pa.array([letters[x:y].tobytes().decode() for x, y in zip(np.maximum(at - UPSTREAM, begin).tolist(), at.tolist(), strict=True)], pa.string()))
                columns.append(pa.array([letters[x:y].tobytes().decode() for x, y in zip(at.tolist(), np.where(q < 0, begin + w, q).tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raws in _together(batch):
                lengths = np.array([len(x) for x in raws])
                if len(raws) == 1:
                    letters, first = np.frombuffer(raws[0], np.uint8), np.zeros(1, np.int64)
                else:
                    letters, first = np.frombuffer(GAP + GAP.join(raws) + GAP, np.uint8), len(GAP) + np.r_[0, np.cumsum(lengths[:-1] + len(GAP))]
                for strand in (1, -1):
                    if strand == -1:  # the last genome comes first
                        first = (len(letters) - first - lengths)[::-1]
                        letters, lengths, ids = _COMPLEMENT[letters][::-1], lengths[::-1], ids.take(pa.array(np.arange(len(ids))[::-1]))
                    found = _next_stops(letters, is_start, is_stop) if len(raws) == 1 else _next_stops_of_many(letters, first + lengths, is_start, is_stop)
                    yield from rows(ids, letters, first, lengths, strand, *found)

    schema = FRAMES + (", upstream string, sequence string" if context else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return genomes.select("genome_id", "sequence").mapInArrow(scan, schema)


def _on_forward(df: DataFrame) -> DataFrame:
    forward = F.col("strand") == 1
    return df.withColumns(
        {"start": F.when(forward, F.col("pos")).otherwise(F.col("length") - F.col("stop")), "end": F.when(forward, F.col("stop")).otherwise(F.col("length") - F.col("pos"))}
    )


COLUMNS = ("genome_id", "strand", "frame", "pos", "stop", "start", "end")


def six_frame_orfs(genomes: DataFrame, min_length: int = 100, include_partial: bool = False, starts: tuple[str, ...] = STARTS) -> DataFrame:
    """Every start codon with the next stop in frame, ``min_length`` bases and more; one row a start.

    ``pos`` and ``stop`` count on the scanned strand, ``start`` and ``end`` on the forward strand.
    ``include_partial``: starts without a stop reach to the last whole codon.
    """
    found = frames(genomes, starts, min_length, partial=include_partial)
    if include_partial:
        found = found.withColumns({"partial": F.col("stop").isNull(), "stop": F.coalesce("stop", "whole_end")})
    return _on_forward(found).select(*COLUMNS, *(["partial"] if include_partial else []))


def orfs_with_sequence(genomes: DataFrame, min_length: int = 100) -> DataFrame:
    """``six_frame_orfs`` with the coding ``sequence`` of each."""
    return _on_forward(frames(genomes, least=min_length, context=True)).select(*COLUMNS, "sequence")


def longest_orf_per_stop(genomes: DataFrame, min_aa: int = 20, context: bool = False) -> DataFrame:
    """The earliest ATG of each stop codon; the length test sees that start alone."""
    found = frames(genomes, ("ATG",), 3 * min_aa + 3, earliest=True, context=context)
    return _on_forward(found).select(*COLUMNS, *(["upstream", "sequence"] if context else []))


def all_starts_orfs(genomes: DataFrame, min_aa: int = 50, context: bool = False) -> DataFrame:
    """Every start of each stop codon with ``min_aa`` codons before the stop."""
    found = frames(genomes, least=3 * min_aa + 3, context=context)
    return _on_forward(found).select(*COLUMNS, *(["upstream", "sequence"] if context else []))


def orf_sequence(sequence: Column, start: Column, end: Column, strand: Column) -> Column:
    """Coding strand between forward coordinates."""
    from annoflux.functions.sequence import reverse_complement

    part = F.substring(sequence, (start + 1).cast("int"), (end - start).cast("int"))
    return F.when(strand == 1, part).otherwise(reverse_complement(part))


def gene_id() -> Column:
    """The id of a predicted gene, of its genome and place."""
    return F.sha2(F.concat_ws("|", "genome_id", "start", "end", "strand", F.lit("orf_prediction")), 256)


def orfs_to_genes(orfs: DataFrame, prefix: str = "ORF") -> DataFrame:
    """Genes numbered by position within their genome; a genome's genes may lie in any number of tasks."""
    return numbered(orfs, ("genome_id",), [F.col("start"), F.col("end"), F.desc("strand"), F.col("frame")], "rank").select(
        "genome_id",
        gene_id().alias("gene_id"),
        F.format_string(f"{prefix}_%04d", "rank").alias("locus_tag"),
        "start",
        "end",
        "strand",
        F.lit("hypothetical protein").alias("product"),
        F.lit("orf_prediction").alias("source"),
    )
