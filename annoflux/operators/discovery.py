"""Gene discovery: when to search, what to fill in, rescue, nested genes, non-coding RNA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from annoflux.functions import sequence as sq
from annoflux.operators import intervals as iv
from annoflux.operators import orfs
from annoflux.operators.lineage import cut

MIN_GENOME = 5.0
MIN_DENSITY = 0.3
RESCUE_SCORE = 0.010
NESTED_SCORE = 0.012
NESTED_SD = 0.7


def with_sequences(genes: DataFrame, genomes: DataFrame) -> DataFrame:
    """Adds the coding ``sequence`` of each gene, in upper case.

    A genome meets its genes in one group and travels once, whatever their number. Spans beyond its ends are cut.
    """
    complement = str.maketrans("ATGC", "TACG")
    out = StructType([*genes.schema.fields, StructField("sequence", StringType())])

    def slices(genes: pa.Table, genome: pa.Table) -> pa.Table:
        whole = (genome["sequence"][0].as_py() or "").upper() if genome.num_rows else ""
        found = []
        for start, end, strand in zip(*(genes[c].to_pylist() for c in ("start", "end", "strand")), strict=True):
            part = whole[max(start, 0) : end]
            found.append(part if strand == 1 else part.translate(complement)[::-1])
        return pa.Table.from_arrays([*genes.columns, pa.array(found, pa.string())], names=out.names)

    one = genomes.select("genome_id", "sequence").groupBy("genome_id")
    return genes.groupBy("genome_id").cogroup(one).applyInArrow(slices, out)


_BASES = np.full(256, 4, np.int64)
_BASES[np.frombuffer(b"TCAGtcag", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]
_CODONS = np.array([a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"])
_PLACE = {codon: n for n, codon in enumerate(_CODONS.tolist())}


def _codons_of(sequences: pa.Array, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and number (-1 with other letters than A, C, G, T) of each whole codon of all sequences; rows ``back`` are reversed and complemented before."""
    raws = [(x or "").encode() for x in sequences.to_pylist()]
    base, size = _BASES[np.frombuffer(b"".join(raws), np.uint8)], np.array([len(x) for x in raws], np.int64)
    first, count = np.cumsum(size) - size, size // 3
    own = np.repeat(np.arange(len(raws)), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    back = back[own]
    at, step = np.where(back, first[own] + size[own] - 1 - 3 * nth, first[own] + 3 * nth), np.where(back, -1, 1)
    letters = [base[at + i * step] for i in range(3)]
    a, b, c = (np.where(back & (x < 4), x ^ 2, x) for x in letters)
    return own, np.where((a < 4) & (b < 4) & (c < 4), a * 16 + b * 4 + c, -1)


def codon_usage(genes: DataFrame, orientation: str = "reference") -> DataFrame:
    """(genome_id, codon, frequency) over gene sequences; codons of A, C, G, T only.

    ``reference`` orientation complements reverse-strand sequences once more, though they are coding
    strands already; ``coding`` takes them as they are. The genes of a batch are counted at once, into 64 numbers a genome:
    no codon becomes a row, and at most 64 rows of a genome and batch are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["genome_id"].dictionary_encode()
            strand = batch["strand"].to_numpy(zero_copy_only=False)
            own, codon = _codons_of(batch["sequence"], strand == -1 if orientation == "reference" else np.zeros(len(strand), bool))
            known = codon >= 0
            n = np.bincount(ids.indices.to_numpy()[own[known]] * 64 + codon[known], minlength=64 * len(ids.dictionary))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(at // 64)), pa.array(_CODONS[at % 64].tolist(), pa.string()), pa.array(n[at])], names=["genome_id", "codon", "n"])

    kind = StructType([genes.schema["genome_id"], StructField("codon", StringType()), StructField("n", LongType())])
    counts = genes.select("genome_id", "strand", "sequence").mapInArrow(count, kind).groupBy("genome_id", "codon").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("genome_id"))  # 64 rows a genome at most
    return counts.select("genome_id", "codon", (F.col("n") / total).alias("frequency"))


def codon_score(candidates: DataFrame, usage: DataFrame) -> DataFrame:
    """Adds codon_score: mean frequency of the codons of ``sequence``, the stop included, unknown ones 0."""
    table = usage.groupBy("genome_id").agg(F.collect_list("codon").alias("_codons"), F.collect_list("frequency").alias("_frequencies"))  # 64 entries
    joined = candidates.join(table, "genome_id", "left")
    out = StructType([*candidates.schema.fields, StructField("codon_score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a task's rows of a genome have equal tables: each is read once
            ids = batch["genome_id"].dictionary_encode()
            rows = ids.indices.to_numpy()
            frequency = np.zeros((len(ids.dictionary), 65))
            for n, row in zip(*np.unique(rows, return_index=True), strict=True):
                for codon, value in zip(batch["_codons"][int(row)].as_py() or (), batch["_frequencies"][int(row)].as_py() or (), strict=True):
                    frequency[n, _PLACE.get(codon, 64)] = value
            frequency[:, 64] = 0
            own, codon = _codons_of(batch["sequence"], np.zeros(batch.num_rows, bool))
            count = np.bincount(own, minlength=batch.num_rows)
            total = np.bincount(own, frequency[rows[own], codon], batch.num_rows)  # codon -1: the last column
            mean = np.where(count > 0, total / np.maximum(count, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in out.names[:-1]], pa.array(mean)], names=out.names)

    return joined.mapInArrow(score, out)


def needs_orfs(genomes: DataFrame, genes: DataFrame) -> DataFrame:
    """(genome_id, n_genes, needs): no genes, or 5 kb and fewer than 0.3 genes a kb."""
    counts = genes.groupBy("genome_id").agg(F.count("*").alias("n_genes"))
    kb = F.length("sequence") / 1000.0
    joined = genomes.join(counts, "genome_id", "left").withColumn("n_genes", F.coalesce("n_genes", F.lit(0)))
    return joined.select("genome_id", "n_genes", ((F.col("n_genes") == 0) | ((kb >= MIN_GENOME) & (F.col("n_genes") / kb < MIN_DENSITY))).alias("needs"))


def fill_orfs(orf_genes: DataFrame, genes: DataFrame) -> DataFrame:
    """Predicted genes that overlap no annotated one."""
    return iv.without_overlap(orf_genes, genes)


def rescue_candidates(genomes: DataFrame, min_aa: int = 20) -> DataFrame:
    """Longest ATG frames with their number of binding motifs upstream."""
    found = orfs.longest_orf_per_stop(genomes, min_aa, context=True)
    # upstream ends at the start codon: motifs stand in its bases from 14 to 4 before the end
    return found.withColumn("rbs", sq.rbs_count(F.col("upstream"), F.length("upstream")))


def short_orf_rescue(genomes: DataFrame, genes: DataFrame, usage: DataFrame, min_aa: int = 20, min_score: float = RESCUE_SCORE) -> DataFrame:
    """Short frames not half covered by a gene, with a binding motif and the genome's codon usage."""
    gated = cut(rescue_candidates(genomes, min_aa).where("rbs > 0"))
    free = iv.covered_by(gated, genes, keep=False)
    scored = codon_score(free, usage).where(F.col("codon_score") >= min_score)
    return scored.dropDuplicates(["genome_id", "start", "end", "strand"])


def rescue_nested_scan(genomes: DataFrame, hosts: DataFrame, min_aa: int = 20) -> DataFrame:
    """The same scan inside host genes, the host itself aside; motifs are looked for inside the host only.

    A genome meets its hosts in one group and travels once. Each strand is read once for all hosts. Hosts that repeat count once;
    parts beyond the genome's ends are cut. Ids may hold any character.
    """
    wide = hosts.where(F.col("end") - F.col("start") >= 3 * min_aa + 6).select("genome_id", F.col("start").cast("long").alias("h_start"), F.col("end").cast("long").alias("h_end"))
    kind = StructType([genomes.schema["genome_id"], *[StructField(n, LongType()) for n in ("start", "end", "strand", "h_start", "h_end")], StructField("upstream", StringType())])
    columns = kind.names

    def sweep(genome: pa.Table, hosts: pa.Table) -> pa.Table:
        spans = sorted(set(zip(hosts["h_start"].to_pylist(), hosts["h_end"].to_pylist(), strict=True)))
        found: set[tuple] = set()
        for seq in set(genome["sequence"].to_pylist()) - {None}:
            raw = np.frombuffer(seq.upper().encode(), np.uint8)
            inside = [(max(a, 0), min(b, len(raw))) for a, b in spans]
            for strand, letters in ((1, raw), (-1, orfs._COMPLEMENT[raw][::-1])) if len(raw) > 2 else ():
                regions = inside if strand == 1 else [(len(raw) - b, len(raw) - a) for a, b in inside]
                for number, first, stop in orfs.longest_inside(letters, regions, 3 * min_aa + 3):
                    for p, q in zip(first.tolist(), stop.tolist(), strict=True):
                        start, end = (p, q) if strand == 1 else (len(raw) - q, len(raw) - p)
                        if (start, end) != spans[number]:
                            found.add((start, end, strand, *spans[number], letters[max(p - orfs.UPSTREAM, regions[number][0]) : p].tobytes().decode()))
        rows = list(zip(*sorted(found), strict=True)) or [()] * 6
        ids = genome["genome_id"] if genome.num_rows else hosts["genome_id"]
        types = [pa.int64()] * 5 + [pa.string()]
        return pa.Table.from_arrays([ids.take(pa.array([0] * len(rows[0]), pa.int64())), *[pa.array(r, t) for r, t in zip(rows, types, strict=True)]], names=columns)

    one = genomes.select("genome_id", "sequence").groupBy("genome_id")
    found = one.cogroup(wide.groupBy("genome_id")).applyInArrow(sweep, kind)
    rbs = sq.rbs_count(F.col("upstream"), F.length("upstream"))
    return found.select("genome_id", "start", "end", F.col("strand").cast("int").alias("strand"), "h_start", "h_end", rbs.alias("rbs")).where("rbs > 0")


def nested_candidates(genomes: DataFrame, min_aa: int = 50) -> DataFrame:
    """All-start frames with the weighted score of their binding motif."""
    found = orfs.all_starts_orfs(genomes, min_aa, context=True)
    return found.withColumn("sd", sq.weighted_sd_score(F.col("upstream"), F.length("upstream")))


def nested_orfs(genomes: DataFrame, parents: DataFrame, usage: DataFrame, min_aa: int = 50, min_sd: float = NESTED_SD, min_score: float = NESTED_SCORE) -> DataFrame:
    """Frames inside or across parents: strong motif first, then the interval and codon tests."""
    strong = cut(nested_candidates(genomes, min_aa).where(F.col("sd") >= min_sd))  # read by each interval test
    inside = iv.near_duplicate(iv.overlaps_parent(strong, parents), parents)
    fresh = inside.join(parents.select("genome_id", "start", "end", "strand").distinct(), ["genome_id", "start", "end", "strand"], "left_anti")
    return codon_score(fresh, usage).where(F.col("codon_score") >= min_score).dropDuplicates(["genome_id", "start", "end", "strand"])


def add_ncrna(genes: DataFrame, trna: DataFrame, rrna: DataFrame) -> DataFrame:
    """Genes, then tRNAs that overlap none of them, then rRNAs that overlap neither."""
    columns = ["genome_id", "start", "end", "strand", "source"]
    genes, trna, rrna = (x.select(*columns) for x in (genes, trna, rrna))
    with_trna = genes.unionByName(iv.without_overlap(trna, genes))
    return with_trna.unionByName(iv.without_overlap(rrna, with_trna))


def gene_discovery(genomes: DataFrame, genes: DataFrame, phage: bool = True, trna: DataFrame | None = None, rrna: DataFrame | None = None) -> DataFrame:
    """Annotated genes, filled ORFs, rescued and, for phages, nested genes, then non-coding RNAs: one row a span with its source.

    ``trna`` and ``rrna`` are the finders' frames (genome_id, start, end, strand); None where a finder didn't run.
    """
    columns = ["genome_id", "start", "end", "strand", "source"]
    known = cut(genes.select(*columns))
    wanting = genomes.join(needs_orfs(genomes, known).where("needs"), "genome_id", "left_semi")
    filled = fill_orfs(orfs.six_frame_orfs(wanting).withColumn("source", F.lit("orf_prediction")).select(*columns), known)
    now = cut(known.unionByName(filled))
    usage = codon_usage(with_sequences(now, genomes))
    rescued = short_orf_rescue(genomes, now, usage).withColumn("source", F.lit("orf_rescue")).select(*columns)
    now = cut(now.unionByName(rescued))
    if phage:
        nested = nested_orfs(genomes, now, codon_usage(with_sequences(now, genomes))).withColumn("source", F.lit("nested_orf")).select(*columns)
        now = cut(now.unionByName(nested))
    for found, source in ((trna, "tRNA_prediction"), (rrna, "rRNA_prediction")):
        if found is not None:
            own = cut(found.withColumn("source", F.lit(source)).select(*columns))
            now = now.unionByName(cut(iv.without_overlap(own, now)))
    return now
