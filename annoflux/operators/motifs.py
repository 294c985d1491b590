"""Sequence motifs: PROSITE patterns, the scan, and summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annoflux.operators.automaton import Automaton

SCHEMA = "ord int, name string, pattern string, description string, category string, weight double"
MIN_SCORE = 0.3
MOST_PATTERNS = 20_000
#: Letters that a task scans at once.
CHUNK = 1 << 18
# The built-in motifs.
BUILTIN = [
    (0, "helix_turn_helix", "[LIVMFYWC][ASGTNQ].{2}[LIVMFYWC].{4,5}[LIVMFYWC].{2}G[LIVMFYWC].{5,6}[LIVMFYWC]{2}", "Helix-turn-helix DNA binding motif", "domain", 0.7),
    (1, "zinc_finger_c2h2", "C.{2,4}C.{3}[LIVMFYWC].{8}H.{3,5}H", "C2H2 zinc finger domain", "domain", 0.85),
    (2, "serine_protease", "[LIVMFYC][LIVMFYWSTAN].{1,2}G[DENSALKR]S[GSC][GSTAPILVMC]", "Serine protease active site", "active_site", 0.8),
    (3, "atp_binding_p_loop", "[AG].{4}GK[ST]", "ATP/GTP binding P-loop (Walker A motif)", "domain", 0.9),
    (4, "walker_b", "[LIVMFY]{4}D[DEST][LIVMFYAG]{2}[GSTA]", "Walker B motif (ATPase)", "domain", 0.8),
    (5, "signal_peptide", "^M[LIVA]{1,3}[^P]{5,15}[AVILM][^P]{0,5}[ASG][^P]{0,3}[ASG]", "N-terminal signal peptide", "signal", 0.4),
    (6, "transmembrane", "[LIVMFYW]{5,}[AGSTC][LIVMFYW]{10,}", "Transmembrane helix", "topology", 0.4),
    (7, "gram_negative_lipobox", "[LVI][ASTVI][GAS]C", "Gram-negative lipoprotein signal", "signal", 0.7),
]


def builtin_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILTIN, SCHEMA)


def prosite_to_regex(pattern: Column) -> Column:
    """PROSITE syntax as a regular expression."""
    steps = (
        (r"([\]}])\([0-9,]*\)", "$1"),  # counts after a class don't count
        (r"[^A-Zx\[\]{}()<>,0-9]", ""),  # hyphens, the final dot and anything unknown
        (r"\{([A-Z]+)\}", "[^$1]"),
        (r"\((\d+(?:,\d+)?)\)", "{$1}"),
        ("x", "."),
        ("<", "^"),
        (">", r"\$"),
    )
    for old, new in steps:
        pattern = F.regexp_replace(pattern, old, new)
    return pattern


def _mentions(text: Column, *words: str) -> Column:
    lowered = F.lower(text)
    found = lowered.contains(words[0])
    for w in words[1:]:
        found |= lowered.contains(w)
    return found


def prosite_weight(description: Column, skip: Column) -> Column:
    base = F.when(skip, 0.6).otherwise(0.85)
    return F.when(_mentions(description, "phosphorylation", "kinase"), 0.3).when(_mentions(description, "myristyl", "glycosylation", "amidation"), 0.4).otherwise(base)


def prosite_category(description: Column) -> Column:
    return (
        F.when(_mentions(description, "phosphorylation", "kinase", "glycosylation", "glycan", "myristyl", "amidation"), "modification")
        .when(_mentions(description, "zinc", "metal", "iron", "copper", "dna", "rna", "nucleic"), "domain")
        .when(_mentions(description, "membrane", "transmembrane"), "topology")
        .when(_mentions(description, "signal", "targeting"), "signal")
        .when(_mentions(description, "active site", "catalytic"), "active_site")
        .otherwise("domain")
    )


def prosite_patterns(entries: DataFrame) -> DataFrame:
    """Scan patterns from PROSITE entries (id, description, pattern, skip)."""
    skip = F.coalesce("skip", F.lit(False))
    return entries.select(
        F.monotonically_increasing_id().cast("int").alias("ord"),
        F.lower("id").alias("name"),
        prosite_to_regex(F.col("pattern")).alias("pattern"),
        "description",
        prosite_category(F.col("description")).alias("category"),
        prosite_weight(F.col("description"), skip).alias("weight"),
    )


def prosite_lookup(entries: DataFrame, entry_id: str | None = None, accession: str | None = None, description: str | None = None) -> DataFrame:
    """Entries (id, accession, description, ...) with that id and accession, in any case, whose description contains the text, in any case."""
    for column, value in (("id", entry_id), ("accession", accession)):
        if value is not None:
            entries = entries.where(F.lower(column) == value.lower())
    return entries if description is None else entries.where(F.lower("description").contains(description.lower()))


def prosite_summary(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("category").agg(F.count("*").alias("n"))


def motif_catalogue(patterns: DataFrame) -> DataFrame:
    """Names by category."""
    return patterns.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def scan_categories(patterns: DataFrame, *categories: str) -> DataFrame:
    return patterns.where(F.col("category").isin(*categories))


def motif_scan(sequences: DataFrame, patterns: DataFrame, key: str = "gene_id", sequence: str = "protein_seq", min_score: float = MIN_SCORE, once: bool = False) -> DataFrame:
    """Leftmost non-overlapping matches of every pattern: key, ord, name, description, category, start, end, matched, score.

    The patterns (the whole of PROSITE has some 1,800; at most ``MOST_PATTERNS``) go to the tasks, which build one
    automaton of them: it tells which patterns can match which sequences, and only those are run. Sequences that repeat within
    ``CHUNK`` letters are scanned once. ``once``: those that repeat anywhere are, at the cost of two shuffles.
    Null sequences match nothing; a score of more than 1 counts as 1.
    """
    if once:
        named = sequences.select(F.col(key), F.upper(sequence).alias("_text")).where("_text <> ''").withColumn("_of", F.sha2("_text", 256))
        found = motif_scan(named.groupBy("_of").agg(F.any_value("_text").alias("_text")), patterns, "_of", "_text", min_score)
        return named.drop("_text").join(found, "_of").drop("_of")
    table = patterns.select("ord", "name", "pattern", "description", "category", "weight").limit(MOST_PATTERNS + 1).collect()
    if len(table) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    rules = [(tuple(r), len(re.sub(r"[\[\]]", "", r.pattern)) // 2) for r in table]
    schema = f"`{key}` {sequences.schema[key].dataType.simpleString()}, ord int, name string, description string, category string, start int, end int, matched string, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(re.compile(pattern).finditer, expected, weight, (ord_, name, description, category)) for (ord_, name, pattern, description, category, weight), expected in rules]
        machine = Automaton([rule[2] for rule, _ in rules])
        types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
        for batch in batches:
            sizes = np.cumsum(np.nan_to_num(pc.utf8_length(batch["sequence"]).to_numpy(zero_copy_only=False)))
            edges = [0, *(np.searchsorted(sizes, np.arange(CHUNK, sizes[-1], CHUNK)) + 1 if len(sizes) else []), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                places: dict[str, list[int]] = {}
                for i, text in enumerate(part["sequence"].to_pylist()):
                    if text:
                        places.setdefault(text, []).append(i)
                texts = list(places)
                rows, out = [], []
                for of, which in zip(*(x.tolist() for x in machine.candidates(texts)), strict=True):
                    find, expected, weight, own = compiled[which]
                    for m in find(texts[of]):
                        near = expected > 0 and 0.8 <= (m.end() - m.start()) / expected <= 1.2
                        score = weight * 1.1 if near else weight
                        if score >= min_score:
                            rows += places[texts[of]]
                            out += [(*own, m.start(), m.end(), m.group(), min(score, 1.0))] * len(places[texts[of]])
                columns = list(zip(*out, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays(
                    [part["key"].take(pa.array(rows, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                    names=[key, "ord", "name", "description", "category", "start", "end", "matched", "score"],
                )

    return sequences.select(F.col(key).alias("key"), F.upper(sequence).alias("sequence")).mapInArrow(scan, schema)


def motif_report(genes: DataFrame, matches: DataFrame) -> DataFrame:
    """Per gene the number of matches and the first motif by position; ``-`` without one."""
    counted = matches.groupBy("gene_id").agg(F.count("*").alias("n_motifs"), F.min_by("name", F.struct("start", "ord")).alias("first_motif"))
    joined = genes.select("gene_id").join(counted, "gene_id", "left")
    return joined.select("gene_id", F.coalesce("n_motifs", F.lit(0)).alias("n_motifs"), F.coalesce("first_motif", F.lit("-")).alias("first_motif"))


def scan_gate(genes: DataFrame, evidence: DataFrame, sure: float = 0.8) -> DataFrame:
    """Genes without annotation evidence of ``sure`` or more, with what is scanned: the protein, else the nucleotides."""
    settled = evidence.where((F.col("evidence_type") == "sequence_feature") & (F.col("confidence") >= sure)).select("gene_id").distinct()
    return genes.join(settled, "gene_id", "left_anti").withColumn("scanned", F.coalesce("protein_seq", "sequence"))
