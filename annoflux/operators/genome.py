"""A genome's whole way: discovery, evidence layers, hypotheses, interpretation, function, novelty, summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoflux.functions import sequence as sq
from annoflux.operators import discovery as dc
from annoflux.operators import evidence as ev
from annoflux.operators import hypotheses as hy
from annoflux.operators import interpretation as ip
from annoflux.operators import motifs as mt
from annoflux.operators.lineage import cut

NCRNA = ("tRNA_prediction", "rRNA_prediction")


@dataclass
class Interpretation:
    """Tables of ``interpret_genomes``; ``results`` has a row for every gene."""

    genes: DataFrame
    evidence: DataFrame
    hypotheses: DataFrame
    results: DataFrame
    novel: DataFrame
    summary: DataFrame


def interpret_genomes(
    genomes: DataFrame,
    genes: DataFrame,
    patterns: DataFrame,
    layers: Callable[[DataFrame], list[DataFrame]] | None = None,
    pfam: DataFrame | None = None,
    phage: bool = False,
    trna: DataFrame | None = None,
    rrna: DataFrame | None = None,
) -> Interpretation:
    """Interprets every gene of ``genomes`` (genome_id, sequence).

    ``genes`` has genome_id, start, end, strand and, as far as annotated, product_name, gb_function and gb_note.
    Discovery adds frames, rescued and nested genes and the finders' RNAs. Genes get the annotation and motif
    layers and those that ``layers`` makes of the gene table (gene_id, protein_seq, ...); genes with sure
    annotation are not scanned for motifs. ``pfam`` maps pfam_id to cog and go_terms.

    A genome without a gene has no row in the summary; genes without evidence are dark. Repeated spans are one gene.
    """
    notes = ["product_name", "gb_function", "gb_note"]
    genes = genes.withColumns({c: F.lit(None).cast("string") for c in notes if c not in genes.columns})
    span = ["genome_id", "start", "end", "strand"]
    known = genes.groupBy(*span).agg(*[F.min(c).alias(c) for c in notes])
    spans = dc.gene_discovery(genomes, known.withColumn("source", F.lit("annotation")), phage, trna, rrna).groupBy(*span).agg(F.min("source").alias("source"))
    sequenced = dc.with_sequences(spans, genomes)
    coding = ~F.col("source").isin(*NCRNA)
    named = sequenced.select(*span, "source", "sequence", F.when(coding, sq.translate_dna(F.col("sequence"))).alias("protein_seq"))
    table = cut(
        named.join(known, span, "left").select(
            F.sha2(F.concat_ws("|", *span), 256).alias("gene_id"), *span, "source", "sequence", "protein_seq", *notes,
            F.when(F.col("source") == "tRNA_prediction", "tRNA").when(F.col("source") == "rRNA_prediction", "rRNA").alias("product"),
        )
    )
    coding_genes = table.where(coding)
    noted = ev.annotation_evidence(coding_genes)
    scanned = mt.motif_scan(mt.scan_gate(coding_genes, noted), patterns, sequence="scanned")
    evidence = cut(ev.collect_evidence(noted, ev.motif_evidence(scanned), *(layers(coding_genes) if layers else [])))
    ranked = cut(ip.rank_hypotheses(ip.score_confidence(hy.generate_hypotheses(evidence, deal=False), evidence)))
    told = ip.interpret(ranked)
    rna = ip.ncrna_interpretation(table)
    told = told.unionByName(rna, allowMissingColumns=True)
    if pfam is None:
        pfam = table.sparkSession.createDataFrame([], "pfam_id string, cog string, go_terms array<string>")
    told = ip.annotate_function(told, ip.first_pfam_id(evidence), pfam).withColumn("normalized_product", ip.normalize_product(F.col("hypothesis")))
    counts = evidence.groupBy("gene_id").agg(F.count("*").alias("evidence_count"))
    length = ip.novelty_protein_length(F.col("protein_seq"), F.col("start"), F.col("end"))
    results = cut(table.select("gene_id", *span, "source", length.alias("protein_length")).join(told, "gene_id", "left").join(counts, "gene_id", "left").na.fill(0, ["evidence_count"]))
    novel = ip.suggested_experiments(ip.novelty(results, exclude_ncrna=True))
    return Interpretation(table, evidence, ranked, results, novel, ip.interpretation_summary(results))
