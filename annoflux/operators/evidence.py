"""Evidence rows from annotations, motif matches and hit tables, and their lookups."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoflux.functions.sequence import is_uninformative
from annoflux.operators.lineage import cut

COLUMNS = ("gene_id", "layer", "layer_seq", "evidence_type", "description", "confidence", "source", "motif_name", "domain_name", "accession", "tool_name")
#: Layers in their fixed order.
LAYERS = ("annotation", "motif", "uniprot", "interpro", "plugin")


def _row(df: DataFrame, layer: str, kind: str, description: Column, confidence: Column, order: Column, tool: str, **extra: Column) -> DataFrame:
    text = F.lit(None).cast("string")
    return df.select(
        "gene_id",
        F.lit(LAYERS.index(layer)).alias("layer"),
        order.cast("long").alias("layer_seq"),
        F.lit(kind).alias("evidence_type"),
        description.alias("description"),
        confidence.cast("double").alias("confidence"),
        extra.get("source", text).alias("source"),
        extra.get("motif_name", text).alias("motif_name"),
        extra.get("domain_name", text).alias("domain_name"),
        extra.get("accession", text).alias("accession"),
        F.lit(tool).alias("tool_name"),
    )


def annotation_evidence(genes: DataFrame) -> DataFrame:
    """Product (0.85), function (0.80) and note (0.60) of each gene, if they say anything.

    Reads gene_id, product_name, gb_function, gb_note; a product counts with a protein (protein_seq) only.
    """
    product, function, note = F.trim("product_name"), F.col("gb_function"), F.col("gb_note")
    wanted = F.array(
        F.struct(F.lit(0).alias("n"), product.alias("text"), F.lit(0.85).alias("c"), F.lit("genbank_product").alias("s"), (F.col("protein_seq").isNotNull() & ~is_uninformative(product) & (F.length(product) > 3)).alias("ok")),
        F.struct(F.lit(1).alias("n"), F.trim(function).alias("text"), F.lit(0.80).alias("c"), F.lit("genbank_function").alias("s"), ((function != "") & ~is_uninformative(function)).alias("ok")),
        F.struct(F.lit(2).alias("n"), F.trim(note).alias("text"), F.lit(0.60).alias("c"), F.lit("genbank_note").alias("s"), (F.length(note) > 5).alias("ok")),
    )
    each = genes.select("gene_id", F.explode(wanted).alias("e")).where("e.ok")
    return _row(each, "annotation", "sequence_feature", F.col("e.text"), F.col("e.c"), F.col("e.n"), "genbank_parser", source=F.col("e.s"))


def motif_evidence(matches: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Motif match: "), F.col("description"), F.lit(" at positions "), F.col("start"), F.lit("-"), F.col("end"))
    order = F.col("start") * 10_000 + F.col("ord")
    return _row(matches, "motif", "motif_match", text, F.col("score"), order, "motif_scanner", motif_name=F.col("name"))


def blast_evidence(hits: DataFrame) -> DataFrame:
    """Significant hits, confidence identity/100 up to 0.99."""
    text = F.concat(F.format_string("%d%%", F.col("identity_percent").cast("int")), F.lit(" identity to "), F.substring("title", 1, 80))
    good = hits.where(F.col("evalue") < 1e-5)
    return _row(good, "plugin", "blast_homology", text, F.least(F.col("identity_percent") / 100, F.lit(0.99)), F.col("hit_rank"), "blastp", accession=F.col("hit_id"))


def local_hit_evidence(hits: DataFrame, tool: str = "diamond", most: int = 10) -> DataFrame:
    """At most ``most`` hits a gene, by rank, of 30 residues and evalue 1e-5."""
    good = hits.where((F.col("align_len") >= 30) & (F.col("evalue") <= 1e-5))
    rank = F.row_number().over(Window.partitionBy("gene_id").orderBy("hit_rank", "hit_id", "align_len", "title"))
    kept = good.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return _row(kept, "plugin", "blast_homology", F.coalesce("title", "hit_id"), F.least(F.col("identity_percent") / 100, F.lit(1.0)), F.col("_rank"), tool, accession=F.col("hit_id"))


def uniprot_evidence(hits: DataFrame) -> DataFrame:
    """0.70; 0.85 with a function; 0.90 if the keywords hold Reviewed."""
    has = F.coalesce(F.col("function_text"), F.lit("")) != ""
    confidence = F.when(F.array_contains("keywords", "Reviewed"), 0.90).when(has, 0.85).otherwise(0.70)
    text = F.concat(F.lit("UniProt match: "), F.col("protein_name"), F.when(has, F.concat(F.lit(" - "), F.substring("function_text", 1, 100))).otherwise(""))
    return _row(hits, "uniprot", "blast_homology", text, confidence, F.col("hit_rank"), "uniprot", accession=F.col("accession"))


def domain_confidence(evalue: Column) -> Column:
    ladder = ((1e-20, 0.95), (1e-10, 0.90), (1e-5, 0.80), (1e-3, 0.70), (0.01, 0.60))
    out = F.when(evalue < ladder[0][0], ladder[0][1])
    for bound, value in ladder[1:]:
        out = out.when(evalue < bound, value)
    return out.otherwise(0.45)


def domain_evidence(domains: DataFrame) -> DataFrame:
    good = domains.where(F.col("evalue") < 0.01)
    return _row(good, "interpro", "domain_hit", F.col("description"), domain_confidence(F.col("evalue")), F.col("hit_rank"), "interpro", domain_name=F.col("domain_name"), accession=F.col("accession"))


def hmm_evidence(domains: DataFrame) -> DataFrame:
    """Scores of 20 and more, confidence score/50 up to 1."""
    good = domains.where(F.col("score") >= 20)
    return _row(good, "plugin", "domain_hit", F.col("description"), F.least(F.col("score") / 50, F.lit(1.0)), F.col("hit_rank"), "hmmscan", domain_name=F.col("domain_name"), accession=F.col("accession"))


def collect_evidence(*layers: DataFrame) -> DataFrame:
    """All layers with ev_seq, the place of each row within its gene, and evidence_id."""
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    order = Window.partitionBy("gene_id").orderBy("layer", "layer_seq", "evidence_type", "description", "confidence")
    placed = every.withColumn("ev_seq", F.row_number().over(order))
    return placed.withColumn("evidence_id", F.concat_ws(":", "gene_id", "ev_seq"))


def skipped_layers(genes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Genes without a row of each layer."""
    present = evidence.groupBy("gene_id").agg(F.collect_set("layer").alias("present"))
    missing = F.array_except(F.array(*[F.lit(i) for i in range(len(LAYERS))]), F.coalesce("present", F.array().cast("array<int>")))
    names = F.array(*[F.lit(x) for x in LAYERS])
    each = genes.select("gene_id").distinct().join(present, "gene_id", "left").select(F.explode(missing).alias("layer"))
    return each.groupBy("layer").agg(F.count("*").alias("n")).select(F.element_at(names, F.col("layer") + 1).alias("layer"), "n")


def genome_evidence(genes: DataFrame, evidence: DataFrame) -> DataFrame:
    return genes.select("genome_id", "gene_id").join(evidence, "gene_id")


# -- lookups in annotation tables ----------------------------------------------------------


def lookup_by_name(genes: DataFrame, annotations: DataFrame, most: int = 3) -> DataFrame:
    """First ``most`` annotations with each gene's name; names that say nothing look up nothing.

    Annotations of a name are ranked before the join, so a common name brings ``most`` rows and no more.
    """
    rank = F.row_number().over(Window.partitionBy("gene_name").orderBy("accession"))
    first = annotations.withColumn("hit_rank", rank).where(F.col("hit_rank") <= most)
    named = genes.where(F.col("name").isNotNull() & (F.col("name") != "") & ~is_uninformative(F.col("name")))
    return named.join(first, F.col("name") == F.col("gene_name"))


def lookup_by_length(genes: DataFrame, annotations: DataFrame, within: int = 20, most: int = 3, least: int = 10) -> DataFrame:
    """For genes without a name the ``most`` annotations of a length within ``within``, by difference and accession.

    Genes of one length have one answer: it is found once for each length, in bins, and joined back.
    """
    bare = F.length(F.regexp_replace("protein_seq", r"[*\-]", ""))
    asking = genes.where(F.coalesce("name", F.lit("")) == "").withColumn("_length", bare).where(F.col("_length") >= least)
    lengths = asking.select("_length").distinct().withColumn("_bin", F.floor(F.col("_length") / within))
    near = lengths.withColumn("_bin", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)))
    # of one annotation length only the first accessions can be among the answers
    same = F.row_number().over(Window.partitionBy("length").orderBy("accession"))
    table = annotations.withColumn("_same", same).where(F.col("_same") <= most).withColumn("_bin", F.floor(F.col("length") / within))
    pairs = near.join(table, "_bin").where(F.abs(F.col("length") - F.col("_length")) <= within)
    rank = F.row_number().over(Window.partitionBy("_length").orderBy(F.abs(F.col("length") - F.col("_length")), "accession"))
    answers = pairs.withColumn("hit_rank", rank).where(F.col("hit_rank") <= most).drop("_bin", "_same")
    return asking.join(answers, "_length").drop("_length")


def domains_by_name(genes: DataFrame, annotations: DataFrame, domains: DataFrame, most: int = 5) -> DataFrame:
    """Name to one accession to at most ``most`` domains."""
    one = lookup_by_name(genes, annotations, 1).select("gene_id", "accession")
    rank = F.row_number().over(Window.partitionBy("accession").orderBy("domain_id"))
    few = domains.withColumn("hit_rank", rank).where(F.col("hit_rank") <= most)
    return one.join(few, "accession")


def pfam_lookup(domains: DataFrame, table: DataFrame) -> DataFrame:
    """Domain accession to COG and GO; the table has one row a family."""
    return domains.join(table, "pfam_id", "left")


def attach_gene(results: DataFrame, genes: DataFrame) -> DataFrame:
    return results.join(genes.select("gene_id", "start", "end", "strand"), "gene_id", "left")


# -- aggregation ---------------------------------------------------------------------------

# Weights of evidence types; others weigh 0.5.
TYPE_WEIGHTS = {"blast_homology": 1.0, "motif_match": 0.8, "orf_prediction": 0.6, "domain_hit": 0.9, "sequence_feature": 0.5, "structural_homology": 0.95}


def type_weight(kind: Column) -> Column:
    out = None
    for name, weight in TYPE_WEIGHTS.items():
        out = F.when(kind == name, weight) if out is None else out.when(kind == name, weight)
    return out.otherwise(0.5)


def evidence_by_type(evidence: DataFrame) -> DataFrame:
    """Per gene and type: n, mean, highest, weighted = weight * mean * n, first_seq."""
    grouped = evidence.groupBy("gene_id", "evidence_type").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.max("confidence").alias("highest"), F.min("ev_seq").alias("first_seq")
    )
    return grouped.withColumn("weighted", type_weight(F.col("evidence_type")) * F.col("mean") * F.col("n"))


def aggregate_evidence(evidence: DataFrame) -> DataFrame:
    """Per gene: total, evidence_count, type_diversity, has_homology, has_motifs, strongest_type."""
    return (
        evidence_by_type(evidence)
        .groupBy("gene_id")
        .agg(
            F.sum("weighted").alias("total"),
            F.sum("n").alias("evidence_count"),
            F.count("*").alias("type_diversity"),
            F.bool_or(F.col("evidence_type") == "blast_homology").alias("has_homology"),
            F.bool_or(F.col("evidence_type") == "motif_match").alias("has_motifs"),
            F.max_by("evidence_type", F.struct(F.round("weighted", 9), -F.col("first_seq"))).alias("strongest_type"),
            F.max(F.when(F.col("evidence_type") == "blast_homology", F.col("highest"))).alias("best_homology"),
            F.max(F.when(F.col("evidence_type") == "domain_hit", F.col("highest"))).alias("best_domain"),
        )
    )


def top_evidence(evidence: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` surest rows of a gene; ties by the type first seen, then by place."""
    first = evidence.groupBy("gene_id", "evidence_type").agg(F.min("ev_seq").alias("type_first"))
    order = Window.partitionBy("gene_id").orderBy(F.desc("confidence"), "type_first", "ev_seq")
    return evidence.join(first, ["gene_id", "evidence_type"]).withColumn("top_rank", F.row_number().over(order)).where(F.col("top_rank") <= most)


def rank_genes_by_evidence(evidence: DataFrame) -> DataFrame:
    """Genes by total, highest first: the rank is the sort order of the rows, so no window holds them all."""
    return aggregate_evidence(evidence).select("gene_id", "total").orderBy(F.desc("total"), "gene_id")


def genome_summary(genomes: DataFrame, genes: DataFrame, interpretations: DataFrame) -> DataFrame:
    """Length, GC, genes, interpreted genes and their share in percent."""
    from annoflux.functions.sequence import gc_percent

    done = genes.join(interpretations.select("gene_id").distinct().withColumn("_done", F.lit(1)), "gene_id", "left")
    counts = done.groupBy("genome_id").agg(F.count("*").alias("gene_count"), F.count("_done").alias("interpreted"))
    joined = genomes.select("genome_id", F.length("sequence").alias("length"), gc_percent(F.col("sequence"), None).alias("gc")).join(counts, "genome_id", "left").na.fill(0, ["gene_count", "interpreted"])
    return joined.withColumn("coverage", F.coalesce(F.try_divide(F.lit(100.0) * F.col("interpreted"), F.col("gene_count")), F.lit(0.0)))


# -- user-defined surface ------------------------------------------------------------------


GENE_EVIDENCE = "evidence_type string, description string, confidence double, source string, motif_name string, domain_name string, accession string"


def gene_plugin(name: str, scan_gene: Callable[[dict], Iterable[dict]]) -> Callable[[DataFrame], DataFrame]:
    """A plugin of a function from one gene (a dict of its columns) to its evidence (dicts with fields of ``GENE_EVIDENCE``).

    A gene on which the function fails, or returns what is no evidence, has one row with the fault as ``error``
    and no evidence; the other genes are not affected.
    """
    fields = [x.split()[0] for x in GENE_EVIDENCE.split(", ")]
    columns = ["gene_id", "layer_seq", *fields, "error"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for gene in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                try:
                    rows = []
                    for n, found in enumerate(scan_gene(gene) or ()):
                        if set(found) - set(fields) or not 0 <= float(found["confidence"]) <= 1:
                            raise ValueError(f"no evidence: {found}")
                        rows.append((gene["gene_id"], n, *[float(found[c]) if c == "confidence" else found.get(c) for c in fields], None))
                    out += rows
                except Exception as fault:  # noqa: BLE001  any fault of foreign code, kept as a row
                    out.append((gene["gene_id"], 0, *[None] * len(fields), f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(out, columns=columns)

    def plugin(genes: DataFrame) -> DataFrame:
        found = genes.mapInPandas(scan, f"gene_id {genes.schema['gene_id'].dataType.simpleString()}, layer_seq long, {GENE_EVIDENCE}, error string")
        return found.withColumns({"layer": F.lit(LAYERS.index("plugin")), "tool_name": F.lit(name)}).select(*COLUMNS, "error")

    return plugin


class EvidencePlugins:
    """Registered sources of evidence: functions from genes to rows with the columns of an evidence layer."""

    def __init__(self) -> None:
        self._scans: dict[str, Callable[[DataFrame], DataFrame]] = {}
        #: Faults of the plugins that the last scan skipped, by name.
        self.skipped: dict[str, str] = {}

    def register(self, name: str, scan: Callable[[DataFrame], DataFrame], available: bool = True) -> None:
        if available:
            self._scans[name] = scan

    def register_gene_scan(self, name: str, scan_gene: Callable[[dict], Iterable[dict]], available: bool = True) -> None:
        """A plugin that sees one gene at a time, as ``gene_plugin`` runs it."""
        self.register(name, gene_plugin(name, scan_gene), available)

    def scan(self, genes: DataFrame, isolate: bool = False) -> DataFrame | None:
        """The union of all plugins' rows; a plugin that fails to plan is skipped, and told in ``skipped``.

        ``isolate``: each plugin is run by itself and its rows are checkpointed, so that one that fails while it
        runs is skipped too. Genes on which a ``gene_plugin`` fails are left out either way; ``faults`` lists them.
        """
        found, self.skipped = None, {}
        for name, scan in self._scans.items():
            try:
                rows = scan(genes)
                rows = (rows.where("error IS NULL") if "error" in rows.columns else rows).select(*COLUMNS)
                rows = cut(rows) if isolate else rows
            except Exception as error:  # noqa: BLE001  a plugin's fault must not end the job
                logging.getLogger(__name__).warning("plugin %s skipped: %s", name, error)
                self.skipped[name] = f"{type(error).__name__}: {error}"
                continue
            found = rows if found is None else found.unionByName(rows)
        return found

    def faults(self, genes: DataFrame) -> DataFrame | None:
        """(plugin, gene_id, error): the genes on which gene plugins fail."""
        found = None
        for name, scan in self._scans.items():
            if name not in self.skipped and "error" in (rows := scan(genes)).columns:
                bad = rows.where("error IS NOT NULL").select(F.lit(name).alias("plugin"), "gene_id", "error")
                found = bad if found is None else found.unionByName(bad)
        return found
