"""Functional hypotheses from evidence: tiers, merging, ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoflux.operators.evidence import aggregate_evidence, top_evidence
from annoflux.operators.lineage import keep

# Keywords of each category, in the order in which categories are tried.
KEYWORDS = {
    "replication": ["polymerase", "helicase", "primase", "ligase", "dna", "replication", "dnaa", "dnab", "dnac", "dnan", "topoisomerase", "gyrase"],
    "transcription": ["rna polymerase", "sigma", "transcription", "rnap", "promoter", "terminator", "elongation", "initiation"],
    "translation": ["ribosom", "trna", "rrna", "aminoacyl", "synthetase", "elongation factor", "initiation factor", "release factor", "translation"],
    "metabolism": [
        "kinase", "phosphatase", "dehydrogenase", "oxidase", "reductase", "synthase", "transferase", "hydrolase",
        "lyase", "isomerase", "ligase", "atp", "nad", "metabolism", "glycolysis", "oxidation",
    ],
    "transport": ["transporter", "permease", "channel", "pump", "abc", "mfs", "import", "export", "efflux", "influx", "membrane"],
    "regulation": ["regulator", "repressor", "activator", "response", "sensor", "histidine kinase", "two-component", "transcription factor"],
    "cell_structure": ["membrane", "cell wall", "peptidoglycan", "lipopolysaccharide", "flagell", "pili", "fimbri", "capsule"],
    "stress_response": ["chaperone", "heat shock", "cold shock", "oxidative", "stress", "groel", "dnak", "clp", "protease"],
    "modification": ["phosphorylation", "glycosylation", "amidation", "acetylation", "methylation", "ubiquitination", "modification", "target protein"],
    "phage_structure": [
        "capsid", "coat protein", "spike protein", "tail", "head", "portal", "baseplate", "fiber", "pilot protein",
        "major capsid", "minor capsid", "scaffold", "scaffolding", "prohead", "procapsid",
    ],
    "phage_lysis": ["lysis", "lysin", "holin", "endolysin", "spanin", "lytic"],
    "phage_replication": [
        "replication initiation", "dna binding protein", "dna pilot", "single-stranded dna binding", "ssdna",
        "rf replication", "rolling circle", "phage replication",
    ],
}
# Functions of motifs, and names of motifs that mislead in phages.
MOTIF_FUNCTIONS = {
    "atp_binding_p_loop": "ATP/GTP binding protein",
    "walker_b": "ATPase",
    "helix_turn_helix": "DNA-binding transcription regulator",
    "zinc_finger_c2h2": "Zinc finger transcription factor",
    "serine_protease": "Serine protease",
    "signal_peptide": "Secreted/membrane protein",
    "transmembrane": "Membrane protein",
    "phosphorylation_site": "Phosphorylation target protein",
    "gram_negative_lipobox": "Lipoprotein",
}
EUKARYOTIC = (
    "conotoxin egf sh2 sh3 zinc_finger zf-c2h2 vwfc vwfa vwfb vwfd tsp1 thrombospondin fn3 fibronectin ig immunoglobulin lrr leucine_rich ank ankyrin wd40"
).split()
MIN_CONFIDENCE, MOST = 0.3, 3
FIELDS = ("gene_id", "tier", "place", "function", "category", "confidence", "source_type", "ids", "reasoning", "keywords")


def _any_of(text: Column, words: list[str]) -> Column:
    # a look at the letter tells of most places that no word begins there
    first = "".join(sorted({w[0] for w in words}))
    return text.rlike(f"(?=[{first}])(?:" + "|".join(w.replace("-", r"\-") for w in words) + ")")


def categorize(text: Column) -> Column:
    """First category with a keyword inside the lowered text, else unknown."""
    lowered, out = F.lower(text), None
    for category, words in KEYWORDS.items():
        hit = _any_of(lowered, words)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("unknown")


def extract_keywords(text: Column) -> Column:
    """Keywords inside the lowered text in table order, the first five."""
    words = list(dict.fromkeys(w for ws in KEYWORDS.values() for w in ws))
    return F.slice(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w)), 1, 5)


def function_from_description(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(text), "putative ", "")
    for word in ("probable ", "hypothetical ", "predicted "):
        cleaned = F.regexp_replace(cleaned, word, "")
    part = F.trim(F.substring_index(F.regexp_replace(cleaned, r"\[.*?\]", ""), ",", 1))
    return F.when(part == "", "Hypothetical protein").otherwise(F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, F.lit(2), F.length(part))))


def motif_function(name: Column) -> Column:
    out = None
    for motif, function in MOTIF_FUNCTIONS.items():
        out = F.when(name == motif, function) if out is None else out.when(name == motif, function)
    return out.otherwise(F.concat(F.lit("Protein with "), name, F.lit(" motif")))


def _rows(df: DataFrame, tier: int, place: Column, function: Column, category: Column, confidence: Column, source: str, ids: Column, reasoning: list[Column], keywords: Column) -> DataFrame:
    return df.select(
        "gene_id", F.lit(tier).alias("tier"), place.cast("long").alias("place"), function.alias("function"), category.alias("category"), confidence.alias("confidence"),
        F.lit(source).alias("source_type"), ids.alias("ids"), F.array(*reasoning).alias("reasoning"), keywords.alias("keywords"),
    )


def annotation_hypotheses(evidence: DataFrame) -> DataFrame:
    own = evidence.where(F.col("evidence_type") == "sequence_feature")
    d = F.col("description")
    why = [F.concat(F.lit("GenBank annotation: "), d), F.lit("Curator-assigned description of the submitted record")]
    return _rows(own, 1, F.col("ev_seq"), d, categorize(d), F.col("confidence"), "GENBANK", F.array("ev_seq"), why, extract_keywords(d))


def _first(evidence: DataFrame, kind: str, most: int) -> DataFrame:
    own = evidence.where(F.col("evidence_type") == kind)
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("gene_id").orderBy("ev_seq"))).where(F.col("_n") <= most)


def homology_hypotheses(evidence: DataFrame, most: int = 3) -> DataFrame:
    d = F.col("description")
    function = function_from_description(d)
    why = [F.concat(F.lit("BLAST homology hit: "), d), F.lit("Sequence identity supports functional similarity"), F.lit("E-value indicates statistical significance")]
    return _rows(_first(evidence, "blast_homology", most), 2, F.col("ev_seq"), function, categorize(function), F.col("confidence"), "BLAST", F.array("ev_seq"), why, extract_keywords(d))


def domain_hypotheses(evidence: DataFrame, most: int = 3) -> DataFrame:
    name = F.coalesce(F.col("domain_name"), F.lit(""))
    function = F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(F.concat(F.lit("Protein with "), name, F.lit(" domain")))
    words = extract_keywords(function)
    keywords = F.slice(F.when((name != "") & ~F.array_contains(words, name), F.concat(F.array(name), words)).otherwise(words), 1, 5)
    why = [F.concat(F.lit("Pfam domain hit: "), name), F.concat(F.lit("Domain description: "), function)]
    return _rows(_first(evidence, "domain_hit", most), 3, F.col("ev_seq"), function, categorize(F.concat_ws(" ", function, name)), F.col("confidence"), "DOMAIN", F.array("ev_seq"), why, keywords)


def _mean(values: Column) -> Column:
    """Mean summed in the list's order, nulls aside: a mean about a threshold must not depend on how rows are dealt out."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def motif_hypotheses(evidence: DataFrame) -> DataFrame:
    """A row for each motif of a gene; motifs without a known function need two matches. Confidences are added up in the order of ev_seq."""
    name = F.coalesce(F.col("motif_name"), F.lit("unknown"))
    grouped = (
        evidence.where(F.col("evidence_type") == "motif_match")
        .groupBy("gene_id", name.alias("motif"))
        .agg(F.count("*").alias("n"), F.min("ev_seq").alias("first_seq"), F.array_sort(F.collect_list(F.struct("ev_seq", "confidence"))).alias("rows"))
        .withColumn("mean", _mean(F.col("rows.confidence")))
    )
    function = motif_function(F.col("motif"))
    known = F.col("motif").isin(*MOTIF_FUNCTIONS)
    category = F.col("category")
    poor = (category == "modification") | (F.col("mean") < 0.5)
    alien = _any_of(F.lower("motif"), EUKARYOTIC)
    boost = F.when(alien, 0.0).when(poor, 0.02).otherwise(0.1)
    cap = F.when(alien, 0.20).when(poor, 0.45).otherwise(0.95)
    kept = grouped.where(known | (F.col("n") >= 2)).withColumn("category", categorize(function))
    why = [
        F.concat(F.lit("Detected "), F.col("motif"), F.lit(" motif pattern")),
        F.concat(F.lit("Motif suggests "), function, F.lit(" function")),
        F.concat(F.lit("Supported by "), F.col("n"), F.lit(" motif match(es)")),
    ]
    return _rows(kept, 4, F.col("first_seq"), function, category, F.least(F.col("mean") * (1 + boost * F.col("n")), cap), "MOTIF", F.col("rows.ev_seq"), why, F.array("motif"))


def motif_fallback(motifs: DataFrame, higher: DataFrame) -> DataFrame:
    """Motif hypotheses of genes without a higher tier, capped at 0.45."""
    return motifs.join(higher.select("gene_id").distinct(), "gene_id", "left_anti").withColumn("confidence", F.least("confidence", F.lit(0.45))).select(*FIELDS)


def title(category: Column) -> Column:
    return F.initcap(F.translate(category, "_", " "))


def combined_hypothesis(evidence: DataFrame) -> DataFrame:
    """One row for genes of two evidence types whose five best descriptions together have a category."""
    diverse = aggregate_evidence(evidence).where(F.col("type_diversity") >= 2).select("gene_id")
    best = top_evidence(evidence, 5).join(diverse, "gene_id", "left_semi")
    grouped = best.groupBy("gene_id").agg(
        F.array_sort(F.collect_list(F.struct("top_rank", "description", "ev_seq"))).alias("t"), F.avg("confidence").alias("mean"), F.count("*").alias("n")
    )
    category = categorize(F.array_join("t.description", " "))
    found = grouped.where(F.col("n") >= 2).withColumn("category", category).where(F.col("category") != "unknown")
    c = F.col("category")
    why = [F.concat(F.lit("Multiple evidence types point to "), c, F.lit(" function")), F.concat(F.lit("Supported by "), F.col("n"), F.lit(" evidence items")), F.lit("Cross-validation increases confidence")]
    return _rows(found, 5, F.lit(0), F.concat(title(c), F.lit("-related protein")), c, F.least(F.col("mean") * 1.2, F.lit(0.95)), "COMBINED", F.col("t.ev_seq"), why, F.array().cast("array<string>"))


_MERGED = "hyp_seq int, function string, category string, confidence double, source_type string, ids array<bigint>, reasoning array<string>, keywords array<string>"


class _Group:
    """Hypotheses that resemble their first."""

    def __init__(self, row) -> None:  # noqa: ANN001
        self.first, self.n, self.confidence = row, 0, 0.0
        self.ids, self.reasoning = {}, {}

    def add(self, row) -> None:  # noqa: ANN001
        self.n += 1
        self.confidence += row.confidence
        self.ids.update(dict.fromkeys(row.ids))
        self.reasoning.update(dict.fromkeys(row.reasoning))

    def row(self, seq: int) -> tuple:
        one = self.n == 1
        confidence = self.confidence if one else min(self.confidence / self.n * 1.1, 0.95)
        return (self.first.gene_id, seq, self.first.function, self.first.category, confidence, self.first.source_type if one else "aggregated", sorted(self.ids), list(self.reasoning), self.first.keywords)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups of each gene's hypotheses, which come in order; a gene's groups are found by category and by function."""
    gene, groups, by_category, by_function = None, [], {}, {}
    columns = ["gene_id", *[c.split()[0] for c in _MERGED.split(", ")]]
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.gene_id != gene:
                out += [g.row(n) for n, g in enumerate(groups)]
                gene, groups, by_category, by_function = row.gene_id, [], {}, {}
            known = row.category is not None and row.category != "unknown"
            at = min(by_category.get(row.category, len(groups)) if known else len(groups), by_function.get(row.lowered, len(groups)) if row.lowered is not None else len(groups))
            if at == len(groups):
                groups.append(_Group(row))
                if known:
                    by_category.setdefault(row.category, at)
                if row.lowered is not None:
                    by_function.setdefault(row.lowered, at)
            groups[at].add(row)
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame([g.row(n) for n, g in enumerate(groups)], columns=columns)


_BRIEF = "hyp_seq int, function string, category string, confidence double"


def _fold_brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_fold`` of hypotheses without lists: a group is its place, first function and category, sum and number."""
    names = ["gene_id", *[c.split()[0] for c in _BRIEF.split(", ")]]
    gene, groups, by_category, by_function = None, [], {}, {}

    def rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int32(), pa.string(), pa.string(), pa.float64()), strict=True)], names=names)

    def closed() -> list[tuple]:
        return [(gene, n, function, category, total if count == 1 or total is None else min(total / count * 1.1, 0.95)) for n, (function, category, total, count) in enumerate(groups)]

    kind = None
    for batch in batches:
        out, kind = [], batch.schema.field("gene_id").type
        for own, function, category, confidence, lowered in zip(*(batch[c].to_pylist() for c in ("gene_id", "function", "category", "confidence", "lowered")), strict=True):
            if own != gene:
                out += closed()
                gene, groups, by_category, by_function = own, [], {}, {}
            known = category is not None and category != "unknown"
            at = min(by_category.get(category, len(groups)) if known else len(groups), by_function.get(lowered, len(groups)) if lowered is not None else len(groups))
            if at == len(groups):
                groups.append([function, category, confidence, 1])
                if known:
                    by_category.setdefault(category, at)
                if lowered is not None:
                    by_function.setdefault(lowered, at)
            else:
                group = groups[at]
                group[2] = None if group[2] is None or confidence is None else group[2] + confidence
                group[3] += 1
        yield rows(out, kind)
    if kind is not None:
        yield rows(closed(), kind)


def merge_similar(hypotheses: DataFrame) -> DataFrame:
    """Folds each gene's hypotheses, in order, into groups that resemble their first member.

    Alike: the same category other than unknown, or the same function but for case. Hypotheses are dealt out by
    gene and streamed in order; a group is found by a lookup, so the work is linear in a gene's
    hypotheses, and a task holds no more than the groups of one gene. Hypotheses without ids, reasoning and keywords give groups without them.
    """
    order = ["tier", "place", "function", "category", "confidence"]
    kind = hypotheses.schema["gene_id"].dataType.simpleString()
    # the window's number puts a gene's rows in order, and moves none where they are dealt out by gene already
    numbered = hypotheses.withColumn("_at", F.row_number().over(Window.partitionBy("gene_id").orderBy(*order))).withColumn("lowered", F.lower("function"))
    if "ids" not in hypotheses.columns:
        return numbered.select("gene_id", "_at", "function", "category", "confidence", "lowered").mapInArrow(_fold_brief, f"gene_id {kind}, {_BRIEF}")
    member = numbered.select("gene_id", "_at", *order, "source_type", F.transform("ids", lambda i: i.cast("long")).alias("ids"), "reasoning", "keywords", "lowered")
    return member.mapInPandas(_fold, f"gene_id {kind}, {_MERGED}")


def dealt(evidence: DataFrame) -> DataFrame:
    """Evidence dealt out by gene once and kept, as all tiers and sums read it and group it by gene."""
    return keep(evidence.repartition(int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gene_id"))


def all_tiers(evidence: DataFrame, details: bool = True) -> DataFrame:
    """The hypotheses of all tiers; without ``details`` they have no source, ids, reasoning and keywords."""
    higher = annotation_hypotheses(evidence).unionByName(homology_hypotheses(evidence)).unionByName(domain_hypotheses(evidence))
    found = higher.unionByName(motif_fallback(motif_hypotheses(evidence), higher)).unionByName(combined_hypothesis(evidence))
    return found if details else found.drop("source_type", "ids", "reasoning", "keywords")


def generate_hypotheses(evidence: DataFrame, least: float = MIN_CONFIDENCE, most: int = MOST, details: bool = True, deal: bool = True) -> DataFrame:
    """Merged hypotheses of at least ``least``, the ``most`` surest of a gene in order (rank), with or without ``details``.

    ``deal``: the evidence is not yet ``dealt`` out by gene and kept.
    """
    evidence = dealt(evidence) if deal else evidence
    # to nine digits: means must not depend on the order in which partitions are summed
    merged = merge_similar(all_tiers(evidence, details)).withColumn("confidence", F.round("confidence", 9)).where(F.col("confidence") >= least)
    order = Window.partitionBy("gene_id").orderBy(F.desc("confidence"), "hyp_seq")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
