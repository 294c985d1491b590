"""Confidence, conflict, interpretation, COG/GO function, novelty and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoflux.operators.evidence import aggregate_evidence

LEVELS = ((0.8, "high"), (0.5, "moderate"), (0.3, "low"))
DOMINANT = 0.15
# Words that tell no function.
STOP_WORDS = ("putative", "potential", "probable", "protein", "domain", "containing")


def score_to_level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for bound, level in LEVELS[1:]:
        out = out.when(score >= bound, level)
    return out.otherwise("speculative")


def score_confidence(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds adjusted, level and the lists positive, negative and uncertainty."""
    joined = hypotheses.join(aggregate_evidence(evidence), "gene_id")
    count, kinds = F.col("evidence_count"), F.col("type_diversity")
    homology, domain = F.col("best_homology"), F.col("best_domain")
    hypothetical = F.lower("function").contains("hypothetical")
    raw = (
        F.col("confidence")
        + F.when(kinds >= 2, 0.10).otherwise(0.0)
        + F.when(count >= 5, 0.05).when(count <= 2, -0.1).otherwise(0.0)
        + F.when(homology >= 0.8, 0.05).otherwise(0.0)
        + F.when(domain >= 0.85, 0.08).when(domain >= 0.70, 0.04).otherwise(0.0)
        + F.when(hypothetical, -0.15).otherwise(0.0)
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    weak = (F.col("category") == "modification") & (clamped > 0.45)
    capped = F.when(weak, 0.45).otherwise(clamped)
    only_motifs = (kinds == 1) & F.col("has_motifs") & (capped > 0.85)
    adjusted = F.round(F.when(only_motifs, 0.85).otherwise(capped), 9)
    text = lambda condition, value: F.when(condition, value)
    positive = F.array_compact(
        F.array(
            text(kinds >= 2, F.concat(F.lit("Multiple evidence types ("), kinds, F.lit(") support this hypothesis"))),
            text(count >= 5, F.concat(F.lit("Strong evidence support ("), count, F.lit(" items)"))),
            text(homology >= 0.8, F.lit("Strong sequence homology")),
            F.when(domain >= 0.85, "High-confidence Pfam domain hit").when(domain >= 0.70, "Pfam domain hit").when(domain.isNotNull(), "Weak Pfam domain signal detected"),
        )
    )
    negative = F.array_compact(
        F.array(
            text(kinds == 1, F.lit("Only one type of evidence available")),
            text(count <= 2, F.lit("Limited evidence available")),
            text(homology < 0.8, F.lit("Moderate sequence identity to known proteins")),
            text(hypothetical, F.lit("Homolog is itself hypothetical/uncharacterized")),
            text(weak, F.lit("Likely nonspecific motif pattern")),
            text(only_motifs, F.lit("Prediction based entirely on sequence motifs without homology")),
        )
    )
    uncertainty = F.array_compact(
        F.array(
            text(kinds == 1, F.lit("single_evidence_type")),
            text(count <= 2, F.lit("limited_evidence")),
            text(homology < 0.8, F.lit("low_sequence_identity")),
            text(hypothetical, F.lit("hypothetical_homolog")),
            text(weak, F.lit("weak_motif_match")),
            text(only_motifs, F.lit("weak_motif_match")),
            F.lit("no_experimental_validation"),
        )
    )
    scored = joined.withColumns({"adjusted": adjusted, "positive": positive, "negative": negative, "uncertainty": uncertainty})
    return scored.withColumn("level", score_to_level(F.col("adjusted"))).select(*hypotheses.columns, "adjusted", "level", "positive", "negative", "uncertainty")


def explain_differences(scored: DataFrame) -> DataFrame:
    """One text a gene: level, first two strengths and weaknesses of each hypothesis."""
    line = F.concat(
        F.lit("Hypothesis "), F.col("rank"), F.lit(": "), F.col("level"),
        F.when(F.size("positive") > 0, F.concat(F.lit("\n  Strengths: "), F.array_join(F.slice("positive", 1, 2), ", "))).otherwise(""),
        F.when(F.size("negative") > 0, F.concat(F.lit("\n  Weaknesses: "), F.array_join(F.slice("negative", 1, 2), ", "))).otherwise(""), F.lit("\n"),
    )
    lines = scored.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select("gene_id", F.when(F.size("l") <= 1, "Single hypothesis - no comparison available.").otherwise(F.concat(F.lit("Hypothesis Comparison:\n\n"), F.array_join("l.line", "\n"))).alias("explanation"))


def rank_hypotheses(scored: DataFrame) -> DataFrame:
    """Adds final_rank by adjusted score; the order of generation breaks ties."""
    return scored.withColumn("final_rank", F.row_number().over(Window.partitionBy("gene_id").orderBy(F.desc("adjusted"), "rank")))


def _telling(function: Column) -> Column:
    return F.filter(F.split(F.lower(function), r"\s+"), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 3))


def check_conflict(ranked: DataFrame) -> DataFrame:
    """First hypotheses with severity and conflict text, from the raw confidence and words of the second."""
    order = Window.partitionBy("gene_id").orderBy("final_rank")
    second = ranked.withColumns({"second": F.lead("function").over(order), "second_confidence": F.lead("confidence").over(order)}).where("final_rank = 1")
    shared = F.arrays_overlap(_telling(F.col("function")), _telling(F.col("second")))
    severity = (
        F.when(F.col("second").isNull(), "NONE").when(F.round(F.col("confidence") - F.col("second_confidence"), 9) > DOMINANT, "NONE").when(shared, "LOW").otherwise("HIGH")
    )
    quoted = F.concat(F.lit("'"), F.col("function"), F.lit("' vs '"), F.col("second"), F.lit("'"))
    text = (
        F.when(F.col("second").isNull(), "No conflict (single or no hypothesis)")
        .when(F.col("severity") == "NONE", "Primary hypothesis dominant")
        .when(F.col("severity") == "LOW", F.concat(F.lit("Similar functions: "), quoted))
        .otherwise(F.concat(F.lit("Ambiguous interpretation: "), quoted))
    )
    return second.withColumn("severity", severity).withColumn("conflict", text)


def interpret(ranked: DataFrame) -> DataFrame:
    """One row a gene: the first hypothesis, downgraded where it conflicts with the second. Hypotheses without details give none."""
    high = F.col("severity") == "HIGH"
    rest = Window.partitionBy("gene_id").orderBy("final_rank").rowsBetween(1, Window.unboundedFollowing)
    others = F.collect_list(F.struct("final_rank", "function", "adjusted")).over(rest)
    details = {
        "ids": F.col("ids"),
        "reasoning": F.when(high, F.concat("reasoning", F.array(F.concat(F.lit("Output flagged: "), F.col("conflict"))))).otherwise(F.col("reasoning")),
        "competing": F.col("competing"),
        "uncertainty": F.when(high, F.concat("uncertainty", F.array(F.lit("conflicting_evidence")))).otherwise(F.col("uncertainty")),
    }
    first = check_conflict(ranked.withColumn("competing", others))
    return first.select(
        "gene_id",
        F.when(high, F.col("conflict")).otherwise(F.col("function")).alias("hypothesis"),
        F.round(F.when(high, F.col("adjusted") * 0.8).otherwise(F.col("adjusted")), 9).alias("score"),
        F.when(high, "low").otherwise(F.col("level")).alias("level"),
        "category",
        "severity",
        *[value.alias(name) for name, value in details.items() if name in first.columns],
    )


def ncrna_interpretation(genes: DataFrame) -> DataFrame:
    """tRNA and rRNA genes: their product, 0.95, high."""
    own = genes.where(F.col("source").isin("tRNA_prediction", "rRNA_prediction"))
    return own.select("gene_id", F.col("product").alias("hypothesis"), F.lit(0.95).alias("score"), F.lit("high").alias("level"), F.lit("ncRNA").alias("category"))


def uninterpreted(genes: DataFrame, interpretations: DataFrame) -> DataFrame:
    return genes.select("gene_id").distinct().join(interpretations.select("gene_id"), "gene_id", "left_anti")


# Sentences of the narrative; {} is the function.
AMBIGUOUS = "What this gene does stays ambiguous, as its evidence disagrees."
OPENINGS = {
    "sure": "Called a **{}** with very high confidence.",
    "high": "The evidence strongly suggests a **{}**.",
    "moderate": "Probably a **{}**; some doubt is left.",
    "low": "A first look hints at a **{}**.",
    "speculative": "Open; at best it resembles a **{}**.",
}
SUPPORT = {
    "none": "No details of the evidence are at hand.",
    "both": "Sequence homology and motifs agree on it.",
    "homology": "It rests mainly on sequence homology to known proteins.",
    "motif": "It rests on conserved motifs or domains of this family.",
    "other": "It rests on features of the sequence and structure alone.",
}
CAVEATS = {
    "conflict": "There is a conflicting signal between sources: review by hand.",
    "alternative": "The runner-up ({}) has less support.",
    "single": "One type of evidence carries it, so a false positive is more likely.",
}


def _said(sentence: str, value: Column) -> Column:
    before, after = sentence.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def narrative(interpretations: DataFrame) -> DataFrame:
    """A paragraph a gene: opening by level, what supports it, caveats. Null lists are empty."""
    function = F.coalesce("hypothesis", F.lit(""))
    level = F.when((F.col("level") == "high") & (F.col("score") > 0.9), "sure").when(F.col("level").isin("high", "moderate", "low"), F.col("level")).otherwise("speculative")
    opening = F.when(function.contains("Ambiguous"), AMBIGUOUS)
    for name, sentence in OPENINGS.items():
        opening = opening.when(level == name, _said(sentence, function))
    chain = F.coalesce("reasoning", F.array().cast("array<string>"))
    mentions = lambda *words: F.exists(chain, lambda r: F.lower(r).rlike("|".join(words)))
    homology, motif = F.exists(chain, lambda r: r.contains("BLAST")) | mentions("homology"), mentions("motif", "domain")
    kind = F.when(F.size(chain) == 0, "none").when(homology & motif, "both").when(homology, "homology").when(motif, "motif").otherwise("other")
    sources = F.coalesce("uncertainty", F.array().cast("array<string>"))
    first = F.get(F.coalesce(F.col("competing.function"), F.array().cast("array<string>")), F.lit(0))
    conflict = F.when(F.array_contains(sources, "conflicting_evidence"), CAVEATS["conflict"]).when(first.isNotNull(), _said(CAVEATS["alternative"], first))
    single = F.when(F.array_contains(sources, "Single Evidence Type"), CAVEATS["single"])
    return interpretations.select("gene_id", F.concat_ws(" ", opening, _lookup(kind, SUPPORT), conflict, single).alias("narrative"))


# -- function ------------------------------------------------------------------------------

# COG letters and names, and the letter of each category.
COG_NAMES = {
    "J": "Translation, ribosomal structure and biogenesis", "A": "RNA processing and modification", "K": "Transcription", "L": "Replication, recombination and repair",
    "B": "Chromatin structure and dynamics", "D": "Cell cycle control, cell division, chromosome partitioning", "Y": "Nuclear structure", "V": "Defense mechanisms",
    "T": "Signal transduction mechanisms", "M": "Cell wall/membrane/envelope biogenesis", "N": "Cell motility", "Z": "Cytoskeleton", "W": "Extracellular structures",
    "U": "Intracellular trafficking, secretion, and vesicular transport", "O": "Posttranslational modification, protein turnover, chaperones",
    "X": "Mobilome: prophages, transposons", "C": "Energy production and conversion", "G": "Carbohydrate transport and metabolism", "E": "Amino acid transport and metabolism",
    "F": "Nucleotide transport and metabolism", "H": "Coenzyme transport and metabolism", "I": "Lipid transport and metabolism", "P": "Inorganic ion transport and metabolism",
    "Q": "Secondary metabolites biosynthesis, transport and catabolism", "R": "General function prediction only", "S": "Function unknown",
}
CATEGORY_COG = {
    "replication": "L", "transcription": "K", "translation": "J", "metabolism": "G", "transport": "P",
    "regulation": "T", "cell_structure": "M", "stress_response": "O", "phage": "X", "unknown": "S",
}
# Placeholders and modifiers of product names, and fragments at their end.
KEPT_PRODUCTS = ("hypothetical protein", "uncharacterized protein", "uncharacterised protein", "unknown", "unknown protein")
LEADING = ("putative", "probable", "predicted", "possible", "uncharacterised", "uncharacterized", "conserved", "hypothetical")
TRAILING = (r"\s*\[partial\]\s*$", r"\s*\(fragment\)\s*$", r"\s*\(partial\)\s*$", r"\s*\(predicted\)\s*$", r"\s+EC[ :]\d+(\.\d+){0,3}\s*$")


def normalize_product(product: Column) -> Column:
    bare = F.trim(product)
    text = bare
    for pattern in TRAILING:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    for _ in range(2):
        text = F.regexp_replace(text, rf"(?i)^(?:{'|'.join(LEADING)}) \s*", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^[ ,;:]+|[ ,;:]+$", "")
    return F.when(F.lower(bare).isin(*KEPT_PRODUCTS), bare).otherwise(text)


def first_pfam_id(evidence: DataFrame) -> DataFrame:
    """The first family accession of each gene's evidence, in order."""
    found = F.regexp_extract(F.concat_ws(" ", "accession", "description"), r"\b(PF\d{5})\b", 1)
    return evidence.withColumn("pfam_id", found).where(F.col("pfam_id") != "").groupBy("gene_id").agg(F.min_by("pfam_id", "ev_seq").alias("pfam_id"))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def annotate_function(interpretations: DataFrame, pfam: DataFrame, table: DataFrame) -> DataFrame:
    """COG letter and name, GO terms and their source: the family's, else inferred from the category."""
    joined = interpretations.join(pfam, "gene_id", "left").join(table, "pfam_id", "left")
    inferred = _lookup(F.col("category"), CATEGORY_COG)
    return joined.withColumns(
        {"cog_category": F.coalesce("cog", inferred), "cog_source": F.when(F.col("cog").isNotNull(), "pfam").when(inferred.isNotNull(), "inferred").otherwise("none")}
    ).withColumn("cog_name", _lookup(F.col("cog_category"), COG_NAMES))


# -- novelty -------------------------------------------------------------------------------

# Experiments suggested for each kind of novelty.
EXPERIMENTS = {
    "dark_long": [
        "Recombinant expression and biochemical activity screening", "Structural characterization by X-ray crystallography or cryo-EM",
        "Deletion mutant phenotyping to assess essentiality", "Comparative genomics: check conservation across related strains",
    ],
    "dark_short": ["Gene deletion to assess essentiality", "Protein interaction screen (co-immunoprecipitation or Y2H)", "RNA-seq profiling across conditions to check expression pattern"],
    "conflict": [
        "Biochemical assay to discriminate between predicted functions", "Mutagenesis of key predicted active-site residues",
        "Crystal structure determination for definitive classification", "Ortholog functional complementation in model organism",
    ],
    "weak": ["Overexpression and in vitro binding/activity assays", "Functional complementation in related organism", "Protein–protein interaction screen"],
}


def novelty_protein_length(protein: Column, start: Column, end: Column) -> Column:
    return F.coalesce(F.length(F.nullif(protein, F.lit(""))), F.floor((end - start) / 3), F.lit(0)).cast("int")


def novelty(results: DataFrame, exclude_ncrna: bool = False) -> DataFrame:
    """Candidates with category and novelty score.

    Reads gene_id, genome_id, protein_length, evidence_count, score, severity and, to exclude, category.
    """
    n, length, score = F.col("evidence_count"), F.col("protein_length"), F.col("score")
    if exclude_ncrna:
        results = results.where(F.coalesce("category", F.lit("")) != "ncRNA")
    dark = F.when(length > 300, 0.95).when(length > 150, 0.85).when(length > 50, 0.75).otherwise(0.55)
    weak = F.least(F.lit(0.5) + F.when(length > 200, 0.1).otherwise(0.0) + F.when(n <= 1, 0.05).when(n >= 4, -0.1).otherwise(0.0), F.lit(0.75))
    conflict = F.col("severity").isin("HIGH", "MODERATE") & (score < 0.5)
    kind = F.when(n == 0, "dark_matter").when(conflict, "conflict").when(score.isNull() | (score < 0.35), "weak_evidence")
    value = F.when(n == 0, dark).when(conflict, 0.65).otherwise(weak)
    return results.withColumns({"novelty": kind, "novelty_score": value}).where(F.col("novelty").isNotNull() & (F.col("novelty_score") >= 0.3))


def suggested_experiments(candidates: DataFrame) -> DataFrame:
    lists = {k: F.array(*[F.lit(x) for x in v]) for k, v in EXPERIMENTS.items()}
    return candidates.withColumn(
        "experiments",
        F.when((F.col("novelty") == "dark_matter") & (F.col("protein_length") > 150), lists["dark_long"])
        .when(F.col("novelty") == "dark_matter", lists["dark_short"])
        .when(F.col("novelty") == "conflict", lists["conflict"])
        .otherwise(lists["weak"]),
    )


def novel_gene_report(candidates: DataFrame) -> DataFrame:
    by = F.col("novelty")
    return candidates.groupBy("genome_id").agg(
        F.count("*").alias("total"), F.count_if(by == "dark_matter").alias("dark"), F.count_if(by == "weak_evidence").alias("weak"), F.count_if(by == "conflict").alias("conflicts")
    ).withColumn("dark_fraction", F.col("dark") / F.col("total"))


def top_novel(candidates: DataFrame, most: int = 20) -> DataFrame:
    order = Window.partitionBy("genome_id").orderBy(F.desc("novelty_score"), "gene_id")
    ranked = candidates.withColumn("novel_rank", F.row_number().over(order)).where(F.col("novel_rank") <= most)
    return ranked.withColumn("priority", F.when(F.col("novelty_score") >= 0.8, "high").when(F.col("novelty_score") >= 0.55, "medium").otherwise("low"))


def interpretation_summary(results: DataFrame) -> DataFrame:
    """Counts by level per genome; a gene without a score is not interpreted."""
    level = F.col("level")
    return results.groupBy("genome_id").agg(
        F.count("*").alias("total"), F.count("score").alias("interpreted"), F.count_if(level == "high").alias("high"), F.count_if(level == "moderate").alias("moderate"),
        F.count_if(level.isin("low", "speculative")).alias("low"),
    ).withColumns({"dark": F.col("total") - F.col("interpreted"), "success_rate": F.col("interpreted") / F.col("total")})


def report_tables(results: DataFrame) -> DataFrame:
    """Top 10 high, 10 moderate and 5 low interpretations of a genome, with how many there are."""
    bucket = F.when(F.col("level") == "speculative", "low").otherwise(F.col("level"))
    part = Window.partitionBy("genome_id", "bucket")
    counts = results.where("score IS NOT NULL").withColumn("bucket", bucket).groupBy("genome_id", "bucket").agg(F.count("*").alias("of"))
    ranked = results.where("score IS NOT NULL").withColumn("bucket", bucket).withColumn("shown_rank", F.row_number().over(part.orderBy(F.desc("score"), "gene_id")))
    most = F.when(F.col("bucket") == "low", 5).otherwise(10)
    return ranked.where(F.col("shown_rank") <= 10).where(F.col("shown_rank") <= most).join(counts, ["genome_id", "bucket"])


def conflict_table(results: DataFrame, most: int = 10) -> DataFrame:
    order = Window.partitionBy("genome_id").orderBy("gene_id")
    own = results.where(F.col("severity").isin("HIGH", "MODERATE"))
    return own.withColumn("shown_rank", F.row_number().over(order)).where(F.col("shown_rank") <= most).select("genome_id", "gene_id", "severity", F.substring("hypothesis", 1, 50).alias("hypothesis"), "score")


def novel_section(candidates: DataFrame) -> DataFrame:
    return suggested_experiments(top_novel(candidates, 5)).select("genome_id", "gene_id", "novel_rank", F.slice("experiments", 1, 3).alias("experiments"))


def search_report(results: DataFrame, text: str = "", level: str = "ALL") -> DataFrame:
    """Rows whose id, hypothesis or a reasoning step holds ``text``, of a level (LOW has speculative ones, DARK none)."""
    wanted = F.lit(text.lower())
    found = F.lower("gene_id").contains(wanted) | F.coalesce(F.lower("hypothesis").contains(wanted), F.lit(False)) | F.coalesce(F.exists("reasoning", lambda r: F.lower(r).contains(wanted)), F.lit(False))
    of_level = {"ALL": F.lit(True), "DARK": F.col("level").isNull(), "LOW": F.col("level").isin("low", "speculative")}.get(level, F.col("level") == level.lower())
    return results.where(found & of_level)
