"""Queries over hypotheses, confidence, interpretation and novelty; the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoflux.functions import sequence as sq
from annoflux.operators import evidence as ev
from annoflux.operators import hypotheses as hy
from annoflux.operators import interpretation as ip
from annoflux.operators import motifs as mt
from annoflux.operators import orfs
from annoflux.operators.genome import interpret_genomes
from annoflux.operators.lineage import cut
from annoflux.plans.queries_evidence import BEST, TYPED, evidence_view
from annoflux.plans.registry import query
from annoflux.plans.views import dealt_genomes, view


def _category(text: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({text}), '{'|'.join(words)}') THEN '{name}'" for name, words in hy.KEYWORDS.items())
    return f"CASE {whens} ELSE 'unknown' END"


_WORDS = ", ".join(f"'{w}'" for w in dict.fromkeys(w for ws in hy.KEYWORDS.values() for w in ws))
_CLEANED = r"trim(split_part(regexp_replace(replace(replace(replace(replace(lower(description), 'putative ', ''), 'probable ', ''), 'hypothetical ', ''), 'predicted ', ''), '\[.*?\]', '', 'g'), ',', 1))"
_FUNCTION = f"CASE WHEN {_CLEANED} = '' THEN 'Hypothetical protein' ELSE upper(substr({_CLEANED}, 1, 1)) || substr({_CLEANED}, 2) END"
_MOTIF = "CASE motif " + " ".join(f"WHEN '{m}' THEN '{f}'" for m, f in hy.MOTIF_FUNCTIONS.items()) + " ELSE 'Protein with ' || motif || ' motif' END"
_ALIEN = f"regexp_matches(lower(motif), '{'|'.join(hy.EUKARYOTIC)}')"

TIERS = (
    TYPED
    + ", "
    + BEST
    + f""",
annotated AS (SELECT gene_id, 1 AS tier, ev_seq AS place, description AS function, {_category("description")} AS category, confidence FROM evidence WHERE evidence_type = 'sequence_feature'),
homologous AS (SELECT gene_id, 2 AS tier, ev_seq AS place, function, {_category("function")} AS category, confidence FROM (SELECT *, {_FUNCTION} AS function, row_number() OVER (PARTITION BY gene_id ORDER BY ev_seq) AS r FROM evidence WHERE evidence_type = 'blast_homology') WHERE r <= 3),
domained AS (SELECT gene_id, 3 AS tier, ev_seq AS place, description AS function, {_category("description")} AS category, confidence FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY ev_seq) AS r FROM evidence WHERE evidence_type = 'domain_hit') WHERE r <= 3),
higher AS (SELECT * FROM annotated UNION ALL SELECT * FROM homologous UNION ALL SELECT * FROM domained),
moved AS (SELECT gene_id, motif_name AS motif, count(*) AS n, avg(confidence) AS mean, min(ev_seq) AS place FROM evidence WHERE evidence_type = 'motif_match' GROUP BY ALL),
called AS (SELECT *, {_MOTIF} AS function FROM moved),
cased AS (SELECT *, {_category("function")} AS category, function <> 'Protein with ' || motif || ' motif' AS known FROM called),
motifs AS (SELECT gene_id, 4 AS tier, place, function, category, least(mean * (1 + CASE WHEN {_ALIEN} THEN 0.0::double WHEN category = 'modification' OR mean < 0.5 THEN 0.02::double ELSE 0.1::double END * n), CASE WHEN {_ALIEN} THEN 0.2::double WHEN category = 'modification' OR mean < 0.5 THEN 0.45::double ELSE 0.95::double END) AS confidence FROM cased WHERE known OR n >= 2),
fallback AS (SELECT * REPLACE (least(confidence, 0.45) AS confidence) FROM motifs WHERE gene_id NOT IN (SELECT gene_id FROM higher)),
told AS (SELECT gene_id, string_agg(description, ' ' ORDER BY top_rank) AS text, avg(confidence) AS mean, count(*) AS n FROM best WHERE top_rank <= 5 AND gene_id IN (SELECT gene_id FROM gathered WHERE type_diversity >= 2) GROUP BY 1),
themed AS (SELECT *, {_category("text")} AS category FROM told WHERE n >= 2),
combined AS (SELECT gene_id, 5 AS tier, 0::bigint AS place, array_to_string(list_transform(string_split(category, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || '-related protein' AS function, category, least(mean * 1.2, 0.95) AS confidence FROM themed WHERE category <> 'unknown'),
tiers AS (SELECT * FROM higher UNION ALL SELECT * FROM fallback UNION ALL SELECT * FROM combined),
keyed AS (SELECT *, CASE WHEN category <> 'unknown' THEN 'c ' || category ELSE 'f ' || lower(function) END AS key FROM tiers),
merged AS (SELECT gene_id, key, arg_min(function, tier * 1000000 + place) AS function, any_value(category) AS category, CASE WHEN count(*) > 1 THEN least(sum(confidence) / count(*) * 1.1, 0.95) ELSE max(confidence) END AS confidence, min(tier * 1000000 + place) AS first, count(*) AS members FROM keyed GROUP BY gene_id, key),
nine AS (SELECT * REPLACE (round(confidence, 9) AS confidence) FROM merged),
kept AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY confidence DESC, first) AS rank FROM nine WHERE confidence >= 0.3),
hyps AS (SELECT * FROM kept WHERE rank <= 3),
raw AS (SELECT h.*, g.type_diversity, g.evidence_count, g.has_motifs, g.best_homology, g.best_domain, greatest(0, least(1, confidence + CASE WHEN type_diversity >= 2 THEN 0.1::double ELSE 0 END + CASE WHEN evidence_count >= 5 THEN 0.05::double WHEN evidence_count <= 2 THEN -0.1::double ELSE 0 END
    + CASE WHEN best_homology >= 0.8 THEN 0.05::double ELSE 0 END + CASE WHEN best_domain >= 0.85 THEN 0.08::double WHEN best_domain >= 0.7 THEN 0.04::double ELSE 0 END + CASE WHEN contains(lower(function), 'hypothetical') THEN -0.15::double ELSE 0 END)) AS clamped FROM hyps h JOIN gathered g USING (gene_id)),
capped AS (SELECT *, CASE WHEN category = 'modification' AND clamped > 0.45 THEN 0.45::double ELSE clamped END AS c1 FROM raw),
scored AS (SELECT *, round(CASE WHEN type_diversity = 1 AND has_motifs AND c1 > 0.85 THEN 0.85::double ELSE c1 END, 9) AS adjusted FROM capped),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY round(adjusted, 9) DESC, rank) AS final_rank FROM scored),
paired AS (SELECT *, lead(function) OVER w AS second, lead(confidence) OVER w AS second_confidence FROM ranked WINDOW w AS (PARTITION BY gene_id ORDER BY final_rank)),
words AS (SELECT *, list_filter(regexp_split_to_array(lower(function), '\\s+'), lambda x: length(x) > 3 AND x NOT IN ('putative', 'potential', 'probable', 'protein', 'domain', 'containing')) AS w1, list_filter(regexp_split_to_array(lower(second), '\\s+'), lambda x: length(x) > 3 AND x NOT IN ('putative', 'potential', 'probable', 'protein', 'domain', 'containing')) AS w2 FROM paired WHERE final_rank = 1),
judged AS (SELECT *, CASE WHEN second IS NULL THEN 'NONE' WHEN round(confidence - second_confidence, 9) > 0.15 THEN 'NONE' WHEN list_has_any(w1, w2) THEN 'LOW' ELSE 'HIGH' END AS severity FROM words),
final AS (SELECT *, round(CASE WHEN severity = 'HIGH' THEN adjusted * 0.8 ELSE adjusted END, 9) AS score, CASE WHEN severity = 'HIGH' THEN 'Ambiguous interpretation: ''' || function || ''' vs ''' || second || '''' ELSE function END AS hypothesis FROM judged) """
)
_LEVEL = "CASE WHEN severity = 'HIGH' THEN 'low' WHEN round(adjusted, 9) >= 0.8 THEN 'high' WHEN round(adjusted, 9) >= 0.5 THEN 'moderate' WHEN round(adjusted, 9) >= 0.3 THEN 'low' ELSE 'speculative' END"


@query("h1_categorize", f"SELECT gene_id, ev_seq, {_category('description')} AS category FROM evidence", ("evidence",))
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_view(spark, sf_dir).select("gene_id", "ev_seq", hy.categorize(F.col("description")).alias("category"))


@query("h2_extract_keywords", f"SELECT gene_id, ev_seq, array_to_string(list_filter([{_WORDS}], lambda w: contains(lower(description), w))[1:5], ',') AS words FROM evidence", ("evidence",))
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_view(spark, sf_dir).select("gene_id", "ev_seq", F.array_join(hy.extract_keywords(F.col("description")), ",").alias("words"))


@query("h5_function_from_description", f"SELECT gene_id, ev_seq, {_FUNCTION} AS function FROM evidence", ("evidence",))
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_view(spark, sf_dir).select("gene_id", "ev_seq", hy.function_from_description(F.col("description")).alias("function"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("gene_id", "function", "category", F.round("confidence", 6).alias("confidence"))


def _tier(name: str) -> str:
    return TIERS + f"SELECT gene_id, function, category, round(confidence, 6) AS confidence FROM {name}"


@query("h3_annotation_hypotheses", _tier("annotated"), ("evidence",))
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(hy.annotation_hypotheses(evidence_view(spark, sf_dir)))


@query("h4_homology_hypotheses", _tier("homologous"), ("evidence",))
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(hy.homology_hypotheses(evidence_view(spark, sf_dir)))


@query("h6_domain_hypotheses", _tier("domained"), ("evidence",))
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(hy.domain_hypotheses(evidence_view(spark, sf_dir)))


@query("h7_motif_hypotheses", _tier("motifs"), ("evidence",))
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(hy.motif_hypotheses(evidence_view(spark, sf_dir)))


@query("h8_motif_fallback", _tier("fallback"), ("evidence",))
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence_view(spark, sf_dir)
    higher = hy.annotation_hypotheses(rows).unionByName(hy.homology_hypotheses(rows)).unionByName(hy.domain_hypotheses(rows))
    return _shown(hy.motif_fallback(hy.motif_hypotheses(rows), higher))


@query("h9_combined_hypothesis", _tier("combined"), ("evidence",))
def h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(hy.combined_hypothesis(evidence_view(spark, sf_dir)))


@query("h10_merge_similar", _tier("merged"), ("evidence",))
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(hy.merge_similar(hy.all_tiers(hy.dealt(evidence_view(spark, sf_dir)), details=False)))


@query("h11_generate_hypotheses", TIERS + "SELECT gene_id, rank, function, category, round(confidence, 6) AS confidence FROM hyps", ("evidence",))
def h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hy.generate_hypotheses(evidence_view(spark, sf_dir), details=False).select("gene_id", "rank", "function", "category", F.round("confidence", 6).alias("confidence"))


def _scored(rows: DataFrame, details: bool = False) -> DataFrame:
    """Hypotheses of evidence that is dealt out, with confidence."""
    return ip.score_confidence(hy.generate_hypotheses(rows, details=details, deal=False), rows)


def _interpreted(rows: DataFrame, details: bool = False) -> DataFrame:
    return ip.interpret(ip.rank_hypotheses(_scored(rows, details)))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hy.dealt(evidence_view(spark, sf_dir))


@query("c1_score_confidence", TIERS + "SELECT gene_id, rank, round(adjusted, 6) AS adjusted FROM scored", ("evidence",))
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_dealt(spark, sf_dir)).select("gene_id", "rank", F.round("adjusted", 6).alias("adjusted"))


@query("c2_score_to_level", "SELECT gene_id, ev_seq, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'moderate' WHEN confidence >= 0.3 THEN 'low' ELSE 'speculative' END AS level FROM evidence", ("evidence",))
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_view(spark, sf_dir).select("gene_id", "ev_seq", ip.score_to_level(F.col("confidence")).alias("level"))


@query("c3_explain_differences")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.explain_differences(_scored(_dealt(spark, sf_dir)))


@query("c4_rank_hypotheses", TIERS + "SELECT gene_id, rank, final_rank FROM ranked", ("evidence",))
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.rank_hypotheses(_scored(_dealt(spark, sf_dir))).select("gene_id", "rank", "final_rank")


@query("c5_check_conflict", TIERS + "SELECT gene_id, severity FROM judged", ("evidence",))
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.check_conflict(ip.rank_hypotheses(_scored(_dealt(spark, sf_dir)))).select("gene_id", "severity")


@query("c6_interpret", TIERS + f"SELECT gene_id, hypothesis, round(score, 6) AS score, {_LEVEL} AS level, category, severity FROM final", ("evidence",))
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interpreted(_dealt(spark, sf_dir)).select("gene_id", "hypothesis", F.round("score", 6).alias("score"), "level", "category", "severity")


@query("c7_ncrna_interpretation", "SELECT genome_id AS gene_id, 'tRNA-' || flag AS hypothesis, 0.95::double AS score, 'high' AS level, 'ncRNA' AS category FROM spans WHERE flag <> 'N'", ("spans",))
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = view(spark, sf_dir, "spans").select(F.col("genome_id").alias("gene_id"), F.when(F.col("flag") == "N", "annotation").otherwise("tRNA_prediction").alias("source"), F.concat(F.lit("tRNA-"), "flag").alias("product"))
    return ip.ncrna_interpretation(genes)


@query("c8_uninterpreted", TIERS + "SELECT DISTINCT gene_id FROM evidence WHERE gene_id NOT IN (SELECT gene_id FROM final)", ("evidence",))
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.uninterpreted(rows := _dealt(spark, sf_dir), _interpreted(rows))


@query("c9_narrative")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.narrative(_interpreted(_dealt(spark, sf_dir), details=True))


_STRIPPED = "trim(description)"
for _pattern in ip.TRAILING:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?i){_pattern}', '')"
for _ in range(2):
    _STRIPPED = rf"regexp_replace({_STRIPPED}, '(?i)^(?:{'|'.join(ip.LEADING)}) \s*', '')"
_STRIPPED = rf"regexp_replace(regexp_replace({_STRIPPED}, '\s+', ' ', 'g'), '^[ ,;:]+|[ ,;:]+$', '', 'g')"
_KEPT = ", ".join(f"'{x}'" for x in ip.KEPT_PRODUCTS)


@query("n1_normalize_product", f"SELECT gene_id, ev_seq, CASE WHEN lower(trim(description)) IN ({_KEPT}) THEN trim(description) ELSE {_STRIPPED} END AS product FROM evidence", ("evidence",))
def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_view(spark, sf_dir).select("gene_id", "ev_seq", ip.normalize_product(F.col("description")).alias("product"))


@query("n2_first_pfam_id", "SELECT gene_id, arg_min(regexp_extract(description, '\\b(PF\\d{5})\\b', 1), ev_seq) AS pfam_id FROM evidence WHERE regexp_matches(description, '\\bPF\\d{5}\\b') GROUP BY 1", ("evidence",))
def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.first_pfam_id(evidence_view(spark, sf_dir))


_COG = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ip.CATEGORY_COG.items()) + " END"


@query(
    "n3_annotate_function",
    TIERS
    + f""", pfam AS (SELECT gene_id, arg_min(regexp_extract(description, '\\b(PF\\d{{5}})\\b', 1), ev_seq) AS pfam_id FROM evidence WHERE regexp_matches(description, '\\bPF\\d{{5}}\\b') GROUP BY 1)
    SELECT f.gene_id, coalesce(CASE WHEN pfam_id = 'PF00136' THEN 'L' END, {_COG}) AS cog_category, CASE WHEN pfam_id = 'PF00136' THEN 'pfam' WHEN {_COG} IS NOT NULL THEN 'inferred' ELSE 'none' END AS cog_source FROM final f LEFT JOIN pfam USING (gene_id)""",
    ("evidence",),
)
def n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families and their COG letters come from the evidence's own accessions."""
    rows = _dealt(spark, sf_dir)
    pfam = ip.first_pfam_id(rows)
    table = pfam.select("pfam_id").distinct().select("pfam_id", F.lit("L").alias("cog"))
    return ip.annotate_function(_interpreted(rows), pfam, table).select("gene_id", "cog_category", "cog_source")


_RESULTS = (
    TIERS
    + f""", called_level AS (SELECT gene_id, score, hypothesis, severity, {_LEVEL} AS level FROM final),
results AS (SELECT o.gene_id, 'ctg' || (cast(substr(o.gene_id, 2) AS bigint) % 20) AS genome_id, (cast(substr(o.gene_id, 2) AS bigint) * 7 % 400)::int AS protein_length,
    CASE WHEN cast(substr(o.gene_id, 2) AS bigint) % 9 = 0 THEN 0 ELSE evidence_count END AS evidence_count, score, hypothesis, severity, level FROM gathered o LEFT JOIN called_level USING (gene_id)),
novel AS (SELECT *, CASE WHEN evidence_count = 0 THEN 'dark_matter' WHEN severity = 'HIGH' AND score < 0.5 THEN 'conflict' WHEN score IS NULL OR round(score, 9) < 0.35 THEN 'weak_evidence' END AS novelty,
    CASE WHEN evidence_count = 0 THEN CASE WHEN protein_length > 300 THEN 0.95::double WHEN protein_length > 150 THEN 0.85::double WHEN protein_length > 50 THEN 0.75::double ELSE 0.55::double END WHEN severity = 'HIGH' AND score < 0.5 THEN 0.65::double
    ELSE least(0.5::double + CASE WHEN protein_length > 200 THEN 0.1::double ELSE 0 END + CASE WHEN evidence_count <= 1 THEN 0.05::double WHEN evidence_count >= 4 THEN -0.1::double ELSE 0 END, 0.75) END AS novelty_score FROM results),
candidates AS (SELECT * FROM novel WHERE novelty IS NOT NULL AND novelty_score >= 0.3) """
)


def results_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(_dealt(spark, sf_dir))


def results_of(rows: DataFrame, details: bool = False, told: DataFrame | None = None) -> DataFrame:
    """A row a gene with its interpretation (``told``, else made of the evidence), if any; every ninth gene counts as without evidence."""
    number = F.expr("cast(substring(gene_id, 2) AS bigint)")
    counts = ev.aggregate_evidence(rows).select("gene_id", F.when(number % 9 == 0, 0).otherwise(F.col("evidence_count")).alias("evidence_count"))
    joined = counts.join(_interpreted(rows, details) if told is None else told, "gene_id", "left")
    return joined.withColumns({"genome_id": F.concat(F.lit("ctg"), number % 20), "protein_length": (number * 7 % 400).cast("int")})


@query("v1_novelty", _RESULTS + "SELECT gene_id, novelty, round(novelty_score, 6) AS novelty_score FROM candidates", ("evidence",))
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.novelty(results_view(spark, sf_dir)).select("gene_id", "novelty", F.round("novelty_score", 6).alias("novelty_score"))


@query("v2_novelty_protein_length", 'SELECT genome_id, start, "end", CASE WHEN strand = 1 THEN 4 ELSE (("end" - start) // 3)::int END AS n FROM spans', ("spans",))
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    protein = F.when(F.col("strand") == 1, "MKV*")
    return view(spark, sf_dir, "spans").select("genome_id", "start", "end", ip.novelty_protein_length(protein, F.col("start"), F.col("end")).alias("n"))


@query("v3_suggested_experiments", _RESULTS + "SELECT gene_id, CASE WHEN novelty = 'dark_matter' AND protein_length > 150 THEN 4 WHEN novelty = 'conflict' THEN 4 ELSE 3 END AS n FROM candidates", ("evidence",))
def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.suggested_experiments(ip.novelty(results_view(spark, sf_dir))).select("gene_id", F.size("experiments").alias("n"))


@query("v4_novel_gene_report", _RESULTS + "SELECT genome_id, count(*) AS total, count_if(novelty = 'dark_matter') AS dark, count_if(novelty = 'weak_evidence') AS weak, count_if(novelty = 'conflict') AS conflicts, count_if(novelty = 'dark_matter') / count(*) AS dark_fraction FROM candidates GROUP BY 1", ("evidence",))
def v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.novel_gene_report(ip.novelty(results_view(spark, sf_dir)))


@query("v4_top_novel", _RESULTS + "SELECT genome_id, gene_id, novel_rank FROM (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY round(novelty_score, 9) DESC, gene_id) AS novel_rank FROM candidates) WHERE novel_rank <= 20", ("evidence",))
def v4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = ip.novelty(results_view(spark, sf_dir)).withColumn("novelty_score", F.round("novelty_score", 9))
    return ip.top_novel(rounded).select("genome_id", "gene_id", "novel_rank")


@query(
    "v5_interpretation_summary",
    _RESULTS + "SELECT genome_id, count(*) AS total, count(score) AS interpreted, count_if(level = 'high') AS high, count_if(level = 'moderate') AS moderate, count_if(level IN ('low', 'speculative')) AS low, count(*) - count(score) AS dark, count(score) / count(*) AS success_rate FROM results GROUP BY 1",
    ("evidence",),
)
def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.interpretation_summary(results_view(spark, sf_dir))


@query(
    "v6_report_tables",
    _RESULTS
    + """, b AS (SELECT *, CASE WHEN level = 'speculative' THEN 'low' ELSE level END AS bucket FROM results WHERE score IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY genome_id, bucket ORDER BY round(score, 6) DESC, gene_id) AS shown_rank, count(*) OVER (PARTITION BY genome_id, bucket) AS "of" FROM b)
    SELECT genome_id, bucket, gene_id, shown_rank, "of" FROM r WHERE shown_rank <= CASE WHEN bucket = 'low' THEN 5 ELSE 10 END""",
    ("evidence",),
)
def v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.report_tables(results_view(spark, sf_dir).withColumn("score", F.round("score", 6))).select("genome_id", "bucket", "gene_id", "shown_rank", "of")


@query("v7_conflict_table", _RESULTS + "SELECT genome_id, gene_id, severity, substr(hypothesis, 1, 50) AS hypothesis FROM (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY gene_id) AS r FROM results WHERE severity = 'HIGH') WHERE r <= 10", ("evidence",))
def v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.conflict_table(results_view(spark, sf_dir)).select("genome_id", "gene_id", "severity", "hypothesis")


@query("v8_novel_section", _RESULTS + "SELECT genome_id, gene_id, novel_rank, 3 AS n FROM (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY round(novelty_score, 9) DESC, gene_id) AS novel_rank FROM candidates) WHERE novel_rank <= 5", ("evidence",))
def v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = ip.novelty(results_view(spark, sf_dir)).withColumn("novelty_score", F.round("novelty_score", 9))
    return ip.novel_section(rounded).select("genome_id", "gene_id", "novel_rank", F.size("experiments").alias("n"))


@query("f8_search_report", _RESULTS + "SELECT gene_id, level FROM results WHERE contains(lower(hypothesis), 'polymerase') AND level IN ('low', 'speculative')", ("evidence",))
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip.search_report(results_view(spark, sf_dir).withColumn("reasoning", F.array().cast("array<string>")), "Polymerase", "LOW").select("gene_id", "level")


@query("w1_genome_support")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-frame ORFs, motifs of their proteins, evidence, hypotheses, confidence; counts by genome."""
    genomes = dealt_genomes(spark, sf_dir)
    found = orfs.orfs_with_sequence(genomes)
    genes = found.select("genome_id", F.concat_ws("|", "genome_id", "start", "end", "strand").alias("gene_id"), sq.translate_dna(F.col("sequence")).alias("protein_seq"))
    evidence = cut(ev.collect_evidence(ev.motif_evidence(mt.motif_scan(genes, mt.builtin_patterns(spark)))))
    scored = ip.rank_hypotheses(ip.score_confidence(hy.generate_hypotheses(evidence, details=False, deal=False), evidence))
    # every frame again, but without its sequence
    every = orfs.six_frame_orfs(genomes).select("genome_id", F.concat_ws("|", "genome_id", "start", "end", "strand").alias("gene_id"))
    return ip.interpretation_summary(every.join(ip.interpret(scored), "gene_id", "left"))


@query("w2_interpret_genomes")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way over every genome, with its long frames as annotated genes; summary by genome."""
    genomes = dealt_genomes(spark, sf_dir)
    products = ("DNA polymerase", "hypothetical protein", "capsid protein", "putative helicase")
    product = F.element_at(F.array(*[F.lit(x) for x in products]), (F.col("start") % len(products) + 1).cast("int"))
    known = orfs.six_frame_orfs(genomes, min_length=300).withColumn("product_name", product)
    return interpret_genomes(genomes, known, mt.builtin_patterns(spark), phage=True).summary


@query("g6_genome_summary")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    genomes = view(spark, sf_dir, "genomes")
    found = orfs.orfs_with_sequence(genomes)
    genes = orfs.orfs_to_genes(found)
    # a gene's id is made of its genome and place, so proteins need no join with genes
    proteins = found.select(orfs.gene_id().alias("gene_id"), sq.translate_dna(F.col("sequence")).alias("protein_seq"))
    return ev.genome_summary(genomes, genes, mt.motif_scan(proteins, mt.builtin_patterns(spark)))
