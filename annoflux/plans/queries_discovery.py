"""Queries over gene discovery, interval joins and motifs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoflux.operators import discovery as dc
from annoflux.operators import intervals as iv
from annoflux.operators import motifs as mt
from annoflux.operators import orfs
from annoflux.plans.queries_sequence import ALL_STARTS, EVENTS, LONGEST, ORFS
from annoflux.plans.registry import query
from annoflux.plans.views import dealt_genomes, view


def _genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "genomes")


def _known(genomes: DataFrame) -> DataFrame:
    """Known genes of the fixture genomes: their six-frame ORFs of 300 bases and more."""
    return orfs.six_frame_orfs(genomes, min_length=300).withColumn("source", F.lit("annotation"))


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(_genomes(spark, sf_dir))


_KNOWN = ORFS + ", genes AS (SELECT * FROM orfs WHERE stop - pos >= 300) "


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spans flagged A against spans flagged R."""
    spans = view(spark, sf_dir, "spans")
    return spans.where("flag = 'A'").drop("flag"), spans.where("flag = 'R'").drop("flag")


_AR = "a AS (SELECT genome_id, start, \"end\", strand FROM spans WHERE flag = 'A'), r AS (SELECT genome_id, start, \"end\", strand FROM spans WHERE flag = 'R') "
_MEETS = 'r.genome_id = a.genome_id AND a.start < r."end" AND a."end" > r.start'


@query("j1_overlaps", _AR + f"SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_MEETS})", ("spans",))
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.without_overlap(*_pair(spark, sf_dir))


@query("j1_overlap_pairs", _AR + f'SELECT a.*, r.start AS r_start, r."end" AS r_end, r.strand AS r_strand FROM a JOIN r ON {_MEETS}', ("spans",))
def j1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.overlap_join(*_pair(spark, sf_dir))


@query("j2_covered_by", _AR + f'SELECT * FROM a WHERE EXISTS (SELECT 1 FROM r WHERE {_MEETS} AND (least(a."end", r."end") - greatest(a.start, r.start))::double / (a."end" - a.start) > 0.5)', ("spans",))
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.covered_by(*_pair(spark, sf_dir))


@query("j3_overlaps_parent", _AR + f"SELECT * FROM a WHERE EXISTS (SELECT 1 FROM r WHERE {_MEETS})", ("spans",))
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.overlaps_parent(*_pair(spark, sf_dir))


@query("j4_near_duplicate", _AR + 'SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.genome_id = a.genome_id AND r.strand = a.strand AND abs(r.start - a.start) < 9 AND abs(r."end" - a."end") < 9)', ("spans",))
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.near_duplicate(*_pair(spark, sf_dir))


@query("j5_genes_in_region", 'SELECT genome_id, start, "end", strand FROM spans WHERE start < 60000 AND "end" > 50000', ("spans",))
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.genes_in_region(view(spark, sf_dir, "spans").drop("flag"), 50_000, 60_000)


@query(
    "b1_reciprocal_overlap",
    _AR + f'SELECT a.start, a."end", r.start AS r_start, r."end" AS r_end, (least(a."end", r."end") - greatest(a.start, r.start))::double / greatest(a."end" - a.start, r."end" - r.start) AS overlap FROM a JOIN r ON {_MEETS}',
    ("spans",),
)
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = iv.overlap_join(*_pair(spark, sf_dir))
    return pairs.select("start", "end", "r_start", "r_end", iv.reciprocal_overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")).alias("overlap"))


@query(
    "o6_needs_orfs",
    _KNOWN + "SELECT g.genome_id, coalesce(c.n, 0) AS n_genes, coalesce(c.n, 0) = 0 OR (length(g.sequence) / 1000.0 >= 5 AND coalesce(c.n, 0) / (length(g.sequence) / 1000.0) < 0.3) AS needs FROM genomes g LEFT JOIN (SELECT genome_id, count(*) AS n FROM genes GROUP BY 1) c ON c.genome_id = g.genome_id",
    ("genomes",),
)
def o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.needs_orfs(_genomes(spark, sf_dir), _genes(spark, sf_dir))


@query("o7_fill_orfs", _KNOWN + 'SELECT genome_id, strand, frame, pos, stop, start, "end" FROM orfs a WHERE NOT EXISTS (SELECT 1 FROM genes r WHERE ' + _MEETS + ")", ("genomes",))
def o7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.fill_orfs(orfs.six_frame_orfs(_genomes(spark, sf_dir)), _genes(spark, sf_dir))


_UPSTREAM = "s AS (SELECT genome_id AS gid, strand AS st, s AS letters FROM strands), "
_RBS = "(contains(w, 'AGGAGG')::int + contains(w, 'GGAGG')::int + contains(w, 'AGGAG')::int)"
_WINDOW = "substr(letters, greatest(pos - 14, 0) + 1, greatest(pos - 4 - greatest(pos - 14, 0), 0)) AS w"
_RESCUED = LONGEST + f", near AS (SELECT rescue.*, {_WINDOW} FROM rescue JOIN (SELECT genome_id AS gid, strand AS st, s AS letters FROM strands) ON gid = genome_id AND st = strand) "


@query("q7_rbs_count", _RESCUED + f'SELECT genome_id, strand, start, "end", {_RBS} AS rbs FROM near', ("genomes",))
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.rescue_candidates(_genomes(spark, sf_dir)).select("genome_id", "strand", "start", "end", "rbs")


_SD = " , ".join(
    f"list_max(list_transform(range(0, 12), lambda i: CASE WHEN substr(w, i + 1, {len(m)}) = '{m}' THEN {w}::double * greatest(0.0::double, 1.0::double - abs(round_even(pos - lo - i - {len(m) / 2.0}, 0) - 9) / 6.0::double) ELSE 0.0::double END))"
    for m, w in (("AGGAGG", 1.0), ("GGAGG", 0.75), ("AGGAG", 0.65))
)
_NEAR = (
    ALL_STARTS
    + ", near AS (SELECT nested.*, greatest(pos - 15, 0) AS lo, substr(letters, greatest(pos - 15, 0) + 1, greatest(pos - 3 - greatest(pos - 15, 0), 0)) AS w, substr(letters, pos + 1, stop - pos) AS seq FROM nested JOIN (SELECT genome_id AS gid, strand AS st, s AS letters FROM strands) ON gid = genome_id AND st = strand) "
)


@query("q9_weighted_sd_score", _NEAR + f'SELECT genome_id, strand, start, "end", CASE WHEN pos < 3 THEN 0.0::double ELSE greatest({_SD}) END AS sd FROM near', ("genomes",))
def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.nested_candidates(_genomes(spark, sf_dir)).select("genome_id", "strand", "start", "end", "sd")


@query("q8_position_weight", 'SELECT genome_id, start, "end", greatest(0.0::double, 1.0::double - abs(("end" - start) % 20 - 9) / 6.0::double) AS w FROM spans', ("spans",))
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoflux.functions.sequence import position_weight

    return view(spark, sf_dir, "spans").select("genome_id", "start", "end", position_weight((F.col("end") - F.col("start")) % 20).alias("w"))


_USAGE = (
    _KNOWN
    + """, coded AS (SELECT g.genome_id, CASE WHEN g.strand = 1 THEN substr(sequence, g.start + 1, g."end" - g.start)
      ELSE substr(sequence, g.start + 1, g."end" - g.start) END AS seq FROM genes g JOIN genomes ON genomes.genome_id = g.genome_id),
    every AS (SELECT genome_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM coded),
    counted AS (SELECT genome_id, substr(seq, 3 * i + 1, 3) AS codon, count(*) AS n FROM every GROUP BY ALL),
    usage AS (SELECT genome_id, codon, n::double / sum(n) OVER (PARTITION BY genome_id) AS frequency FROM counted) """
)


@query("q10_codon_usage", _USAGE + "SELECT genome_id, codon, round(frequency, 9) AS frequency FROM usage", ("genomes",))
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In reference orientation a reverse gene's coding strand is complemented again: the forward letters."""
    genes = dc.with_sequences(_genes(spark, sf_dir), _genomes(spark, sf_dir))
    return dc.codon_usage(genes).withColumn("frequency", F.round("frequency", 9))


_SCORED = _USAGE.replace("usage AS (", "usage AS MATERIALIZED (")


@query(
    "q11_codon_score",
    _SCORED
    + """, ones AS (SELECT genome_id, start, "end", strand, substr(letters, pos + 1, stop - pos) AS seq FROM genes JOIN (SELECT genome_id AS gid, strand AS st, s AS letters FROM strands) ON gid = genome_id AND st = strand),
    split AS (SELECT genome_id, start, "end", strand, unnest(range(0, length(seq) // 3)) AS i, seq FROM ones)
    SELECT split.genome_id, start, "end", strand, round(avg(coalesce(frequency, 0)), 9) AS codon_score FROM split LEFT JOIN usage ON usage.genome_id = split.genome_id AND codon = substr(seq, 3 * i + 1, 3) GROUP BY ALL""",
    ("genomes",),
)
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    genomes = _genomes(spark, sf_dir)
    genes = dc.with_sequences(_genes(spark, sf_dir), genomes)
    return dc.codon_score(genes, dc.codon_usage(genes)).select("genome_id", "start", "end", "strand", F.round("codon_score", 9).alias("codon_score"))


_STRANDED = "(SELECT genome_id AS gid, strand AS st, s AS letters FROM strands) ON gid = genome_id AND st = strand"


def _rated(source: str, extra: str) -> str:
    """Common tables that give the rows of ``source`` (with seq and ``extra``) their codon score."""
    return f"""split AS (SELECT genome_id, start, "end", strand, {extra}, unnest(range(0, length(seq) // 3)) AS i, seq FROM {source}),
    rated AS (SELECT split.genome_id, start, "end", strand, {extra}, avg(coalesce(frequency, 0)) AS codon_score FROM split LEFT JOIN usage ON usage.genome_id = split.genome_id AND codon = substr(seq, 3 * i + 1, 3) GROUP BY ALL)
    SELECT genome_id, start, "end", strand, {extra}, round(codon_score, 6) AS codon_score FROM rated """


_SHORT = (
    _SCORED + ", " + LONGEST[len(EVENTS) :] + f", near AS (SELECT rescue.*, letters, {_WINDOW} FROM rescue JOIN {_STRANDED}), "
    + f"""gated AS (SELECT genome_id, strand, start, "end", {_RBS} AS rbs, substr(letters, pos + 1, stop - pos) AS seq FROM near),
    free AS (SELECT * FROM gated a WHERE rbs > 0 AND NOT EXISTS (SELECT 1 FROM genes r WHERE {_MEETS} AND (least(a."end", r."end") - greatest(a.start, r.start))::double / (a."end" - a.start) > 0.5)), """
)
_INNER = (
    _SCORED + ", " + _NEAR[len(EVENTS) :] + f""", strong AS (SELECT genome_id, strand, start, "end", seq, CASE WHEN pos < 3 THEN 0.0::double ELSE greatest({_SD}) END AS sd FROM near),
    inner_ AS (SELECT * FROM strong a WHERE sd >= 0.7 AND EXISTS (SELECT 1 FROM genes r WHERE {_MEETS})
      AND NOT EXISTS (SELECT 1 FROM genes r WHERE r.genome_id = a.genome_id AND r.strand = a.strand AND abs(r.start - a.start) < 9 AND abs(r."end" - a."end") < 9)), """
)


@query("o8_short_orf_rescue", _SHORT + _rated("free", "rbs") + "WHERE codon_score >= 0.010", ("genomes",))
def o8(spark: SparkSession, sf_dir: str) -> DataFrame:
    genomes, genes = _genomes(spark, sf_dir), _genes(spark, sf_dir)
    return dc.short_orf_rescue(genomes, genes, dc.codon_usage(dc.with_sequences(genes, genomes))).select("genome_id", "start", "end", "strand", "rbs", F.round("codon_score", 6).alias("codon_score"))


# the scan of the rescue over the hosts' parts instead of the genomes
_HOSTED = re.sub(r"\b(strands|codons|events|begun|longest|rescue|near)\b", r"host_\1", _RESCUED).replace("FROM genomes", "FROM regions")
_REGIONS = """, hosts AS (SELECT DISTINCT genome_id, start, "end" FROM genes WHERE "end" - start >= 66), regions AS (SELECT row_number() OVER () AS genome_id, h.genome_id AS host_of, start AS h_start, "end" AS h_end,
    substr(g.sequence, start + 1, "end" - start) AS sequence FROM hosts h JOIN genomes g ON g.genome_id = h.genome_id), """


@query(
    "o9_rescue_nested_scan",
    _KNOWN
    + _REGIONS
    + _HOSTED
    + f""", found AS (SELECT r.host_of AS genome_id, n.start + h_start AS start, n."end" + h_start AS "end", strand, h_start, h_end, {_RBS} AS rbs FROM host_near n JOIN regions r ON r.genome_id = n.genome_id)
    SELECT DISTINCT * FROM found WHERE rbs > 0 AND (start <> h_start OR "end" <> h_end)""",
    ("genomes",),
)
def o9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.rescue_nested_scan(_genomes(spark, sf_dir), _genes(spark, sf_dir))


@query("o10_nested_orfs", _INNER + _rated("inner_", "sd") + "WHERE codon_score >= 0.012", ("genomes",))
def o10(spark: SparkSession, sf_dir: str) -> DataFrame:
    genomes = dealt_genomes(spark, sf_dir)
    genes = _known(genomes)
    return dc.nested_orfs(genomes, genes, dc.codon_usage(dc.with_sequences(genes, genomes))).select("genome_id", "start", "end", "strand", "sd", F.round("codon_score", 6).alias("codon_score"))


@query(
    "o11_add_ncrna",
    """g AS (SELECT genome_id, start, "end", strand, 'annotation' AS source FROM spans WHERE flag = 'A'), t AS (SELECT genome_id, start, "end", strand, 'tRNA_prediction' AS source FROM spans WHERE flag = 'R'),
    u AS (SELECT genome_id, start, "end", strand, 'rRNA_prediction' AS source FROM spans WHERE flag = 'N'),
    gt AS (SELECT * FROM g UNION ALL SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM g r WHERE """
    + _MEETS
    + ")) SELECT * FROM gt UNION ALL SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM gt r WHERE "
    + _MEETS
    + ")",
    ("spans",),
)
def o11(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "spans")
    kinds = [spans.where(F.col("flag") == f).withColumn("source", F.lit(s)) for f, s in (("A", "annotation"), ("R", "tRNA_prediction"), ("N", "rRNA_prediction"))]
    return dc.add_ncrna(*kinds)


@query("o12_gene_discovery")
def o12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order, with short frames standing in for the finders' tRNA and rRNA."""
    genomes = dealt_genomes(spark, sf_dir)
    short = orfs.longest_orf_per_stop(genomes, 20).where(F.col("end") - F.col("start") < 100)
    trna, rrna = (short.where(F.col("strand") == s).select("genome_id", "start", "end", "strand") for s in (1, -1))
    return dc.gene_discovery(genomes, _known(genomes).where(F.col("end") - F.col("start") >= 360), trna=trna, rrna=rrna)


@query("u1_union_and_distinct", "SELECT DISTINCT genome_id, start, \"end\", strand FROM spans WHERE flag IN ('A', 'R')", ("spans",))
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, r = _pair(spark, sf_dir)
    return a.unionByName(r).dropDuplicates(["genome_id", "start", "end", "strand"])


_PATTERNS = "patterns AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{n}', '{p}', '{c}', {w}::double)" for o, n, p, _, c, w in mt.BUILTIN) + ") AS t(ord, name, pattern, category, weight)) "
_SCORE = "CASE WHEN length(m) / floor(length(replace(replace(pattern, '[', ''), ']', '')) / 2) BETWEEN 0.8 AND 1.2 THEN weight * 1.1::double ELSE weight END"
_MATCHES = _PATTERNS + f", hit AS (SELECT gene_id, ord, name, category, weight, pattern, unnest(regexp_extract_all(protein_seq, pattern)) AS m FROM proteins, patterns), scored AS (SELECT *, least({_SCORE}, 1.0::double) AS score FROM hit WHERE {_SCORE} >= 0.3) "


@query("m5_motif_scan", _MATCHES + "SELECT gene_id, ord, name, m AS matched, round(score, 6) AS score FROM scored", ("proteins",))
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mt.motif_scan(view(spark, sf_dir, "proteins"), mt.builtin_patterns(spark))
    return found.select("gene_id", "ord", "name", "matched", F.round("score", 6).alias("score"))


@query("m5_motif_places")
def m5_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.motif_scan(view(spark, sf_dir, "proteins"), mt.builtin_patterns(spark)).select("gene_id", "name", "start", "end")


@query("m6_scan_categories", _MATCHES + "SELECT gene_id, name, count(*) AS n FROM scored WHERE category IN ('domain', 'signal') GROUP BY ALL", ("proteins",))
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mt.scan_categories(mt.builtin_patterns(spark), "domain", "signal")
    return mt.motif_scan(view(spark, sf_dir, "proteins"), chosen).groupBy("gene_id", "name").agg(F.count("*").alias("n"))


@query("m7_motif_catalogue", _MATCHES + "SELECT category, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM scored GROUP BY category", ("proteins",))
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of the motifs that occur."""
    return mt.motif_catalogue(mt.motif_scan(view(spark, sf_dir, "proteins"), mt.builtin_patterns(spark)))


@query("m8_motif_report")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    proteins = view(spark, sf_dir, "proteins")
    return mt.motif_report(proteins, mt.motif_scan(proteins, mt.builtin_patterns(spark)))


_PROSITE = "SELECT accession, lower(gene_name) AS name, {} FROM annotations"


@query(
    "m2_prosite_weights",
    "SELECT accession, CASE WHEN contains(lower(protein_name), 'phosphorylation') OR contains(lower(protein_name), 'kinase') THEN 0.3::double WHEN contains(lower(protein_name), 'myristyl') OR contains(lower(protein_name), 'glycosylation') OR contains(lower(protein_name), 'amidation') THEN 0.4::double WHEN length % 20 = 0 THEN 0.6::double ELSE 0.85::double END AS weight FROM annotations",
    ("annotations",),
)
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "annotations").select("accession", mt.prosite_weight(F.col("protein_name"), F.col("length") % 20 == 0).alias("weight"))


_ANY = lambda *w: "(" + " OR ".join(f"contains(lower(protein_name), '{x}')" for x in w) + ")"
_CATEGORY = (
    f"CASE WHEN {_ANY('phosphorylation', 'kinase', 'glycosylation', 'glycan', 'myristyl', 'amidation')} THEN 'modification' WHEN {_ANY('zinc', 'metal', 'iron', 'copper', 'dna', 'rna', 'nucleic')} THEN 'domain' "
    f"WHEN {_ANY('membrane', 'transmembrane')} THEN 'topology' WHEN {_ANY('signal', 'targeting')} THEN 'signal' WHEN {_ANY('active site', 'catalytic')} THEN 'active_site' ELSE 'domain' END"
)


@query("m3_prosite_category", f"SELECT accession, {_CATEGORY} AS category FROM annotations", ("annotations",))
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "annotations").select("accession", mt.prosite_category(F.col("protein_name")).alias("category"))


@query("m4_prosite_summary", f"SELECT {_CATEGORY} AS category, count(*) AS n FROM annotations GROUP BY 1", ("annotations",))
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.prosite_summary(view(spark, sf_dir, "annotations").select(mt.prosite_category(F.col("protein_name")).alias("category")))


@query("m9_scan_gate", "SELECT gene_id FROM proteins WHERE replace(gene_id, 'd', 'g') NOT IN (SELECT gene_id FROM evidence WHERE evidence_type = 'sequence_feature' AND confidence >= 0.8)", ("proteins", "evidence"))
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = view(spark, sf_dir, "proteins").withColumn("sequence", F.lit(None).cast("string"))
    evidence = view(spark, sf_dir, "evidence").withColumn("gene_id", F.translate("gene_id", "g", "d"))
    return mt.scan_gate(genes, evidence).select("gene_id")
