"""Queries over sequences and texts: validation, scalar functions, ORFs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoflux.functions import sequence as sq
from annoflux.operators import orfs
from annoflux.plans.registry import query
from annoflux.plans.views import view


@query("f1_valid_genome", "SELECT genome_id, regexp_full_match(sequence, '[ATGCNRYSWKMBDHV]*') AS valid FROM genomes", ("genomes",))
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "genomes").select("genome_id", F.col("sequence").rlike(sq.VALID_GENOME).alias("valid"))


@query("f2_normalise_gene_seq", "SELECT gene_id, translate(upper(protein_seq), 'RYWSKMBDHV', 'NNNNNNNNNN') AS seq FROM proteins", ("proteins",))
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "proteins").select("gene_id", sq.normalise_gene(F.col("protein_seq")).alias("seq"))


@query("f3_valid_protein", "SELECT gene_id, regexp_full_match(protein_seq, '[ACDEFGHIKLMNPQRSTVWYX*]*') AS valid FROM proteins", ("proteins",))
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "proteins").select("gene_id", F.col("protein_seq").rlike(sq.VALID_PROTEIN).alias("valid"))


@query("f4_valid_location", 'SELECT genome_id, start, "end" FROM spans WHERE start >= 0 AND "end" > start', ("spans",))
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "spans").where("start >= 0 AND `end` > start").select("genome_id", "start", "end")


@query("f5_valid_confidence", "SELECT gene_id, ev_seq FROM evidence WHERE confidence BETWEEN 0 AND 1", ("evidence",))
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "evidence").where(F.col("confidence").between(0, 1)).select("gene_id", "ev_seq")


_PLACEHOLDERS = ", ".join(f"'{x}'" for x in sq.PLACEHOLDERS)


@query(
    "f6_is_uninformative",
    rf"SELECT gene_id, ev_seq, lower(trim(description)) IN ({_PLACEHOLDERS}) OR regexp_matches(lower(trim(description)), '{sq.ORF_NAME}') AS uninformative FROM evidence",
    ("evidence",),
)
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "evidence").select("gene_id", "ev_seq", sq.is_uninformative(F.col("description")).alias("uninformative"))


@query("f7_hit_significance", "SELECT gene_id, hit_id, evalue < 1e-5 AS significant, identity_percent >= 70 AS high_identity, evalue < 0.01 AS domain_significant FROM hits", ("hits",))
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = view(spark, sf_dir, "hits")
    return hits.select("gene_id", "hit_id", (F.col("evalue") < 1e-5).alias("significant"), (F.col("identity_percent") >= 70).alias("high_identity"), (F.col("evalue") < 0.01).alias("domain_significant"))


@query("f9_display_name", "SELECT accession, coalesce(nullif(gene_name, ''), nullif(protein_name, ''), accession) AS shown FROM annotations", ("annotations",))
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "annotations").select("accession", sq.display_name(F.col("gene_name"), F.col("protein_name"), F.col("accession")).alias("shown"))


@query("f10_gene_by_name", "SELECT accession, gene_name FROM annotations WHERE gene_name = (SELECT min(gene_name) FROM annotations)", ("annotations",))
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotations = view(spark, sf_dir, "annotations")
    wanted = annotations.agg(F.min("gene_name").alias("gene_name"))
    return annotations.join(F.broadcast(wanted), "gene_name").select("accession", "gene_name")  # one row


@query("q1_reverse_complement", "SELECT genome_id, reverse(translate(regexp_replace(sequence, '[^ATGCN]', 'N', 'g'), 'ATGC', 'TACG')) AS revcomp FROM genomes", ("genomes",))
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "genomes").select("genome_id", sq.reverse_complement(F.col("sequence")).alias("revcomp"))


@query("q2_gc_content", "SELECT genome_id, 100.0::double * (length(sequence) - length(translate(sequence, 'GC', ''))) / length(sequence) AS gc FROM genomes", ("genomes",))
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "genomes").select("genome_id", sq.gc_percent(F.col("sequence"), None).alias("gc"))


_CODON = "substr(sequence, 3 * i + {}, 1)"
_AMINO = f"substr('{sq.AMINO_ACIDS}', 16 * (instr('TCAG', {_CODON.format(1)}) - 1) + 4 * (instr('TCAG', {_CODON.format(2)}) - 1) + instr('TCAG', {_CODON.format(3)}), 1)"


@query("q3_translate_dna", f"SELECT genome_id, array_to_string(list_transform(range(0, length(sequence) // 3), lambda i: {_AMINO}), '') AS protein FROM genomes", ("genomes",))
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "genomes").select("genome_id", sq.translate_dna(F.col("sequence")).alias("protein"))


@query("q4_protein_length", "SELECT gene_id, length(rtrim(protein_seq, '*')) AS n FROM proteins", ("proteins",))
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "proteins").select("gene_id", sq.protein_length(F.col("protein_seq")).alias("n"))


_COUNT = "(length(protein_seq) - length(replace(protein_seq, '{}', '')))"
_MASS = " + ".join(f"{_COUNT.format(x)} * {w}::double" for x, w in sq.WEIGHTS.items())
_KNOWN = " + ".join(_COUNT.format(x) for x in sq.WEIGHTS)


@query(
    "q5_molecular_weight",
    f"SELECT gene_id, round(0.0::double + {_MASS} + (length(protein_seq) - ({_KNOWN})) * 110.0::double - CASE WHEN length(protein_seq) > 1 THEN (length(protein_seq) - 1) * 18.015::double ELSE 0 END, 4) AS weight FROM proteins",
    ("proteins",),
)
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "proteins").select("gene_id", F.round(sq.molecular_weight(F.col("protein_seq"), None), 4).alias("weight"))


@query(
    "q6_aa_composition",
    "SELECT gene_id, letter, count(*) AS n FROM (SELECT gene_id, unnest(string_split(protein_seq, '')) AS letter FROM proteins) WHERE letter <> '' GROUP BY ALL",
    ("proteins",),
)
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "proteins").select("gene_id", F.explode(sq.composition(F.col("protein_seq"))).alias("letter", "n")).withColumn("n", F.col("n").cast("long"))


# -- codon events in SQL: both strands, kinds by position, the next stop by a window
EVENTS = """strands AS (SELECT genome_id, 1 AS strand, length(sequence) AS len, sequence AS s FROM genomes
    UNION ALL SELECT genome_id, -1, length(sequence), reverse(translate(sequence, 'ATGC', 'TACG')) FROM genomes),
codons AS (SELECT genome_id, strand, len, s, pos, pos % 3 AS frame, substr(s, pos + 1, 3) AS codon FROM (SELECT *, unnest(range(0, len - 2)) AS pos FROM strands)),
events AS (SELECT *, min(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN pos + 3 END) OVER (PARTITION BY genome_id, strand, frame ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop,
    len - ((len - frame) % 3) AS whole_end FROM codons WHERE codon IN ('TAA', 'TAG', 'TGA', 'ATG', 'GTG', 'TTG')),
begun AS (SELECT * FROM events WHERE codon IN ('ATG', 'GTG', 'TTG')), """
_FORWARD = 'CASE WHEN strand = 1 THEN pos ELSE len - stop END AS start, CASE WHEN strand = 1 THEN stop ELSE len - pos END AS "end"'
ORFS = EVENTS + f"orfs AS (SELECT genome_id, strand, frame, pos, stop, {_FORWARD} FROM begun WHERE stop - pos >= 100) "
LONGEST = EVENTS + f"longest AS (SELECT genome_id, strand, frame, min(pos) AS pos, stop, any_value(len) AS len FROM begun WHERE codon = 'ATG' AND stop IS NOT NULL GROUP BY genome_id, strand, frame, stop), rescue AS (SELECT *, {_FORWARD} FROM longest WHERE stop - pos >= 63) "
ALL_STARTS = EVENTS + f"nested AS (SELECT *, {_FORWARD} FROM begun WHERE stop - pos >= 153) "


@query("o1_six_frame_orfs", ORFS + "SELECT * FROM orfs", ("genomes",))
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.six_frame_orfs(view(spark, sf_dir, "genomes"))


@query(
    "o2_partial_orfs",
    EVENTS + "open AS (SELECT genome_id, strand, frame, pos, coalesce(stop, whole_end) AS stop, stop IS NULL AS partial, len FROM begun) SELECT genome_id, strand, frame, pos, stop, partial, " + _FORWARD + " FROM open WHERE stop - pos >= 100",
    ("genomes",),
)
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.six_frame_orfs(view(spark, sf_dir, "genomes"), include_partial=True)


@query("o3_longest_orf_per_stop", LONGEST + 'SELECT genome_id, strand, frame, pos, stop, start, "end" FROM rescue', ("genomes",))
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.longest_orf_per_stop(view(spark, sf_dir, "genomes"))


@query("o4_all_starts_orfs", ALL_STARTS + 'SELECT genome_id, strand, frame, pos, stop, start, "end" FROM nested', ("genomes",))
def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.all_starts_orfs(view(spark, sf_dir, "genomes"))


@query(
    "o5_orfs_to_genes",
    ORFS
    + """SELECT genome_id, sha256(concat_ws('|', genome_id, start, "end", strand, 'orf_prediction')) AS gene_id,
    'ORF_' || lpad(row_number() OVER (PARTITION BY genome_id ORDER BY start, "end", strand DESC, frame)::varchar, 4, '0') AS locus_tag, start, "end", strand,
    'hypothetical protein' AS product, 'orf_prediction' AS source FROM orfs""",
    ("genomes",),
)
def o5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orfs.orfs_to_genes(orfs.six_frame_orfs(view(spark, sf_dir, "genomes")))
