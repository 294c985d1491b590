"""Queries over file formats: records are derived from the tables and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoflux.plans.registry import query
from annoflux.plans.views import view
from annoflux.sources import readers as rd


@query("s1_read_fasta", "SELECT genome_id AS name, 'sample of ' || genome_id || ' [Phage ' || substr(genome_id, 2) || ']' AS description, 'Phage ' || substr(genome_id, 2) AS organism, sequence, true AS valid FROM genomes", ("genomes",))
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr("substring(genome_id, 2)")
    header = F.concat(F.lit(">"), "genome_id", F.lit(" sample of "), "genome_id", F.lit(" [Phage "), number, F.lit("]"))
    folded = F.array_join(F.regexp_extract_all(F.lower("sequence"), F.lit(".{1,60}"), F.lit(0)), "\n")
    records = view(spark, sf_dir, "genomes").select(F.concat_ws("\n", header, folded).alias("value"))
    return rd.parse_fasta(records).select("name", "description", "organism", "sequence", "valid")


_GB = """LOCUS       %s  300 bp    DNA     linear   UNK
DEFINITION  Genome of %s.
ACCESSION   %s
KEYWORDS    test.
SOURCE      Phage
  ORGANISM  Phage %s
            Viruses.
FEATURES             Location/Qualifiers
     source          1..300
                     /db_xref="taxon:%d"
     gene            1..90
                     /gene="a"
                     /locus_tag="T1"
     CDS             1..90
                     /locus_tag="T1"
                     /product="capsid
                     protein"
     CDS             complement(100..198)
                     /note="second %s"
ORIGIN
%s"""


def _genbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    genomes = view(spark, sf_dir, "genomes")
    lines = F.array_join(F.transform(F.regexp_extract_all(F.lower("sequence"), F.lit(".{1,60}"), F.lit(0)), lambda x, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), x)), "\n")
    number = F.expr("cast(substring(genome_id, 2) AS int)")
    value = F.format_string(_GB, "genome_id", "genome_id", "genome_id", "genome_id", number, "genome_id", lines)
    return rd.parse_genbank_records(genomes.select(value.alias("value")))


@query("s2_read_genbank", "SELECT genome_id AS name, 'Genome of ' || genome_id AS definition, 'Phage ' || genome_id AS organism, cast(substr(genome_id, 2) AS int) AS taxonomy_id, sequence FROM genomes", ("genomes",))
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _genbank(spark, sf_dir).select("name", "definition", "organism", "taxonomy_id", "sequence")


@query(
    "s2_genbank_genes",
    """SELECT 'a' AS name, 'T1' AS locus_tag, 0::bigint AS start, 90::bigint AS "end", 1 AS strand, substr(sequence, 1, 90) AS sequence, 'capsid protein' AS product_name, NULL AS gb_note FROM genomes
    UNION ALL SELECT NULL, 'CDS_0002', 99, 198, -1, reverse(translate(substr(sequence, 100, 99), 'ATGC', 'TACG')), NULL, 'second ' || genome_id FROM genomes""",
    ("genomes",),
)
def s2_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.genbank_genes(_genbank(spark, sf_dir)).select("name", "locus_tag", "start", "end", "strand", "sequence", "product_name", "gb_note")


@query(
    "s3_detect_format",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fasta' WHEN 1 THEN 'genbank' WHEN 2 THEN 'genbank' ELSE NULL END AS format FROM documents",
)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    kind = F.col("doc_id") % 4
    path = F.concat(F.lit("/in/x"), "doc_id", F.when(kind == 0, ".FNA").when(kind == 1, ".gbk").otherwise(".txt"))
    return docs.select("doc_id", rd.detect_format(path, F.when(kind == 2, "LOCUS  x").otherwise("?")).alias("format"))


@query("s4_read_prosite", "SELECT upper(accession) AS id, accession, protein_name AS description, '[AG]-x(4)-G-K-[ST]' AS pattern, length % 20 = 0 AS skip FROM annotations", ("annotations",))
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    skip = F.when(F.col("length") % 20 == 0, "CC   /SKIP-FLAG=TRUE;\n").otherwise("")
    text = F.concat(F.lit("ID   "), F.upper("accession"), F.lit("; PATTERN.\nAC   "), "accession", F.lit(";\nDE   "), "protein_name", F.lit("\nPA   [AG]-x(4)-G-\nPA   K-[ST].\n"), skip)
    return rd.parse_prosite(view(spark, sf_dir, "annotations").select(text.alias("value")))


@query("m1_prosite_to_regex", "SELECT accession, CASE length % 3 WHEN 0 THEN '[AG].{4}GK[ST]' WHEN 1 THEN '^M[^P].{2,3}C$' ELSE 'A{2}.[ST]' END AS regex FROM annotations", ("annotations",))
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoflux.operators.motifs import prosite_to_regex

    pattern = F.when(F.col("length") % 3 == 0, "[AG]-x(4)-G-K-[ST].").when(F.col("length") % 3 == 1, "<M-{P}-x(2,3)-C>.").otherwise("A(2)-x-[ST](3).")
    return view(spark, sf_dir, "annotations").select("accession", prosite_to_regex(pattern).alias("regex"))


@query("s5_read_pfam_table", "SELECT accession AS pfam_id, gene_name AS pfam_name, 'L' AS cog, 'GO:1,GO:' || length AS terms FROM annotations WHERE length % 30 <> 0", ("annotations",))
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat_ws("\t", "accession", "gene_name", F.lit("L"), F.concat(F.lit("GO:1|GO:"), "length"))
    lines = view(spark, sf_dir, "annotations").select(F.when(F.col("length") % 30 == 0, F.concat(F.lit("# "), row)).otherwise(row).alias("value"))
    return rd.parse_pfam_table(lines).select("pfam_id", "pfam_name", "cog", F.array_join("go_terms", ",").alias("terms"))


@query(
    "s6_blast_hits",
    "SELECT hit_id, title, evalue, align_len, align_len % 7 AS mismatches, align_len % 7 AS gap_opens, round_even(100.0::double * (align_len - align_len % 7) / align_len, 1) > 90 AS close FROM hits",
    ("hits",),
)
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, gaps, zero = F.col("align_len"), F.col("align_len") % 7, F.lit(1)
    segment = F.struct(
        F.lit(50.0).alias("Hsp_bit-score"), F.col("evalue").alias("Hsp_evalue"), (n - gaps).alias("Hsp_identity"), n.alias("Hsp_align-len"), gaps.alias("Hsp_gaps"),
        zero.alias("Hsp_query-from"), n.alias("Hsp_query-to"), zero.alias("Hsp_hit-from"), n.alias("Hsp_hit-to"),
    )
    hits = view(spark, sf_dir, "hits").select(F.col("hit_id").alias("Hit_id"), F.col("title").alias("Hit_def"), F.col("hit_id").alias("Hit_accession"), F.struct(F.array(segment).alias("Hsp")).alias("Hit_hsps"))
    return rd.shape_blast(hits).select("hit_id", "title", "evalue", "align_len", "mismatches", "gap_opens", (F.col("identity_percent") > 90).alias("close"))


@query("s7_diamond_hits", "SELECT gene_id, hit_id, identity_percent::double AS identity_percent, align_len, title FROM hits WHERE hit_rank <= 5", ("hits",))
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat_ws("\t", "gene_id", "hit_id", "identity_percent", "align_len", "evalue", F.lit("50"), "title")
    lines = view(spark, sf_dir, "hits").select(F.when(F.col("hit_rank") <= 5, full).otherwise(F.col("gene_id")).alias("value"))
    return rd.parse_diamond(lines).select("gene_id", "hit_id", "identity_percent", "align_len", "title")


def _gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("flag") == "A", "rRNA").otherwise("CDS")
    row = F.concat_ws("\t", "genome_id", F.lit("tool"), kind, F.col("start") + 1, "end", F.lit("."), F.when(F.col("strand") == -1, "-").otherwise("+"), F.lit("0"), F.concat(F.lit("ID=1;product=16S "), "flag"))
    return view(spark, sf_dir, "spans").select(row.alias("value"))


@query("s8_rrna_gff", "SELECT genome_id, start, \"end\", strand, '16S A' AS product, 'rRNA_prediction' AS source FROM spans WHERE flag = 'A' AND \"end\" <= 150000", ("spans",))
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = view(spark, sf_dir, "spans").select("genome_id").distinct().withColumn("length", F.lit(150_000))
    return rd.rrna_gff(_gff(spark, sf_dir), lengths)


@query("s9_cds_gff", "SELECT genome_id, start, \"end\", strand FROM spans WHERE flag <> 'A'", ("spans",))
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.cds_gff(_gff(spark, sf_dir))


@query("s10_trna_lines", "SELECT 'tRNA-' || flag || '(cgc)' AS product, start, \"end\", strand, 'tRNA_prediction' AS source FROM spans", ("spans",))
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  3.  tRNA-"), "flag", F.lit("(cgc)   "), F.when(F.col("strand") == -1, "c").otherwise(""), F.lit("["), F.col("start") + 1, F.lit(","), "end", F.lit("]  74 bp"))
    return rd.trna_lines(view(spark, sf_dir, "spans").select(line.alias("value")))


@query("s11_uniprot_entries", "SELECT accession, protein_name, 'E. coli' AS organism, gene_name, length, 'does ' || gene_name AS function_text, 1 AS n_go FROM annotations", ("annotations",))
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda c: F.struct(c.alias("value"))
    entry = F.struct(
        F.col("accession").alias("primaryAccession"),
        F.struct(F.struct(value(F.col("protein_name")).alias("fullName")).alias("recommendedName")).alias("proteinDescription"),
        F.struct(F.lit("E. coli").alias("scientificName")).alias("organism"),
        F.array(F.struct(value(F.col("gene_name")).alias("geneName"))).alias("genes"),
        F.array(F.struct(F.lit("FUNCTION").alias("commentType"), F.array(value(F.concat(F.lit("does "), "gene_name"))).alias("texts"))).alias("comments"),
        F.array(F.struct(F.lit("GO").alias("database"), F.lit("GO:1").alias("id")), F.struct(F.lit("PDB").alias("database"), F.lit("1ABC").alias("id"))).alias("uniProtKBCrossReferences"),
        F.struct("length").alias("sequence"),
    )
    parsed = rd.parse_uniprot(view(spark, sf_dir, "annotations").select(F.to_json(entry).alias("value")))
    return parsed.select("accession", "protein_name", "organism", F.col("gene_names")[0].alias("gene_name"), "length", "function_text", F.size("go_terms").alias("n_go"))


@query("s12_interpro_entries", "SELECT accession AS gene_id, unnest(range(0, least(length // 10 % 8, 5)::int))::int AS hit_rank, 1e-10::double AS evalue FROM annotations", ("annotations",))
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("length") / 10) % 8
    results = F.transform(F.slice(F.sequence(F.lit(0), F.lit(8)), F.lit(1), n.cast("int")), lambda i: F.struct(F.struct(F.concat(F.lit("IPR"), i).alias("accession"), F.lit("domain").alias("name")).alias("metadata")))
    records = view(spark, sf_dir, "annotations").select(F.col("accession").alias("gene_id"), F.to_json(F.struct(results.alias("results"))).alias("value"))
    return rd.parse_interpro(records).select("gene_id", "hit_rank", "evalue")


@query("s13_hmm_domains", "SELECT gene_id, hit_id, least(align_len::double / 50, 1.0) AS confidence FROM hits WHERE align_len >= 20", ("hits",))
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rd.hmm_domains(view(spark, sf_dir, "hits").withColumn("score", F.col("align_len").cast("double"))).select("gene_id", "hit_id", "confidence")
