"""Queries over evidence rows, lookups and aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoflux.operators import evidence as ev
from annoflux.plans.registry import query
from annoflux.plans.views import view


def evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "evidence").withColumns({"domain_name": F.lit(None).cast("string"), "accession": F.lit(None).cast("string")})


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with annotations: the evidence view's descriptions as products, functions and notes."""
    rows = view(spark, sf_dir, "evidence")
    pick = lambda n: F.max(F.when(F.col("ev_seq") == n, F.col("description")))
    return rows.groupBy("gene_id").agg(pick(1).alias("product_name"), pick(2).alias("gb_function"), pick(3).alias("gb_note")).withColumn("protein_seq", F.lit("M"))


_GENES = """genes AS (SELECT gene_id, max(CASE WHEN ev_seq = 1 THEN description END) AS product, max(CASE WHEN ev_seq = 2 THEN description END) AS func, max(CASE WHEN ev_seq = 3 THEN description END) AS note FROM evidence GROUP BY 1), """
_SILENT = "(lower(trim({0})) IN ('hypothetical protein', 'predicted protein', 'unknown protein', 'uncharacterized protein', 'putative protein', 'conserved hypothetical protein', 'probable protein') OR regexp_matches(lower(trim({0})), '^(orf|gp|cds|gene|protein|hypothetical|putative\\s+orf)\\s*[\\d_\\-]+$'))"


@query(
    "e1_annotation_evidence",
    _GENES
    + f"""rows AS (SELECT gene_id, product AS description, 0.85::double AS confidence, 'genbank_product' AS source FROM genes WHERE NOT {_SILENT.format("product")} AND length(trim(product)) > 3
    UNION ALL SELECT gene_id, func, 0.80, 'genbank_function' FROM genes WHERE func <> '' AND NOT {_SILENT.format("func")} UNION ALL SELECT gene_id, note, 0.60, 'genbank_note' FROM genes WHERE length(note) > 5) SELECT * FROM rows""",
    ("evidence",),
)
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.annotation_evidence(_genes(spark, sf_dir)).select("gene_id", "description", "confidence", "source")


@query(
    "e3_blast_evidence",
    "SELECT gene_id, cast(floor(identity_percent) AS int)::varchar || '% identity to ' || substr(title, 1, 80) AS description, least(identity_percent::double / 100, 0.99) AS confidence FROM hits WHERE evalue < 1e-5",
    ("hits",),
)
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.blast_evidence(view(spark, sf_dir, "hits")).select("gene_id", "description", "confidence")


@query(
    "e4_local_hit_evidence",
    """SELECT gene_id, title AS description, least(identity_percent::double / 100, 1.0) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY hit_rank, hit_id, align_len, title) AS r
    FROM hits WHERE align_len >= 30 AND evalue <= 1e-5) WHERE r <= 10""",
    ("hits",),
)
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.local_hit_evidence(view(spark, sf_dir, "hits")).select("gene_id", "description", "confidence")


_UNIPROT = "a AS (SELECT *, CASE WHEN length % 30 = 0 THEN protein_name ELSE '' END AS function_text, length % 70 = 0 AS reviewed FROM annotations) "


@query(
    "e5_uniprot_evidence",
    _UNIPROT
    + "SELECT accession AS gene_id, CASE WHEN reviewed THEN 0.9::double WHEN function_text <> '' THEN 0.85::double ELSE 0.7::double END AS confidence, 'UniProt match: ' || protein_name || CASE WHEN function_text <> '' THEN ' - ' || substr(function_text, 1, 100) ELSE '' END AS description FROM a",
    ("annotations",),
)
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "annotations")
    keywords = F.when(F.col("length") % 70 == 0, F.array(F.lit("Reviewed"))).otherwise(F.array(F.lit("Kinase")))
    hits = a.withColumns({"function_text": F.when(F.col("length") % 30 == 0, F.col("protein_name")).otherwise(""), "keywords": keywords, "gene_id": F.col("accession"), "hit_rank": F.lit(1)})
    return ev.uniprot_evidence(hits).select("gene_id", "confidence", "description")


_LADDER = "CASE WHEN e < 1e-20 THEN 0.95::double WHEN e < 1e-10 THEN 0.9::double WHEN e < 1e-5 THEN 0.8::double WHEN e < 1e-3 THEN 0.7::double WHEN e < 0.01 THEN 0.6::double ELSE 0.45::double END"
_EVALUE = "CASE hit_rank WHEN 1 THEN 1e-25::double WHEN 2 THEN 1e-12::double WHEN 3 THEN 1e-7::double WHEN 4 THEN 1e-4::double WHEN 5 THEN 5e-3::double ELSE 0.5::double END"


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = view(spark, sf_dir, "hits")
    rank = F.col("hit_rank")
    evalue = F.when(rank == 1, 1e-25).when(rank == 2, 1e-12).when(rank == 3, 1e-7).when(rank == 4, 1e-4).when(rank == 5, 5e-3).otherwise(0.5)
    return hits.withColumns({"evalue": evalue, "description": F.col("title"), "domain_name": F.col("hit_id"), "accession": F.col("hit_id"), "score": F.col("align_len").cast("double")})


@query("e6_domain_evidence", f"d AS (SELECT gene_id, title, {_EVALUE} AS e FROM hits) SELECT gene_id, title AS description, {_LADDER} AS confidence FROM d WHERE e < 0.01", ("hits",))
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.domain_evidence(_domains(spark, sf_dir)).select("gene_id", "description", "confidence")


@query("e7_hmm_evidence", "SELECT gene_id, title AS description, least(align_len::double / 50, 1.0) AS confidence FROM hits WHERE align_len >= 20", ("hits",))
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.hmm_evidence(_domains(spark, sf_dir)).select("gene_id", "description", "confidence")


@query("e2_motif_evidence")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoflux.operators import motifs as mt

    return ev.motif_evidence(mt.motif_scan(view(spark, sf_dir, "proteins"), mt.builtin_patterns(spark))).select("gene_id", "motif_name", "description", "confidence")


_LAYERED = (
    _GENES
    + f"""l AS (SELECT gene_id, 0 AS layer, 0 AS layer_seq, 'sequence_feature' AS evidence_type, product AS description, 0.85::double AS confidence FROM genes WHERE NOT {_SILENT.format("product")} AND length(trim(product)) > 3
    UNION ALL SELECT gene_id, 0, 1, 'sequence_feature', func, 0.8 FROM genes WHERE func <> '' AND NOT {_SILENT.format("func")} UNION ALL SELECT gene_id, 0, 2, 'sequence_feature', note, 0.6 FROM genes WHERE length(note) > 5
    UNION ALL SELECT gene_id, 3, hit_rank, 'domain_hit', title, {_LADDER} FROM (SELECT *, {_EVALUE} AS e FROM hits) WHERE e < 0.01) """
)


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.collect_evidence(ev.annotation_evidence(_genes(spark, sf_dir)), ev.domain_evidence(_domains(spark, sf_dir)))


@query(
    "e8_collect_evidence",
    _LAYERED + "SELECT gene_id, row_number() OVER (PARTITION BY gene_id ORDER BY layer, layer_seq, evidence_type, description, confidence) AS ev_seq, evidence_type, description, confidence FROM l",
    ("evidence", "hits"),
)
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).select("gene_id", "ev_seq", "evidence_type", "description", "confidence")


@query(
    "e9_skipped_layers",
    _LAYERED + "SELECT name AS layer, count(*) AS n FROM genes, (VALUES (0, 'annotation'), (1, 'motif'), (2, 'uniprot'), (3, 'interpro'), (4, 'plugin')) AS v(i, name) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.gene_id = genes.gene_id AND l.layer = i) GROUP BY name",
    ("evidence", "hits"),
)
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.skipped_layers(_genes(spark, sf_dir), _layers(spark, sf_dir))


@query("e10_genome_evidence", "SELECT 'ctg' || (cast(substr(gene_id, 2) AS bigint) % 100) AS genome_id, gene_id, ev_seq, confidence FROM evidence", ("evidence",))
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence_view(spark, sf_dir)
    genes = rows.select("gene_id").distinct().withColumn("genome_id", F.concat(F.lit("ctg"), F.substring("gene_id", 2, 20).cast("long") % 100))
    return ev.genome_evidence(genes, rows).select("genome_id", "gene_id", "ev_seq", "confidence")


_NAMED = "g AS (SELECT gene_id, hit_id, title, split_part(title, ' [', 1) AS name FROM hits) "


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "hits").select("gene_id", "hit_id", "title", F.substring_index("title", " [", 1).alias("name"))


_FIRST = "f AS (SELECT *, row_number() OVER (PARTITION BY gene_name ORDER BY accession) AS hit_rank FROM annotations) "


@query("j6_lookup_by_name", _NAMED + ", " + _FIRST + "SELECT gene_id, name, accession, hit_rank FROM g JOIN f ON name = gene_name WHERE hit_rank <= 3", ("hits", "annotations"))
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.lookup_by_name(_named(spark, sf_dir), view(spark, sf_dir, "annotations")).select("gene_id", "name", "accession", "hit_rank")


@query(
    "j7_lookup_by_length",
    """p AS (SELECT gene_id, length(protein_seq) AS len FROM proteins), q AS (SELECT DISTINCT len FROM p WHERE len >= 10),
    r AS (SELECT len, accession, row_number() OVER (PARTITION BY len ORDER BY abs(length - len), accession) AS hit_rank FROM q JOIN annotations ON abs(length - len) <= 20)
    SELECT gene_id, accession, hit_rank FROM p JOIN r USING (len) WHERE hit_rank <= 3""",
    ("proteins", "annotations"),
)
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    proteins = view(spark, sf_dir, "proteins")
    genes = proteins.select("gene_id", "protein_seq", F.lit(None).cast("string").alias("name"))
    return ev.lookup_by_length(genes, view(spark, sf_dir, "annotations")).select("gene_id", "accession", "hit_rank")


@query(
    "j8_domains_by_name",
    _NAMED
    + ", "
    + _FIRST
    + """, one AS (SELECT gene_id, accession FROM g JOIN f ON name = gene_name WHERE hit_rank = 1), d AS (SELECT 'P' || l_partkey AS accession, l_orderkey AS domain_id FROM lineitem GROUP BY ALL),
    few AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY domain_id) AS hit_rank FROM d) SELECT gene_id, accession, domain_id, hit_rank FROM one JOIN few USING (accession) WHERE hit_rank <= 5""",
    ("hits", "annotations"),
)
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    domains = lines.select(F.concat(F.lit("P"), "l_partkey").alias("accession"), F.col("l_orderkey").alias("domain_id")).distinct()
    return ev.domains_by_name(_named(spark, sf_dir), view(spark, sf_dir, "annotations"), domains).select("gene_id", "accession", "domain_id", "hit_rank")


@query("j9_pfam_lookup", "t AS (SELECT accession AS hit, gene_name AS cog FROM annotations) SELECT gene_id, hit_id, cog FROM hits LEFT JOIN t ON 'sp|' || substr(hit, 2) = hit_id", ("hits", "annotations"))
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = view(spark, sf_dir, "annotations").select(F.concat(F.lit("sp|"), F.expr("substring(accession, 2)")).alias("pfam_id"), F.col("gene_name").alias("cog"))
    return ev.pfam_lookup(view(spark, sf_dir, "hits").withColumn("pfam_id", F.col("hit_id")), table).select("gene_id", "hit_id", "cog")


@query("j10_attach_gene", 'g AS (SELECT genome_id AS gene_id, min(start) AS start, max("end") AS "end", max(strand) AS strand FROM spans GROUP BY 1) SELECT s.genome_id AS gene_id, s.flag, g.start, g."end", g.strand FROM spans s LEFT JOIN g ON g.gene_id = s.genome_id', ("spans",))
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "spans")
    genes = spans.groupBy(F.col("genome_id").alias("gene_id")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("strand").alias("strand"))
    return ev.attach_gene(spans.select(F.col("genome_id").alias("gene_id"), "flag"), genes)


TYPED = """typed AS (SELECT gene_id, evidence_type, count(*) AS n, avg(confidence) AS mean, max(confidence) AS highest, min(ev_seq) AS first_seq,
    CASE evidence_type WHEN 'blast_homology' THEN 1.0::double WHEN 'motif_match' THEN 0.8::double WHEN 'domain_hit' THEN 0.9::double ELSE 0.5::double END * avg(confidence) * count(*) AS weighted FROM evidence GROUP BY gene_id, evidence_type),
gathered AS (SELECT gene_id, sum(weighted) AS total, sum(n)::bigint AS evidence_count, count(*) AS type_diversity, bool_or(evidence_type = 'blast_homology') AS has_homology, bool_or(evidence_type = 'motif_match') AS has_motifs,
    arg_max(evidence_type, round(weighted, 9) * 1000 - first_seq * 1e-7) AS strongest_type, max(CASE WHEN evidence_type = 'blast_homology' THEN highest END) AS best_homology, max(CASE WHEN evidence_type = 'domain_hit' THEN highest END) AS best_domain FROM typed GROUP BY 1) """


@query("g1_evidence_by_type", TYPED + "SELECT gene_id, evidence_type, n, highest, first_seq, round(mean, 6) AS mean, round(weighted, 6) AS weighted FROM typed", ("evidence",))
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.evidence_by_type(evidence_view(spark, sf_dir)).select("gene_id", "evidence_type", "n", "highest", "first_seq", F.round("mean", 6).alias("mean"), F.round("weighted", 6).alias("weighted"))


@query("g2_aggregate_evidence", TYPED + "SELECT gene_id, round(total, 6) AS total, evidence_count, type_diversity, has_homology, has_motifs, strongest_type FROM gathered", ("evidence",))
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.aggregate_evidence(evidence_view(spark, sf_dir)).select("gene_id", F.round("total", 6).alias("total"), "evidence_count", "type_diversity", "has_homology", "has_motifs", "strongest_type")


BEST = "best AS (SELECT e.*, row_number() OVER (PARTITION BY e.gene_id ORDER BY confidence DESC, first_seq, ev_seq) AS top_rank FROM evidence e JOIN typed t ON t.gene_id = e.gene_id AND t.evidence_type = e.evidence_type) "


@query("g3_top_evidence", TYPED + ", " + BEST + "SELECT gene_id, ev_seq, top_rank FROM best WHERE top_rank <= 5", ("evidence",))
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.top_evidence(evidence_view(spark, sf_dir)).select("gene_id", "ev_seq", "top_rank")


@query("g4_rank_genes_by_evidence", TYPED + "SELECT gene_id, round(total, 6) AS total FROM gathered ORDER BY total DESC", ("evidence",))
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rank_genes_by_evidence(evidence_view(spark, sf_dir)).withColumn("total", F.round("total", 6))


@query("g5_best_interpretation", "SELECT gene_id, max(confidence) AS score FROM evidence GROUP BY 1", ("evidence",))
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = evidence_view(spark, sf_dir).groupBy("gene_id").agg(F.max_by(F.struct("confidence", "description"), F.struct("confidence", -F.col("ev_seq"))).alias("b"))
    return best.select("gene_id", F.col("b.confidence").alias("score"))


@query("p1_evidence_plugins", "SELECT gene_id, title AS description FROM hits WHERE align_len >= 20", ("hits",))
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plugins, of which one is broken and skipped."""
    plugins = ev.EvidencePlugins()
    plugins.register("hmm", lambda genes: ev.hmm_evidence(genes))
    plugins.register("broken", lambda genes: genes.select("no_such_column"))
    return plugins.scan(_domains(spark, sf_dir)).select("gene_id", "description")
