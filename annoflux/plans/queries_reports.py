"""Queries over evaluation of gene calls, catalogues, exports and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoflux.functions import sequence as sq
from annoflux.operators import evaluation as bm
from annoflux.operators import orfs
from annoflux.plans.queries_interpret import _RESULTS, _dealt, _interpreted, _scored, results_of, results_view
from annoflux.plans.queries_evidence import evidence_view
from annoflux.plans.queries_sequence import ORFS
from annoflux.operators.evidence import aggregate_evidence
from annoflux.operators.interpretation import annotate_function, first_pfam_id, interpret, interpretation_summary, normalize_product, rank_hypotheses
from annoflux.operators.lineage import keep, shared_folder
from annoflux.plans.registry import query
from annoflux.plans.views import as_genomes, view
from annoflux.sources import sinks
from annoflux.streaming.interpretation import stream_interpret


def _truth_and_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spans = view(spark, sf_dir, "spans")
    return spans.where("flag = 'A'").drop("flag"), spans.where("flag = 'R'").drop("flag")


def _matched(name: str, calls: str) -> str:
    """Common tables in SQL that walk the calls of each contig strand in order, each taking its first free truth span."""
    return f"""t{name} AS (SELECT genome_id, strand, start, "end", row_number() OVER (PARTITION BY genome_id, strand ORDER BY start, "end") AS t FROM spans WHERE flag = 'A'),
    p{name} AS (SELECT genome_id, strand, start, "end", row_number() OVER (PARTITION BY genome_id, strand ORDER BY start, "end") AS p FROM spans WHERE {calls}),
    c{name} AS (SELECT p.genome_id, p.strand, p, list(t ORDER BY t) AS ts, row_number() OVER (PARTITION BY p.genome_id, p.strand ORDER BY p) AS k FROM p{name} p JOIN t{name} t ON t.genome_id = p.genome_id AND t.strand = p.strand
        AND (least(p."end", t."end") - greatest(p.start, t.start))::double / greatest(p."end" - p.start, t."end" - t.start) >= 0.5 GROUP BY p.genome_id, p.strand, p),
    walk{name} AS (SELECT genome_id, strand, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS p, NULL::BIGINT AS t FROM c{name} WHERE k = 1
        UNION ALL SELECT genome_id, strand, k, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got) END, p, got
        FROM (SELECT c.genome_id, c.strand, c.k, w.taken, c.p, list_min(list_filter(c.ts, lambda x: NOT list_contains(w.taken, x))) AS got FROM walk{name} w JOIN c{name} c ON c.genome_id = w.genome_id AND c.strand = w.strand AND c.k = w.k + 1)),
    rated{name} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
        SELECT genome_id, tp, n_p - tp AS fp, n_t - tp AS fn, CASE WHEN n_p > 0 THEN tp / n_p::double ELSE 0 END AS precision, CASE WHEN n_t > 0 THEN tp / n_t::double ELSE 0 END AS recall FROM (
            SELECT coalesce(a.genome_id, b.genome_id) AS genome_id, coalesce(a.n, 0) AS n_t, coalesce(b.n, 0) AS n_p, coalesce(m.n, 0) AS tp FROM (SELECT genome_id, count(*) AS n FROM t{name} GROUP BY 1) a
            FULL JOIN (SELECT genome_id, count(*) AS n FROM p{name} GROUP BY 1) b ON a.genome_id = b.genome_id
            LEFT JOIN (SELECT genome_id, count(*) AS n FROM walk{name} WHERE t IS NOT NULL GROUP BY 1) m ON m.genome_id = coalesce(a.genome_id, b.genome_id))))"""


_CALLS = _matched("", "flag = 'R'")


@query("b2_match_genes", _CALLS + " SELECT genome_id, strand, p, t FROM walk WHERE t IS NOT NULL", ("spans",))
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.match_genes(*_truth_and_calls(spark, sf_dir))


@query("b3_evaluation", _CALLS + " SELECT * FROM rated", ("spans",))
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.evaluation(*_truth_and_calls(spark, sf_dir))


@query(
    "b4_compare_tools",
    _CALLS + ", " + _matched("_forward", "flag = 'R' AND strand = 1") + " SELECT a.genome_id, a.f1 AS f1_a, b.f1 AS f1_b, a.f1 - b.f1 AS delta FROM rated a JOIN rated_forward b ON a.genome_id = b.genome_id",
    ("spans",),
)
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, calls = _truth_and_calls(spark, sf_dir)
    return bm.compare_tools(bm.evaluation(truth, calls), bm.evaluation(truth, calls.where("strand = 1")))


@query(
    "b5_count_by_mode",
    "SELECT genome_id, flag AS mode, count(*) AS n, count(*) / (200000 / 1000.0::double) AS per_kb FROM spans GROUP BY ALL",
    ("spans",),
)
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "spans").withColumnRenamed("flag", "mode")
    return bm.count_by_mode(spans, spans.select("genome_id").distinct().withColumn("length", F.lit(200_000)))


_JSON = "jobs_with AS (SELECT *, CASE WHEN total_genes % 2 = 0 THEN 'x' || (total_genes % 500) ELSE 'y' || (total_genes % 300) END AS gene, total_genes % 3 > 0 AS dark FROM jobs) "


@query(
    "k1_dark_gene_catalogue",
    _JSON + "SELECT gene AS gene_id, job_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY created_at DESC, job_id) AS r FROM jobs_with WHERE status = 'COMPLETED' AND dark) WHERE r = 1",
    ("jobs",),
)
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("total_genes")
    gene = F.when(n % 2 == 0, F.concat(F.lit("x"), n % 500)).otherwise(F.concat(F.lit("y"), n % 300))
    jobs = view(spark, sf_dir, "jobs").withColumn("genes_json", F.to_json(F.array(F.struct(gene.alias("gene_id"), (n % 3 > 0).alias("is_dark")))))
    return bm.dark_gene_catalogue(jobs)


@query("k2_job_list", "SELECT * FROM jobs ORDER BY created_at DESC, job_id", ("jobs",))
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.job_list(view(spark, sf_dir, "jobs"))


@query(
    "k2_job_statistics",
    _RESULTS
    + """SELECT job_id, user_id, status, created_at, count(gene_id) AS total_genes, count(score) AS interpreted_genes, count(*) FILTER (WHERE level = 'high') AS high_confidence_count, count(gene_id) - count(score) AS dark_count
    FROM jobs LEFT JOIN results ON job_id = concat('job', substr(gene_id, 2)) GROUP BY job_id, user_id, status, created_at""",
    ("evidence", "jobs"),
)
def k2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a job, whose genes are those of its lines."""
    results = results_view(spark, sf_dir).withColumn("job_id", F.concat(F.lit("job"), F.expr("substring(gene_id, 2)")))
    return bm.job_statistics(view(spark, sf_dir, "jobs"), results)


@query("k3_stale_jobs", "SELECT job_id, CASE WHEN status IN ('PENDING', 'RUNNING') AND created_at::timestamp < timestamp '1996-01-01' - interval 10 minute THEN 'CANCELLED' ELSE status END AS status FROM jobs", ("jobs",))
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.stale_jobs(view(spark, sf_dir, "jobs"), F.lit("1996-01-01").cast("timestamp")).select("job_id", "status")


@query(
    "k4_lookup_freshness",
    """e AS (SELECT user_id AS namespace, sha256(upper(trim(status))) AS key_hash, created_at AS stored_at, total_genes AS value FROM jobs),
    l AS (SELECT *, row_number() OVER (PARTITION BY namespace, key_hash ORDER BY stored_at DESC, value DESC) AS n FROM e) SELECT namespace, key_hash, value FROM l WHERE n = 1 AND stored_at::timestamp >= timestamp '1996-01-01' - interval 30 day""",
    ("jobs",),
)
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = view(spark, sf_dir, "jobs").select(F.col("user_id").alias("namespace"), F.col("status").alias("key"), F.col("created_at").cast("timestamp").alias("stored_at"), F.col("total_genes").alias("value"))
    return bm.lookup_freshness(entries, F.lit("1996-01-01").cast("timestamp")).select("namespace", "key_hash", "value")


@query("k4_entries_by_namespace", "SELECT user_id AS namespace, count(DISTINCT upper(trim(status))) AS n FROM jobs GROUP BY 1", ("jobs",))
def k4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.entries_by_namespace(view(spark, sf_dir, "jobs").select(F.col("user_id").alias("namespace"), F.col("status").alias("key")))


@query("k5_genes_in_order", 'SELECT genome_id, start, "end", strand FROM spans ORDER BY genome_id, start, "end"', ("spans",))
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm.genes_in_order(view(spark, sf_dir, "spans").drop("flag"))


@query("s14_export_genome_json")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes with their frames as genes: protein, evidence and non-coding interpretations."""
    genomes = view(spark, sf_dir, "genomes")
    found = orfs.orfs_with_sequence(genomes, min_length=300)
    genes = orfs.orfs_to_genes(found).join(found.select(orfs.gene_id().alias("gene_id"), "sequence", sq.translate_dna(F.col("sequence")).alias("protein_seq")), "gene_id")
    evidence = genes.select("gene_id", F.lit(1).alias("ev_seq"), F.lit("orf_prediction").alias("evidence_type"), F.col("product").alias("description"), F.lit(0.5).alias("confidence"))
    return sinks.genome_json(genomes, genes, evidence)


@query("s15_export_interpretation_json")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _dealt(spark, sf_dir)
    ranked = keep(rank_hypotheses(_scored(evidence, details=True)))  # three a gene, read for the results, their sums and the lists of hypotheses
    results = results_of(evidence, told=interpret(ranked))
    return sinks.interpretation_json(results, interpretation_summary(results), ranked, aggregate_evidence(evidence))


@query("s16_export_evidence_json", "SELECT gene_id, count(*) AS n FROM evidence GROUP BY 1", ("evidence",))
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported texts, read again and counted."""
    texts = sinks.evidence_json(evidence_view(spark, sf_dir))
    return texts.select(F.get_json_object("json", "$.gene_id").alias("gene_id")).groupBy("gene_id").agg(F.count("*").alias("n"))


@query("s17_gene_records")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir)
    number = F.expr("cast(substring(gene_id, 2) AS bigint)")
    genes = rows.select("gene_id").distinct().withColumns({"start": number, "end": number + 300, "strand": F.lit(1)})
    told = _interpreted(rows, details=True).withColumn("normalized_product", normalize_product(F.col("hypothesis")))
    families = first_pfam_id(rows.withColumn("accession", F.lit(None).cast("string")))
    table = spark.createDataFrame([("PF00136", "L", ["GO:0003677"])], "pfam_id string, cog string, go_terms array<string>")
    return sinks.gene_records(genes, annotate_function(told, families, table), rows)


@query("s18_report_rows")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report_rows(results_of(_dealt(spark, sf_dir), details=True))


@query("t1_stream_interpret", ORFS + "SELECT genome_id, count(*) AS n_orfs FROM orfs GROUP BY 1", ("genomes",))
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a stream of uploads; each genome's calls, written by batch and read again."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def interpret(batch: DataFrame) -> DataFrame:
        genomes = as_genomes(batch)
        return orfs.six_frame_orfs(genomes).groupBy("genome_id").agg(F.count("*").alias("n_orfs"))

    run = stream_interpret(spark, f"{sf_dir}/documents.parque[t]", f"{place}/out", f"{place}/state", interpret, "doc_id long, text string", key="doc_id")
    run.awaitTermination()
    return spark.read.parquet(f"{place}/out").select("genome_id", "n_orfs")
