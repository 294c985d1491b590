"""Inputs of the registered queries, derived from the driver tables by one expression in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annoflux.operators.lineage import spread

TABLES = ("documents", "lineitem", "part", "orders")

_PRODUCTS = (
    "'putative DNA polymerase III', 'hypothetical protein', 'ATP synthase subunit', 'membrane transporter [Escherichia coli]', "
    "'capsid protein (fragment)', 'holin', 'sensor histidine kinase', 'Pfam PF00136 DNA_pol_B', 'probable tail fiber, partial', "
    "'chaperone GroEL', 'terminase small subunit', 'orf0001'"
)
_MOTIFS = "'atp_binding_p_loop', 'walker_b', 'serine_protease', 'signal_peptide', 'phosphorylation_site', 'egf_like', 'mystery'"
# a genome has 64 bases for every 64 characters of its whole text
_ORDINAL = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax)"

SPARK = {
    "genomes": """SELECT concat('d', doc_id) AS genome_id, array_join(transform(sequence(0, cast(length(coalesce(text, '')) / 64 AS int)),
        i -> translate(sha2(concat(i, ':', substring(coalesce(text, ''), i * 64 + 1, 64)), 256), '0123456789abcdef', 'ACGTACGTACGTACGT')), '') AS sequence FROM documents""",
    "proteins": "SELECT concat('d', doc_id) AS gene_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '')), 'BJOUXZ', 'AKCGMS') AS protein_seq FROM documents",
    "spans": """SELECT concat('ctg', l_suppkey) AS genome_id, l_returnflag AS flag, cast((l_orderkey * 37) % 200000 AS bigint) AS start,
        cast((l_orderkey * 37) % 200000 + 60 + cast(l_quantity AS int) * 30 AS bigint) AS `end`, CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END AS strand FROM lineitem""",
    "evidence": f"""SELECT concat('g', l_orderkey) AS gene_id, {_ORDINAL} AS ev_seq,
        CASE l_partkey % 5 WHEN 0 THEN 'blast_homology' WHEN 1 THEN 'motif_match' WHEN 2 THEN 'domain_hit' WHEN 3 THEN 'sequence_feature' ELSE 'motif_match' END AS evidence_type,
        element_at(array({_PRODUCTS}), cast(l_suppkey % 12 AS int) + 1) AS description, least(1.0D, 0.2D + l_discount * 6 + l_tax * 3) AS confidence,
        element_at(array({_MOTIFS}), cast(l_partkey % 7 AS int) + 1) AS motif_name FROM lineitem""",
    "hits": """SELECT concat('g', l_orderkey) AS gene_id, concat('sp|', l_partkey) AS hit_id, concat(p_name, ' [', p_brand, ']') AS title, l_quantity * 2 AS identity_percent,
        cast(20 + l_quantity * 4 AS int) AS align_len, CASE WHEN l_linenumber <= 4 THEN 1e-9D ELSE 1e-3D END AS evalue, l_linenumber AS hit_rank FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "annotations": "SELECT concat('P', p_partkey) AS accession, p_name AS gene_name, concat(p_type, ' ', p_name) AS protein_name, cast(p_size * 10 AS int) AS length FROM part",
    "jobs": """SELECT concat('job', o_orderkey) AS job_id, concat('c', o_custkey) AS user_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'RUNNING' END AS status,
        o_orderdate AS created_at, cast(floor(o_totalprice) AS bigint) AS total_genes FROM orders""",
}

DUCK = {
    "genomes": """SELECT concat('d', doc_id) AS genome_id, array_to_string(list_transform(range(0, length(coalesce(text, '')) // 64 + 1),
        lambda i: translate(sha256(concat(i, ':', substr(coalesce(text, ''), i * 64 + 1, 64))), '0123456789abcdef', 'ACGTACGTACGTACGT')), '') AS sequence FROM documents""",
    "proteins": "SELECT concat('d', doc_id) AS gene_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BJOUXZ', 'AKCGMS') AS protein_seq FROM documents",
    "spans": SPARK["spans"].replace("`end`", '"end"'),
    "evidence": SPARK["evidence"].replace(f"element_at(array({_PRODUCTS}), ", f"list_extract([{_PRODUCTS}], ").replace(f"element_at(array({_MOTIFS}), ", f"list_extract([{_MOTIFS}], ").replace("1.0D", "1.0::double").replace("0.2D", "0.2::double"),
    "hits": SPARK["hits"].replace("1e-9D", "1e-9::double").replace("1e-3D", "1e-3::double"),
    "annotations": SPARK["annotations"],
    "jobs": SPARK["jobs"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the tables of ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in SPARK[name]}
    return spark.sql(SPARK[name].replace("FROM documents", "FROM {documents}").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN part", "JOIN {part}").replace("FROM part", "FROM {part}").replace("FROM orders", "FROM {orders}"), **tables)


def dealt_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view ``genomes``, made in as many tasks as shuffles have and dealt out by genome, for plans that read it in many steps."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return spread(as_genomes(documents), "genome_id")


def as_genomes(documents: DataFrame) -> DataFrame:
    """The view ``genomes`` over rows (doc_id, text) from elsewhere, such as a batch of a stream."""
    return documents.sparkSession.sql(SPARK["genomes"].replace("FROM documents", "FROM {documents}"), documents=documents)


def duck(body: str, *names: str) -> str:
    """DuckDB SQL with the named views in front; ``body`` begins with SELECT or with more common tables and ``SELECT``."""
    views = ", ".join(f"{n} AS ({DUCK[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if ' UNION ALL SELECT ' in body and 'walk' in body else ''}{views}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"
