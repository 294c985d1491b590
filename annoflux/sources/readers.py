"""Genome and tool-output formats as DataFrames.

Each ``read_*`` loads files with a Spark text, csv, xml or json source and hands the
records to a ``parse_*`` function, which works on any DataFrame of record texts
(column ``value``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annoflux.functions.sequence import VALID_GENOME
from annoflux.operators.lineage import cut
from annoflux.operators.orfs import orf_sequence

EXTENSIONS = {"fasta": ("fasta", "fa", "fna", "ffn", "faa"), "genbank": ("gb", "gbk", "genbank", "gbff")}


def detect_format(path: Column, first_line: Column) -> Column:
    """By extension, else by the first line; null if neither tells."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.when(ext.isin(*EXTENSIONS["fasta"]), "fasta").when(ext.isin(*EXTENSIONS["genbank"]), "genbank")
    return out.when(first_line.startswith(">"), "fasta").when(first_line.startswith("LOCUS"), "genbank")


# -- FASTA ---------------------------------------------------------------------------------


def parse_fasta(records: DataFrame) -> DataFrame:
    """One genome a record: name, description, organism, sequence, valid (letters known)."""
    text = F.regexp_replace("value", "^>", "")
    header = F.regexp_extract(text, r"^([^\n]*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s", ""))
    name = F.regexp_extract(header, r"^(\S*)", 1)
    rows = records.where(F.trim("value") != "").select(
        name.alias("name"),
        F.trim(F.regexp_replace(header, r"^\S*\s*", "")).alias("description"),
        F.nullif(F.regexp_extract(header, r"\[([^\[\]]*)\][^\]]*$", 1), F.lit("")).alias("organism"),
        body.alias("sequence"),
        F.lit("fasta").alias("file_format"),
    )
    genome_id = F.sha2(F.concat_ws("|", "name", F.sha2("sequence", 256)), 256)
    return rows.withColumns({"genome_id": genome_id, "valid": (F.col("sequence") != "") & F.col("sequence").rlike(VALID_GENOME)})


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


CHUNK = "file string, block long, n long, header string, sequence string"


def _record_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of records from lines: a piece ends with its record, its block of the file or its batch; only a record's first has a header."""
    here, n = None, 0
    for batch in batches:
        out = []
        for (file, block), lines in batch.groupby(["file", "block"], sort=False)["value"]:
            if (file, block) != here:
                here, n = (file, block), 0
            header, body = None, []
            for line in lines:
                if line.startswith(">"):
                    if header is not None or body:
                        out.append((file, block, n, header, "".join(body)))
                        n += 1
                    header, body = line[1:].rstrip("\r"), []
                else:
                    body.append("".join(line.split()).upper())
            out.append((file, block, n, header, "".join(body)))
            n += 1
        yield pd.DataFrame(out, columns=["file", "block", "n", "header", "sequence"])


def read_fasta_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, chunk, header, sequence): the records of FASTA files in chunks, for records too long for one row.

    Files are read by line and split anywhere, so a record longer than a split is read by several tasks; no row
    holds more of it than a batch. ``record`` and ``chunk`` count up in the file's order, with gaps. What comes before a
    file's first header is left out. A chunk that starts without a header belongs to the last header
    before it: that is looked up over one row for each block of a file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = cut(lines.mapInPandas(_record_pieces, CHUNK))
    place = F.struct("block", "n")
    of_block = pieces.groupBy("file", "block").agg(F.max(F.when(F.col("header").isNotNull(), F.struct("block", "n", "header"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    handed = of_block.withColumn("before", before).select("file", "block", "before")
    # within a block the last header is the piece's own or one above it
    inner = F.last(F.when(F.col("header").isNotNull(), F.struct("block", "n", "header")), ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("n"))
    owned = pieces.withColumn("inner", inner).join(handed, ["file", "block"]).withColumn("of", F.coalesce("inner", "before")).where("of IS NOT NULL")
    number = lambda p: p["block"] * F.lit(1 << 20) + p["n"]
    return owned.select("file", number(F.col("of")).alias("record"), number(place).alias("chunk"), "of.header", "sequence")


# -- GenBank -------------------------------------------------------------------------------

FLAT = (
    "name string, definition string, accession string, organism string, taxonomy_id int, keywords string, sequence string, "
    "features array<struct<n:int,type:string,start:bigint,end:bigint,strand:int,gene:string,locus_tag:string,product:string,translation:string,func:string,note:string,pseudo:boolean>>"
)
_QUALIFIERS = {"gene": "gene", "locus_tag": "locus_tag", "product": "product", "translation": "translation", "function": "func", "note": "note"}


def _flat_record(text: str) -> dict | None:
    """Tokens of a GenBank flat-file record; what they mean is left to the DataFrame steps."""
    head, _, rest = text.partition("\nFEATURES")
    table, _, origin = rest.partition("\nORIGIN")
    if "LOCUS" not in head:
        return None
    field = lambda key: " ".join(w for m in re.findall(rf"^{key}[ ]+(.*)((?:\n {{12}}.*)*)", head, re.M)[:1] for w in " ".join(m).split())
    organism = re.search(r"^  ORGANISM +(.*)", head, re.M)
    features, taxon = [], None
    for n, m in enumerate(re.finditer(r"^ {5}(\S+) +((?:.|\n {21}(?!/))*)((?:\n {21}.*)*)", table, re.M)):
        kind, place, body = m.group(1), re.sub(r"\s", "", m.group(2)), m.group(3)
        spans = [int(x) for x in re.findall(r"\d+", place)]
        own = {}
        for q in re.finditer(r'^ {21}/([A-Za-z_]+)(?:=(?:"((?:[^"]|"")*)"|(\S+)))?', body, re.M):
            value = re.sub(r"\n {21}", "" if q.group(1) == "translation" else " ", q.group(2) if q.group(2) is not None else q.group(3) or "")
            own.setdefault(q.group(1), []).append(value)
        if kind == "source" and taxon is None:
            taxon = next((int(x[6:]) for x in own.get("db_xref", []) if re.fullmatch(r"taxon:\d+", x)), None)
        if kind in ("gene", "CDS") and spans:
            row = {"n": n, "type": kind, "start": min(spans) - 1, "end": max(spans), "strand": -1 if place.startswith("complement") else 1, "pseudo": "pseudo" in own or (kind == "gene" and "pseudogene" in own)}
            features.append(row | {column: own.get(q, [None])[0] for q, column in _QUALIFIERS.items()})
    return {
        "name": field("LOCUS").split(" ")[0], "definition": field("DEFINITION").rstrip("."), "accession": field("ACCESSION").split(" ")[0], "organism": organism.group(1).strip() if organism else None,
        "taxonomy_id": taxon, "keywords": field("KEYWORDS"), "sequence": re.sub(r"[^A-Za-z]", "", origin.partition("\n//")[0].partition("\n")[2]).upper(), "features": features,
    }


def parse_genbank_records(records: DataFrame) -> DataFrame:
    """Tokenised records with genome_id and their features as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in map(_flat_record, batch["value"].to_pylist()) if r]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    span = pa.struct(
        [("n", pa.int32()), ("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strand", pa.int32()), *[(x, pa.string()) for x in ("gene", "locus_tag", "product", "translation", "func", "note")], ("pseudo", pa.bool_())]
    )
    schema = pa.schema([*[(x, pa.string()) for x in ("name", "definition", "accession", "organism")], ("taxonomy_id", pa.int32()), ("keywords", pa.string()), ("sequence", pa.string()), ("features", pa.list_(span))])
    found = records.select("value").mapInArrow(run, FLAT)
    return found.withColumn("genome_id", F.sha2(F.concat_ws("|", "accession", "name", F.sha2("sequence", 256)), 256))


def genbank_genes(records: DataFrame) -> DataFrame:
    """Genes of tokenised records: gene features with the CDS of their locus tag, else of their name; then CDS that no gene claims."""
    features = records.select("genome_id", "sequence", F.explode("features").alias("f")).select("genome_id", "sequence", "f.*")
    gene, cds = features.where("type = 'gene'"), features.where("type = 'CDS'")
    details = F.struct(F.col("n").alias("cds_n"), "product", "translation", "func", "note")
    by_tag = cds.where("locus_tag IS NOT NULL").groupBy("genome_id", "locus_tag").agg(F.max_by(details, "n").alias("tagged"))
    by_name = cds.where("gene IS NOT NULL").groupBy("genome_id", "gene").agg(F.max_by(details, "n").alias("named"))
    columns = ["genome_id", "n", "start", "end", "strand", "gene", "locus_tag", "pseudo", "sequence"]
    paired = gene.select(*columns).join(by_tag, ["genome_id", "locus_tag"], "left").join(by_name, ["genome_id", "gene"], "left").withColumn("c", F.coalesce("tagged", "named"))
    unclaimed = cds.join(gene.select("genome_id", "start", "end", "strand").distinct(), ["genome_id", "start", "end", "strand"], "left_anti")
    both = paired.select(*columns, "c.product", "c.translation", "c.func", "c.note", F.lit(0).alias("kind")).unionByName(unclaimed.select(*columns, "product", "translation", "func", "note", F.lit(1).alias("kind")))
    from pyspark.sql import Window

    counted = both.withColumn("number", F.row_number().over(Window.partitionBy("genome_id").orderBy("kind", "n")))
    return counted.select(
        "genome_id",
        F.sha2(F.concat_ws("|", "genome_id", "start", "end", "strand", F.lit("annotation"), "n"), 256).alias("gene_id"),
        F.col("gene").alias("name"),
        F.when((F.col("kind") == 1) & F.col("locus_tag").isNull(), F.format_string("CDS_%04d", "number")).otherwise(F.col("locus_tag")).alias("locus_tag"),
        "start", "end", "strand",
        orf_sequence(F.col("sequence"), F.col("start"), F.col("end"), F.col("strand")).alias("sequence"),
        F.col("translation").alias("protein_seq"), F.col("product").alias("product_name"), F.col("func").alias("gb_function"), F.col("note").alias("gb_note"),
        F.col("pseudo").alias("is_pseudo"), F.lit("annotation").alias("source"),
    )


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    return parse_genbank_records(spark.read.option("lineSep", "\n//").text(path))


# -- PROSITE, Pfam -------------------------------------------------------------------------


def parse_prosite(records: DataFrame) -> DataFrame:
    """Entries of type PATTERN: id, accession, description, pattern, skip."""
    text = F.col("value")
    pattern = F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^PA   (.*)$"), F.lit(1)), "")
    return records.where(text.rlike(r"(?m)^ID   \S+; PATTERN\.")).select(
        F.regexp_extract(text, r"(?m)^ID   ([^;]+);", 1).alias("id"),
        F.regexp_extract(text, r"(?m)^AC   ([^;]+);", 1).alias("accession"),
        F.regexp_extract(text, r"(?m)^DE   (.*)$", 1).alias("description"),
        F.regexp_replace(pattern, r"\.\s*$", "").alias("pattern"),
        text.rlike(r"(?m)^CC   /SKIP-FLAG=TRUE").alias("skip"),
    )


def read_prosite(spark: SparkSession, path: str) -> DataFrame:
    return parse_prosite(spark.read.option("lineSep", "\n//").text(path))


def _columns(lines: DataFrame, least: int) -> DataFrame:
    """Tab-separated fields of lines that are no comments and have ``least`` fields."""
    fields = F.split("value", "\t")
    return lines.where(~F.col("value").startswith("#")).select(fields.alias("f")).where(F.size("f") >= least)


def parse_pfam_table(lines: DataFrame) -> DataFrame:
    f = F.col("f")
    terms = F.filter(F.split(F.coalesce(F.get(f, F.lit(3)), F.lit("")), r"\|"), lambda x: x != "")
    return _columns(lines, 3).select(f[0].alias("pfam_id"), f[1].alias("pfam_name"), f[2].alias("cog"), terms.alias("go_terms"))


def read_pfam_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_pfam_table(spark.read.text(path))


# -- tool outputs --------------------------------------------------------------------------

HIT = (
    "Hit_id string, Hit_def string, Hit_accession string, Hit_hsps struct<Hsp:array<struct<`Hsp_bit-score`:double,Hsp_evalue:double,Hsp_identity:int,`Hsp_align-len`:int,Hsp_gaps:int,"
    "`Hsp_query-from`:int,`Hsp_query-to`:int,`Hsp_hit-from`:int,`Hsp_hit-to`:int>>>"
)


def shape_blast(hits: DataFrame) -> DataFrame:
    """First aligned segment of each hit; gaps stand for mismatches and gap openings alike."""
    h = F.col("Hit_hsps.Hsp")[0]
    align = F.coalesce(h["Hsp_align-len"], F.lit(1))
    share = lambda x: F.when(align > 0, F.round(x / align * 100, 1)).otherwise(0.0)
    return hits.where(h.isNotNull()).select(
        F.col("Hit_id").alias("hit_id"), F.col("Hit_def").alias("title"), F.col("Hit_accession").alias("accession"), h["Hsp_evalue"].alias("evalue"), h["Hsp_bit-score"].alias("bit_score"),
        share(h["Hsp_identity"]).alias("identity_percent"), share(h["Hsp_query-to"] - h["Hsp_query-from"] + 1).alias("coverage_percent"), align.alias("align_len"),
        h["Hsp_gaps"].alias("mismatches"), h["Hsp_gaps"].alias("gap_opens"),
    )


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    return shape_blast(spark.read.format("xml").option("rowTag", "Hit").schema(HIT).load(path))


def parse_diamond(lines: DataFrame) -> DataFrame:
    f = F.col("f")
    return _columns(lines, 7).select(
        f[0].alias("gene_id"), f[1].alias("hit_id"), f[2].cast("double").alias("identity_percent"), f[3].cast("int").alias("align_len"), f[4].cast("double").alias("evalue"), f[5].cast("double").alias("bit_score"), f[6].alias("title")
    )


def read_diamond(spark: SparkSession, path: str) -> DataFrame:
    return parse_diamond(spark.read.text(path))


def parse_gff(lines: DataFrame) -> DataFrame:
    f = F.col("f")
    return _columns(lines, 9).select(
        f[0].alias("genome_id"), f[2].alias("type"), (f[3].cast("long") - 1).alias("start"), f[4].cast("long").alias("end"), F.when(f[6] == "-", -1).otherwise(1).alias("strand"),
        F.nullif(F.regexp_extract(f[8], r"(?:^|;)product=([^;]*)", 1), F.lit("")).alias("product"),
    )


def rrna_gff(lines: DataFrame, lengths: DataFrame) -> DataFrame:
    """rRNA rows inside their genome (genome_id, length)."""
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("length"))
    return parse_gff(lines).where("type = 'rRNA'").join(lengths, "genome_id").where(inside).drop("length", "type").withColumn("source", F.lit("rRNA_prediction"))


def cds_gff(lines: DataFrame) -> DataFrame:
    return parse_gff(lines).where("type = 'CDS'").select("genome_id", "start", "end", "strand")


TRNA_LINE = r"^\s*\d+\.\s+(\S+)\s+(c?)\[(\d+),(\d+)\]"


def trna_lines(lines: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("value", TRNA_LINE, i)
    found = lines.where(F.col("value").rlike(TRNA_LINE))
    return found.select(part(1).alias("product"), (part(3).cast("long") - 1).alias("start"), part(4).cast("long").alias("end"), F.when(part(2) == "c", -1).otherwise(1).alias("strand"), F.lit("tRNA_prediction").alias("source")).where("start >= 0 AND `end` > start")


UNIPROT = (
    "primaryAccession string, proteinDescription struct<recommendedName:struct<fullName:struct<value:string>>>, organism struct<scientificName:string>, genes array<struct<geneName:struct<value:string>>>, "
    "comments array<struct<commentType:string,texts:array<struct<value:string>>>>, keywords array<struct<name:string>>, uniProtKBCrossReferences array<struct<database:string,id:string>>, sequence struct<length:int>"
)


def parse_uniprot(records: DataFrame) -> DataFrame:
    """Entries as JSON texts: names, first function text, at most ten keywords and GO terms."""
    e = records.select(F.from_json("value", UNIPROT).alias("e")).select("e.*")
    functions = F.filter("comments", lambda c: c["commentType"] == "FUNCTION")
    go = F.filter("uniProtKBCrossReferences", lambda x: x["database"] == "GO")
    return e.select(
        F.coalesce("primaryAccession", F.lit("")).alias("accession"),
        F.coalesce("proteinDescription.recommendedName.fullName.value", F.lit("Unknown protein")).alias("protein_name"),
        F.coalesce("organism.scientificName", F.lit("Unknown")).alias("organism"),
        F.filter(F.col("genes.geneName.value"), lambda x: x.isNotNull()).alias("gene_names"),
        F.coalesce(F.get(F.get(functions, F.lit(0))["texts"], F.lit(0))["value"], F.lit("")).alias("function_text"),
        F.slice(F.coalesce("keywords.name", F.array().cast("array<string>")), 1, 10).alias("keywords"),
        F.slice(F.coalesce(F.transform(go, lambda x: x["id"]), F.array().cast("array<string>")), 1, 10).alias("go_terms"),
        F.col("sequence.length").alias("length"),
    )


INTERPRO = "results array<struct<metadata:struct<accession:string,name:string,type:string>>>"


def parse_interpro(records: DataFrame, most: int = 5) -> DataFrame:
    """First domain hits of each result list (gene_id, value); fixed evalue and score."""
    r = records.select("gene_id", F.posexplode(F.slice(F.from_json("value", INTERPRO)["results"], 1, most)).alias("hit_rank", "r"))
    return r.select("gene_id", "hit_rank", F.col("r.metadata.accession").alias("accession"), F.col("r.metadata.name").alias("domain_name"), F.col("r.metadata.name").alias("description"), F.lit(1e-10).alias("evalue"), F.lit(100.0).alias("score"))


def hmm_domains(domains: DataFrame) -> DataFrame:
    return domains.where(F.col("score") >= 20).withColumn("confidence", F.least(F.col("score") / 50, F.lit(1.0)))
