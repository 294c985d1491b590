"""Long records, long lists of annotations and codon counts, against plain Python."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from annoflux.operators import discovery, hypotheses
from annoflux.operators.interpretation import interpretation_summary
from annoflux.sources import readers, sinks


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_fasta_in_chunks(spark, tmp_path, split):
    """A record longer than a split comes in chunks that make up what the reader of whole records gives."""
    rnd = random.Random(2)
    dna = lambda n: "\n".join("".join(rnd.choice("ACGTn") for _ in range(60)) for _ in range(n))
    for name, sizes in (("a.fa", (1, 200, 2)), ("b.fa", (3, 0, 90)), ("c.fa", (1,) * 40)):
        (tmp_path / name).write_text("".join(f">{name}{i} some [E. coli] text\n{dna(n)}\n" for i, n in enumerate(sizes)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        chunks = readers.read_fasta_chunks(spark, str(tmp_path / "*.fa")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = {}
    for r in sorted(chunks, key=lambda r: (r["file"], r["chunk"])):
        whole.setdefault((r["file"], r["record"], r["header"].split()[0]), []).append(r["sequence"])
    want = {r["name"]: r["sequence"] for r in readers.read_fasta(spark, str(tmp_path / "*.fa")).collect()}
    assert {k[2]: "".join(v) for k, v in whole.items()} == want and len(whole) == len(want)
    assert (max(len(v) for v in whole.values()) > 3) == (split == "1k")


def test_merge_of_many_annotations(spark):
    """A gene with 100,000 annotations takes seconds; a small gene is merged as by the pairwise rule."""
    rnd = random.Random(5)
    rows = [("small", rnd.randint(0, 2), n, rnd.choice(["Kinase", "kinase", "Pump", "pump", "X", "y", "Y"]), rnd.choice(["unknown", "metabolism", "transport"]), rnd.random(), "PRODUCT", [n], [f"r{n % 5}"], [f"k{n}"]) for n in range(60)]
    columns = "gene_id string, tier int, place int, function string, category string, confidence double, source_type string, ids array<int>, reasoning array<string>, keywords array<string>"
    small = spark.createDataFrame(rows, columns)
    big = spark.range(100_000).select(
        F.lit("big").alias("gene_id"), F.lit(0).alias("tier"), F.col("id").cast("int").alias("place"), F.concat(F.lit("f"), F.col("id") % 50_000).alias("function"), F.lit("unknown").alias("category"),
        F.lit(0.5).alias("confidence"), F.lit("PRODUCT").alias("source_type"), F.array(F.col("id").cast("int")).alias("ids"), F.array(F.lit("r")).alias("reasoning"), F.array(F.lit("k")).alias("keywords"),
    )
    began = time.time()
    found = hypotheses.merge_similar(small.unionByName(big)).collect()
    assert time.time() - began < 60
    assert Counter(r["gene_id"] for r in found)["big"] == 50_000
    groups = []
    for h in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[4], r[5])):
        like = next((g for g in groups if g[0][4] == h[4] != "unknown" or g[0][3].lower() == h[3].lower()), None)
        groups.append([h]) if like is None else like.append(h)
    want = [(g[0][3], g[0][4], g[0][6] if len(g) == 1 else "aggregated", sorted(i for h in g for i in h[7]), list(dict.fromkeys(x for h in g for x in h[8])), g[0][9]) for g in groups]
    own = sorted((r for r in found if r["gene_id"] == "small"), key=lambda r: r["hyp_seq"])
    assert [(r["function"], r["category"], r["source_type"], r["ids"], r["reasoning"], r["keywords"]) for r in own] == want
    assert [r["confidence"] for r in own] == pytest.approx([g[0][5] if len(g) == 1 else min(sum(h[5] for h in g) / len(g) * 1.1, 0.95) for g in groups])


def test_codon_usage(spark):
    rnd = random.Random(6)
    genes = [(f"g{i % 3}", rnd.choice([1, -1]), "".join(rnd.choice("ACGTacgN") for _ in range(rnd.randint(0, 80)))) for i in range(60)] + [("g0", 1, None)]
    df = spark.createDataFrame(genes, "genome_id string, strand int, sequence string").repartition(4)
    for orientation in ("reference", "coding"):
        counts = {}
        for genome, strand, seq in genes:
            seq = (seq or "").upper()
            if strand == -1 and orientation == "reference":
                seq = seq.translate(str.maketrans("ATGC", "TACG"))[::-1]
            counts.setdefault(genome, Counter()).update(c for i in range(0, len(seq) - 2, 3) if set(c := seq[i : i + 3]) <= set("ACGT"))
        want = {(g, c): n / sum(own.values()) for g, own in counts.items() for c, n in own.items()}
        found = {(r["genome_id"], r["codon"]): r["frequency"] for r in discovery.codon_usage(df, orientation).collect()}
        assert found == pytest.approx(want)


def test_exports_in_lines(spark, tmp_path):
    """Lines of an export, written and put together by object, are the texts of the export in one row."""
    genomes = spark.createDataFrame([(f"g{i}", "ACGT" * i) for i in range(5)], "genome_id string, sequence string")
    genes = spark.range(300).select(F.concat(F.lit("g"), F.col("id") % 3).alias("genome_id"), F.concat(F.lit("x"), "id").alias("gene_id"), (F.col("id") * 7 % 100).alias("start"), (F.col("id") * 7 % 100 + 3).alias("end"), F.lit(1).alias("strand"), F.lit("M*").alias("protein_seq"))
    evidence = genes.select("gene_id", F.lit(1).alias("ev_seq"), F.lit("motif_match").alias("evidence_type"), F.lit('a "quoted" },{ text').alias("description"), F.lit(0.5).alias("confidence"))
    results = genes.select("genome_id", "gene_id", F.when(F.col("start") > 20, "kinase").alias("hypothesis"), F.when(F.col("start") > 20, 0.9).alias("score"), F.lit("high").alias("level"), F.lit("NONE").alias("severity"))
    pairs = [
        (sinks.genome_json(genomes, genes, evidence), sinks.genome_json_lines(genomes, genes, evidence)),
        (sinks.interpretation_json(results, interpretation_summary(results)), sinks.interpretation_json_lines(results, interpretation_summary(results))),
    ]
    for n, (whole, lines) in enumerate(pairs):
        sinks.write_lines(lines, str(tmp_path / str(n)))
        texts = "".join(p.read_text() for p in (tmp_path / str(n)).glob("part-*")).replace("\n]}\n", "\n]}\0").replace("[]}\n", "[]}\0").split("\0")
        found = {x.get("id", x.get("genome_id")): x for x in (json.loads(t) for t in texts if t.strip())}
        assert found == {r["genome_id"]: json.loads(r["json"]) for r in whole.collect()}
        plan = lines._jdf.queryExecution().toString()
        assert "collect_list(struct(start" not in plan and "collect_list(struct(gene_id" not in plan
