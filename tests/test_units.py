"""Single operators on handmade inputs."""

import random

import pytest
from pyspark.sql import functions as F

from annoflux.functions import sequence as sq
from annoflux.operators import evaluation, hypotheses, interpretation, intervals, motifs, orfs
from annoflux.operators import evidence as ev
from annoflux.sources import readers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_orf_strings(spark):
    long = "ATG" + "AAA" * 32 + "TAA"
    two = "ATG" + "AAA" * 9 + "ATG" + "AAA" * 19 + "TAA"
    genomes = spark.createDataFrame([("a", long), ("b", two)], "genome_id string, sequence string")
    found = orfs.six_frame_orfs(genomes, min_length=60).where("strand = 1").orderBy("genome_id", "start").select("genome_id", "start", "end").collect()
    assert [tuple(r) for r in found] == [("a", 0, 102), ("b", 0, 93), ("b", 30, 93)]
    protein = spark.createDataFrame([(long,)], "s string").select(sq.translate_dna(F.col("s"))).first()[0]
    assert protein == "M" + "K" * 32 + "*"


def naive_orfs(seq, least=100):
    comp = seq.translate(str.maketrans("ATGC", "TACG"))[::-1]
    out = set()
    for strand, s in ((1, seq), (-1, comp)):
        for i in range(len(s) - 2):
            if s[i : i + 3] in ("ATG", "GTG", "TTG"):
                stop = next((j + 3 for j in range(i, len(s) - 2, 3) if s[j : j + 3] in ("TAA", "TAG", "TGA")), None)
                if stop and stop - i >= least:
                    out.add((strand, i, stop) if strand == 1 else (strand, len(s) - stop, len(s) - i))
    return out


def test_orfs_across_tiles(spark, monkeypatch):
    """Small tiles, so that next stops are carried from later ones."""
    monkeypatch.setattr(orfs, "TILE", 50)
    rnd = random.Random(5)
    seq = "".join(rnd.choice("ACGT") for _ in range(2500))
    genomes = spark.createDataFrame([("g", seq)], "genome_id string, sequence string")
    got = {(r.strand, r.start, r.end) for r in orfs.six_frame_orfs(genomes).collect()}
    assert got == naive_orfs(seq)


def test_sd_scores(spark):
    strong = "N" * 8 + "AGGAGG" + "N" * 6 + "ATG"
    score = lambda s, start: one(spark, sq.weighted_sd_score(F.col("s"), F.col("p")), s=s, p=start)
    assert score(strong, 20) >= 0.99
    assert score("N" * 20 + "ATG", 20) == 0.0
    assert score("ATG", 0) == 0.0
    assert one(spark, sq.position_weight(F.col("d")), d=9) == 1.0
    assert one(spark, sq.position_weight(F.col("d")), d=15) == 0.0


def test_p_loop(spark):
    proteins = spark.createDataFrame([("g", "MKVLIGXXXXGKSFAM"), ("e", ""), ("n", None)], "gene_id string, protein_seq string")
    found = motifs.motif_scan(proteins, motifs.builtin_patterns(spark)).collect()
    assert [(r["name"], r["start"], r["end"]) for r in found] == [("atp_binding_p_loop", 5, 13)]


def test_interval_join_with_giants(spark):
    """Spans from a few bases to the whole contig, against all pairs."""
    rnd = random.Random(1)
    make = lambda n: [("c" + str(rnd.randint(0, 2)), s := rnd.randint(0, 5000), s + rnd.choice([3, 40, 900, 5000]), rnd.choice([1, -1])) for _ in range(n)]
    a, b = make(150), make(120)
    schema = "genome_id string, start long, end long, strand int"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = sorted((r.genome_id, r.start, r.end, r.strand, r.r_start, r.r_end, r.r_strand) for r in intervals.overlap_join(left, right, size=16).collect())
    assert got == sorted((*x, *y[1:]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])


def test_greedy_matching(spark):
    rnd = random.Random(2)
    schema = "genome_id string, start long, end long, strand int"
    spans = lambda n: sorted({("c", s := rnd.randint(0, 300), s + rnd.randint(20, 60), 1) for _ in range(n)}, key=lambda x: x[1:3])
    truth, preds = spans(40), spans(40)
    taken, tp = set(), 0
    for p in preds:
        for i, t in enumerate(truth):
            inter = min(p[2], t[2]) - max(p[1], t[1])
            if i not in taken and inter > 0 and inter / max(p[2] - p[1], t[2] - t[1]) >= 0.5:
                taken.add(i)
                tp += 1
                break
    row = evaluation.evaluation(spark.createDataFrame(truth, schema), spark.createDataFrame(preds, schema)).first()
    assert (row.tp, row.fp, row.fn) == (tp, len(preds) - tp, len(truth) - tp)


def test_merge_keeps_order_and_groups(spark):
    rows = [("g", 1, 1, "Kinase", "metabolism", 0.5), ("g", 1, 2, "Kinase XYZ", "metabolism", 0.4), ("g", 1, 3, "Transporter", "transport", 0.8), ("g", 2, 1, "transporter", "unknown", 0.6)]
    df = spark.createDataFrame(rows, "gene_id string, tier int, place long, function string, category string, confidence double")
    df = df.withColumns({"source_type": F.lit("T"), "ids": F.array("place"), "reasoning": F.array("function"), "keywords": F.array(F.lit("k"))})
    got = [(r.function, r.source_type, round(r.confidence, 3), r.ids) for r in hypotheses.merge_similar(df).orderBy("hyp_seq").collect()]
    assert got == [("Kinase", "aggregated", 0.495, [1, 2]), ("Transporter", "aggregated", 0.77, [1, 3])]


@pytest.mark.parametrize(("text", "category"), [("DNA polymerase", "replication"), ("ATP synthase", "metabolism"), ("membrane transporter", "transport"), ("xyz protein", "unknown")])
def test_categories(spark, text, category):
    assert one(spark, hypotheses.categorize(F.col("t")), t=text) == category


@pytest.mark.parametrize(("first", "second", "severity"), [(("Kinase", 0.9), ("Pump", 0.5), "NONE"), (("serine kinase", 0.8), ("tyrosine kinase", 0.75), "LOW"), (("DNA polymerase", 0.8), ("ATP synthase", 0.75), "HIGH")])
def test_conflicts(spark, first, second, severity):
    rows = [("g", 1, *first), ("g", 2, *second)]
    df = spark.createDataFrame(rows, "gene_id string, final_rank int, function string, confidence double")
    assert interpretation.check_conflict(df).first()["severity"] == severity


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("putative DNA polymerase", "DNA polymerase"), ("probable putative helicase", "helicase"), ("capsid [partial]", "capsid"), ("holin (fragment)", "holin"), ("phosphatase EC 3.1.3.1", "phosphatase"), ("hypothetical protein", "hypothetical protein")],
)
def test_products(spark, raw, clean):
    assert one(spark, interpretation.normalize_product(F.col("t")), t=raw) == clean


def test_novelty_cases(spark):
    rows = [("a", "x", 310, 0, None, None), ("b", "x", 120, 3, 0.85, "NONE"), ("c", "x", 120, 1, 0.20, "NONE"), ("d", "x", 120, 4, 0.45, "HIGH")]
    df = spark.createDataFrame(rows, "gene_id string, genome_id string, protein_length int, evidence_count int, score double, severity string")
    got = {r.gene_id: (r.novelty, round(r.novelty_score, 2)) for r in interpretation.novelty(df).collect()}
    assert got == {"a": ("dark_matter", 0.95), "c": ("weak_evidence", 0.55), "d": ("conflict", 0.65)}


@pytest.mark.parametrize(("evalue", "confidence"), [(1e-30, 0.95), (1e-15, 0.9), (1e-7, 0.8), (1e-4, 0.7), (5e-3, 0.6), (0.5, 0.45)])
def test_domain_ladder(spark, evalue, confidence):
    assert one(spark, ev.domain_confidence(F.col("e")), e=evalue) == confidence


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one [E. coli]\nacgt\nACGN\n>s2\nAC!T\n")
    got = {r.name: (r.description, r.organism, r.sequence, r.valid) for r in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"s1": ("first one [E. coli]", "E. coli", "ACGTACGN", True), "s2": ("", None, "AC!T", False)}
    (tmp_path / "h.xml").write_text(
        "<B><Hit><Hit_id>h</Hit_id><Hit_def>d</Hit_def><Hit_accession>A</Hit_accession><Hit_hsps><Hsp><Hsp_bit-score>50</Hsp_bit-score><Hsp_evalue>1e-9</Hsp_evalue><Hsp_identity>45</Hsp_identity>"
        "<Hsp_align-len>60</Hsp_align-len><Hsp_gaps>2</Hsp_gaps><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>60</Hsp_query-to><Hsp_hit-from>1</Hsp_hit-from><Hsp_hit-to>60</Hsp_hit-to></Hsp></Hit_hsps></Hit></B>"
    )
    hit = readers.read_blast_xml(spark, str(tmp_path / "h.xml")).first()
    assert (hit.hit_id, hit.identity_percent, hit.coverage_percent, hit.mismatches) == ("h", 75.0, 100.0, 2)
    (tmp_path / "p.dat").write_text("CC   header\n//\nID   ASN; PATTERN.\nAC   PS1;\nDE   N-glycosylation.\nPA   N-{P}-[ST]-\nPA   {P}.\n//\nID   M; MATRIX.\nAC   PS2;\n//\n")
    assert [(r.id, r.pattern) for r in readers.read_prosite(spark, str(tmp_path / "p.dat")).collect()] == [("ASN", "N-{P}-[ST]-{P}")]


def test_stream(spark, tmp_path):
    from annoflux.streaming.interpretation import stream_interpret

    spark.createDataFrame([("a", "ATG" + "AAA" * 40 + "TAA")], "genome_id string, sequence string").write.parquet(str(tmp_path / "in"))
    run = lambda: stream_interpret(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), orfs.six_frame_orfs).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    run()
    assert first > 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == first
