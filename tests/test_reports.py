"""Discovery, reports and exports on handmade inputs, against plain Python."""

import json
import random

import numpy as np
import pytest

from annoflux.operators import discovery, evaluation, interpretation, motifs, orfs
from annoflux.operators import evidence as ev
from annoflux.operators.genome import interpret_genomes
from annoflux.sources import sinks

TOLD = "gene_id string, hypothesis string, score double, level string, category string, severity string, ids array<string>, reasoning array<string>, competing array<struct<final_rank:int,function:string,adjusted:double>>, uncertainty array<string>"
SPAN = "genome_id string, start long, end long, strand int"


def told(gene="g", hypothesis="kinase", score=0.95, level="high", severity="NONE", reasoning=("BLAST hit",), competing=(), uncertainty=()):
    return (gene, hypothesis, score, level, "metabolism", severity, ["1"], list(reasoning), list(competing), list(uncertainty))


@pytest.mark.parametrize(
    ("row", "parts"),
    [
        (told(), ["Called a **kinase** with very high confidence.", "mainly on sequence homology"]),
        (told(score=0.85, reasoning=["a Motif"]), ["The evidence strongly suggests a **kinase**.", "conserved motifs"]),
        (told(level="moderate", reasoning=["BLAST", "motif"]), ["Probably a **kinase**; some doubt is left.", "homology and motifs agree"]),
        (told(level="low", reasoning=[], competing=[(2, "pump", 0.4)]), ["A first look hints at a **kinase**. No details of the evidence are at hand. The runner-up (pump)"]),
        (told(level="speculative", reasoning=["length"]), ["Open; at best it resembles a **kinase**. It rests on features"]),
        (told(hypothesis="Ambiguous interpretation: 'a' vs 'b'", level="low", competing=[(2, "pump", 0.4)], uncertainty=["conflicting_evidence"]), ["stays ambiguous", "conflicting signal"]),
    ],
)
def test_narrative(spark, row, parts):
    text = interpretation.narrative(spark.createDataFrame([row], TOLD)).first().narrative
    assert all(p in text for p in parts), text
    assert ("runner-up" in text) == (bool(row[8]) and "conflicting_evidence" not in row[9])


def test_genome_json(spark):
    genomes = spark.createDataFrame([("x", "ATGGCC", "E. coli"), ("bare", "", None)], "genome_id string, sequence string, organism string")
    genes = spark.createDataFrame([("x", "b", 3, 6, 1, "MA", "kinase"), ("x", "a", 0, 3, -1, None, None)], "genome_id string, gene_id string, start long, end long, strand int, protein_seq string, product string")
    evidence = spark.createDataFrame([("b", 2, "motif_match", "m2", 0.5), ("b", 1, "motif_match", 'm "1"', 0.6)], "gene_id string, ev_seq int, evidence_type string, description string, confidence double")
    found = {r.genome_id: json.loads(r.json) for r in sinks.genome_json(genomes, genes, evidence, spark.createDataFrame([told("b")], TOLD), include_sequence=True).collect()}
    x = found["x"]
    assert (x["id"], x["length"], x["gene_count"], x["metadata"]["organism"], x["sequence"]) == ("x", 6, 2, "E. coli", "ATGGCC")
    assert [g["id"] for g in x["genes"]] == ["a", "b"]
    assert x["genes"][0]["protein"] is None
    assert x["genes"][1]["protein"]["product_name"] == "kinase"
    assert x["genes"][1]["location"] == {"start": 3, "end": 6, "strand": 1}
    assert [e["description"] for e in x["genes"][1]["evidence"]] == ['m "1"', "m2"]
    assert x["genes"][1]["interpretations"][0]["confidence_level"] == "high"
    assert found["bare"]["genes"] == []


def test_interpretation_json(spark):
    rows = [told("a", competing=[(2, "pump", 0.4)]), told("b", level="low")]
    results = spark.createDataFrame([("x", *r) for r in rows] + [("x", "dark", *[None] * 9)], "genome_id string, " + TOLD)
    hyps = spark.createDataFrame([("a", 2, "pump", "transport", 0.4, ["r"]), ("a", 1, "kinase", "metabolism", 0.9, ["q"])], "gene_id string, final_rank int, function string, category string, confidence double, reasoning array<string>")
    sums = spark.createDataFrame([("a", 3, 2, 1.5)], "gene_id string, evidence_count long, type_diversity long, total double")
    out = json.loads(sinks.interpretation_json(results, interpretation.interpretation_summary(results), hyps, sums).first().json)
    assert out["statistics"] == {"total_genes": 3, "interpreted_genes": 2, "success_rate": 66.67, "high_confidence": 1, "moderate_confidence": 0, "low_confidence": 1, "failed": 0}
    a, b, dark = out["results"]
    assert [h["function"] for h in a["hypotheses"]] == ["kinase", "pump"]
    assert a["evidence_summary"] == {"count": 3, "types": 2, "weighted_score": 1.5}
    assert a["interpretation"]["competing_hypotheses"][0]["reason_not_preferred"] == "Lower adjusted confidence (40% vs 95%; Δ=55%)"
    assert dark["interpretation"] is None and dark["success"]


def test_records_and_report_rows(spark):
    genes = spark.createDataFrame([("a", 0, 300, 1), ("b", 300, 600, -1)], "gene_id string, start long, end long, strand int")
    evidence = spark.createDataFrame([("a", n, "motif_match", f"m{n}", n / 10) for n in range(1, 8)], "gene_id string, ev_seq int, evidence_type string, description string, confidence double")
    rows = {r.gene_id: r for r in sinks.gene_records(genes, spark.createDataFrame([told("a", competing=[(2, "pump", 0.4567)])], TOLD), evidence).collect()}
    assert [e.label for e in rows["a"].evidence] == ["m7", "m6", "m5", "m4", "m3"]
    assert (rows["a"].level, rows["a"].function, rows["a"].competing_hypotheses[0].confidence, rows["a"].is_dark) == ("HIGH", "kinase", 0.457, False)
    assert (rows["b"].is_dark, rows["b"].evidence, rows["b"].go_terms, rows["b"].length) == (True, [], [], 300)
    flat = {r.gene_id: tuple(r) for r in sinks.report_rows(spark.createDataFrame([told("a"), ("c", *[None] * 9)], TOLD)).collect()}
    assert flat == {"a": ("a", "kinase", "HIGH", 0.95, "metabolism", 1), "c": ("c", "unknown", "NONE", 0.0, "unknown", 0)}


def test_motif_report_and_evidence(spark):
    genes = spark.createDataFrame([("a", "MKVLIGXXXXGKSFAMGAAAAGKT"), ("b", "M"), ("c", None)], "gene_id string, protein_seq string")
    matches = motifs.motif_scan(genes, motifs.builtin_patterns(spark).where("name = 'atp_binding_p_loop'"))
    assert {tuple(r) for r in motifs.motif_report(genes, matches).collect()} == {("a", 2, "atp_binding_p_loop"), ("b", 0, "-"), ("c", 0, "-")}
    rows = ev.motif_evidence(matches).orderBy("layer_seq").collect()
    assert [r.description for r in rows] == ["Motif match: ATP/GTP binding P-loop (Walker A motif) at positions 5-13", "Motif match: ATP/GTP binding P-loop (Walker A motif) at positions 16-24"]


def test_explain_differences(spark):
    rows = [("a", 1, "high", ["p1", "p2", "p3"], []), ("a", 2, "low", [], ["n1"]), ("b", 1, "low", [], [])]
    found = dict(interpretation.explain_differences(spark.createDataFrame(rows, "gene_id string, rank int, level string, positive array<string>, negative array<string>")).collect())
    assert found["a"] == "Hypothesis Comparison:\n\nHypothesis 1: high\n  Strengths: p1, p2\n\nHypothesis 2: low\n  Weaknesses: n1\n"
    assert found["b"] == "Single hypothesis - no comparison available."


def test_summary_and_tools(spark):
    genomes = spark.createDataFrame([("x", "GGCCAATT"), ("empty", "")], "genome_id string, sequence string")
    genes = spark.createDataFrame([("x", "a"), ("x", "b")], "genome_id string, gene_id string")
    found = {r.genome_id: (r.length, r.gc, r.gene_count, r.interpreted, r.coverage) for r in ev.genome_summary(genomes, genes, spark.createDataFrame([("a",), ("a",)], "gene_id string")).collect()}
    assert found == {"x": (8, 50.0, 2, 1, 50.0), "empty": (0, 0.0, 0, 0, 0.0)}
    f1 = lambda *rows: spark.createDataFrame(rows, "genome_id string, f1 double")
    assert [tuple(r) for r in evaluation.compare_tools(f1(("x", 0.75), ("y", 1.0)), f1(("x", 0.5))).collect()] == [("x", 0.75, 0.5, 0.25)]


def scanned(seq, starts, least, earliest):
    turned = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    out = set()
    for strand, s in ((1, seq), (-1, turned)):
        seen = set()
        for i in range(len(s) - 2):
            if s[i : i + 3] in starts:
                stop = next((j + 3 for j in range(i, len(s) - 2, 3) if s[j : j + 3] in ("TAA", "TAG", "TGA")), None)
                if stop is None or (earliest and stop in seen):
                    continue
                seen.add(stop)
                if stop - i >= least:
                    start, end = (i, stop) if strand == 1 else (len(s) - stop, len(s) - i)
                    out.add((start, end, strand, s[max(i - 15, 0) : i], s[i:stop]))
    return out


def dna(n, seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice(["A", "C", "G", "T", "AGGAGG"]) for _ in range(n))


@pytest.mark.parametrize("tile", [3, 30, 31, 64, 5000])
def test_next_stops_across_tiles(monkeypatch, tile):
    """Next stops are carried from later tiles; tasks import the module anew, so the helper is called here."""
    monkeypatch.setattr(orfs, "TILE", tile)
    for n in (3, 4, 5, 66, 1500):
        seq = dna(n, n)
        place, stop = orfs._next_stops(np.frombuffer(seq.encode(), np.uint8), orfs._kinds(orfs.STARTS), orfs._kinds(orfs.STOPS))
        expected = []
        for i in range(len(seq) - 2):
            if seq[i : i + 3] in orfs.STARTS:
                expected.append((i, next((j + 3 for j in range(i, len(seq) - 2, 3) if seq[j : j + 3] in orfs.STOPS), -1)))
        assert list(zip(place.tolist(), stop.tolist(), strict=True)) == expected


def test_frames_with_context(spark):
    seqs = {"a": dna(1500, 1), "b": dna(40, 2), "short": "AT", "none": None, "n": dna(300, 3) + "NNN" + dna(300, 4)}
    genomes = spark.createDataFrame(list(seqs.items()), "genome_id string, sequence string")
    rows = lambda df: {(r.genome_id, r.start, r.end, r.strand, r.upstream, r.sequence) for r in df.collect()}
    every = lambda *options: {(g, *x) for g, s in seqs.items() for x in scanned(s or "", *options)}
    assert rows(orfs.longest_orf_per_stop(genomes, 20, context=True)) == every(("ATG",), 63, True)
    assert rows(orfs.all_starts_orfs(genomes, 10, context=True)) == every(("ATG", "GTG", "TTG"), 33, False)


def test_nested_scan(spark):
    """Frames inside a host with a motif upstream, the host itself aside, against the plain scan of the host."""
    seq = dna(400, 7) + "AGGAGGACTACTATG" + "GCT" * 30 + "TAA" + dna(600, 8)
    genomes = spark.createDataFrame([("x", seq)], "genome_id string, sequence string")
    hosts = spark.createDataFrame([("x", 100, 1600, 1), ("x", 50, 100, 1)], SPAN)
    found = {(r.start, r.end, r.strand) for r in discovery.rescue_nested_scan(genomes, hosts).collect()}
    motifs_in = lambda up: any(m in up[max(len(up) - 14, 0) : max(len(up) - 4, 0)] for m in ("AGGAGG", "GGAGG", "AGGAG"))
    expected = {(100 + a, 100 + b, s) for a, b, s, up, _ in scanned(seq[100:1600], ("ATG",), 63, True) if motifs_in(up)}
    assert found == expected and found


def test_discovery_ends_with_rna(spark):
    genomes = spark.createDataFrame([("x", dna(2000, 9)), ("y", "ACGT" * 50)], "genome_id string, sequence string")
    genes = spark.createDataFrame([("x", 0, 90, 1, "annotation")], SPAN + ", source string")
    rna = lambda *rows: spark.createDataFrame(rows, SPAN)
    found = discovery.gene_discovery(genomes, genes, trna=rna(("y", 0, 70, 1), ("x", 80, 95, 1)), rrna=rna(("y", 60, 120, 1), ("y", 130, 190, -1))).collect()
    own = {(r.genome_id, r.start, r.end, r.source) for r in found if r.source.endswith("RNA_prediction")}
    assert own == {("y", 0, 70, "tRNA_prediction"), ("y", 130, 190, "rRNA_prediction")}
    assert ("x", 0, 90, 1, "annotation") in {tuple(r) for r in found}


def test_interpret_genomes(spark):
    body = "ATG" + "GCT" * 40 + "TAA"
    genomes = spark.createDataFrame([("x", "CCCCC" + body + "CC" * 40), ("none", "ACGT")], "genome_id string, sequence string")
    genes = spark.createDataFrame([("x", 5, 5 + len(body), 1, "DNA polymerase"), ("x", 5, 5 + len(body), 1, "DNA polymerase")], SPAN + ", product_name string")
    trna = spark.createDataFrame([("x", 140, 200, 1)], SPAN)
    done = interpret_genomes(genomes, genes, motifs.builtin_patterns(spark), trna=trna)
    rows = {(r.start, r.source): r for r in done.results.where("genome_id = 'x'").collect()}
    gene = rows[5, "annotation"]
    assert (gene.hypothesis, gene.category, gene.cog_category, gene.evidence_count) == ("DNA polymerase", "replication", "L", 1)
    assert (rows[140, "tRNA_prediction"].hypothesis, rows[140, "tRNA_prediction"].category) == ("tRNA", "ncRNA")
    assert "ncRNA" not in {r.category for r in done.novel.collect()}
    summary = {r.genome_id: r.asDict() for r in done.summary.collect()}
    assert summary["x"]["total"] == len(rows) and summary["x"]["interpreted"] >= 2
    assert done.genes.where("start = 5 and strand = 1").first().protein_seq == "M" + "A" * 40 + "*"


def test_interpret_no_genomes(spark):
    none = spark.createDataFrame([], "genome_id string, sequence string")
    done = interpret_genomes(none, spark.createDataFrame([], SPAN), motifs.builtin_patterns(spark))
    assert done.results.count() == 0 and done.summary.count() == 0
