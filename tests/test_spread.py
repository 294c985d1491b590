"""Genomes dealt out over tasks, many scanned at once, and codons counted by batch, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from annoflux.operators import discovery, hypotheses, interpretation, orfs
from annoflux.operators.lineage import keep
from annoflux.plans import registry
from annoflux.plans.views import dealt_genomes, view
from tests.test_units import naive_orfs


def test_genomes_of_one_split_are_dealt_out(spark, sf_dir):
    """The documents lie in one split, so that one task made and scanned all genomes."""
    whole = view(spark, sf_dir, "genomes")
    assert whole.rdd.getNumPartitions() == 1
    dealt = dealt_genomes(spark, sf_dir)
    sizes = Counter(r["p"] for r in dealt.select(F.spark_partition_id().alias("p")).collect())
    assert len(sizes) == 8 and max(sizes.values()) < sum(sizes.values()) / 2
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))


def test_scan_of_many_genomes_at_once(spark, monkeypatch):
    """Short genomes together and longer ones alone, in any case and with letters that are no base; no frame reaches into the next genome."""
    monkeypatch.setattr(orfs, "TILE", 400)
    calls = []
    monkeypatch.setattr(orfs, "_next_stops_of_many", lambda *x, f=orfs._next_stops_of_many: calls.append(1) or f(*x))
    rnd = random.Random(8)
    texts = {f"g{i}": "".join(rnd.choice("ACGTACGTACGTacgtNR") for _ in range(rnd.choice([0, 1, 2, 3, 4, 30, 90, 200, 700]))) for i in range(120)} | {"open": "ATG" + "AAA" * 20, "next": "TAA" + "ATG" * 9 + "TAA"}
    genomes = spark.createDataFrame([*texts.items(), ("null", None)], "genome_id string, sequence string").coalesce(1)
    want = {(g, *x) for g, s in texts.items() for x in naive_orfs(s.upper(), 12)}
    found = orfs.six_frame_orfs(genomes, min_length=12).collect()
    assert {(r.genome_id, r.strand, r.start, r.end) for r in found} == want and len(found) == len(want)
    for r in orfs.orfs_with_sequence(genomes, min_length=12).collect():
        part = texts[r.genome_id].upper()[r.start : r.end]
        assert r.sequence == (part if r.strand == 1 else part.translate(str.maketrans("ATGC", "TACG"))[::-1])
    whole = [(r.genome_id, r.stop, r.partial) for r in orfs.six_frame_orfs(genomes, min_length=60, include_partial=True).where("genome_id = 'open' AND strand = 1").collect()]
    assert whole == [("open", 63, True)]
    first = {(r.genome_id, r.strand, r.stop): r.pos for r in orfs.longest_orf_per_stop(genomes, 3, context=True).collect()}
    atg = {}
    for g, s in texts.items():
        for strand, t in ((1, s.upper()), (-1, s.upper().translate(str.maketrans("ATGC", "TACG"))[::-1])):
            for i in range(len(t) - 2):
                stop = next((j + 3 for j in range(i, len(t) - 2, 3) if t[j : j + 3] in orfs.STOPS), None)
                if t[i : i + 3] == "ATG" and stop:
                    atg.setdefault((g, strand, stop), i)
    assert first == {k: i for k, i in atg.items() if k[2] - i >= 12}


def test_codon_scores(spark):
    rnd = random.Random(9)
    genes = [(f"g{i % 3}", i, rnd.choice([1, -1]), "".join(rnd.choice("ACGTacgtN") for _ in range(rnd.randint(0, 60)))) for i in range(50)] + [("g0", 50, 1, None), ("none", 51, 1, "ATGATG")]
    df = spark.createDataFrame(genes, "genome_id string, n int, strand int, sequence string").repartition(3)
    usage = {(r["genome_id"], r["codon"]): r["frequency"] for r in discovery.codon_usage(df.where("n < 40")).collect()}
    found = discovery.codon_score(df, discovery.codon_usage(df.where("n < 40")))
    assert found.columns == [*df.columns, "codon_score"]
    codons = {n: [s.upper()[i : i + 3] for i in range(0, len(s or "") - 2, 3)] for _, n, _, s in genes if s}
    want = {n: sum(usage.get((g, c), 0) for c in codons.get(n, ())) / max(len(codons.get(n, ())), 1) for g, n, _, _ in genes}
    assert {r["n"]: r["codon_score"] for r in found.collect()} == pytest.approx(want)


def test_motif_mean_does_not_depend_on_how_rows_lie(spark):
    """0.38 + 0.92 + 0.2 lies below 1.5 or at it, by the order of adding; it is that of ev_seq, in which the SQL's rows come, however evidence is dealt out."""
    rows = [("g", 1, 0.38), ("g", 4, 0.2 + 0.08 * 6 + 0.08 * 3), ("g", 5, 0.2)]
    found = set()
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0), (0, 2, 1), (2, 1, 0)):
        df = spark.createDataFrame([(g, n, "motif_match", "walker_b", c) for g, n, c in (rows[i] for i in order)], "gene_id string, ev_seq int, evidence_type string, motif_name string, confidence double").repartition(3, "ev_seq")
        (row,) = hypotheses.motif_hypotheses(df).collect()
        found.add((row["confidence"], tuple(row["ids"])))
    mean = (rows[0][2] + rows[1][2] + rows[2][2]) / 3
    assert mean < 0.5 and found == {(0.45, (1, 4, 5))}
    none = spark.createDataFrame([("g", 1, "motif_match", "walker_b", None)], "gene_id string, ev_seq int, evidence_type string, motif_name string, confidence double")
    assert [tuple(r["ids"]) for r in hypotheses.motif_hypotheses(none).collect()] == [(1,)]


def _evidence(spark, rnd, genes=60):
    kinds, products = ["sequence_feature", "blast_homology", "domain_hit", "motif_match"], ["DNA polymerase", "putative kinase", "membrane pump [E. coli]", "holin", "orf0001", "capsid protein"]
    rows = [(f"g{g}", n, rnd.choice(kinds), rnd.choice(products), rnd.randint(20, 99) / 100, rnd.choice(["walker_b", "mystery", "egf_like"])) for g in range(genes) for n in range(1, rnd.randint(2, 9))]
    return spark.createDataFrame(rows, "gene_id string, ev_seq int, evidence_type string, description string, confidence double, motif_name string").withColumns({"domain_name": F.lit(None).cast("string"), "accession": F.lit(None).cast("string")})


def test_evidence_is_dealt_out_once(spark):
    """Hypotheses, confidence and interpretation of kept evidence move none of it again; without details they are those with details, without the lists."""
    rows = hypotheses.dealt(_evidence(spark, random.Random(4)))
    seen = {}
    for details in (True, False):
        scored = interpretation.score_confidence(hypotheses.generate_hypotheses(rows, details=details, deal=False), rows)
        told = interpretation.interpret(interpretation.rank_hypotheses(scored))
        seen[details] = sorted(map(str, told.select("gene_id", "hypothesis", "score", "level", "category", "severity", "competing", "uncertainty").collect()))
        assert ("ids" in told.columns) == ("reasoning" in told.columns) == details
        found = told.select("gene_id", "score")
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # Python's groups of hypotheses are made once, and are all that is dealt out
        assert plan.count("MapInPandas" if details else "MapInArrow") == 1 and "LeftOuter" not in plan
    assert seen[True] == seen[False] and len(seen[True]) > 30
    rows.unpersist()


def test_brief_merge_is_the_whole_one(spark):
    rnd = random.Random(6)
    rows = [(f"g{n % 7}", rnd.randint(0, 2), n, rnd.choice(["Kinase", "kinase", "Pump", "pump", "X", None]), rnd.choice(["unknown", "metabolism", "transport", None]), rnd.random(), "S", [n], ["r"], ["k"]) for n in range(200)]
    df = spark.createDataFrame(rows, "gene_id string, tier int, place int, function string, category string, confidence double, source_type string, ids array<int>, reasoning array<string>, keywords array<string>")
    columns = ["gene_id", "hyp_seq", "function", "category", "confidence"]
    brief = hypotheses.merge_similar(df.drop("source_type", "ids", "reasoning", "keywords"))
    assert brief.columns == columns
    assert sorted(map(str, brief.collect())) == sorted(map(str, hypotheses.merge_similar(df).select(columns).collect()))


def test_kept_frame_is_read_anew(spark, tmp_path):
    """A frame made alike after its files changed is not taken from the cache."""
    import pandas as pd

    seen = []
    for value in (1, 2):
        pd.DataFrame({"x": [value]}).to_parquet(f"{tmp_path}/a.parquet")
        seen.append(keep(spark.read.parquet(f"{tmp_path}/a.parquet")).first()["x"])
    assert seen == [1, 2]
    spark.catalog.clearCache()


def test_export_merges_hypotheses_once(spark, sf_dir, monkeypatch):
    """The results, their sums and the lists of hypotheses were each made from the evidence anew."""
    calls = []
    monkeypatch.setattr(hypotheses, "merge_similar", lambda *x, f=hypotheses.merge_similar: calls.append(1) or f(*x))
    registry.queries()["s15_export_interpretation_json"](spark, sf_dir)
    assert len(calls) == 1
