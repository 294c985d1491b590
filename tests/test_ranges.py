"""Numbers, islands, matches, nested scans, the stream and plugins, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from annoflux.operators import discovery, evaluation, orfs
from annoflux.operators import evidence as ev
from annoflux.operators.ranges import islands, numbered
from annoflux.streaming.interpretation import stream_interpret

SPAN = "genome_id string, start long, end long, strand int"


@pytest.fixture(scope="module")
def spans(spark):
    """One genome holds most rows, others few; some spans repeat, one covers many."""
    rnd = random.Random(4)
    rows = [("big|1" if rnd.random() < 0.7 else f"g|{rnd.randint(0, 9)}", a := rnd.randint(0, 40_000), a + rnd.randint(1, 60), rnd.choice([1, -1])) for _ in range(3000)]
    rows += [("big|1", 5000, 15_000, 1), ("last", 1, 5, -1)] + rows[:20]
    return rows, spark.createDataFrame(rows, SPAN).repartition(5)


@pytest.fixture(params=[10_000, 37])
def batch(request, spark):
    """Rows that a task sees at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_numbers(spans, batch):
    rows, df = spans
    found = numbered(df, ("genome_id", "strand"), [F.col("start"), F.desc("end")], "n").collect()
    assert sorted((*r[:4],) for r in map(tuple, found)) == sorted(rows)
    for key in {(r[0], r[3]) for r in rows}:
        own = sorted((r["n"], r["start"], -r["end"]) for r in found if (r["genome_id"], r["strand"]) == key)
        assert [n for n, _, _ in own] == list(range(1, len(own) + 1))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_islands(spans, batch):
    rows, df = spans
    found = [tuple(r) for r in islands(df, ("genome_id", "strand"), "start", "end", "island").collect()]
    assert len(found) == len(rows)
    want = []
    for key in {(r[0], r[3]) for r in rows}:
        begin, reach = None, None
        for g, a, b, s in sorted(r for r in rows if (r[0], r[3]) == key):
            if begin is None or a >= reach:
                begin, reach = a, b
            reach = max(reach, b)
            want.append((g, a, b, s, begin))
    assert sorted(found) == sorted(want)


def test_greedy_matches(spark, spans, batch):
    rows, df = spans
    truth = [r for i, r in enumerate(rows) if i % 2]
    calls = [r for i, r in enumerate(rows) if not i % 2]
    want = set()
    for key in {(r[0], r[3]) for r in rows}:
        t, p = (sorted((a, b) for g, a, b, s in x if (g, s) == key) for x in (truth, calls))
        free = dict(enumerate(t, 1))
        for n, (a, b) in enumerate(p, 1):
            for k, (c, d) in free.items():
                if 2 * (min(b, d) - max(a, c)) >= max(b - a, d - c):
                    want.add((*key, n, k))
                    del free[k]
                    break
    found = evaluation.match_genes(spark.createDataFrame(truth, SPAN), spark.createDataFrame(calls, SPAN))
    assert {tuple(r) for r in found.collect()} == want


def test_no_window_by_genome(spark, spans):
    _, df = spans
    plan = orfs.orfs_to_genes(df.withColumn("frame", F.lit(0)))._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], SPAN)
    assert numbered(none, ("genome_id",), ["start"], "n").count() == 0
    assert islands(none, ("genome_id",), "start", "end", "i").count() == 0
    assert evaluation.match_genes(none, none).count() == 0


def test_nested_scan_of_any_id(spark):
    """Ids of databases, repeated and overlapping hosts, both strands: equal to the scan of each host by itself."""
    rnd = random.Random(6)
    motif = lambda: "".join(rnd.choice(["AGGAGGTTTTTTATG", "CTCCAT", "GGAGG", "ATG"] + [rnd.choice("ACGT") * 3] * 30) for _ in range(700))
    genomes = [("gi|962|ref|NC_1|", motif()), ("gi|963", motif().lower()), ("none", None)]
    hosts = [(g, a, a + n, 1) for g, _ in genomes for a, n in ((0, 900), (3, 900), (3, 900), (100, 400), (40, 66), (50, 65), (1000, 5000))] + [("away", 0, 100, 1)]
    found = discovery.rescue_nested_scan(spark.createDataFrame(genomes, "genome_id string, sequence string"), spark.createDataFrame(hosts, SPAN)).collect()
    want = set()
    for g, a, b, _ in set(hosts):
        seq = dict(genomes).get(g)
        if seq is None or b - a < 66:
            continue
        region = spark.createDataFrame([("r", seq[a:b])], "genome_id string, sequence string")
        for r in discovery.rescue_candidates(region).where("rbs > 0").collect():
            if (r["start"], r["end"]) != (0, b - a):
                want.add((g, a + r["start"], a + r["end"], r["strand"], a, b, r["rbs"]))
    assert want and sorted(tuple(r) for r in found) == sorted(want)


def test_stream_sees_a_genome_once(spark, tmp_path):
    """A genome that comes again in a later batch, also after a restart, is not interpreted again."""
    schema, seq = "genome_id string, sequence string", "ATG" + "AAA" * 40 + "TAA"
    add = lambda *ids: spark.createDataFrame([(i, seq) for i in ids], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: stream_interpret(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), orfs.six_frame_orfs).awaitTermination()
    seen = lambda: sorted(r["genome_id"] for r in spark.read.parquet(str(tmp_path / "out")).where("start = 0").collect())
    add("a", "b", "b")
    run()
    assert seen() == ["a", "b"]
    add("b", "c")
    run()
    add("a", "c", "d")
    run()
    assert seen() == ["a", "b", "c", "d"]


def test_plugins_that_fail_while_running(spark):
    genes = spark.createDataFrame([(f"g{i}", i) for i in range(20)], "gene_id string, n long")

    def one_gene(gene):
        if gene["n"] == 7:
            raise KeyError("seven")
        return [{"evidence_type": "domain_hit", "description": f"hit {gene['n']}", "confidence": 2.0 if gene["n"] == 9 else 0.5}] * (gene["n"] % 2)

    plugins = ev.EvidencePlugins()
    plugins.register_gene_scan("mine", one_gene)
    plugins.register("late", lambda g: g.select(*[F.lit(None).cast("string").alias(c) for c in ev.COLUMNS if c not in ("gene_id", "confidence", "layer", "layer_seq")], F.col("gene_id"), F.lit(0).alias("layer"), F.lit(0).cast("long").alias("layer_seq"), F.raise_error(F.lit("late")).cast("double").alias("confidence")))
    found = plugins.scan(genes, isolate=True).collect()
    assert sorted(r["description"] for r in found) == sorted(f"hit {n}" for n in range(1, 20, 2) if n not in (7, 9))
    assert "late" in plugins.skipped and len(plugins.skipped) == 1
    assert sorted((r["plugin"], r["gene_id"], r["error"][:8]) for r in plugins.faults(genes).collect()) == [("mine", "g7", "KeyError"), ("mine", "g9", "ValueErr")]
