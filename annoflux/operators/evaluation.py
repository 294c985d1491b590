"""Evaluation of gene calls, and catalogue queries over many genomes and jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoflux.operators import intervals as iv
from annoflux.operators.ranges import islands, numbered


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches of pairs that come by island, prediction, truth; what is taken is kept while predictions can still reach it."""
    island, last, taken = None, None, {}
    for batch in batches:
        out = []
        for x in batch.itertuples(index=False):
            own = (x.genome_id, x.strand, x.island)
            if own != island:
                island, last, taken = own, None, {}
            if x.p != last and x.t not in taken:
                taken, last = {t: end for t, end in taken.items() if end > x.start} if len(taken) > 1024 else taken, x.p
                taken[x.t] = x.r_end
                out.append((x.genome_id, x.strand, x.p, x.t))
        yield pd.DataFrame(out, columns=["genome_id", "strand", "p", "t"])


def match_genes(truth: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(genome_id, strand, p, t): greedy matches of predictions, in order, with the first free truth span.

    Spans are numbered within genome and strand by position, without a task for a contig. The pairs that overlap
    enough come from the binned join; pairs whose spans are chained by overlaps are an island. Islands don't
    compete for a span: each is matched by itself, its pairs streamed in order.
    """
    spans = ("genome_id", "strand", "start", "end")
    p, t = (numbered(x.select(*spans), ("genome_id", "strand"), ["start", "end"], n) for x, n in ((predictions, "p"), (truth, "t")))
    enough = iv.reciprocal_overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) >= threshold
    pairs = iv.overlap_join(p, t, keys=("genome_id", "strand"), extra=enough).withColumnRenamed("r_t", "t")
    pairs = pairs.withColumns({"low": F.least("start", "r_start"), "high": F.greatest("end", "r_end")})
    chained = islands(pairs, ("genome_id", "strand"), "low", "high", "island")
    key = ["genome_id", "strand", "island"]
    streamed = chained.select(*key, "p", "t", "start", "r_end").repartition(*key).sortWithinPartitions(*key, "p", "t")
    return streamed.mapInPandas(_greedy, "genome_id string, strand int, p long, t long")


def evaluation(truth: DataFrame, predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per genome tp, fp, fn, precision, recall and f1; 0 where nothing divides."""
    hits = match_genes(truth, predictions, threshold).groupBy("genome_id").agg(F.count("*").alias("tp"))
    n_t, n_p = (x.groupBy("genome_id").agg(F.count("*").alias(n)) for x, n in ((truth, "n_truth"), (predictions, "n_pred")))
    every = n_t.join(n_p, "genome_id", "full").join(hits, "genome_id", "left").na.fill(0)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counted = every.select("genome_id", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"))
    rated = counted.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def compare_tools(a: DataFrame, b: DataFrame) -> DataFrame:
    """F1 of a less that of b by genome."""
    both = a.select("genome_id", F.col("f1").alias("f1_a")).join(b.select("genome_id", F.col("f1").alias("f1_b")), "genome_id")
    return both.withColumn("delta", F.col("f1_a") - F.col("f1_b"))


def count_by_mode(genes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Genes and genes a kb by genome and mode; ``lengths`` has genome_id and length."""
    counts = genes.groupBy("genome_id", "mode").agg(F.count("*").alias("n"))
    return counts.join(lengths, "genome_id").withColumn("per_kb", F.col("n") / (F.col("length") / 1000.0)).drop("length")


def dark_gene_catalogue(jobs: DataFrame) -> DataFrame:
    """Dark genes of completed jobs, once each: that of the latest job.

    ``genes_json`` is a list of records with gene_id and is_dark.
    """
    record = F.from_json("genes_json", "array<struct<gene_id:string,is_dark:boolean>>")
    each = jobs.where("status = 'COMPLETED'").select("job_id", "created_at", F.explode(record).alias("g")).where("g.is_dark")
    rows = each.select("g.gene_id", "job_id", "created_at")
    first = Window.partitionBy("gene_id").orderBy(F.desc("created_at"), "job_id")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def job_list(jobs: DataFrame, most: int | None = None) -> DataFrame:
    ordered = jobs.orderBy(F.desc("created_at"), "job_id")
    return ordered if most is None else ordered.limit(most)


def job_statistics(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with total_genes, interpreted_genes, high_confidence_count and dark_count of their results (job_id, score, level); 0 without any."""
    counts = results.groupBy("job_id").agg(
        F.count("*").alias("total_genes"), F.count("score").alias("interpreted_genes"), F.count_if(F.col("level") == "high").alias("high_confidence_count"), (F.count("*") - F.count("score")).alias("dark_count")
    )
    names = ["total_genes", "interpreted_genes", "high_confidence_count", "dark_count"]
    return jobs.drop(*names).join(counts, "job_id", "left").na.fill(0, names)


def stale_jobs(jobs: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Jobs with the status that cleaning gives them: pending or running ones older than ``minutes`` are cancelled."""
    old = F.col("created_at").cast("timestamp") < now - F.make_dt_interval(mins=F.lit(minutes))
    return jobs.withColumn("status", F.when(F.col("status").isin("PENDING", "RUNNING") & old, "CANCELLED").otherwise(F.col("status")))


def lookup_freshness(entries: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Latest row of each (namespace, hashed key), without expired ones.

    Reads namespace, key, stored_at and value; keys are trimmed and upper-cased before hashing.
    """
    hashed = entries.withColumn("key_hash", F.sha2(F.upper(F.trim("key")), 256))
    latest = Window.partitionBy("namespace", "key_hash").orderBy(F.desc("stored_at"), F.desc("value"))
    kept = hashed.withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n")
    return kept.where(F.col("stored_at") >= now - F.make_dt_interval(days=F.lit(days)))


def entries_by_namespace(entries: DataFrame) -> DataFrame:
    """(namespace, n): different stored keys of each namespace, expired ones included."""
    keys = entries.select("namespace", F.sha2(F.upper(F.trim("key")), 256).alias("key_hash")).distinct()
    return keys.groupBy("namespace").agg(F.count("*").alias("n"))


def genes_in_order(genes: DataFrame) -> DataFrame:
    return genes.orderBy("genome_id", "start", "end")
