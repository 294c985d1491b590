"""Interval joins as equi-joins on bins with a residual condition.

Both sides are dealt into the bins that they touch; a pair is kept in the last of its two
first bins, so that it is seen once. Spans of more than ``GIANT`` bins would fill the bins
of a whole contig: they go into coarser bins of their own and meet the rest there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 4096
GIANT = 64


def _binned(df: DataFrame, size: int, start: str, end: str, levels: bool) -> DataFrame:
    """A row for each bin and level: level 0 for common spans, 1 (``GIANT`` times as wide) for giants."""
    span = F.floor((F.col(end) - 1) / size) - F.floor(F.col(start) / size)
    level = F.when(span > GIANT, 1).otherwise(0)
    df = df.withColumn("_level", level)
    both = F.explode(F.array(F.lit(0), F.lit(1))) if levels else F.col("_level")
    df = df.withColumn("_at", both)
    width = F.when(F.col("_at") == 1, F.lit(size * GIANT)).otherwise(F.lit(size))
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    return df.withColumns({"_first": first, "_bin": F.explode(F.sequence(first, F.greatest(first, last)))})


def overlap_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("genome_id",), extra: Column | None = None, size: int = BIN) -> DataFrame:
    """Pairs of spans with ``left.start < right.end`` and ``left.end > right.start`` and equal keys.

    Columns of ``right`` other than the keys get the prefix ``r_``. ``extra`` is a further condition on the pair.
    """
    renamed = right.select(*keys, *[F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns if c not in keys])
    condition = (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    if extra is not None:
        condition &= extra
    # every span is known at the level of its partner: level 1 holds pairs with a giant on either side
    a = _binned(left, size, "start", "end", levels=True).select(*left.columns, "_level", "_at", "_first", "_bin")
    b = _binned(renamed, size, "r_start", "r_end", levels=True)
    b = b.select(*renamed.columns, F.col("_level").alias("_r_level"), "_at", F.col("_first").alias("_r_first"), "_bin")
    a = a.where((F.col("_at") == 1) | (F.col("_level") == 0))
    b = b.where((F.col("_at") == 1) | (F.col("_r_level") == 0))
    once = F.col("_bin") == F.greatest("_first", "_r_first")
    right_level = F.col("_at") == F.greatest("_level", "_r_level")
    return a.join(b, [*keys, "_at", "_bin"]).where(condition & once & right_level).select(*left.columns, *[c for c in renamed.columns if c not in keys])


def overlap_filter(left: DataFrame, right: DataFrame, keep: bool, keys: tuple[str, ...] = ("genome_id",), extra: Column | None = None, size: int = BIN) -> DataFrame:
    """Rows of ``left`` with (``keep``) or without an overlapping row of ``right``; rows with equal spans fare alike.

    Only different spans go through the bins; ``extra`` may use the keys, start, end and r_ columns.
    """
    span = [*keys, "start", "end"]
    met = overlap_join(left.select(*span).distinct(), right, keys, extra, size).select(*span).distinct()
    return left.join(met, span, "left_semi" if keep else "left_anti")


def without_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """J1 as anti-join: spans that overlap none of ``right``."""
    return overlap_filter(left, right, keep=False)


def covered_by(left: DataFrame, right: DataFrame, fraction: float = 0.5, keep: bool = True) -> DataFrame:
    """J2: spans of whose length more than ``fraction`` is covered by a single span of ``right`` (or the others)."""
    inter = F.least("end", "r_end") - F.greatest("start", "r_start")
    return overlap_filter(left, right, keep, extra=inter / (F.col("end") - F.col("start")) > fraction)


def overlaps_parent(left: DataFrame, parents: DataFrame) -> DataFrame:
    """J3: spans that overlap some parent."""
    return overlap_filter(left, parents, keep=True)


def near_duplicate(left: DataFrame, parents: DataFrame, within: int = 9, keep: bool = False) -> DataFrame:
    """J4: spans without (or with) a parent on their strand both of whose ends lie less than ``within`` from theirs."""
    near = (F.abs(F.col("start") - F.col("p_start")) < within) & (F.abs(F.col("end") - F.col("p_end")) < within)
    span = ["genome_id", "strand", "start", "end"]
    cell = F.floor(F.col("start") / within)
    a = left.select(*span).distinct().withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    b = parents.select("genome_id", "strand", F.col("start").alias("p_start"), F.col("end").alias("p_end")).withColumn("_cell", F.floor(F.col("p_start") / within))
    met = a.join(b, ["genome_id", "strand", "_cell"]).where(near).select(*span).distinct()
    return left.join(met, span, "left_semi" if keep else "left_anti")


def genes_in_region(genes: DataFrame, start: int, end: int) -> DataFrame:
    """J5: genes that overlap [start, end)."""
    return genes.where((F.col("start") < end) & (F.col("end") > start))


def reciprocal_overlap(start: Column, end: Column, r_start: Column, r_end: Column) -> Column:
    """B1: intersection over the longer span."""
    inter = F.greatest(F.least(end, r_end) - F.greatest(start, r_start), F.lit(0))
    longer = F.greatest(end - start, r_end - r_start)
    return F.when(longer > 0, inter / longer).otherwise(0.0)
