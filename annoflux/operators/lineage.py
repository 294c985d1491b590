"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where it is unset and Spark runs inside one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return tempfile.mkdtemp(prefix="checkpoints-")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows out by ``key`` once and checkpoints them: a table that lies in one split is else read by a single task in every step."""
    return cut(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints a frame that several steps read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """Keeps a frame that several steps read in Spark's columnar cache, on disk only, dealt out as it is.

    Columns that repeat take a small part of what a checkpoint's rows do. It stays until it is unpersisted or the
    session's cache is cleared. The condition is true and its text is new each time, so that a frame made alike later, when its files
    may be others, is read anew.
    """
    return df.where(F.lit(uuid.uuid4().hex) != "").persist(StorageLevel.DISK_ONLY)
