"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where it is unset and Spark runs inside one process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints a frame that several steps read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
