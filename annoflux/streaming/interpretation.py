"""Stream of uploaded genomes to interpretations: files in, tables out, each genome once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

GENOMES = "genome_id string, sequence string"


def stream_interpret(spark: SparkSession, source: str, target: str, checkpoint: str, interpret: Callable[[DataFrame], DataFrame], schema: str = GENOMES, key: str = "genome_id") -> StreamingQuery:
    """Interprets new genome files (parquet) of ``source`` and appends the results to ``target``.

    A genome is interpreted when its ``key`` is first seen, and never again over the stream's life: the keys seen are
    keyed state of the stream, kept in ``checkpoint`` by partition (with many millions, in the RocksDB state store), and survive restarts. A batch writes to a folder of its own number, so a batch that is run again replaces what it wrote.
    The stream ends when the files present are done; a later call goes on from the checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        interpret(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
