"""Incremental, restartable processing of files (SNK02, JN05, section 2.17).

A file stream with a checkpoint reads each file once; each micro-batch appends
only rows whose keys the table lacks, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from folioflow.sources.sinks import append_missing


def process_new_files(spark: SparkSession, source: str, schema: T.StructType, table: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame] = lambda df: df, fmt: str = "parquet", glob: str | None = None) -> None:
    """Process what has come since the last call and append it to a Parquet table. ``glob`` names what of the source is read: files, or folders with all files in them."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        source = f"{source.rstrip('/')}/{{{glob}}}"  # in braces a plain name is a pattern too, which may match one file

    def batch(df: DataFrame, _: int) -> None:
        append_missing(work(df), table, keys)

    stream = reader.load(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
