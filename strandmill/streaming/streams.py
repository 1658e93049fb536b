"""Streaming forms: stateless curation, first rows per id, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_each: int = 1) -> DataFrame:
    """A folder of files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(kind).load(path)


def curated(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Curation steps are projections, so they hold for streams as they are."""
    for step in steps:
        stream = step(stream)
    return stream


def first_per_id(stream: DataFrame, id_column: str, time_column: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose id has not come before; with a time column, state is kept for ``delay``."""
    if time_column is None:
        return stream.dropDuplicates([id_column])
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([id_column])


def windowed_counts(stream: DataFrame, time_column: str, width: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and key; rows later than ``delay`` are left out."""
    return stream.withWatermark(time_column, delay).groupBy(F.window(time_column, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run what is available into Parquet files; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()


def run_to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Run what is available through a memory table, for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
