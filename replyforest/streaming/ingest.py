"""Resumable ingest: a file stream that remembers what it has read."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from replyforest.sources.growing import BLOCK, stream_of_lines
from replyforest.sources.jsonl import parse_lines


def ingest_resumable(
    spark: SparkSession, source: str, target: str, checkpoint: str, fields: list[str], files_per_batch: int = 64
) -> StreamingQuery:
    """Appends the records of files not seen before to a Parquet table, then stops.

    The checkpoint stands for the id to resume after, a micro-batch for a chunk.
    Malformed lines are skipped.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(source)
    return (
        parse_lines(lines, fields)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_growing(spark: SparkSession, source: str, target: str, checkpoint: str, fields: list[str], block: int = BLOCK) -> StreamingQuery:
    """Appends the new records of growing files to a Parquet table, then stops.

    The checkpoint holds up to which byte every file was read, so lines that were appended to a file are the only ones
    that are read of it, and a half line waits for its end.  Malformed lines are skipped.
    """
    return (
        parse_lines(stream_of_lines(spark, source, block).select("value"), fields)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
