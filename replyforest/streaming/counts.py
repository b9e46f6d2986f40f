"""Statistics that are kept up with an ingest.

Every batch stores its own counts under its number, so a batch that is done again after a failure replaces them and
counts once.  From time to time the counts so far are put together; the number of the last batch in them is stored
after them, and batches up to that number are no longer read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from replyforest.session import remove
from replyforest.sources.growing import stream_of_lines
from replyforest.sources.jsonl import parse_lines

COUNTS = "stat string, key string, value bigint"
COMPACT_EVERY = 64


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store; one that is not there yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _last_sum(spark: SparkSession, store: str) -> int:
    """The last batch of the last sum that was written to its end, -1 before the first."""
    last = _read(spark, f"{store}/sums", "upto bigint").agg(F.max("upto")).first()[0]
    return -1 if last is None else last


def counted(spark: SparkSession, store: str) -> DataFrame:
    """``stat, key, value`` of everything that was ingested."""
    last = _last_sum(spark, store)
    rows = _read(spark, f"{store}/batches", f"{COUNTS}, batch bigint").where(F.col("batch") > last).drop("batch")
    if last >= 0:
        rows = rows.unionByName(_read(spark, f"{store}/sum-{last}", COUNTS))
    return rows.groupBy("stat", "key").agg(F.sum("value").alias("value"))


def add_batch(rows: DataFrame, batch: int, store: str, keys: dict[str, Column], compact_every: int = COMPACT_EVERY) -> None:
    """Counts the rows of a batch by each of ``keys``; to be called in the order of the batches, again after a failure."""
    spark = rows.sparkSession
    pairs = [F.struct(F.lit(stat).alias("stat"), key.cast("string").alias("key")) for stat, key in keys.items()]
    counts = rows.select(F.inline(F.array(*pairs))).groupBy("stat", "key").agg(F.count("*").alias("value"))
    counts.write.mode("overwrite").parquet(f"{store}/batches/batch={batch}")
    if (batch + 1) % compact_every == 0 and _last_sum(spark, store) < batch:
        before = _last_sum(spark, store)
        counted(spark, store).write.mode("overwrite").parquet(f"{store}/sum-{batch}")
        spark.createDataFrame([(batch,)], "upto bigint").write.mode("append").parquet(f"{store}/sums")
        for old in range(max(0, batch + 1 - 2 * compact_every), batch + 1 - compact_every):
            remove(spark, f"{store}/batches/batch={old}")  # a reader may still be at those of the last sum
        if before >= compact_every:
            remove(spark, f"{store}/sum-{before - compact_every}")


def ingest_and_count(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    fields: list[str],
    keys: dict[str, Column],
    target: str | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Counts the new records of growing JSON-lines files by ``keys``, and keeps them in ``target`` if it is given.

    The checkpoint holds up to which byte every file was read.  In ``target`` a batch has a partition of its own, which
    is replaced when the batch is done again.  Null keys count as a key of their own.
    """

    def add(rows: DataFrame, batch: int) -> None:
        if target:
            rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")
            rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{target}/batch={batch}")
        add_batch(rows, batch, store, keys, compact_every)

    records = parse_lines(stream_of_lines(spark, source).select("value"), fields)
    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_stats(counts: DataFrame, segment: str = "all") -> DataFrame:
    """The counts as rows of the statistics store: the most frequent key first, then by key."""
    order = Window.partitionBy("stat").orderBy(F.desc("value"), "key")
    return counts.select(F.row_number().over(order).cast("bigint").alias("ord"), "key", "value", "stat", F.lit(segment).alias("segment"))
