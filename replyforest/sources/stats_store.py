"""Stored statistics: one table, one partition per histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "ord bigint, key string, value bigint, stat string, segment string"


def save(stats: DataFrame, path: str) -> None:
    """Replaces the histograms that ``stats`` holds and leaves all others."""
    save_rows(stats.select("ord", "key", "value", "stat", "segment"), path)


def save_rows(rows: DataFrame, path: str) -> None:
    """Replaces the rows of every statistic and segment that ``rows`` holds and leaves all others.

    Averages and quartiles are kept like this too, each kind in a folder of its own.  Rebalancing gathers few rows of
    a segment in one file each and splits many.
    """
    (
        rows.hint("rebalance", F.col("stat"), F.col("segment"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stat", "segment")
        .parquet(path)
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    """All stored histograms; a store that is not there is empty."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def as_json(stats: DataFrame) -> DataFrame:
    """One JSON object per entry of a histogram, with the histogram's name and the place of the entry in it."""
    name = F.concat_ws("_", "stat", "segment").alias("name")
    return stats.select(F.to_json(F.struct(name, "ord", "key", "value")).alias("value"))


def export_json(stats: DataFrame, path: str) -> None:
    as_json(stats).write.mode("overwrite").text(path)
