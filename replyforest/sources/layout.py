"""Tables laid out by key: bucketed, sorted, with Bloom filters on the key.

Rows of a key are in one bucket, so a join or grouping on the key needs no exchange of the stored side, a lookup of a key
opens one bucket, and the statistics and Bloom filters of its row groups leave out most of what is in there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforest.operators.threads import comment_facts, post_facts

BYTES_PER_BUCKET = 1024**3
MOST_BUCKETS = 20_000


@dataclass(frozen=True)
class Layout:
    """A stored table: its name in the catalog, its folder, its key and the number of buckets."""

    name: str
    path: str
    keys: tuple[str, ...]
    buckets: int


def buckets_for(spark: SparkSession, size: int, per_bucket: int = BYTES_PER_BUCKET) -> int:
    """How many buckets a table of ``size`` bytes gets.

    No fewer than there are shuffle partitions: Spark would deal out a table with fewer buckets anew.
    """
    return max(min(MOST_BUCKETS, -(-size // per_bucket)), int(spark.conf.get("spark.sql.shuffle.partitions")))


def store(rows: DataFrame, layout: Layout) -> DataFrame:
    """Replaces the table with ``rows`` and returns it; a bucket is one sorted file."""
    writer = rows.repartition(layout.buckets, *layout.keys).write.format("parquet").mode("overwrite").option("path", layout.path)
    for key in layout.keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.bucketBy(layout.buckets, *layout.keys).sortBy(*layout.keys).saveAsTable(layout.name)
    return rows.sparkSession.table(layout.name)


def attach(spark: SparkSession, layout: Layout, schema: str) -> DataFrame:
    """A table that another application stored, under its name in this one."""
    keys = ", ".join(f"`{key}`" for key in layout.keys)
    spark.sql(f"DROP TABLE IF EXISTS {layout.name}")  # the name only; the files belong to whoever stored them
    spark.sql(
        f"CREATE TABLE {layout.name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
        f"INTO {layout.buckets} BUCKETS LOCATION '{layout.path}'"
    )
    return spark.table(layout.name)


def store_corpus(posts: DataFrame, comments: DataFrame, folder: str, prefix: str, buckets: int) -> dict[str, DataFrame]:
    """The tables that later steps read by key.

    ``posts`` and ``comments`` whole, by id, for lookups; ``comment_facts`` by id and parent and ``post_facts`` by post,
    one row each, for scores, authors and withdrawals.  ``threads.thread_facts`` takes the facts in place of the comments.
    """

    def table(name: str, rows: DataFrame, *keys: str) -> DataFrame:
        return store(rows, Layout(f"{prefix}_{name}", f"{folder}/{name}", keys, buckets))

    return {
        "posts": table("posts", posts.where("id is not null"), "id"),
        "comments": table("comments", comments.where("id is not null"), "id"),
        "comment_facts": table("comment_facts", comment_facts(comments), "id", "parent_id"),
        "post_facts": table("post_facts", post_facts(posts), "posts"),
    }


def look_up(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of a key; one bucket is opened, and of it the row groups that may hold the key."""
    return table.where(F.col(key) == F.lit(value))
