"""What several corpus operators share: tables, row numbers in groups, connected components."""

from __future__ import annotations

import ctypes
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replyforest.session import passing_folder, stage

ROWS_PER_BLOCK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def worker_cache() -> dict:
    """What a Python worker keeps from one task to the next; a module of its own, as functions travel with the job."""
    return sys.modules.setdefault("replyforest_worker_cache", types.ModuleType("replyforest_worker_cache")).__dict__


def give_back_memory() -> None:
    """Returns to the system what a finished task freed; the worker process lives on, and so would its heap."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def utf8_bytes(column: Column) -> Column:
    return F.encode(column, "UTF-8")


def crc32_of_text(column: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes of a text."""
    return F.crc32(utf8_bytes(column))


def crc32_of_id(column: Column) -> Column:
    """crc32 of an id written in decimal digits."""
    return crc32_of_text(column.cast("string"))


def numbered_in_groups(df: DataFrame, group: str, order: str, rows: int, name: str) -> DataFrame:
    """Adds ``name``, numbers without gaps from 0 in each group, in any order that is fixed by ``order``.

    A group is cut into blocks by the hash of ``order``, so that no task holds a whole group; the sizes
    of the blocks, one row per block, give each block its start.
    """
    blocks = max(1, -(-rows // ROWS_PER_BLOCK))
    blocked = df.withColumn("_block", F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int"))
    sizes = blocked.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(order))
    return (
        blocked.withColumn("_inside", inside)
        .join(starts, [group, "_block"])
        .withColumn(name, (F.col("_start") + F.col("_inside") - 1).cast("bigint"))
        .drop("_block", "_inside", "_start")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; a component is named by its smallest node.

    Large-star and small-star steps until the edges stay as they are.  A step groups by node for a minimum,
    which is combined before the shuffle, and joins it back, so that a node with many links can be split.
    The tables of the steps lie in the shared folder.
    """
    spark = edges.sparkSession
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    with passing_folder(spark, "components") as folder:
        current, mark = _staged_with_mark(current, folder)
        while mark[0]:
            # Large star: every larger neighbour of a node is linked to the smallest node around it.
            both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            # Small star: every smaller neighbour, and the node itself, is linked to the smallest of them.
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            following, new_mark = _staged_with_mark(small, folder)
            done = new_mark == mark
            current, mark = following, new_mark
            if done:
                break
        roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        named = current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        return stage(named.groupBy("node").agg(F.min("component").alias("component")), "components")


def _staged_with_mark(pairs: DataFrame, folder: str) -> tuple[DataFrame, tuple]:
    staged = stage(pairs, "pairs", folder=folder)
    hashed = F.xxhash64("u", "v")
    row = staged.agg(F.count("*"), F.coalesce(F.bit_xor(hashed), F.lit(0))).first()
    return staged, (row[0], row[1])


def rows_that_stay(docs: DataFrame, doc_id: str, key: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided (doc_id, key, kept)`` keeps, with their columns.

    ``key`` tells texts of one id apart.  Rows that repeat id and key stay or go together, and one of them stays.
    Only what goes is looked up.
    """
    going = decided.groupBy(F.col("doc_id").alias("going_id"), F.col("key").alias("going_key"))
    going = going.agg(F.max("kept").alias("stays"), F.count("*").alias("times")).where("not stays or times > 1")
    # The row travels as one column, so that no name of its own can clash with those used here.
    own = docs.select(F.struct("*").alias("own"), F.col(f"`{doc_id}`").alias("own_id"), key.alias("own_key"))
    met = F.col("own_id").eqNullSafe(F.col("going_id")) & (F.col("own_key") == F.col("going_key"))
    joined = own.join(going, met, "left").where("stays is null or stays")
    if not going.where("stays and times > 1").isEmpty():
        copies = Window.partitionBy("own_id", "own_key").orderBy("own_key")
        joined = joined.withColumn("number", F.row_number().over(copies)).where("number = 1 or times is null")
    return joined.select("own.*")
