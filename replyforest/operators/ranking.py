"""Positions in a total order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyforest.session import SMALL_ROWS, passing_folder, stage, stage_and_count

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits
STEP = 2  # bytes by which keys are narrowed in a pass
FEW = 4096  # keys that are put in order for a pick


def numbered(df: DataFrame, *order: Column | str, rows: int | None = None) -> DataFrame:
    """``df`` with its 0-based ``position`` in the given order.

    Rows are range-partitioned and sorted where they are; only the row counts of the
    partitions come together, one number per partition.  A table that was counted to be
    small is numbered in one window.
    """
    everything = Window.partitionBy(F.lit(0))
    if rows is not None and rows <= SMALL_ROWS:
        return df.withColumn("position", F.row_number().over(everything.orderBy(*order)).cast("bigint") - 1)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(ranged.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    partition = F.shiftright("_row", ROW_BITS)
    sizes = staged.groupBy(partition.alias("_partition")).agg(F.count("*").alias("_size"))
    before = everything.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_partition", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return (
        staged.withColumn("_partition", partition)
        # One row per shuffle partition, so the broadcast side does not grow with the data.
        .join(F.broadcast(starts), "_partition")
        .withColumn("position", F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("_row", "_partition", "_start")
    )


def numbered_within(df: DataFrame, rows: int, by: str, *order: Column | str) -> DataFrame:
    """``df`` of ``rows`` rows with its 0-based ``position`` inside each of a few groups."""
    placed = numbered(df, by, *order, rows=rows)
    # One row per group.
    starts = F.broadcast(placed.groupBy(by).agg(F.min("position").alias("_first")))
    return placed.join(starts, by).withColumn("position", F.col("position") - F.col("_first")).drop("_first")


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in the given order; a large ``n`` is cut by position.

    Rows that tie are put in order by all their columns, so that the same rows come either way.
    """
    order = (*order, *[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])
    if n <= SMALL_ROWS:
        return df.orderBy(*order).limit(n)
    return numbered(df, *order).where(F.col("position") < n).drop("position")


def last_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows in the given order of columns."""
    return first_rows(df, n, *[F.col(name).desc() for name in order])


def _ordered_bytes(df: DataFrame, key: str) -> Column:
    """Bytes that are ordered as the key is, null first."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        flipped = F.col(key).cast("bigint").bitwiseXOR(F.lit(-(2**63)))
        plain = F.unhex(F.lpad(F.hex(flipped), 16, "0"))
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        plain = F.col(key).cast("binary")
    else:
        raise TypeError(f"rows are picked by a text or a whole number, not by {kind.simpleString()}")
    return F.when(F.col(key).isNull(), F.lit(bytearray())).otherwise(F.concat(F.lit(bytearray(b"\x01")), plain))


def rows_at(df: DataFrame, picks: list[tuple[int, int]], key: str) -> DataFrame:
    """The rows at ``(pick, position)`` in the order of a unique ``key``, with the number of the pick.

    Nothing is sorted but a few keys at the end.  Keys are counted by their first bytes, which tells each pick the bytes
    its key begins with and its position among those that do; the next pass counts only these by two bytes more, until
    at most ``FEW`` keys are left to each pick.  All picks share the passes.  Only counts are shuffled; the row is
    fetched by its key.
    """
    spark = df.sparkSession
    few = len(picks) <= SMALL_ROWS
    small = F.broadcast if few else (lambda rows: rows)
    keys = df.select(F.col(key).alias("key"), _ordered_bytes(df, key).alias("bytes"))
    at = spark.createDataFrame(picks, "pick bigint, position bigint").withColumn("head", F.lit(bytearray()))
    head = lambda size: F.substring("bytes", 1, size)
    with passing_folder(spark, "picks") as folder:
        size = open_picks = 0
        while size == 0 or open_picks:
            size += STEP
            active = small(at.select("head").distinct())
            counted = keys.select(head(size - STEP).alias("head"), head(size).alias("longer")).join(active, "head")
            counted = counted.groupBy("head", "longer").agg(F.count("*").alias("rows"))
            before = Window.partitionBy("head").orderBy("longer").rowsBetween(Window.unboundedPreceding, -1)
            starts = counted.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
            inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("rows"))
            narrowed = at.select("pick", "position", "head").join(starts, "head").where(inside)
            narrowed = narrowed.select("pick", (F.col("position") - F.col("start")).alias("position"), F.col("longer").alias("head"), "rows")
            # A head that is shorter than asked for is a whole key.
            at, open_picks = stage_and_count(narrowed, "at", (F.col("rows") > FEW) & (F.octet_length("head") == size), folder=folder)
        left = keys.withColumn("head", head(size)).join(small(at.select("head").distinct()), "head")
        place = F.row_number().over(Window.partitionBy("head").orderBy("bytes")) - 1
        picked = left.select("key", "head", place.cast("bigint").alias("position")).join(small(at), ["head", "position"])
        picked = stage(picked.select("pick", F.col("key").alias(key)), "picked")
    return df.join(small(picked), key)


def row_at(df: DataFrame, offset: int, key: str) -> DataFrame:
    """The row at a 0-based offset in the order of a unique ``key``."""
    return rows_at(df, [(0, offset)], key).drop("pick")
