"""JSON-lines dumps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyforest.schemas import text_schema

BAD = "_corrupt_record"


def first_by_place(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of files just read, in order of file, split and row; they come in this order.

    The rows of each split are counted, and a row's place in its split is the distance of its number from the first
    one there; only counts come together, one row per split.
    """
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = placed.groupBy("_file", "_split").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).where(F.col("_start") < n)
    found = placed.join(starts, ["_file", "_split"]).where(F.col("_start") + F.col("_row") - F.col("_first") < n)
    return found.orderBy("_file", "_split", "_row").select(rows.columns)


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` text lines, files in order of their names."""
    return first_by_place(spark.read.text(path), n)


def record_of(value: Column, schema: T.DataType) -> Column:
    """The one object that a line holds; null for any other line.

    A reader of one object stops at its end, so lines are read as lists: of two objects on a line there are two.
    """
    return F.get(_records_of(value, schema), F.lit(0))


def _looks_whole(value: Column) -> Column:
    """Whether a line begins and ends as an object does; others are not worth reading."""
    return value.rlike(r'^ *\{[ \t\r\n]*["}]') & F.btrim(value, F.lit(" \t\r\n")).endswith("}")


def _records_of(value: Column, schema: T.DataType) -> Column:
    """The record of a line as a list of one, null for any other line; a line is read once."""
    found = F.from_json(F.concat(F.lit("["), value, F.lit("]")), T.ArrayType(schema), {"allowSingleQuotes": "false"})
    return F.when(_looks_whole(value), F.get(F.transform(F.array(found), lambda f: F.when(F.size(f) == 1, f)), F.lit(0)))


def field_names(lines: DataFrame) -> list[str]:
    """Names of all fields that occur, in the order in which records hold them.

    One row per name comes back; a dump has a few dozen.
    """
    whole = lines.where(record_of(F.col("value"), text_schema([BAD])).isNotNull())
    keys = whole.select(F.posexplode(F.json_object_keys("value")).alias("place", "name"))
    return [row.name for row in keys.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()]


def jsonl_head(spark: SparkSession, path: str, fields: list[str] | None = None, n: int = 1000) -> DataFrame:
    """The first ``n`` records; a missing field is null, a malformed line raises.

    Values stay text, nested objects stay JSON text.  Without ``fields`` all are taken.
    """
    lines = first_lines(spark, path, n)
    fields = fields or field_names(lines)
    record = record_of(F.col("value"), text_schema(fields))
    whole = F.when(record.isNull(), F.raise_error(F.lit("malformed line in JSONL"))).otherwise(record)
    return lines.select(whole.alias("record")).select("record.*")


def parse_lines(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Records of a ``value`` column of text lines; malformed lines are skipped.

    Works on batches and on streams alike.
    """
    # A generator reads a line once, where a filter and each field would read it again.
    others = [c for c in lines.columns if c != "value"]
    records = lines.where(_looks_whole(F.col("value"))).select(
        *others, F.explode(_records_of(F.col("value"), text_schema(fields))).alias("record")
    )
    return records.where(F.col("record").isNotNull()).select(*others, *[F.col(f"record.{f}").alias(f) for f in fields])


def _may_hold(value: Column, text: str) -> Column:
    """Whether a field of a line may be ``text``; lines of which this is false need not be read for it.

    Letters and digits stand in a line as they are, or as ``\\u`` and their number.  Other texts may be written in more ways.
    """
    if not re.fullmatch("[A-Za-z]+[0-9][A-Za-z0-9_]*", text):
        return F.lit(True)
    return value.contains(text) | value.contains("\\u")


def jsonl_columns(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """All records of a dump, chosen fields (or all) as text; malformed lines are skipped."""
    lines = spark.read.text(path)
    return parse_lines(lines, fields or field_names(lines))


def ingest_after_id(
    spark: SparkSession, path: str, fields: list[str] | None = None, resume_id: str | None = None
) -> DataFrame:
    """Records that follow the first one with ``resume_id``; later copies of it are left out too.

    Places are compared by file, split and row, so the files stay spread over the tasks.
    An id that never occurs gives no rows.
    """
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("place"),
    )
    fields = fields or field_names(lines)
    wanted = fields if "id" in fields else [*fields, "id"]
    records = parse_lines(lines, wanted)
    if resume_id is not None:
        # A single place comes back, and becomes a literal of the filter.
        candidates = parse_lines(lines.where(_may_hold(F.col("value"), resume_id)), ["id"])
        found = candidates.where(F.col("id") == resume_id).agg(F.min("place").alias("place")).first().place
        if found is None:
            return records.select(*fields).where(F.lit(False))
        after = F.struct(F.lit(found.file).alias("file"), F.lit(found.split).alias("split"), F.lit(found.row).alias("row"))
        records = records.where((F.col("place") > after) & ~F.coalesce(F.col("id") == resume_id, F.lit(False)))
    return records.select(*fields)
