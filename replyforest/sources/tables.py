"""CSV tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyforest.functions.expressions import cast_or_fail, typed
from replyforest.schemas import COMMENT_FIELDS, FIELD_TYPES, POST_FIELDS, text_schema
from replyforest.sources.csv_records import csv_records, first_records
from replyforest.sources.jsonl import BAD, first_by_place, jsonl_columns

# Quotes are doubled inside quoted text, and text may hold line breaks.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
CSV_WRITING = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
ROWS_PER_FILE = 200_000  # of the CSV that is written here, so that a folder is read by many tasks


def _csv_rows(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, in_splits: bool, first: int | None = None, **options: str
) -> DataFrame:
    """Rows of CSV files with header, all or the ``first``."""
    if not (multi_line and in_splits):
        rows = spark.read.schema(schema).options(**CSV_OPTIONS, **options).option("multiLine", multi_line).csv(path)
        return rows if first is None else first_by_place(rows, first)
    records = csv_records(spark, path)
    if first is not None:
        records = first_records(records, first)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    reading = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    return records.select(F.from_csv("record", fields, {**reading, **options}).alias("row")).select("row.*")


def csv_text(spark: SparkSession, path: str, fields: list[str], multi_line: bool = True, in_splits: bool = False) -> DataFrame:
    """All columns of a CSV with header as text; only empty fields are null.

    With ``multi_line`` quoted text may hold line breaks, and a file is read by one task unless it is read ``in_splits``,
    whose lines go through Arrow.  Without it files are read in splits, and every line is a row.
    """
    return _csv_rows(spark, path, text_schema(fields), multi_line, in_splits)


def csv_tolerant_scan(spark: SparkSession, path: str, fields: list[str], multi_line: bool = True, in_splits: bool = False) -> DataFrame:
    """Short rows are padded with nulls; rows that are too long or of a wrong type are dropped."""
    schema = text_schema(fields).add(T.StructField(BAD, T.StringType()))
    rows = _csv_rows(spark, path, schema, multi_line, in_splits, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD)
    # Both kinds of wrong length are flagged; the commas outside quotes tell them apart.
    outside = F.regexp_replace(BAD, '"[^"]*"', "")
    commas = F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit("")))
    keep = F.col(BAD).isNull() | (commas < len(fields))
    for name in fields:
        if name in FIELD_TYPES:
            keep = keep & (F.col(name).isNull() | typed(name, strict=False).isNotNull())
    return rows.where(keep).select(*[typed(name, strict=False).alias(name) for name in fields])


def load_posts(spark: SparkSession, path: str, fields: list[str], in_splits: bool = False) -> DataFrame:
    """The columns of the posts table from a CSV with ``fields``."""
    return csv_tolerant_scan(spark, path, fields, in_splits=in_splits).select(*POST_FIELDS)


def _comment_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[cast_or_fail(F.col("score"), "int").alias("score") if name == "score" else F.col(name) for name in COMMENT_FIELDS]
    )


def load_comments(spark: SparkSession, path: str, fields: list[str], in_splits: bool = False) -> DataFrame:
    """The columns of the comments table; a score that is no number fails the job."""
    return _comment_columns(csv_text(spark, path, fields, in_splits=in_splits))


def posts_of_dump(spark: SparkSession, path: str) -> DataFrame:
    """The posts table straight from JSON lines; a value of a wrong type becomes null."""
    return jsonl_columns(spark, path, POST_FIELDS).select(*[typed(name, strict=False).alias(name) for name in POST_FIELDS])


def comments_of_dump(spark: SparkSession, path: str) -> DataFrame:
    """The comments table straight from JSON lines; a score that is no number fails the job."""
    return _comment_columns(jsonl_columns(spark, path, COMMENT_FIELDS))


def csv_head(spark: SparkSession, path: str, fields: list[str], n: int, multi_line: bool = True, in_splits: bool = False) -> DataFrame:
    """The first ``n`` rows, files in order of their names."""
    return _csv_rows(spark, path, text_schema(fields), multi_line, in_splits, n)


def write_csv(rows: DataFrame, path: str) -> None:
    """Appends rows to a CSV folder: quotes doubled, blanks kept, a header in each file."""
    rows.write.mode("append").options(**CSV_WRITING).option("maxRecordsPerFile", ROWS_PER_FILE).csv(path)


def append_csv(records: DataFrame, path: str) -> int:
    """Appends records to a CSV folder, each file with its header; returns how many."""
    seen = Observation()
    observed = records.observe(seen, F.count(F.lit(1)).alias("rows"))
    write_csv(observed, path)
    return seen.get["rows"]


def overwrite(df: DataFrame, path: str) -> DataFrame:
    """Replaces a table and returns it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> DataFrame:
    """Adds rows to a table and returns the whole table."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_matching(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows without those whose key is in ``keys``; a null key is never deleted."""
    return rows.join(keys.select(*on), on, "left_anti")
