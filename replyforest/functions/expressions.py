"""Column expressions shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyforest.schemas import FIELD_TYPES, level_name

# Marks of withdrawn content, and the stand-in for a missing author.
WITHDRAWN = ("[deleted]", "[removed]")
NULL_AUTHOR = "NULL_AUTHOR"


def strip_prefix(parent_id: Column) -> Column:
    """Id without its three-character type prefix."""
    return F.substring(parent_id, 4, 2147483647)


def type_prefix(parent_id: Column) -> Column:
    return F.substring(parent_id, 1, 3)


def is_withdrawn(*columns: Column) -> Column:
    """True when any column is exactly a mark; null never counts."""
    flag = F.lit(False)
    for column in columns:
        flag = flag | F.coalesce(column.isin(*WITHDRAWN), F.lit(False))
    return flag


def post_withdrawn() -> Column:
    return is_withdrawn(F.col("author"), F.col("title"), F.col("selftext"))


def comment_withdrawn() -> Column:
    return is_withdrawn(F.col("author"), F.col("body"))


def non_null_count(*columns: Column) -> Column:
    total = F.lit(0)
    for column in columns:
        total = total + F.when(column.isNotNull(), 1).otherwise(0)
    return total.cast("bigint")


def score_or_zero(score: Column) -> Column:
    return F.coalesce(score, F.lit(0))


def author_or_marker(author: Column) -> Column:
    return F.coalesce(author, F.lit(NULL_AUTHOR))


def wide_levels(path: Column, levels: int) -> list[Column]:
    """One column per level, null below the end of the path."""
    return [F.get(path, F.lit(i)).alias(level_name(i)) for i in range(levels)]


def level_of_name(name: Column) -> Column:
    """Level of a level-table name: 0 for top-level comments, k for deeper ones, else null."""
    deeper = name.rlike("^comments_to_comments_[0-9]+$")
    return (
        F.when(name == level_name(0), F.lit(0))
        .when(deeper, F.regexp_extract(name, "([0-9]+)$", 1).cast("int"))
        .cast("bigint")
    )


def name_of_level(level: Column) -> Column:
    return F.when(level < 0, F.lit("posts")).when(level == 0, F.lit(level_name(0))).otherwise(
        F.concat(F.lit("comments_to_comments_"), level.cast("string"))
    )


def parse_text_list(text: Column) -> Column:
    """``['a', 'b']`` as text to an array of strings."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")


def clamp_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0))


def is_integer_text(text: Column) -> Column:
    return text.rlike("^-*[0-9]+$")


def cast_or_fail(column: Column, kind: str | T.DataType) -> Column:
    """A cast that fails on a bad value, whatever the session says about casts."""
    value = column.try_cast(kind)
    return F.when(column.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("bad value: "), column))).otherwise(value)


def typed(name: str, strict: bool = True) -> Column:
    """A text field cast to its type; ``strict`` fails on a bad value, else it becomes null."""
    kind, column = FIELD_TYPES.get(name), F.col(name)
    if kind is None:
        return column
    return (cast_or_fail(column, kind) if strict else column.try_cast(kind)).alias(name)
