"""Joins of raw dumps for a first look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforest.functions.expressions import strip_prefix, type_prefix


def with_parent_parts(comments: DataFrame) -> DataFrame:
    """Comments with the parent's id and type prefix as columns."""
    return comments.withColumn("post_id", strip_prefix(F.col("parent_id"))).withColumn("prefix", type_prefix(F.col("parent_id")))


def merge(posts: DataFrame, comments: DataFrame, post_key: str, comment_key: str) -> DataFrame:
    """Inner join; columns that both sides have get the suffixes ``_post`` and ``_comment``."""
    shared = set(posts.columns) & set(comments.columns)
    left = posts.select([F.col(c).alias(f"{c}_post" if c in shared else c) for c in posts.columns])
    right = comments.select([F.col(c).alias(f"{c}_comment" if c in shared else c) for c in comments.columns])
    left_key = f"{post_key}_post" if post_key in shared else post_key
    right_key = f"{comment_key}_comment" if comment_key in shared else comment_key
    return left.join(right, left[left_key] == right[right_key], "inner")
