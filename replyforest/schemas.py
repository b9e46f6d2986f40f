"""Fixed schemas of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields read from the raw dumps and from the loaded tables.
RAW_POST_FIELDS = [
    "created_utc",
    "id",
    "name",
    "title",
    "selftext",
    "subreddit",
    "score",
    "upvote_ratio",
    "num_comments",
    "archived",
    "author",
    "distinguished",
    "media",
]
RAW_COMMENT_FIELDS = ["created_utc", "id", "body", "score", "controversiality", "author", "parent_id"]
POST_FIELDS = ["id", "title", "selftext", "subreddit", "score", "upvote_ratio", "media", "author"]
COMMENT_FIELDS = ["id", "body", "score", "author", "parent_id"]

# Types of the fields that are not text.
FIELD_TYPES: dict[str, T.DataType] = {
    "created_utc": T.LongType(),
    "score": T.LongType(),
    "num_comments": T.LongType(),
    "controversiality": T.LongType(),
    "upvote_ratio": T.DoubleType(),
    "archived": T.BooleanType(),
}


def text_schema(fields: list[str]) -> T.StructType:
    """All fields as text, so that no value is lost to a type mismatch."""
    return T.StructType([T.StructField(name, T.StringType()) for name in fields])


def level_name(level: int) -> str:
    """Column name of a level in the wide tables."""
    return "comments_to_posts" if level == 0 else f"comments_to_comments_{level}"
