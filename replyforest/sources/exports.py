"""Threads written out with the rows behind their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame

from replyforest.operators.sampling import as_json, sample_rows, sample_with_replacement, with_metadata
from replyforest.sources.tables import write_csv


def threads_jsonl_export(
    threads: DataFrame, posts: DataFrame, comments: DataFrame, path: str, levels: int, n: int = 100, seed: int | None = None
) -> None:
    """``n`` random threads with metadata, one JSON object per line; a thread may repeat."""
    picked = sample_with_replacement(threads, n, seed)
    if picked is None:
        return
    as_json(with_metadata(picked, posts, comments), levels).write.mode("overwrite").text(path)


def thread_to_samples(threads: DataFrame, posts: DataFrame, comments: DataFrame, posts_path: str, comments_path: str) -> None:
    """Appends the post rows and the comment rows of threads to two CSV folders."""
    of_posts, of_comments = sample_rows(threads, posts, comments)
    for rows, path in ((of_posts, posts_path), (of_comments, comments_path)):
        write_csv(rows, path)
