"""Threads (root-to-comment paths) and the per-post lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforest.functions.expressions import (
    NULL_AUTHOR,
    comment_withdrawn,
    post_withdrawn,
    score_or_zero,
    wide_levels,
)
from replyforest.operators.hierarchy import stripped
from replyforest.schemas import level_name
from replyforest.session import stage


def connected(nodes: DataFrame) -> DataFrame:
    return nodes.where("connected") if "connected" in nodes.columns else nodes


def all_threads(nodes: DataFrame) -> DataFrame:
    """One thread per comment, ``(posts, ctp_id, path)``; the path is already in the node."""
    return connected(nodes).select(F.col("root_id").alias("posts"), "ctp_id", "path")


def widen(threads: DataFrame, levels: int) -> DataFrame:
    """The wide view: one id column per level, null below the end of the path."""
    return threads.select("posts", *wide_levels(F.col("path"), levels))


def longest_threads(threads: DataFrame, seed: int | None = None) -> DataFrame:
    """The longest thread under each top-level comment.

    Ties go to the greater last id, or to a random thread when a seed is given.  The
    maximum is taken before the shuffle too, so a hot top-level comment costs no more
    than one row per task.
    """
    tie = F.element_at("path", -1) if seed is None else F.rand(seed)
    rank = F.struct(F.size("path"), F.col("tie"))
    return (
        threads.where(F.col("ctp_id").isNotNull())
        .withColumn("tie", tie)
        .groupBy("ctp_id")
        .agg(F.max_by(F.struct("posts", "path"), rank).alias("longest"))
        .select("longest.posts", "ctp_id", "longest.path")
    )


def members(threads: DataFrame) -> DataFrame:
    """One row per comment of a thread, with its place and its parent."""
    return threads.select("posts", "ctp_id", "path", F.posexplode("path").alias("lvl", "id")).select(
        "posts",
        "ctp_id",
        F.col("lvl").cast("bigint").alias("lvl"),
        "id",
        F.coalesce(F.get("path", F.col("lvl") - 1), F.col("posts")).alias("parent_id"),
    )


def comment_facts(comments: DataFrame) -> DataFrame:
    """Score, author and withdrawal of a comment, one row per id and parent.

    Repeated dumps of a comment collapse to the smallest row, so that they do not
    count twice.
    """
    facts = stripped(comments).select("id", "parent_id", "score", "author", comment_withdrawn().alias("withdrawn"))
    return (
        facts.groupBy("id", "parent_id")
        .agg(F.min(F.struct("score", "author", "withdrawn")).alias("fact"))
        .select("id", "parent_id", "fact.*")
    )


def post_facts(posts: DataFrame) -> DataFrame:
    """Community, score and withdrawal of a post, one row per id."""
    facts = posts.where(F.col("id").isNotNull()).select(
        F.col("id").alias("posts"), "subreddit", F.col("score").alias("post_score"), post_withdrawn().alias("post_withdrawn")
    )
    return (
        facts.groupBy("posts")
        .agg(F.min(F.struct("subreddit", "post_score", "post_withdrawn")).alias("fact"))
        .select("posts", "fact.*")
    )


def members_with_facts(threads: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments of threads with score, author and withdrawal; unknown ids keep nulls.

    ``comments`` may be a stored table of ``comment_facts``, which is joined as it lies.
    """
    facts = comments if "withdrawn" in comments.columns else comment_facts(comments)
    return members(threads).join(facts, ["id", "parent_id"], "left")


def authors_per_thread(member_rows: DataFrame) -> DataFrame:
    """Comments per author inside a thread; a missing author is a row of its own."""
    return member_rows.groupBy("ctp_id", "author").agg(
        F.count("*").alias("comments"),
        F.sum(score_or_zero(F.col("score"))).alias("score"),
        F.max(F.coalesce("withdrawn", F.lit(False))).alias("withdrawn"),
    )


def thread_facts(threads: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """One row per thread with all that the filters and the statistics ask for.

    A thread is no longer than its tree is deep, so its rows are brought together once
    and both groupings run on that partitioning.  The post facts are staged so that the
    last join is between two plain shuffles, which lets adaptive execution split a hot post.
    """
    rows = members_with_facts(threads, comments).repartition("ctp_id")
    named = F.col("author") != ""
    per_thread = (
        authors_per_thread(rows)
        .groupBy("ctp_id")
        .agg(
            F.sum("score").alias("total_score"),
            # Null and the marker text count as one author.
            (
                F.count("*")
                - (F.max(F.col("author").isNull()) & F.max(F.coalesce(F.col("author") == NULL_AUTHOR, F.lit(False)))).cast("bigint")
            ).alias("authors"),
            F.count(F.when(named, True)).alias("named_authors"),
            F.min(F.when(named, F.col("comments"))).alias("fewest_comments"),
            F.max("withdrawn").alias("comment_withdrawn"),
        )
    )
    return (
        threads.join(per_thread, "ctp_id")
        .join(stage(post_facts(posts), "posts"), "posts", "left")
        .select(
            "posts",
            "ctp_id",
            "path",
            F.size("path").cast("bigint").alias("length"),
            "total_score",
            "authors",
            "named_authors",
            "fewest_comments",
            (F.col("comment_withdrawn") | F.coalesce("post_withdrawn", F.lit(False))).alias("withdrawn"),
            "subreddit",
            "post_score",
        )
    )


def lookup_long(nodes: DataFrame, parts: int = 1) -> DataFrame:
    """Sorted ids per post, level and part.

    With several ``parts`` every level is spread over them by the hash of the id, so that neither an array nor a task
    has to hold a whole hot post; the parts of a level hold each of its ids once.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("bigint").alias("part")
    return (
        connected(nodes)
        .select(F.col("root_id").alias("posts"), "lvl", part, "id")
        .groupBy("posts", "lvl", "part")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )


def lookup_table(posts: DataFrame, long: DataFrame, levels: int) -> DataFrame:
    """The wide lookup: one array of ids per level; posts without comments keep nulls.

    A post has one row per part that holds ids of it, one at least; a post that was dumped twice has no more.
    """
    wide = long.groupBy("posts", "part").agg(
        *[F.first(F.when(F.col("lvl") == i, F.col("ids")), ignorenulls=True).alias(level_name(i)) for i in range(levels)]
    )
    return (
        posts.select(F.col("id").alias("posts"))
        .distinct()
        .join(wide, "posts", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
    )
