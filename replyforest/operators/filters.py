"""Choosing threads by content, authors, score and community."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforest.functions.expressions import post_withdrawn
from replyforest.operators.threads import comment_facts

VIRAL_SCORE = 1000  # fixed value: posts from here on are viral


def of_posts(rows: DataFrame, posts: DataFrame) -> DataFrame:
    """Rows of threads or of the lookup that belong to ``posts``."""
    return rows.join(posts.select(F.col("id").alias("posts")), "posts", "left_semi")


def by_subreddit(rows: DataFrame, posts: DataFrame, subreddit: str) -> DataFrame:
    return of_posts(rows, posts.where(F.col("subreddit") == subreddit))


def by_score(rows: DataFrame, posts: DataFrame, viral: bool, threshold: int = VIRAL_SCORE) -> DataFrame:
    """Rows whose post scores at least ``threshold``, or less; a null score is in neither."""
    score = F.col("score")
    return of_posts(rows, posts.where(score >= threshold if viral else score < threshold))


def withdrawn_ids(posts: DataFrame, nodes: DataFrame, comments: DataFrame) -> DataFrame:
    """Ids of posts and attached comments whose content was withdrawn, with their kind."""
    bad_comments = comment_facts(comments).where("withdrawn").select("id", "parent_id")
    return (
        posts.where(post_withdrawn())
        .select("id", F.lit("post").alias("kind"))
        .unionByName(nodes.join(bad_comments, ["id", "parent_id"], "left_semi").select("id", F.lit("comment").alias("kind")))
    )


def without_withdrawn(facts: DataFrame) -> DataFrame:
    """Threads without withdrawn content, the post included."""
    return facts.where(~F.col("withdrawn"))


def with_authors(facts: DataFrame, count: int | None = None) -> DataFrame:
    """Threads without withdrawn content where every named author wrote at least twice.

    ``count`` keeps threads of that many named authors; without it the number is in
    ``named_authors``, so that one pass serves every count.
    """
    chosen = without_withdrawn(facts).where(F.col("fewest_comments") >= 2)
    return chosen if count is None else chosen.where(F.col("named_authors") == count)


def virality(score: Column, threshold: int = VIRAL_SCORE) -> Column:
    """Name of the half a post score falls in; null for a null score."""
    return F.when(score >= threshold, F.lit("threads_viral")).when(score < threshold, F.lit("threads_non_viral"))


FAMILIES = ("virality", "participants", "subreddits")


def tagged(
    facts: DataFrame,
    communities: list[str],
    author_counts: tuple[int, ...] = (2, 3, 4, 5),
    threshold: int = VIRAL_SCORE,
) -> DataFrame:
    """Threads without withdrawn content, with the name of their segment in each family or null.

    The names are worked out in the scan, without a join; ``communities`` are a few.
    """
    of_authors = (F.col("fewest_comments") >= 2) & F.col("named_authors").isin(*author_counts)
    return without_withdrawn(facts).withColumns(
        {
            "virality": virality(F.col("post_score"), threshold),
            "participants": F.when(of_authors, F.concat(F.lit("threads_"), F.col("named_authors"), F.lit("_authors"))),
            "subreddits": F.when(F.col("subreddit").isin(*communities), F.concat("subreddit", F.lit("_threads"))),
        }
    )


def in_segments(rows: DataFrame) -> DataFrame:
    """Tagged rows repeated once for each segment they are in, at most four times."""
    tags = [F.struct(F.lit("all").alias("family"), F.lit("threads").alias("segment"))]
    tags += [F.struct(F.lit(name).alias("family"), F.col(name).alias("segment")) for name in FAMILIES]
    return (
        rows.withColumn("tag", F.explode(F.array(*tags)))
        .select("*", "tag.*")
        .where(F.col("segment").isNotNull())
        .drop("tag", *FAMILIES)
    )


def segments(
    facts: DataFrame,
    communities: list[str],
    author_counts: tuple[int, ...] = (2, 3, 4, 5),
    threshold: int = VIRAL_SCORE,
) -> DataFrame:
    """Threads without withdrawn content, once for each segment they are in."""
    return in_segments(tagged(facts, communities, author_counts, threshold))
