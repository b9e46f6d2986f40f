"""Reproducible picks of threads, and threads with the rows behind their ids."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforest.functions.expressions import comment_withdrawn, post_withdrawn
from replyforest.operators.hierarchy import stripped
from replyforest.operators.ranking import rows_at
from replyforest.operators.threads import members
from replyforest.schemas import level_name
from replyforest.session import small_side

PLACE_BITS = 33  # of the ids that Spark gives to rows: the place in the partition, below its number
PICKS_PER_PIECE = 100_000


def seeded_offset(seed: int, rows: int) -> int:
    """The offset a seed stands for in a table of that many rows."""
    return random.Random(seed).randint(0, rows - 1)


def at_offsets(threads: DataFrame, picks: list[tuple[int, int]]) -> DataFrame:
    """Threads at ``(pick, offset)`` in order of the top-level comment; offsets may repeat.

    For tables with one thread per top-level comment.  The picks are as many as the caller asks for, however large the
    table is.
    """
    return rows_at(threads, picks, "ctp_id")


def random_thread(threads: DataFrame, seed: int) -> DataFrame | None:
    """The thread a seed stands for, or None for an empty table."""
    rows = threads.count()
    if rows == 0:
        return None
    return at_offsets(threads, [(0, seeded_offset(seed, rows))]).drop("pick")


def random_thread_unseeded(threads: DataFrame) -> DataFrame:
    return threads.orderBy(F.rand()).limit(1)


def subset_tables(threads: DataFrame, subsets: int = 3, rows_each: int = 3) -> DataFrame | None:
    """Seeded rows of several subsets, all picked in one pass; a row may repeat."""
    rows = threads.count()
    if rows == 0:
        return None
    picks = [
        (i * rows_each + j, seeded_offset(i * 100 + j, rows)) for i in range(subsets) for j in range(rows_each)
    ]
    return at_offsets(threads, picks).withColumn("subset", F.floor(F.col("pick") / rows_each) + 1)


def sample_with_replacement(threads: DataFrame, n: int, seed: int | None = None) -> DataFrame | None:
    """``n`` random threads, each with the number of its pick."""
    rows = threads.count()
    if rows == 0:
        return None
    rng = random.Random(seed)
    return at_offsets(threads, [(pick, rng.randrange(rows)) for pick in range(n)])


def sample_by_partitions(rows: DataFrame, n: int, seed: int) -> DataFrame | None:
    """``n`` rows drawn with replacement, each with the number of its ``pick``; None for an empty table.

    ``rows`` is a table read from files, so that its partitions hold the same rows in the same order whenever they are
    read; then a seed stands for the same rows.  Picks are dealt over the partitions as a multinomial draw would, then
    each falls on a place in its partition by a hash.  The driver sees one count per partition, rows are neither sorted
    nor numbered throughout, and picks are made by tasks, so that ``n`` may exceed the table.
    """
    spark = rows.sparkSession
    kept = [F.col(f"`{name}`") for name in rows.columns]
    mark = F.monotonically_increasing_id()
    marked = rows.select(F.struct(*kept).alias("row"), mark.alias("mark"))
    part, place = F.shiftright("mark", PLACE_BITS), F.col("mark").bitwiseAND((1 << PLACE_BITS) - 1)
    counts = sorted(rows.select(mark.alias("mark")).groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect())
    rest = sum(count for _, count in counts)
    if rest == 0:
        return None
    rng, dealt, left = random.Random(seed), [], n
    for number, count in counts:
        share = left if count == rest else rng.binomialvariate(left, count / rest)
        if share:
            dealt.append((number, count, n - left, share))
        left, rest = left - share, rest - count
    pieces = spark.createDataFrame(dealt, "part bigint, rows bigint, first bigint, share bigint").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("share") - 1) / PICKS_PER_PIECE)))
    )
    start = F.col("piece") * PICKS_PER_PIECE
    end = F.least(start + PICKS_PER_PIECE, F.col("share")) - 1
    picks = pieces.repartition("part", "piece").withColumn("draw", F.explode(F.sequence(start, end))).select(
        "part", (F.col("first") + F.col("draw")).alias("pick"), F.pmod(F.xxhash64(F.lit(seed), "part", "draw"), "rows").alias("place")
    )
    found = marked.select("row", part.alias("part"), place.alias("place")).join(small_side(picks), ["part", "place"])
    return found.select("pick", "row.*")


def post_rows(posts: DataFrame) -> DataFrame:
    """Whole post rows, one per id: the smallest of repeated dumps."""
    rank = F.struct("subreddit", "score", post_withdrawn(), *posts.columns)
    return posts.groupBy("id").agg(F.min_by(F.struct(*posts.columns), rank).alias("row")).select("row.*")


def comment_rows(comments: DataFrame) -> DataFrame:
    """Whole comment rows with stripped parent id, chosen as for the statistics."""
    rows = stripped(comments)
    rank = F.struct("score", "author", comment_withdrawn(), *comments.columns)
    return rows.groupBy("id", "parent_id").agg(F.min_by(F.struct(*comments.columns), rank).alias("row")).select("row.*")


def with_metadata(threads: DataFrame, posts: DataFrame, comments: DataFrame, by: str = "pick") -> DataFrame:
    """Every id of a thread replaced by its row; an unknown id becomes null.

    ``by`` names the threads.  Rows gather per thread, which is no longer than its tree
    is deep.  The wanted ids are counted while they are written, and few of them are broadcast, so that the texts of
    all other comments are not shuffled.
    """
    ids = members(threads.withColumn("ctp_id", F.col(by))).withColumnRenamed("ctp_id", by).drop("posts")
    rows = comment_rows(comments.join(small_side(ids.select("id").distinct()), "id", "left_semi"))
    row = F.struct(*[F.col(name) for name in comments.columns])
    found = rows.select("id", "parent_id", row.alias("comment"))
    per_thread = (
        ids.join(found, ["id", "parent_id"], "left")
        .groupBy(by)
        .agg(F.sort_array(F.collect_list(F.struct("lvl", "comment"))).alias("levels"))
        .select(by, F.transform("levels", lambda level: level["comment"]).alias("comments"))
    )
    post_row = F.struct(*[F.col(name) for name in posts.columns])
    roots = small_side(threads.select(F.col("posts").alias("id")).distinct())
    heads = post_rows(posts.join(roots, "id", "left_semi")).select(
        F.col("id").alias("posts"), post_row.alias("post")
    )
    return (
        threads.select(by, "posts")
        .join(per_thread, by, "left")
        .join(heads, "posts", "left")
        .select(by, "posts", "post", "comments")
    )


def as_json(threads: DataFrame, levels: int) -> DataFrame:
    """Threads with metadata as one JSON object each, a key per level."""
    columns = [F.col("post").alias("posts")]
    columns += [F.get("comments", F.lit(i)).alias(level_name(i)) for i in range(levels)]
    return threads.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def sample_rows(threads: DataFrame, posts: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The post rows and the comment rows behind threads, comments with stripped parent id."""
    ids = members(threads).select("id", "parent_id").distinct()
    of_threads = posts.join(small_side(threads.select(F.col("posts").alias("id")).distinct()), "id", "left_semi")
    in_threads = comments.join(small_side(ids.select("id").distinct()), "id", "left_semi")
    chosen = comment_rows(in_threads).join(ids, ["id", "parent_id"], "left_semi")
    return post_rows(of_threads), chosen.select(*comments.columns)
