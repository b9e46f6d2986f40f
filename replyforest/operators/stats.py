"""Counts, histograms and what is derived from them.

A histogram is a set of rows ``(stat, segment, ord, key, value)``: ``key`` is the label
as text and ``ord`` the place in the stored order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforest.functions.expressions import name_of_level
from replyforest.operators.filters import FAMILIES, in_segments
from replyforest.operators.ranking import first_rows, numbered_within
from replyforest.operators.threads import connected, post_facts
from replyforest.session import stage_and_count

EPSILON = 1e-4  # fixed value in the denominator of the weighted average
BLOCK = 4096  # keys of a histogram that are accumulated in one go


# --- counts -----------------------------------------------------------------------


def row_counts(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows per level table and of the posts."""
    levels = nodes.groupBy("lvl").agg(F.count("*").alias("row_count"))
    all_posts = posts.agg(F.lit(-1).cast("bigint").alias("lvl"), F.count("*").alias("row_count"))
    return all_posts.unionByName(levels).select("lvl", name_of_level(F.col("lvl")).alias("table_name"), "row_count")


def total_comments(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("table_name").like("comments_%")).agg(F.sum("row_count").alias("total_comments"))


def depth_distribution(threads: DataFrame, levels: int) -> DataFrame:
    """Distinct ids per level column of any thread table, the posts first.

    A column of the ``levels`` that no thread reaches counts 0.
    """
    ids = threads.select(F.posexplode(F.concat(F.array("posts"), "path")).alias("ord", "id"))
    counts = ids.groupBy("ord").agg(F.count_distinct("id").alias("row_count"))
    columns = threads.sparkSession.range(levels + 1).select(F.col("id").alias("ord"))
    return columns.join(counts, "ord", "left").select(
        "ord",
        name_of_level(F.col("ord") - 1).alias("conversation_length"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )


def depth_of_all_threads(nodes: DataFrame, levels: int) -> DataFrame:
    """``depth_distribution`` of the table of all threads, without its paths.

    Every attached comment ends a thread and occurs at its own level only, so a column has as many ids as the level
    has comments; only the posts need a distinct count.
    """
    attached = connected(nodes)
    counts = attached.groupBy((F.col("lvl") + 1).alias("ord")).agg(F.count("*").alias("row_count"))
    roots = attached.agg(F.lit(0).cast("bigint").alias("ord"), F.count_distinct("root_id").alias("row_count"))
    columns = nodes.sparkSession.range(levels + 1).select(F.col("id").alias("ord"))
    return columns.join(roots.unionByName(counts), "ord", "left").select(
        "ord",
        name_of_level(F.col("ord") - 1).alias("conversation_length"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )


def depth_from_lengths(lengths: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """``depth_distribution`` per segment, of tables with one thread per top-level comment.

    There every comment id occurs once, so a level has as many ids as threads reach it;
    only the posts need a distinct count.  ``lengths`` has one row per segment and
    length, ``roots`` the number of posts per segment.  Levels down to ``levels`` that a
    segment does not reach count 0.
    """
    up = Window.partitionBy("segment").orderBy("length")
    down = Window.partitionBy("segment").orderBy(F.col("length").desc())
    steps = lengths.select(
        "segment",
        F.sum("threads").over(down).alias("row_count"),
        (F.coalesce(F.lag("length").over(up), F.lit(0)) + 1).alias("first"),
        F.col("length").alias("last"),
        F.max("length").over(Window.partitionBy("segment")).alias("deepest"),
    )
    # What lies below the deepest level hangs on its row.
    is_deepest = (F.col("last") == F.col("deepest")) & (F.col("deepest") < levels)
    nothing, floor = F.lit(0).cast("bigint"), F.lit(levels).cast("bigint")
    unreached = F.when(
        is_deepest, F.struct(nothing.alias("row_count"), (F.col("deepest") + 1).alias("first"), floor.alias("last"))
    )
    spans = F.array_compact(F.array(F.struct("row_count", "first", "last"), unreached))
    below = steps.select("segment", F.inline(spans)).select("segment", "row_count", F.explode(F.sequence("first", "last")).alias("ord"))
    posts = roots.select("segment", "row_count", F.lit(0).cast("bigint").alias("ord"))
    return posts.unionByName(below).withColumn("conversation_length", name_of_level(F.col("ord") - 1))


def segment_roots(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("segment").agg(F.count_distinct("posts").alias("row_count"))


def thread_lengths(depth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Difference of each level's count to the next level's; nothing below two levels.

    ``depth`` has one row per level, so the window stays small.
    """
    group = Window.partitionBy(*(by or [F.lit(0)]))
    following = F.lead("row_count").over(group.orderBy("ord"))
    return (
        depth.withColumn("levels", F.count("*").over(group))
        .withColumn("row_count", F.col("row_count") - F.coalesce(following, F.lit(0)))
        .where(F.col("levels") >= 2)
        .select(*(by or []), F.col("ord").alias("length"), F.col("row_count").alias("threads"))
    )


def histogram(rows: DataFrame, key: Column, name: str, count: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias(count))


def subreddit_distribution(threads: DataFrame, posts: DataFrame) -> DataFrame:
    """Threads per community, those without one under null; counted per post before the posts are joined."""
    per_post = threads.groupBy("posts").agg(F.count("*").alias("threads"))
    return (
        per_post.join(post_facts(posts).select("posts", "subreddit"), "posts")
        .groupBy("subreddit")
        .agg(F.sum("threads").alias("number_of_posts"))
    )


def top_communities(distribution: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest communities, ties by name."""
    return first_rows(distribution, n, F.col("number_of_posts").desc(), F.col("subreddit"))


# --- lookup shapes ----------------------------------------------------------------


def level_widths(nodes: DataFrame) -> DataFrame:
    """Comments per post and level; counted, never collected."""
    return connected(nodes).groupBy(F.col("root_id").alias("posts"), "lvl").agg(F.count("*").alias("width"))


def lookup_shapes(posts: DataFrame, widths: DataFrame) -> DataFrame:
    """Per post: number of levels, widest level (0 without comments) and the width of each level."""
    per_post = widths.groupBy("posts").agg(
        F.count("*").alias("levels"), F.max("width").alias("widest"), F.collect_list("width").alias("widths")
    )
    return (
        post_facts(posts)
        .select("posts", "subreddit")
        .join(per_post, "posts", "left")
        .select(
            "posts",
            "subreddit",
            F.coalesce("levels", F.lit(0)).alias("levels"),
            F.coalesce("widest", F.lit(0)).alias("widest"),
            F.coalesce("widths", F.array().cast("array<bigint>")).alias("widths"),
        )
    )


def thread_table_shapes(threads: DataFrame) -> DataFrame:
    """The same statistics of a thread table, where every id counts as width 1."""
    size = F.size("path").cast("bigint")
    one = F.when(size > 0, 1).otherwise(0).cast("bigint")
    entries = F.array(
        F.struct(F.lit("lengths").alias("stat"), size.alias("key"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("widths").alias("stat"), one.alias("key"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("all_widths").alias("stat"), F.lit(1).cast("bigint").alias("key"), size.alias("n")),
    )
    return (
        threads.select(F.inline(entries))
        .groupBy("stat", "key")
        .agg(F.sum("n").alias("value"))
        .where(F.col("value") > 0)
    )


# --- histograms of all segments ---------------------------------------------------


def _as_histogram(rows: DataFrame, stat: Column, segment: Column, ord_: Column, key: Column, value: Column) -> DataFrame:
    return rows.select(
        stat.alias("stat"),
        segment.alias("segment"),
        ord_.cast("bigint").alias("ord"),
        key.cast("string").alias("key"),
        value.cast("bigint").alias("value"),
    )


# Column of the thread facts behind each statistic.
COUNTED = {
    "thread_score_distribution": "total_score",
    "author_distribution": "authors",
    "thread_lengths": "length",
    "subreddit_distribution": "subreddit",
}


def segment_counts(tagged: DataFrame) -> DataFrame:
    """Threads per segment, statistic and value.

    Threads are counted by grouping sets, one per statistic, together with their tags;
    only the counts are then repeated for the segments.
    """
    columns = list(COUNTED.values())
    counts = tagged.groupingSets([[*FAMILIES, column] for column in columns], *FAMILIES, *columns).agg(
        F.count("*").alias("value"), *[F.grouping(column).alias(f"{column}_left_out") for column in columns]
    )
    stat = F.coalesce(*[F.when(F.col(f"{column}_left_out") == 0, F.lit(name)) for name, column in COUNTED.items()])
    number = F.coalesce(*[F.col(column) for name, column in COUNTED.items() if name != "subreddit_distribution"])
    rows = counts.select(*FAMILIES, stat.alias("stat"), number.alias("number"), F.col("subreddit").alias("label"), "value")
    return in_segments(rows).groupBy("segment", "stat", "number", "label").agg(F.sum("value").alias("value"))


def segment_histograms(tagged: DataFrame, levels: int) -> DataFrame:
    """All histograms of all segments.

    The tagged threads are read twice, once for all counts and once for the distinct
    posts; the rest works on the counts.
    """
    stat, seg, value = F.col("stat"), F.col("segment"), F.col("value")
    is_label = stat == "subreddit_distribution"
    counts, label_rows = stage_and_count(segment_counts(tagged), "counts", is_label)
    numbers = counts.where(~stat.isin("thread_lengths", "subreddit_distribution"))
    lengths = counts.where(stat == "thread_lengths").select("segment", F.col("number").alias("length"), value.alias("threads"))
    totals = lengths.groupBy("segment").agg(F.sum("threads").alias("threads"))
    depth = depth_from_lengths(lengths, segment_roots(in_segments(tagged)), levels)
    differences = thread_lengths(depth, ["segment"])
    labels = counts.where(is_label).select("segment", "label", "value")
    places = numbered_within(labels, label_rows, "segment", value.desc(), "label")
    zero = F.lit(0)
    return (
        _as_histogram(numbers, stat, seg, F.col("number"), F.col("number"), value)
        .unionByName(_as_histogram(totals, F.lit("number_of_threads"), seg, zero, zero, F.col("threads")))
        .unionByName(
            _as_histogram(depth, F.lit("depth_distribution"), seg, F.col("ord"), F.col("conversation_length"), F.col("row_count"))
        )
        .unionByName(_as_histogram(differences, F.lit("thread_lengths"), seg, F.col("length"), F.col("length"), F.col("threads")))
        .unionByName(
            _as_histogram(places, F.lit("subreddit_distribution"), seg, F.col("position"), F.col("label"), value)
        )
    )


def lookup_histograms(posts: DataFrame, nodes: DataFrame, communities: list[str]) -> DataFrame:
    """Histograms of the lookup, of all posts and of each of the communities, in one pass."""

    def entry(stat: str, number: Column) -> Column:
        return F.named_struct(F.lit("stat"), F.lit(stat), F.lit("number"), number)

    community = F.when(F.col("subreddit").isin(*communities), F.concat("subreddit", F.lit("_lookup")))
    entries = F.concat(
        F.array(entry("thread_lengths", F.col("levels")), entry("thread_widths", F.col("widest"))),
        F.transform("widths", lambda width: entry("all_widths", width)),
    )
    counted = (
        lookup_shapes(posts, level_widths(nodes))
        .select(F.explode(F.array_compact(F.array(F.lit("lookup_table"), community))).alias("segment"), entries.alias("entries"))
        .select("segment", F.inline("entries"))
        .groupBy("segment", "stat", "number")
        .agg(F.count("*").alias("value"))
    )
    return _as_histogram(counted, F.col("stat"), F.col("segment"), F.col("number"), F.col("number"), F.col("value"))


# --- averages and quartiles -------------------------------------------------------


def weighted_averages(stats: DataFrame) -> DataFrame:
    """Mean of every histogram, with a small constant in the denominator.

    Levels weigh by their place.  Where the statistic is a score the denominator takes
    all counts, else only the positive ones.  Text keys have no mean.
    """
    stat = F.col("stat")
    is_depth = stat.contains("depth")
    weight = F.when(is_depth, F.col("ord")).otherwise(F.col("key").try_cast("bigint"))
    counts = F.when(stat.contains("score") & ~is_depth, F.col("value")).otherwise(F.greatest("value", F.lit(0)))
    return (
        stats.groupBy("stat", "segment")
        .agg(
            F.sum(weight * F.col("value")).alias("total"),
            F.sum(counts).alias("count"),
            F.bool_and(weight.isNotNull()).alias("numeric"),
        )
        .where("numeric")
        .withColumn("average", F.col("total").cast("double") / (F.col("count").cast("double") + F.lit(EPSILON)))
        .select("stat", "segment", "average")
    )


def running_counts(stats: DataFrame) -> DataFrame:
    """Positive counts with their running total in stored order.

    Totals are first taken over blocks of ``BLOCK`` places, so that neither window sees
    a whole histogram: one runs over block totals, one inside a block.
    """
    by = ["stat", "segment"]
    positive = stats.where(F.col("value") > 0).withColumn("block", F.floor(F.col("ord") / BLOCK))
    blocks = positive.groupBy(*by, "block").agg(F.sum("value").alias("block_total"))
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *by,
        "block",
        F.coalesce(F.sum("block_total").over(before), F.lit(0)).alias("before"),
        F.sum("block_total").over(Window.partitionBy(*by)).alias("n"),
    )
    inside = Window.partitionBy(*by, "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return (
        positive.join(blocks, [*by, "block"])
        .withColumn("running", F.col("before") + F.sum("value").over(inside))
        .select(*by, "ord", "key", "value", "running", "n")
    )


def _rank_values(stats: DataFrame) -> DataFrame:
    """The keys at the ranks of the quartiles and of the two middle places."""
    n = F.col("n")

    def key_at(rank: Column) -> Column:
        return F.min_by("key", F.when(F.col("running") >= rank, F.col("ord")))

    return running_counts(stats).groupBy("stat", "segment").agg(
        F.max("n").alias("n"),
        # Integer forms of ceil(n / 4), ceil(3 n / 4) and of the middle ranks.
        key_at(F.expr("(n + 3) div 4")).alias("q1"),
        key_at(F.expr("(3 * n + 3) div 4")).alias("q3"),
        key_at(F.expr("(n + 1) div 2")).alias("low"),
        key_at(F.expr("n div 2 + 1")).alias("high"),
    )


def _numeric_ranks() -> Column:
    ok = F.lit(True)
    for name in ("q1", "q3", "low", "high"):
        ok = ok & F.col(name).try_cast("bigint").isNotNull()
    return ok


def weighted_quartiles(stats: DataFrame) -> DataFrame:
    """Quartiles and interquartile range of histograms with whole-number keys."""
    q1, q3, low, high = (F.col(name).cast("bigint") for name in ("q1", "q3", "low", "high"))
    return (
        _rank_values(stats)
        .where(_numeric_ranks())
        .select("stat", "segment", q1.alias("q1"), ((low + high) / F.lit(2.0)).alias("q2"), q3.alias("q3"), (q3 - q1).alias("iqr"))
    )


def weighted_quartiles_labels(stats: DataFrame) -> DataFrame:
    """Quartiles of histograms with text keys; the range and an uneven median become text."""
    median = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        F.concat(F.lit("Median between "), "low", F.lit(" and "), "high")
    )
    return (
        _rank_values(stats)
        .where(~_numeric_ranks())
        .select("stat", "segment", "q1", median.alias("q2"), "q3", F.concat("q3", F.lit(" - "), "q1").alias("iqr"))
    )


# --- exploration ------------------------------------------------------------------


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def value_percent(rows: DataFrame, column: str) -> DataFrame:
    """Share of each value in percent, nulls left out."""
    total = rows.agg(F.count(column)).scalar()
    return value_counts(rows, column).select("value", (F.col("count") / total * 100).alias("percent"))


def distinct_row_count(rows: DataFrame) -> DataFrame:
    """Rows and distinct rows, from one aggregation over whole rows."""
    copies = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    return copies.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"), F.count("*").alias("unique_rows"))
