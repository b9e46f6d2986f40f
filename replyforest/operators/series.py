"""Histograms as series for plotting: clipped, zero-filled and put side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforest.functions.expressions import clamp_negative, is_integer_text
from replyforest.operators.ranking import first_rows

# Ranges of keys that are shown, by kind of statistic.
DENSE_RANGE = {"score": (-50, 400), "lengths": (None, 50)}
UNIFIED_RANGE = {"score": (-100, 400), "lengths": (1, 50), "author_distribution": (1, 30)}
SINGLE_RANGE = {"thread_score_distribution": (-10, 30), "thread_lengths": (1, 10), "author_distribution": (1, 10)}

STEP = 65_536  # longest run of keys generated in one array


def _clip(rows: DataFrame, ranges: dict[str, tuple[int | None, int]]) -> DataFrame:
    """Rows whose number lies in the range of the first kind its statistic matches."""
    keep = F.lit(True)
    for kind, (low, high) in reversed(ranges.items()):
        inside = F.col("x") <= high if low is None else F.col("x").between(low, high)
        keep = F.when(F.col("stat").contains(kind), inside).otherwise(keep)
    return rows.where(keep)


def _every_key(ranges: DataFrame) -> DataFrame:
    """One row per whole number from ``low`` to ``high``, made in bounded arrays."""
    starts = ranges.withColumn("start", F.explode(F.sequence("low", "high", F.lit(STEP).cast("bigint"))))
    return starts.withColumn("x", F.explode(F.sequence("start", F.least(F.col("start") + STEP - 1, F.col("high"))))).drop(
        "low", "high", "start"
    )


def numbers(stats: DataFrame) -> DataFrame:
    """Histogram rows with whole-number keys, the key as ``x``."""
    return stats.where(is_integer_text(F.col("key"))).withColumn("x", F.col("key").cast("bigint"))


def dense_series(stats: DataFrame) -> DataFrame:
    """Every histogram clipped and zero-filled from its smallest to its largest key.

    Histograms with other keys stay as they are.
    """
    by = ["stat", "segment"]
    whole = stats.groupBy(*by).agg(F.bool_and(is_integer_text(F.col("key"))).alias("whole")).where("whole").select(*by)
    shown = _clip(numbers(stats.join(whole, by, "left_semi")), DENSE_RANGE).select(*by, "x", "value")
    axis = _every_key(shown.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high")))
    filled = axis.join(shown, [*by, "x"], "left").select(
        *by, F.col("x").cast("string").alias("x"), clamp_negative(F.coalesce("value", F.lit(0))).cast("bigint").alias("y")
    )
    labels = stats.join(whole, by, "left_anti").select(*by, F.col("key").alias("x"), clamp_negative(F.col("value")).alias("y"))
    return filled.unionByName(labels)


def unified_series(stats: DataFrame) -> DataFrame:
    """All segments of a family and statistic on one axis: zero-filled, no negative counts.

    ``stats`` has a ``family`` column.  The axis spans the keys that any of them shows,
    a few hundred at most, and is built per segment.
    """
    group = ["family", "stat"]
    shown = _clip(numbers(stats), UNIFIED_RANGE).select(*group, "segment", "x", "value")
    spans = shown.groupBy(*group).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    names = stats.select(*group, "segment").distinct()
    axis = _every_key(names.join(spans, group))
    return axis.join(shown, [*group, "segment", "x"], "left").select(
        *group, "segment", "x", clamp_negative(F.coalesce("value", F.lit(0))).cast("bigint").alias("y")
    )


def single_series(stats: DataFrame) -> DataFrame:
    """Each histogram on its own, clipped to a narrow range, without filling."""
    return (
        _clip(numbers(stats.where(F.col("stat").isin(*SINGLE_RANGE))), SINGLE_RANGE)
        .select("stat", "segment", "x", clamp_negative(F.col("value")).alias("y"))
        .orderBy("stat", "segment", "x")
    )


def top_series(stats: DataFrame, segment: str, n: int = 10) -> DataFrame:
    """The first ``n`` communities in stored order."""
    rows = stats.where((F.col("stat") == "subreddit_distribution") & (F.col("segment") == segment))
    return first_rows(rows, n, "ord").select(F.col("key").alias("x"), clamp_negative(F.col("value")).alias("y"))


# The statistics compared within each family.
COMPARED = {
    "author_distribution": ("virality", "subreddits"),
    "thread_lengths": ("virality", "participants", "subreddits"),
    "thread_score_distribution": ("virality", "participants", "subreddits"),
}


def compare_segments(stats: DataFrame, families: DataFrame) -> DataFrame:
    """Histograms of the segments that are put side by side, tagged with their family.

    ``families`` lists ``(family, segment)``, a dozen rows; the segment of all threads
    joins every family.
    """
    wanted = F.lit(False)
    for stat, names in COMPARED.items():
        wanted = wanted | ((F.col("stat") == stat) & F.col("family").isin(*names))
    names = families.where(F.col("family") != "all")
    base = names.select("family").distinct().withColumn("segment", F.lit("threads"))
    return stats.join(F.broadcast(names.unionByName(base)), "segment").where(wanted)
