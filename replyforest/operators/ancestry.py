"""Ancestors without paths: every comment gets the interval that its subtree takes in a walk through its tree.

``enter`` is a comment's place in the walk, which visits a comment before its answers, from 0 at the top-level comment;
``leave`` is the first place after its subtree.  So b is below a if both share ``ctp_id`` and a.enter < b.enter < a.leave,
and rows are of one width however deep the tree is.  Pointers are doubled, as in ``hierarchy``: the number of rounds
grows with the logarithm of the depth, not with that of the rows, as ranking the whole walk as a list would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyforest.operators.hierarchy import OPEN, POST, _links, unroll
from replyforest.session import passing_folder, small_side, stage, stage_and_count

BLOCK = 65_536  # answers of one comment, or places of one tree, that a window holds
NODE = ("id", "parent_id", "root_id", "ctp_id", "lvl")
TOP = "struct<ctp_id:string,root_id:string>"


def _pointers(posts: DataFrame, comments: DataFrame, folder: str) -> DataFrame:
    """``id, parent_id, pointer, top, weight, is_target, status`` of the comments whose parent is there.

    What answers a post has arrived: its pointer is null.
    """
    several = F.col("parent_id") != F.col("last_parent")
    links, ambiguous = stage_and_count(_links(posts, comments), "links", several, folder=folder)
    if ambiguous:
        # Which of several parents counts depends on whole paths.
        settled = unroll(posts, comments).select("id", "parent_id")
        parents = settled.join(links.select("id", (F.col("is_parent") & ~F.col("is_post")).alias("is_target")), "id")
    else:
        parents = links.where(F.col("parent_id").isNotNull()).select(
            "id", "parent_id", (F.col("is_parent") & ~F.col("is_post")).alias("is_target")
        )
    there = F.col("is_post") | F.col("parent_id").isNotNull()
    above = links.where(F.col("is_parent") & there).select(F.col("id").alias("parent_id"), "is_post")
    arrived = F.struct(F.col("id").alias("ctp_id"), F.col("parent_id").alias("root_id"))
    return parents.join(above, "parent_id").select(
        "id",
        "parent_id",
        F.when(~F.col("is_post"), F.col("parent_id")).alias("pointer"),
        F.when(F.col("is_post"), arrived).cast(TOP).alias("top"),
        F.when(F.col("is_post"), 0).otherwise(1).cast("bigint").alias("weight"),
        "is_target",
        F.when(F.col("is_post"), POST).otherwise(OPEN).alias("status"),
    )


def _next(below: DataFrame, targets: DataFrame) -> DataFrame:
    """Pointers one target further, with the weights on the way; what meets nothing drops out."""
    above = targets.select(
        F.col("id").alias("pointer"),
        F.col("pointer").alias("next_pointer"),
        F.col("top").alias("next_top"),
        F.col("weight").alias("further"),
        F.col("status").alias("next_status"),
    )
    own = [c for c in below.columns if c not in ("pointer", "top", "weight", "status")]
    return below.join(above, "pointer").select(
        *own,
        F.col("next_pointer").alias("pointer"),
        F.col("next_top").alias("top"),
        (F.col("weight") + F.col("further")).alias("weight"),
        F.col("next_status").alias("status"),
    )


def _united(pieces: list[DataFrame]) -> DataFrame:
    rows = pieces[0]
    for piece in pieces[1:]:
        rows = rows.unionByName(piece)
    return rows


def _climb(rows: DataFrame, folder: str, counts: list[DataFrame] | None = None) -> DataFrame:
    """Rows that reach the top of their tree, with the weights on the way added up.

    A round in which nothing arrives is the last: a comment at twice the distance would have an ancestor that does, so
    only loops are left.

    With ``counts`` rows also carry ``size``, the comments less than 2^r below them; what a round adds to an id is
    appended to the list, and an id's subtree is one more than all that was added.
    """
    is_open = F.col("status") == OPEN
    start, left = stage_and_count(rows, "start", is_open, "status", folder)
    arrived, below = [start.where(~is_open)], start.where(is_open)
    while left:
        moved = _next(below, _united([*arrived, below]).where("is_target"))
        if counts is not None:
            more = below.groupBy(F.col("pointer").alias("id")).agg(F.sum("size").alias("more"))
            counts.append(stage(more, "more", folder=folder))
            grown = F.col("size") + F.coalesce("more", F.lit(0))
            moved = moved.join(counts[-1], "id", "left").withColumn("size", grown).drop("more")
        step, left = stage_and_count(moved, "climb", is_open, "status", folder)
        arrived.append(step.where(~is_open))
        below = step.where(is_open)
        if left and arrived[-1].isEmpty():
            break
    return _united(arrived)


def _before(sized: DataFrame, block: int, folder: str) -> DataFrame:
    """``id, before``: the comments in the subtrees of earlier answers to the same comment.

    Answers are in order of their ids.  More than ``block`` answers to one comment are spread over blocks by a hash,
    in order of the blocks first, so that no window holds all of a hot comment.
    """
    answers = sized.where(F.col("lvl") > 0).select("id", "parent_id", "size")
    widths = answers.groupBy("parent_id").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = small_side(widths.select("parent_id", F.ceil(F.col("n") / block).alias("blocks")))
    place = F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0))
    spread = stage(answers.join(hot, "parent_id", "left").withColumn("block", place), "spread", folder=folder)
    totals = spread.where(F.col("blocks").isNotNull()).groupBy("parent_id", "block").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("parent_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(totals.select("parent_id", "block", F.sum("total").over(earlier).alias("skipped")))
    inside = Window.partitionBy("parent_id", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spread.withColumn("inside", F.sum("size").over(inside))
        .join(offsets, ["parent_id", "block"], "left")
        .select("id", (F.coalesce("inside", F.lit(0)) + F.coalesce("skipped", F.lit(0))).alias("before"))
    )


def intervals(posts: DataFrame, comments: DataFrame, block: int = BLOCK) -> DataFrame:
    """``id, parent_id, root_id, ctp_id, lvl, enter, leave`` of every comment that hangs under a post; staged.

    Places are those of ``hierarchy.unroll``: a comment counts once however often it was dumped, answers to an id that
    is a post and a comment belong to the post, comments under nothing or in a loop have no place, nor have those
    without id.  Only if an id was dumped with several parents are paths made, to tell which one counts.
    """
    with passing_folder(comments.sparkSession, "intervals") as folder:
        counts: list[DataFrame] = []
        pointers = _pointers(posts, comments, folder).withColumn("size", F.lit(1).cast("bigint"))
        placed = _climb(pointers, folder, counts).withColumnRenamed("weight", "lvl").drop("size")
        if counts:
            below = _united(counts).groupBy("id").agg(F.sum("more").alias("below"))
            placed = placed.join(below, "id", "left")
        else:
            placed = placed.withColumn("below", F.lit(0).cast("bigint"))
        size = (F.coalesce("below", F.lit(0)) + 1).alias("size")
        sized = stage(placed.select("id", "parent_id", "top", "lvl", "is_target", size), "sized", folder=folder)
        is_answer = F.col("lvl") > 0
        steps = sized.join(_before(sized, block, folder), "id", "left").select(
            "id",
            "parent_id",
            "top",
            "lvl",
            "is_target",
            "size",
            F.when(is_answer, F.col("parent_id")).alias("pointer"),
            F.when(is_answer, F.col("before") + 1).otherwise(0).cast("bigint").alias("weight"),
            F.when(is_answer, OPEN).otherwise(POST).alias("status"),
        )
        walked = _climb(steps, folder).select(
            "id", "parent_id", "top.root_id", "top.ctp_id", "lvl", F.col("weight").alias("enter"), (F.col("weight") + F.col("size")).alias("leave")
        )
        return stage(walked, "intervals")


def _running(events: DataFrame, names: list[str], block: int) -> DataFrame:
    """Sums over all events of a tree up to each ``place``; ``events`` has one row per ``ctp_id`` and ``place``.

    A window holds ``block`` places at most; a tree of more has one row per block in a window of totals.
    """
    cut = events.withColumn("block", F.floor(F.col("place") / block))
    totals = cut.groupBy("ctp_id", "block").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy("ctp_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    skipped = totals.select("ctp_id", "block", *[F.sum(n).over(earlier).alias(f"skipped_{n}") for n in names])
    skipped = small_side(skipped.where(F.col("block") > 0))
    inside = Window.partitionBy("ctp_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in cut.columns if c not in names and c != "block"]
    sums = [F.sum(n).over(inside).alias(n) for n in names]
    found = cut.select(*rest, "block", *sums).join(skipped, ["ctp_id", "block"], "left")
    return found.select(*rest, *[(F.col(n) + F.coalesce(f"skipped_{n}", F.lit(0))).alias(n) for n in names])


def _valued(numbers: DataFrame, values: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [c for c in values.columns if c != "id"]
    taken = {"ctp_id", "enter", "leave", "place", "block"}.intersection(names)
    if taken:
        raise ValueError(f"columns of values are named like those of the intervals: {sorted(taken)}")
    per_id = values.where(F.col("id").isNotNull()).groupBy("id").agg(*[F.sum(F.col(n).cast("bigint")).alias(n) for n in names])
    joined = numbers.select("id", "ctp_id", "enter", "leave").join(per_id, "id", "left")
    return joined.na.fill(0, names), names


def _subtree_sums(valued: DataFrame, names: list[str], block: int, folder: str) -> DataFrame:
    """The sum up to the last place of a subtree, less that up to its first place, and the comment's own value."""
    valued = stage(valued, "valued", folder=folder)
    last = F.col("leave") - 1
    zero = [F.lit(0).cast("bigint").alias(n) for n in names]
    events = valued.select("ctp_id", F.col("enter").alias("place"), *names).unionByName(
        valued.where(last > F.col("enter")).select("ctp_id", last.alias("place"), *zero).distinct()
    )
    events = events.groupBy("ctp_id", "place").agg(*[F.sum(n).alias(n) for n in names])
    upto = stage(_running(events, names, block), "upto", folder=folder)
    leaves = valued.where(last == F.col("enter")).select("id", *names)
    first = upto.select("ctp_id", F.col("place").alias("enter"), *[F.col(n).alias(f"first_{n}") for n in names])
    end = upto.select("ctp_id", F.col("place").alias("end"), *[F.col(n).alias(f"end_{n}") for n in names])
    inner = valued.where(last > F.col("enter")).withColumn("end", last).join(first, ["ctp_id", "enter"]).join(end, ["ctp_id", "end"])
    return inner.select("id", *[(F.col(f"end_{n}") - F.col(f"first_{n}") + F.col(n)).alias(n) for n in names]).unionByName(leaves)


def subtree_sums(numbers: DataFrame, values: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every comment the sums of ``values`` over itself and all below it; staged.

    ``numbers`` comes from ``intervals`` and may have lost rows, which then count nothing.  ``values`` has ``id`` and
    whole numbers; ids without values, and nulls, count 0, and values of a repeated id are added.
    """
    with passing_folder(numbers.sparkSession, "sums") as folder:
        return stage(_subtree_sums(*_valued(numbers, values), block, folder), "subtrees")


def path_sums(numbers: DataFrame, values: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every comment the sums of ``values`` over itself and all its ancestors; staged.

    A value counts from its comment's first place on and is taken back after its subtree.  Rows and values as for
    ``subtree_sums``.
    """
    with passing_folder(numbers.sparkSession, "sums") as folder:
        joined, names = _valued(numbers, values)
        valued = stage(joined, "valued", folder=folder)
        some = F.lit(False)
        for n in names:
            some = some | (F.col(n) != 0)
        back = [(-F.col(n)).alias(n) for n in names]
        events = valued.select("ctp_id", F.col("enter").alias("place"), "id", *names).unionByName(
            valued.where(some).select("ctp_id", F.col("leave").alias("place"), F.lit(None).cast("string").alias("id"), *back)
        )
        per_place = events.groupBy("ctp_id", "place").agg(F.max("id").alias("id"), *[F.sum(n).alias(n) for n in names])
        return stage(_running(per_place, names, block).where(F.col("id").isNotNull()).select("id", *names), "paths")


def prune(numbers: DataFrame, level: int, block: int = BLOCK) -> DataFrame:
    """``hierarchy.cascade_prune`` on intervals: comments above ``level`` with none on it below them; staged.

    Only trees that reach ``level`` are summed up, and only what goes is looked up: a short or sparse level is in few of
    them.  Intervals stay as they are, so that the result can be cut again.
    """
    if "connected" not in numbers.columns:
        numbers = numbers.withColumn("connected", F.lit(True))
    with passing_folder(numbers.sparkSession, "prune") as folder:
        on_level = (F.col("lvl") == level).cast("bigint")
        cut_tops = small_side(numbers.where(F.col("lvl") == level).select("ctp_id", F.lit(True).alias("top_cut")).distinct())
        reaching = numbers.where(F.col("lvl") <= level).join(cut_tops, "ctp_id", "left_semi")
        marked = reaching.select("id", "ctp_id", "enter", "leave", on_level.alias("marks"))
        gone = small_side(_subtree_sums(marked, ["marks"], block, folder).where(F.col("marks") > 0).select("id"))
        left = (
            numbers.where(F.col("lvl") < level)
            .join(gone, "id", "left_anti")
            .join(cut_tops, "ctp_id", "left")
            .withColumn("connected", F.col("connected") & F.col("top_cut").isNull())
        )
        return stage(left.select(*NODE, "enter", "leave", "connected"), "pruned")
