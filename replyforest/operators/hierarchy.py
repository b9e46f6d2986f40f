"""The reply forest: attaching comments to posts, and cutting sparse levels.

Comments become one long table ``nodes(id, parent_id, root_id, ctp_id, lvl, path)``;
``path`` holds the comment ids from the top-level comment down to the node, and the
level is a column, so no plan grows with the depth of the forest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforest.functions.expressions import strip_prefix
from replyforest.session import SMALL_ROWS, passing_folder, stage, stage_and_count

# What a pointer rests on: a post, a comment still to be climbed, or an id with several parents.
POST, OPEN, HELD = "post", "open", "held"


def stripped(comments: DataFrame) -> DataFrame:
    """Comments with an id, their parent id without the type prefix."""
    return comments.where(F.col("id").isNotNull()).withColumn("parent_id", strip_prefix(F.col("parent_id")))


def answers_to(comments: DataFrame, parents: DataFrame) -> DataFrame:
    """Comments (parent id stripped) whose parent is one of ``parents``."""
    return comments.join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")


def not_placed(comments: DataFrame, placed: DataFrame) -> DataFrame:
    """Comments whose id is not in ``placed``."""
    return comments.join(placed.select("id"), "id", "left_anti")


def _links(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """One row per id that occurs as a post, a comment or a parent.

    ``parent_id`` to ``last_parent`` spans the parents of a comment; they differ only
    for an id that was dumped more than once with different parents.
    """
    absent = F.lit(None).cast("string")

    def occurrence(id_: Column, parent: Column, is_post: bool, is_parent: bool) -> Column:
        return F.struct(
            id_.alias("id"), parent.alias("parent_id"), F.lit(is_post).alias("is_post"), F.lit(is_parent).alias("is_parent")
        )

    child, parent = F.col("id"), F.col("parent_id")
    answers = stripped(comments).select("id", "parent_id").where(parent.isNotNull())
    occurrences = answers.select(
        F.inline(F.array(occurrence(child, parent, False, False), occurrence(parent, absent, False, True)))
    ).unionByName(
        posts.where(child.isNotNull()).select(F.inline(F.array(occurrence(child, absent, True, False))))
    )
    return occurrences.groupBy("id").agg(
        F.min("parent_id").alias("parent_id"),
        F.max("parent_id").alias("last_parent"),
        F.max("is_post").alias("is_post"),
        F.max("is_parent").alias("is_parent"),
    )


def _climb(below: DataFrame, targets: DataFrame) -> DataFrame:
    """Follow every pointer of ``below`` one target further.

    ``targets`` has one row per id, so the join never multiplies rows, and a hot parent
    is a skewed key on one side only, which adaptive execution splits.  What meets
    nothing, or is still to climb to a comment it has passed, can never attach and drops
    out; so paths along a cycle do not keep growing.
    """
    above = targets.select(
        F.col("id").alias("pointer"),
        F.col("pointer").alias("next_pointer"),
        F.col("path").alias("path_above"),
        F.col("status").alias("next_status"),
    )
    climbed = below.drop("status").join(above, "pointer").select(
        "id",
        F.col("next_pointer").alias("pointer"),
        F.concat("path_above", "path").alias("path"),
        F.col("next_status").alias("status"),
        "is_target",
        "is_option",
    )
    return climbed.where((F.col("status") != OPEN) | ~F.array_contains("path", F.col("pointer")))


def _settle_options(options: DataFrame, folder: str) -> DataFrame:
    """Places the ids that have several parents: the shallowest place wins.

    Ties go to the smaller path, then to the smaller post.  Options may hang on one
    another, so places are improved until they no longer change; every round is a join
    on the ids concerned.
    """
    rank = F.struct(F.size("path"), F.col("path"), F.col("pointer"))

    def best_of(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("id").agg(F.min_by(F.struct("pointer", "path"), rank).alias("place"))
        return stage(best.select("id", "place.*"), "options", folder=folder)

    def fingerprint(rows: DataFrame):
        return rows.agg(F.count("*"), F.bit_xor(F.xxhash64("id", "pointer", "path"))).first()

    rooted = options.where(F.col("status") == POST).select("id", "pointer", "path")
    hanging = options.where(F.col("status") == HELD).select("id", F.col("pointer").alias("anchor"), F.col("path").alias("below"))
    best = best_of(rooted)
    mark = fingerprint(best)
    while True:
        moved = hanging.join(best.withColumnRenamed("id", "anchor"), "anchor").select(
            "id", "pointer", F.concat("path", "below").alias("path")
        )
        best = best_of(rooted.unionByName(moved))
        previous, mark = mark, fingerprint(best)
        if mark == previous:
            return best


def unroll(posts: DataFrame, comments: DataFrame, min_rows: int | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """Every comment that hangs, directly or not, under a post; staged.

    Pointers are doubled: after round r a comment knows its ancestors up to distance
    2^r, so the number of rounds grows with the logarithm of the depth.  A comment whose
    parent id is both a post and a comment answers the post.  Comments in a cycle, or
    under a parent that is not there, never attach.

    With ``min_rows`` climbing ends once a level that ``first_short_level`` would find is
    known, as nothing below it is wanted: levels down to that one are whole, deeper ones
    need not be.  That keeps a few endless chains from growing endless paths.

    ``anchors`` are nodes that have their places already, none of them in ``comments``; what hangs under them attaches
    there.
    """
    with passing_folder(comments.sparkSession, "unroll") as folder:
        return stage(_attach(posts, comments, min_rows, folder, anchors), "nodes")


def _short_level_known(pieces: list[DataFrame], min_rows: int) -> bool:
    """Whether a level that is whole by now has fewer than ``min_rows`` comments.

    After r rounds all levels below 2^r - 1 are whole.
    """
    rows = pieces[0]
    for piece in pieces[1:]:
        rows = rows.unionByName(piece)
    counts = rows.groupBy((F.size("path") - 1).cast("bigint").alias("lvl")).agg(F.count("*").alias("row_count"))
    return first_short_level(counts, min_rows) < 2 ** len(pieces) - 1


def _attach(posts: DataFrame, comments: DataFrame, min_rows: int | None, folder: str, anchors: DataFrame | None) -> DataFrame:
    several = F.col("parent_id") != F.col("last_parent")
    ends = posts if anchors is None else posts.select("id").unionByName(anchors.select("id"))
    links, ambiguous_ids = stage_and_count(_links(ends, comments), "links", several, folder=folder)
    is_comment = F.col("parent_id").isNotNull()
    empty_path = F.array().cast("array<string>")

    targets = links.where(F.col("is_parent") & (F.col("is_post") | is_comment)).select(
        "id",
        F.when(F.col("is_post") | several, F.col("id")).otherwise(F.col("parent_id")).alias("pointer"),
        F.when(F.col("is_post") | several, empty_path).otherwise(F.array("id")).alias("path"),
        F.when(F.col("is_post"), POST).when(several, HELD).otherwise(OPEN).alias("status"),
    )
    below = links.where(is_comment & ~several).select(
        "id",
        F.col("parent_id").alias("pointer"),
        F.array("id").alias("path"),
        (F.col("is_parent") & ~F.col("is_post")).alias("is_target"),
        F.lit(False).alias("is_option"),
    )
    if ambiguous_ids:
        below = below.unionByName(_options(comments, links.where(several).select("id")))

    fixed = targets.where(F.col("status") != OPEN)
    pieces: list[DataFrame] = []
    while True:
        is_open = F.col("status") == OPEN
        step, open_rows = stage_and_count(_climb(below, targets), "climb", is_open, "status", folder)
        pieces.append(step.where(~is_open))
        below = step.where(is_open)
        if open_rows == 0:
            break
        # With ids that have several parents the levels are known only in the end.
        if min_rows and not ambiguous_ids and len(pieces) > 1 and _short_level_known(pieces, min_rows):
            break
        targets = fixed
        for piece in (*pieces, below):
            targets = targets.unionByName(piece.where("is_target").select("id", "pointer", "path", "status"))

    attached = pieces[0]
    for piece in pieces[1:]:
        attached = attached.unionByName(piece)
    if anchors is not None:
        attached = _below_anchors(attached, anchors)
    placed = attached.where((F.col("status") == POST) & ~F.col("is_option")).select("id", "pointer", "path")
    if ambiguous_ids:
        best = _settle_options(attached.where("is_option"), folder)
        on_best = (
            attached.where((F.col("status") == HELD) & ~F.col("is_option"))
            .select("id", F.col("pointer").alias("anchor"), F.col("path").alias("below"))
            .join(best.withColumnRenamed("id", "anchor"), "anchor")
            .select("id", "pointer", F.concat("path", "below").alias("path"))
        )
        placed = placed.unionByName(best).unionByName(on_best)
    return placed.select(
        "id",
        F.coalesce(F.get("path", F.size("path") - 2), F.col("pointer")).alias("parent_id"),
        F.col("pointer").alias("root_id"),
        F.get("path", F.lit(0)).alias("ctp_id"),
        (F.size("path") - 1).cast("bigint").alias("lvl"),
        "path",
    )


def _below_anchors(attached: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pointers that rest on an anchor go on to its post, and paths begin with that of the anchor."""
    above = anchors.select(F.col("id").alias("pointer"), F.col("root_id").alias("root"), F.col("path").alias("above"))
    joined = attached.join(above, "pointer", "left")
    path = F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path"))
    return joined.select("id", F.coalesce("root", "pointer").alias("pointer"), path.alias("path"), "status", "is_target", "is_option")


def _options(comments: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """One pointer per distinct parent of the ids that have several."""
    return (
        stripped(comments)
        .select("id", F.col("parent_id").alias("pointer"))
        .where(F.col("pointer").isNotNull())
        .join(ambiguous, "id", "left_semi")
        .distinct()
        .select(
            "id",
            "pointer",
            F.array("id").alias("path"),
            F.lit(False).alias("is_target"),
            F.lit(True).alias("is_option"),
        )
    )


def orphans(comments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Comments that hang under no post."""
    return not_placed(stripped(comments), nodes)


def level_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("lvl").agg(F.count("*").alias("row_count"))


def first_short_level(counts: DataFrame, min_rows: int = 100) -> int:
    """Smallest level from 2 on with fewer than ``min_rows`` comments, or with none.

    Top-level comments and the level below them are never tested.
    """
    full = {row["lvl"] for row in counts.where(F.col("row_count") >= min_rows).collect()}
    level = 2
    while level in full:
        level += 1
    return level


def first_sparse_level(counts: DataFrame, min_ratio: float = 0.05) -> DataFrame:
    """One row: smallest level from 1 on with less than ``min_ratio`` of the top-level comments, else null.

    ``counts`` has one row per level, so the window over it stays small.
    """
    top = F.max(F.when(F.col("lvl") == 0, F.col("row_count"))).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("top", top).agg(
        F.min(F.when((F.col("lvl") >= 1) & (F.col("row_count") / F.col("top") < min_ratio), F.col("lvl"))).alias("lvl")
    )


def cascade_prune(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes above ``level`` that are no ancestor of a node on it.

    ``connected`` tells whether the top-level comment is still there; only connected
    nodes show up in threads and in the lookup, the others merely count as rows.
    """
    if "connected" not in nodes.columns:
        nodes = nodes.withColumn("connected", F.lit(True))
    on_level = nodes.where(F.col("lvl") == level).select("ctp_id", F.slice("path", 1, level).alias("ancestors"))
    cut, rows = stage_and_count(on_level, "cut")
    ancestors = cut.select(F.explode("ancestors").alias("id")).distinct()
    cut_tops = cut.select("ctp_id", F.lit(True).alias("top_cut")).distinct()
    if rows * level <= SMALL_ROWS:
        ancestors, cut_tops = F.broadcast(ancestors), F.broadcast(cut_tops)
    return (
        nodes.where(F.col("lvl") < level)
        .join(ancestors, "id", "left_anti")
        .join(cut_tops, "ctp_id", "left")
        .withColumn("connected", F.col("connected") & F.col("top_cut").isNull())
        .select("id", "parent_id", "root_id", "ctp_id", "lvl", "path", "connected")
    )
