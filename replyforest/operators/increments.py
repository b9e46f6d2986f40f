"""A reply forest that takes in new posts and comments without being built anew.

New comments climb over each other and end at stored nodes, whose paths go before theirs.  Stored comments that hung
under nothing are released by new parents.  What was placed is only placed again below an id that was dumped with
another parent, or that became a post.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforest.operators.hierarchy import stripped, unroll
from replyforest.session import stage, stage_and_count

PARTS = 256  # partitions of the stored nodes
NODE = ["id", "parent_id", "root_id", "ctp_id", "lvl", "path"]


@dataclass
class Forest:
    """``posts (id)``, ``nodes`` as ``unroll`` makes them, and the links ``(id, parent_id)`` of comments that are ``loose``
    and of ids that have ``several`` parents.  Only nodes have paths."""

    posts: DataFrame
    nodes: DataFrame
    loose: DataFrame
    several: DataFrame


def _links(comments: DataFrame) -> DataFrame:
    """The distinct links of comments, parents without their prefix; a comment without a parent has none."""
    return stripped(comments).where("parent_id is not null").select("id", "parent_id").distinct()


def _with_several(links: DataFrame) -> DataFrame:
    """The links of ids that have several parents."""
    ids = links.groupBy("id").agg((F.min("parent_id") != F.max("parent_id")).alias("several")).where("several")
    return links.join(ids.select("id"), "id", "left_semi")


def _of(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose ``column`` is one of ``ids (id)``."""
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_semi")


def _without(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_anti")


def start(posts: DataFrame, comments: DataFrame) -> Forest:
    """The forest of a first load."""
    nodes = unroll(posts, comments)
    links = stage(_links(comments), "links")
    ids = stage(posts.where("id is not null").select("id").distinct(), "posts")
    return Forest(ids, nodes, stage(_without(links, nodes), "loose"), stage(_with_several(links), "several"))


def save(forest: Forest, path: str) -> None:
    """Writes a forest; its nodes lie in partitions by top-level comment, so that a few trees are a few files."""
    part = F.pmod(F.xxhash64("ctp_id"), F.lit(PARTS)).cast("int")
    forest.nodes.select(*NODE).withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/nodes")
    for name in ("posts", "loose", "several"):
        getattr(forest, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Forest:
    link, node = "id string, parent_id string", "id string, parent_id string, root_id string, ctp_id string, lvl bigint, path array<string>, part int"
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Forest(read("posts", "id string"), read("nodes", node), read("loose", link), read("several", link))


def whole_rows(nodes: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Whole rows of stored nodes, paths included, whose ``column`` is one of ``keys (id)``.

    Which partitions hold them is found by ids alone; those numbers, at most ``PARTS``, choose the files to read.
    """
    if "part" in nodes.columns:
        parts = [row.part for row in _of(nodes.select(column, "part"), keys, column).select("part").distinct().collect()]
        nodes = nodes.where(F.col("part").isin(parts))
    return _of(nodes.select(*NODE), keys, column)


def _below(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """The ids of ``moved (id)`` and of all nodes below them; only the trees that hold some of them are read."""
    tops = _of(nodes.select("id", "ctp_id"), moved).select(F.col("ctp_id").alias("id")).distinct()
    trees = whole_rows(nodes, stage(tops, "tops"), "ctp_id").select("id", F.explode("path").alias("above"))
    return _of(trees, moved, "above").select("id").distinct()


def grow(forest: Forest, posts: DataFrame, comments: DataFrame) -> Forest:
    """The forest with new posts and comments: the same as one built of everything at once.

    Copies of known rows change nothing.  What new rows touch is small beside the forest, so the whole nodes are read by
    their ids only; paths are read of the nodes that new comments answer, and of the trees in which something moves.
    """
    nodes, narrow = forest.nodes, forest.nodes.select("id", "parent_id", "root_id")
    new_posts = stage(_without(posts.where("id is not null").select("id").distinct(), forest.posts), "new-posts")
    known = narrow.select("id", "parent_id").unionByName(forest.several).unionByName(forest.loose)
    new = stage(_links(comments).join(known, ["id", "parent_id"], "left_anti"), "new-links")
    every_post = forest.posts.unionByName(new_posts)
    several = _with_several(_of(known, new).unionByName(new).distinct()).unionByName(forest.several).distinct()
    several, ambiguous = stage_and_count(several, "several")

    # Nodes that were dumped with another parent, answer a new post so far taken for a comment, or might answer one.
    answers = _of(narrow, new_posts, "parent_id").where("root_id <> parent_id").select("id")
    moved = answers
    if ambiguous:  # a node that was dumped with another parent is among them
        moved = moved.unionByName(_of(narrow, new).select("id"))
        moved = moved.unionByName(_of(_of(forest.several, new_posts, "parent_id").select("id"), narrow))
    moved, more = stage_and_count(moved.distinct(), "moved")
    while True:
        again = stage(_below(nodes, moved), "again") if more else moved
        # What is new is not among the loose, and nodes are in neither unless an id has several parents.
        links = new.unionByName(forest.loose)
        if more:
            links = links.unionByName(_of(narrow, again).select("id", "parent_id"))
        if ambiguous:
            links = links.unionByName(_of(several, links))
        links = stage(links.distinct() if more or ambiguous else links, "open-links")
        parents = stage(links.select(F.col("parent_id").alias("id")).distinct(), "parents")
        ends = _of(every_post, parents)
        above = _without(parents, every_post)
        held = stage(whole_rows(nodes, _without(above, again) if more else above, "id"), "anchors")
        prefixed = links.select("id", F.concat(F.lit("t1_"), "parent_id").alias("parent_id"))
        placed = unroll(ends, prefixed, anchors=held)
        if not ambiguous:
            break
        # Another parent of a node that stayed where it was may have come to a place, or to another one.
        stirred = _without(_of(several, placed, "parent_id").select("id"), links)
        stirred, found = stage_and_count(_of(stirred, narrow).distinct(), "stirred")
        if not found:
            break
        moved, more = stage(moved.unionByName(stirred).distinct(), "moved"), more + found
    kept = _without(nodes.select(*NODE), again) if more else nodes.select(*NODE)
    loose = stage(_without(links, placed), "loose")
    return Forest(stage(every_post, "posts"), stage(kept.unionByName(placed.select(*NODE)), "nodes"), loose, several)
