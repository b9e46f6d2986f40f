"""What the plans must and must not hold."""

import os

import pytest

from pyspark.sql import functions as F

from forests import comments_frame, posts_frame
from replyforest.operators import filters, hierarchy, sampling, stats, threads
from replyforest.plans import queries
from replyforest.session import stage

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(frame):
    """The scanned columns, one text per scan."""
    return [line.split("ReadSchema: ")[1] for line in plan(frame).splitlines() if "ReadSchema: " in line]


@needs_data
def test_no_query_joins_without_a_key_or_leaves_the_jvm(spark):
    for name, query in queries.QUERIES.items():
        text = plan(query(spark, FOLDER))
        for bad in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
            assert bad not in text, (name, bad)


@pytest.fixture(scope="module")
def nodes(spark):
    posts = posts_frame(spark, ["p", "q"])
    return hierarchy.unroll(posts, comments_frame(spark, [("a", "p"), ("b", "a"), ("c", "b"), ("d", "q")]))


def test_counting_reads_only_what_it_counts(nodes):
    assert scans(hierarchy.level_counts(nodes)) == ["struct<lvl:bigint>"]
    assert scans(stats.level_widths(nodes)) == ["struct<root_id:string,lvl:bigint>"]


def test_filters_reach_the_scan(spark):
    posts = stage(posts_frame(spark, ["p", "q"]))
    text = plan(filters.by_score(posts.selectExpr("id AS posts"), posts, viral=True))
    assert "GreaterThanOrEqual(score,1000)" in text
    comments = stage(comments_frame(spark, [("a", "p")]))
    assert "EqualTo(id,a)" in plan(comments.where("id = 'a'"))


def test_texts_do_not_travel_with_the_tree(spark):
    posts = stage(posts_frame(spark, ["p", "q"]))
    comments = stage(comments_frame(spark, [("a", "p")]))
    assert sorted(scans(hierarchy._links(posts, comments))) == ["struct<id:string,parent_id:string>", "struct<id:string>"]


def test_threads_shuffle_once(spark, nodes):
    """All threads need no shuffle, the longest ones a single one, after a partial aggregation."""
    assert "Exchange" not in plan(threads.all_threads(nodes))
    text = plan(threads.longest_threads(threads.all_threads(nodes)))
    assert text.count("Exchange") == 1 and "partial_max_by" in text


def test_parts_of_a_level_go_to_different_tasks(nodes):
    text = plan(threads.lookup_long(nodes, parts=7))
    last = [line for line in text.splitlines() if "Exchange" in line][0]
    assert "posts#" in last and "lvl#" in last and "part#" in last


def test_samples_leave_other_texts_where_they_are(spark, nodes):
    """Without static broadcasts too, comments are shuffled after the wanted ones were chosen."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posts, comments = stage(posts_frame(spark, ["p"])), stage(comments_frame(spark, [("a", "p"), ("b", "a")]))
        picked = threads.all_threads(nodes).withColumn("pick", F.lit(0))
        text = plan(sampling.with_metadata(picked, posts, comments))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [part for part in text.split("\n") if "FileScan" in part and "body" in part]
    assert scans
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if line == scans[0])
    above = [line for line in lines[:at] if len(line) - len(line.lstrip(" :+-")) < len(lines[at]) - len(lines[at].lstrip(" :+-"))]
    nearest = [line for line in above if "Join" in line or "Exchange" in line][-1]
    assert "BroadcastHashJoin" in nearest and "LeftSemi" in nearest


def test_all_threads_are_counted_without_paths(nodes):
    assert "Generate" not in plan(stats.depth_of_all_threads(nodes, 3))


def test_deduplication_and_join_share_a_shuffle(spark, nodes):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        comments = stage(comments_frame(spark, [("a", "p"), ("b", "a")]))
        text = plan(threads.members_with_facts(threads.all_threads(nodes), comments))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2


@needs_data
def test_statistics_share_one_aggregation(spark):
    corpus = queries.corpus(spark, FOLDER)
    text = plan(stats.segment_counts(filters.tagged(corpus.facts, ["sub1"])))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 2 and "path" not in text.split("ReadSchema")[1]
