import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forests import attach, comments_frame, places, posts_frame
from plan_texts import executed_plan
from replyforest.operators import hierarchy, threads
from replyforest.session import stage


def check(spark, posts, links):
    found = places(hierarchy.unroll(posts_frame(spark, posts), comments_frame(spark, links)))
    assert found == attach(posts, links)
    return found


def test_plain_tree(spark):
    found = check(spark, ["p", "q"], [("a", "p"), ("b", "a"), ("c", "b"), ("d", "a"), ("e", "q")])
    assert found["c"] == ("p", ("a", "b", "c"))


def test_no_comments_and_no_posts(spark):
    assert check(spark, ["p"], []) == {}
    assert check(spark, [], [("a", "p")]) == {}


def test_orphans_and_their_answers_stay_out(spark):
    links = [("a", "p"), ("b", "gone"), ("c", "b"), ("d", "c"), ("e", "d"), ("n", None), (None, "p")]
    assert set(check(spark, ["p"], links)) == {"a"}
    nodes = hierarchy.unroll(posts_frame(spark, ["p"]), comments_frame(spark, links))
    left = hierarchy.orphans(comments_frame(spark, links), nodes)
    assert sorted(r.id for r in left.collect()) == ["b", "c", "d", "e", "n"]


def test_cycles_never_attach(spark):
    links = [("a", "p"), ("x", "y"), ("y", "x"), ("z", "y"), ("self", "self"), ("s", "self")]
    links += [(f"d{i}", f"d{i - 1}" if i else "a") for i in range(40)]
    assert len(check(spark, ["p"], links)) == 41


def test_long_cycle_ends(spark):
    links = [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)] + [(f"h{i}", f"r{i}" if i < 5 else f"h{i - 5}") for i in range(60)]
    assert set(check(spark, ["p"], [("a", "p"), *links])) == {"a"}


def test_parent_that_is_post_and_comment(spark):
    found = check(spark, ["p", "x"], [("a", "p"), ("x", "a"), ("b", "x"), ("c", "b")])
    assert found["b"] == ("x", ("b",)) and found["x"] == ("p", ("a", "x"))


def test_repeated_comment_counts_once(spark):
    assert check(spark, ["p"], [("a", "p"), ("a", "p"), ("b", "a"), ("b", "a"), ("c", "b")])["c"] == ("p", ("a", "b", "c"))


def test_repeated_comment_with_other_parents_takes_the_first_level(spark):
    found = check(
        spark,
        ["p", "q"],
        [("a", "p"), ("b", "a"), ("c", "b"), ("x", "c"), ("x", "a"), ("y", "x"), ("z", "y"), ("y", "c"), ("w", "z"), ("v", "p"), ("v", "q")],
    )
    assert found["x"] == ("p", ("a", "x")) and found["w"][1] == ("a", "x", "y", "z", "w")
    assert found["v"] == ("p", ("v",))


def test_deep_chain_needs_few_rounds(spark):
    links = [(f"c{i:04}", f"c{i - 1:04}" if i else "p") for i in range(300)]
    random.Random(1).shuffle(links)
    found = check(spark, ["p"], links)
    assert len(found["c0299"][1]) == 300


@pytest.mark.parametrize("min_rows", [1, 2, 4, 30])
def test_climbing_ends_at_a_short_level(spark, min_rows):
    """Chains of very different length: the cut is the same, the longest is not followed to its end."""
    links = []
    for chain, length in enumerate([200, 200, 9, 9, 5, 3] + [2] * 30):
        links += [(f"c{chain}_{i}", f"c{chain}_{i - 1}" if i else "p") for i in range(length)]
    posts, comments = posts_frame(spark, ["p"]), comments_frame(spark, links)
    whole, part = hierarchy.unroll(posts, comments), hierarchy.unroll(posts, comments, min_rows)

    def cut(nodes):
        level = hierarchy.first_short_level(hierarchy.level_counts(nodes), min_rows)
        return level, sorted((r.id, r.connected) for r in hierarchy.cascade_prune(nodes, level).collect())

    assert cut(whole) == cut(part)
    if min_rows > 2:
        assert part.agg(F.max("lvl")).first()[0] < 40


names = st.sampled_from([f"n{i}" for i in range(9)])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(posts=st.lists(st.sampled_from(["n0", "p", "q"]), unique=True), links=st.lists(st.tuples(names, st.one_of(names, st.sampled_from(["p", "q", "gone"]))), max_size=16))
def test_any_links(spark, posts, links):
    check(spark, posts, links)


def test_prune_takes_ancestors_and_disconnects_their_siblings(spark):
    links = [("a", "p"), ("b", "a"), ("c", "b"), ("s", "a"), ("t", "s"), ("k", "p"), ("l", "k")]
    nodes = hierarchy.unroll(posts_frame(spark, ["p"]), comments_frame(spark, links))
    # Level 2 holds c and t, so a, b and s go as well.
    left = {r.id: r.connected for r in hierarchy.cascade_prune(nodes, 2).collect()}
    assert left == {"k": True, "l": True}
    deeper = comments_frame(spark, links + [("d", "c")])
    cut = hierarchy.cascade_prune(hierarchy.unroll(posts_frame(spark, ["p"]), deeper), 3)
    assert {r.id: r.connected for r in cut.collect()} == {"s": False, "t": False, "k": True, "l": True}
    # A second cut goes on from what the first one left.
    again = {r.id: r.connected for r in hierarchy.cascade_prune(cut, 2).collect()}
    assert again == {"k": True, "l": True}


def test_levels_at_which_cuts_start(spark):
    def counts(*rows):
        return spark.createDataFrame(list(enumerate(rows)), "lvl bigint, row_count bigint")

    assert hierarchy.first_short_level(counts(5, 5, 500, 99), 100) == 3
    assert hierarchy.first_short_level(counts(500, 500, 500), 100) == 3
    assert hierarchy.first_short_level(counts(3), 100) == 2
    assert hierarchy.first_sparse_level(counts(100, 50, 5, 4), 0.05).first().lvl == 3
    assert hierarchy.first_sparse_level(counts(100, 50), 0.05).first().lvl is None


def hot_forest(spark, n):
    """Half of all comments answer one post, a quarter one comment, the others earlier comments."""
    i = F.col("id")
    parent = (
        F.when(i % 2 == 0, F.lit("t3_p0")).when(i % 4 == 1, F.lit("t1_c0")).otherwise(F.concat(F.lit("t1_c"), F.floor(i / 3)))
    )
    comments = spark.range(n).select(
        F.concat(F.lit("c"), i).alias("id"),
        F.lit("text").alias("body"),
        (i % 7).alias("score"),
        F.concat(F.lit("u"), i % 5).alias("author"),
        parent.alias("parent_id"),
    )
    return posts_frame(spark, ["p0", "p1"]), comments


def test_hot_parent_is_split(spark, tiny_skew):
    posts, comments = hot_forest(spark, 40_000)
    links = stage(hierarchy._links(posts, comments))
    targets = links.where("is_parent").select("id", F.col("parent_id").alias("pointer"), F.array("id").alias("path"), F.lit("open").alias("status"))
    below = links.where("parent_id IS NOT NULL").select(
        "id", F.col("parent_id").alias("pointer"), F.array("id").alias("path"), F.lit(True).alias("is_target"), F.lit(False).alias("is_option")
    )
    assert "skew=true" in executed_plan(hierarchy._climb(below, targets))


def test_hot_post_is_split_when_facts_are_gathered(spark, tiny_skew):
    posts, comments = hot_forest(spark, 40_000)
    nodes = hierarchy.unroll(posts, comments)
    assert nodes.count() == 40_000
    longest = stage(threads.longest_threads(threads.all_threads(nodes)))
    facts = threads.thread_facts(longest, posts, comments)
    assert "skew=true" in executed_plan(facts)
    assert facts.count() == 20_000 and facts.where("posts = 'p0' AND post_score = 1").count() == 20_000


def test_hot_post_is_split_when_threads_are_chosen(spark, tiny_skew):
    posts, comments = hot_forest(spark, 40_000)
    answers = hierarchy.answers_to(hierarchy.stripped(comments).repartition(8), posts)
    assert "skew=true" in executed_plan(answers) and answers.count() == 20_000
