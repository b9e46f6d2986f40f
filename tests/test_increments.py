import random
import re

import pytest

from forests import attach, comments_frame, places, posts_frame
from plan_texts import executed_plan
from replyforest.operators import hierarchy, increments


def run(spark, steps, tmp_path=None):
    """Grows a forest by steps ``(posts, links)`` and compares it with one of everything after each."""
    forest, posts, links = None, [], []
    for number, (more_posts, more_links) in enumerate(steps):
        posts, links = posts + more_posts, links + more_links
        new = posts_frame(spark, more_posts), comments_frame(spark, more_links)
        forest = increments.grow(forest, *new) if forest else increments.start(*new)
        assert places(forest.nodes) == attach(posts, links)
        attached = set(attach(posts, links))
        whole = {(i, p) for i, p in links if i is not None and p is not None}
        assert {tuple(r) for r in forest.loose.collect()} == {(i, p) for i, p in whole if i not in attached}
        if tmp_path:
            increments.save(forest, str(tmp_path / str(number)))
            forest = increments.load(spark, str(tmp_path / str(number)))
    return forest


def test_new_comments_climb_over_stored_nodes(spark):
    run(spark, [(["p"], [("a", "p"), ("b", "a")]), ([], [("d", "c"), ("c", "b"), ("x", "a"), ("y", "p"), ("y", "p")]), ([], [("b", "a")])])


def test_orphans_are_released(spark):
    run(spark, [(["p"], [("c", "b"), ("d", "c"), ("q1", "q")]), (["q"], []), ([], [("b", "a")]), ([], [("a", "p")])])


def test_a_post_that_was_a_comment(spark):
    run(spark, [(["p"], [("a", "p"), ("b", "a"), ("c", "b"), ("d", "c")]), (["b"], [("e", "d"), ("f", "a")]), (["a"], [])])


def test_another_parent(spark):
    run(spark, [(["p"], [("a", "p"), ("b", "a"), ("c", "b"), ("d", "c")]), ([], [("c", "p")]), ([], [("d", "gone")]), ([], [("gone", "p"), ("b", "x")])])


def test_a_second_parent_comes_to_a_place(spark):
    """x hangs deep, with an orphan as its other parent; when that is attached, x and what is below it moves up."""
    chain = [(f"a{i}", f"a{i - 1}" if i else "p") for i in range(6)]
    run(spark, [(["p"], chain + [("x", "a5"), ("x", "o"), ("y", "x"), ("z", "y"), ("z", "w")]), ([], [("o", "p"), ("w", "y")]), ([], [("n", "z")])])


@pytest.mark.parametrize("seed", range(2))
def test_random_splits(spark, tmp_path, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(45)]
    links = [(i, rng.choice(ids[: max(1, n)] if rng.random() < 0.9 else ids)) for n, i in enumerate(ids)] + [(rng.choice(ids), rng.choice(ids)) for _ in range(8)]
    posts = ["n0", *rng.sample(ids, 3), "other"]
    rng.shuffle(links)
    cut = sorted(rng.sample(range(len(links)), 2))
    steps = [(posts[:2], links[: cut[0]]), (posts[2:3], links[cut[0] : cut[1]]), (posts[3:], links[cut[1] :])]
    run(spark, steps, tmp_path if seed == 0 else None)


def test_untouched_trees_are_not_read(spark, tmp_path):
    links = [(f"t{i}", "p") for i in range(400)] + [(f"u{i}", f"t{i}") for i in range(400)]
    increments.save(increments.start(posts_frame(spark, ["p"]), comments_frame(spark, links)), str(tmp_path / "f"))
    forest = increments.load(spark, str(tmp_path / "f"))
    few = spark.createDataFrame([("u7",), ("u8",), ("nothing",)], "id string")
    rows = increments.whole_rows(forest.nodes, few, "id")
    plan = executed_plan(rows)
    assert sorted(r.id for r in rows.collect()) == ["u7", "u8"]
    chosen = re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN \(([^)]*)\)", plan) or re.search(r"part#\d+ = (\d+)", plan)
    assert 1 <= len(chosen.group(1).split(",")) <= 2 < forest.nodes.select("part").distinct().count()
    grown = increments.grow(forest, posts_frame(spark, []), comments_frame(spark, [("v", "u7"), ("w", "v")]))
    assert grown.nodes.count() == 802
    assert {r.id: r.path for r in grown.nodes.where("id in ('v', 'w')").collect()} == {"v": ["t7", "u7", "v"], "w": ["t7", "u7", "v", "w"]}


def test_nothing_new(spark):
    run(spark, [([], []), (["p"], [("a", "p")]), ([], []), (["p"], [("a", "p"), (None, "p"), ("b", None)])])
    assert hierarchy.unroll(posts_frame(spark, []), comments_frame(spark, [])).count() == 0


def test_what_is_placed_is_not_read_again_without_several_parents(spark, monkeypatch):
    """Only ids with several parents can be stirred; a forest without any does not look for them."""
    staged = []
    monkeypatch.setattr(increments, "stage_and_count", lambda df, name, f=increments.stage_and_count: staged.append(name) or f(df, name))
    steps = [(["p"], [("c", "b"), ("q1", "q")]), (["q"], [("a", "p")]), ([], [("b", "a")])]
    run(spark, steps)
    assert staged == ["several", "moved"] * 2
    staged.clear()
    run(spark, [*steps, ([], [("c", "p")])])
    assert "stirred" in staged
