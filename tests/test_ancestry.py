import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forests import attach, comments_frame, posts_frame
from replyforest.operators import ancestry, hierarchy

VALUES = "id string, score bigint, marks int"


def walk(found):
    """Comments per (post, path) prefix, counted plainly."""
    below = {i: 0 for i in found}
    for root, path in found.values():
        for ancestor in path:
            below[ancestor] += 1
    return below


def check(spark, posts, links, block):
    """Intervals hold exactly what lies below, on the places that ``attach`` finds."""
    found = attach(posts, links)
    rows = ancestry.intervals(posts_frame(spark, posts), comments_frame(spark, links), block).collect()
    assert len(rows) == len(found)
    of = {r.id: r for r in rows}
    sizes = walk(found)
    places = {}
    for i, (root, path) in found.items():
        r = of[i]
        assert (r.root_id, r.ctp_id, r.lvl) == (root, path[0], len(path) - 1)
        assert r.parent_id == (path[-2] if len(path) > 1 else root)
        assert r.leave - r.enter == sizes[i]
        places.setdefault(path[0], []).append(r.enter)
        for ancestor in path:
            a = of[ancestor]
            assert a.ctp_id == r.ctp_id and a.enter <= r.enter < a.leave
    for tree in places.values():
        assert sorted(tree) == list(range(len(tree)))
    return found, of


def random_links(rng, n, spread):
    return [(f"c{i}", rng.choice(["p", "q", "gone"]) if i == 0 or rng.random() < 0.1 else f"c{rng.randrange(max(0, i - spread), i)}") for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, 65_536])
@pytest.mark.parametrize("spread", [2, 200])
def test_random_trees(spark, block, spread):
    links = random_links(random.Random(spread), 200, spread)
    links += [("x", "y"), ("y", "x"), ("z", "x"), ("self", "self"), ("o", "nobody"), ("oo", "o"), ("n", None), (None, "p"), *links[:20]]
    check(spark, ["p", "q"], links, block)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdefghp"), st.sampled_from("abcdefghpq")), max_size=14))
def test_any_links(spark, links):
    """Loops, several parents, ids that are posts and comments."""
    check(spark, ["p", "q"], links, 2)


def test_nothing(spark):
    assert ancestry.intervals(posts_frame(spark, ["p"]), comments_frame(spark, [])).count() == 0
    empty = ancestry.intervals(posts_frame(spark, []), comments_frame(spark, [("a", "p")]))
    values = spark.createDataFrame([("a", 1, 1)], VALUES)
    assert ancestry.subtree_sums(empty, values).count() == 0 and ancestry.path_sums(empty, values).count() == 0
    assert ancestry.prune(empty, 2).count() == 0


@pytest.mark.parametrize("block", [1, 7, 65_536])
def test_sums(spark, block):
    rng = random.Random(block)
    links = random_links(rng, 150, 9) + [(f"h{i}", "c3") for i in range(60)]
    values = [(i, rng.choice([None, -5, 0, 3, 8]), rng.randint(0, 1)) for i, _ in links if rng.random() < 0.8]
    values += [(links[7][0], 100, 1), ("unknown", 1, 1), (None, 1, 1)]
    found = attach(["p", "q"], links)
    numbers = ancestry.intervals(posts_frame(spark, ["p", "q"]), comments_frame(spark, links), block)
    frame = spark.createDataFrame(values, VALUES)
    below, above = {i: [0, 0] for i in found}, {i: [0, 0] for i in found}
    for v, score, mark in values:
        for i, (_, path) in found.items():
            if v in found and i in found[v][1]:
                below[i] = [below[i][0] + (score or 0), below[i][1] + mark]
            if v in path:
                above[i] = [above[i][0] + (score or 0), above[i][1] + mark]
    assert {r.id: [r.score, r.marks] for r in ancestry.subtree_sums(numbers, frame, block).collect()} == below
    assert {r.id: [r.score, r.marks] for r in ancestry.path_sums(numbers, frame, block).collect()} == above
    with pytest.raises(ValueError):
        ancestry.path_sums(numbers, frame.withColumnRenamed("score", "enter"))


@pytest.mark.parametrize("block", [2, 65_536])
def test_prune_equals_the_cut_by_paths(spark, block):
    links = random_links(random.Random(4), 200, 12)
    posts, comments = posts_frame(spark, ["p", "q"]), comments_frame(spark, links)
    by_paths, by_intervals = hierarchy.unroll(posts, comments), ancestry.intervals(posts, comments, block)
    columns = [*ancestry.NODE, "connected"]
    for level in (7, 4, 1):  # each cut works on what the one before left
        by_paths, by_intervals = hierarchy.cascade_prune(by_paths, level), ancestry.prune(by_intervals, level, block)
        assert sorted(map(tuple, by_intervals.select(*columns).collect())) == sorted(map(tuple, by_paths.select(*columns).collect()))


def test_depth_of_ten_thousand(spark):
    """Rows stay of one width: a chain, a leaf beside each tenth comment, and a cut near its end."""
    depth = 10_000
    links = [(f"c{i:05}", f"c{i - 1:05}" if i else "p") for i in range(depth)] + [(f"leaf{i}", f"c{i:05}") for i in range(0, depth, 10)]
    random.Random(2).shuffle(links)
    numbers = ancestry.intervals(posts_frame(spark, ["p"]), comments_frame(spark, links))
    assert {t for _, t in numbers.dtypes} == {"string", "bigint"}
    of = {r.id: r for r in numbers.collect()}
    assert len(of) == len(links) and of["c00000"].leave - of["c00000"].enter == len(links)
    for i in range(0, depth, 997):
        r = of[f"c{i:05}"]
        leaves = len(range(-(-i // 10) * 10, depth, 10))
        assert r.lvl == i and r.leave - r.enter == depth - i + leaves
    left = ancestry.prune(numbers, depth - 1)
    assert left.where(F.col("id").startswith("c")).count() == 0 and left.count() == depth // 10
    assert left.where("connected").count() == 0


def test_prune_sums_up_only_trees_that_reach_the_level(spark, monkeypatch):
    """A level in one of twenty trees costs the sums of that tree only."""
    links = [(f"c{i}", "p") for i in range(20)] + [(f"d{i}", f"c{i}") for i in range(20)] + [("e", "d7"), ("f", "e"), ("d7b", "c7")]
    numbers = ancestry.intervals(posts_frame(spark, ["p"]), comments_frame(spark, links))
    seen, sums = [], ancestry._subtree_sums

    def watched(valued, *rest):
        seen.append(valued.count())
        return sums(valued, *rest)

    monkeypatch.setattr(ancestry, "_subtree_sums", watched)
    left = {r.id: r.connected for r in ancestry.prune(numbers, 2).collect()}
    assert seen == [4]
    wanted = {i: True for i, _ in links if i not in ("c7", "d7", "e", "f", "d7b")}
    assert left == {**wanted, "d7b": False}
    assert ancestry.prune(numbers, 4).count() == len(links) and seen[-1] == 0
