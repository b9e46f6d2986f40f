import os

import pytest

from replyforest.operators import sampling
from replyforest.plans import queries
from replyforest.session import stage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def uneven(spark):
    """Forty rows in partitions of 1 to 25 rows, read from files."""
    rows = spark.range(25).repartition(1)
    for start, end in ((25, 26), (26, 40)):
        rows = rows.union(spark.range(start, end).repartition(1))
    return stage(rows.selectExpr("id", "id AS pick_", "cast(null AS string) AS part"))


def test_every_row_is_as_likely(uneven):
    n = 40_000
    picked = sampling.sample_by_partitions(uneven, n, 3)
    assert picked.columns == ["pick", *uneven.columns]
    rows = picked.collect()
    assert sorted(r.pick for r in rows) == list(range(n))
    times = [0] * 40
    for r in rows:
        times[r.id] += 1
    # 39 degrees of freedom; a value above 73 has a probability of about 0.001.
    assert sum((t - n / 40) ** 2 / (n / 40) for t in times) < 73


def test_a_seed_stands_for_the_same_rows(uneven):
    draw = lambda seed: sorted((r.pick, r.id) for r in sampling.sample_by_partitions(uneven, 500, seed).collect())
    assert draw(1) == draw(1) != draw(2)


def test_picks_in_pieces(uneven, monkeypatch):
    whole = sorted((r.pick, r.id) for r in sampling.sample_by_partitions(uneven, 300, 9).collect())
    monkeypatch.setattr(sampling, "PICKS_PER_PIECE", 7)
    assert sorted((r.pick, r.id) for r in sampling.sample_by_partitions(uneven, 300, 9).collect()) == whole


def test_no_rows_and_no_picks(spark, uneven):
    assert sampling.sample_by_partitions(stage(spark.range(0)), 5, 1) is None
    assert sampling.sample_by_partitions(uneven, 0, 1).count() == 0


def test_rows_are_not_sorted_or_shuffled(uneven):
    picked = sampling.sample_by_partitions(uneven, 10, 1)
    picked.collect()
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan and "Sort " not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_threads_drawn(spark):
    stored = queries.corpus(spark, FOLDER).threads
    known = {(r.posts, r.ctp_id, tuple(r.path)) for r in stored.collect()}
    rows = sampling.sample_by_partitions(stored, len(known), 42).collect()
    assert sorted(r.pick for r in rows) == list(range(len(known)))
    assert {(r.posts, r.ctp_id, tuple(r.path)) for r in rows} <= known
