import random

import numpy as np
import pytest

from replyforest.llm import neighbours as nn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


def exact(rows, k=20):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in usable:
        if q % 20 == 0:
            others = sorted(((float((a * b).sum()), i) for i, b in usable if i != q), key=lambda s: (-s[0], s[1]))
            out[q] = others[:k]
    return out


def recall(spark, rows, k=20):
    vectors = frame(spark, rows)
    found = {}
    for r in nn.nearest(vectors, vectors["vec_id"] % 20 == 0, k=k).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    truth = exact(rows, k)
    assert set(found) == {q for q, others in truth.items() if others}
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, len(truth[q]) + 1))
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        hits += len({i for _, i, _ in near} & {i for _, i in truth[q]})
    return hits / max(1, sum(map(len, truth.values())))


@pytest.mark.parametrize("dimensions", [64, 7])
def test_recall(spark, dimensions):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=dimensions) * rng.choice([0.1, 1, 30])).tolist()) for i in range(3000)]
    assert recall(spark, rows) >= 0.97


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn, "VECTORS", 200)
    monkeypatch.setattr(nn, "QUERIES", 10)
    rng = np.random.default_rng(4)
    assert recall(spark, [(i, rng.normal(size=32).tolist()) for i in range(1500)]) >= 0.97


def test_ties_go_to_the_smaller_id(spark):
    one = [1.0] + [0.0] * 15
    rows = [(i, one) for i in range(400)] + [(1000 + i, np.eye(16)[i % 16].tolist()) for i in range(40)]
    vectors = frame(spark, rows)
    found = [r for r in nn.nearest(vectors, vectors["vec_id"] % 20 == 0).collect() if r.query_id == 20]
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == list(range(20)) and {r.score for r in found} == {1.0}


def test_odd_vectors(spark):
    rng = random.Random(1)
    good = [(i, [rng.random() - 0.5 for _ in range(8)]) for i in range(1, 60)]
    odd = [(None, [1.0] * 8), (0, None), (80, [0.0] * 8), (100, [float("nan")] * 8), (120, [None] + [1.0] * 7), (140, [float("inf")] * 8), (160, [1.0] * 5), (180, [])]
    vectors = frame(spark, good + odd)
    found = nn.nearest(vectors, vectors["vec_id"] % 20 == 0).collect()
    assert {r.query_id for r in found} == {20, 40} and {r.vec_id for r in found} <= set(range(1, 60))


def test_few_candidates_and_empty_tables(spark):
    vectors = frame(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0])])
    rows = nn.nearest(vectors, vectors["vec_id"] % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(rows)] == [(0, 1, 1, 4.0), (0, 2, 2, -1.0)]
    empty = frame(spark, [])
    assert nn.nearest(empty, empty["vec_id"] % 20 == 0).count() == 0


@pytest.mark.parametrize("factor", [1e-200, 1e100, 1.0])
def test_queries_of_any_size(spark, factor):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * (factor if i == 0 else 1)).tolist()) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {r.rank: r.vec_id for r in nn.nearest(vectors, vectors["vec_id"] == 0).collect()}
    query = np.array(rows[0][1])
    truth = sorted((-float((query * np.array(v)).sum()), i) for i, v in rows[1:])
    assert [found[n + 1] for n in range(20)] == [i for _, i in truth[:20]]
