import math
from fractions import Fraction

import numpy as np
import pytest

from replyforest.llm import whitening as wh
from replyforest.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


def whole(vector):
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return tuple(math.floor(256 * c) for c in vector)


def plain(rows, components=4):
    """The contract in exact numbers, but for the eigenvectors, which come from the library's solver."""
    x = {}
    for i, v in rows:
        if whole(v) is not None:
            x.setdefault(i, []).append(whole(v))
    fit = sorted({v for some in x.values() for v in some})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values)[:components] if values[k] > 1e-9 * values.max()]
    out = {}
    for i, some in x.items():
        for v in some:
            y = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)])
            deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
            for k, j in enumerate(order, 1):
                out.setdefault((i, k), []).append((n, deviation, y @ axes[:, j] / math.sqrt(values[j]), values[j] / values.sum()))
    return out


def check(spark, rows, **more):
    result = wh.whiten(frame(spark, rows), **more).collect()
    expected, found = plain(rows, more.get("components", 4)), {}
    for r in result:
        assert r.identity_error <= 1e-9
        found.setdefault((r.vec_id, r.component), []).append((r.n, int(r.deviation), r.whitened, r.explained))
    assert set(found) == set(expected)
    sign = {}
    for key, some in expected.items():
        some, ours = sorted(some, key=lambda t: (t[1], abs(t[2]))), sorted(found[key], key=lambda t: (t[1], abs(t[2])))
        assert [t[:2] for t in some] == [t[:2] for t in ours]
        for a, b in zip(some, ours):
            assert b[3] == pytest.approx(a[3], rel=1e-9)
            assert abs(b[2]) == pytest.approx(abs(a[2]), abs=1e-7)
            if abs(a[2]) > 1e-3:
                assert sign.setdefault(key[1], np.sign(a[2] * b[2])) == np.sign(a[2] * b[2])
    return result


@pytest.mark.parametrize("dimensions", [2, 7, 64])
def test_against_exact_numbers(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    spread = np.linspace(3, 0.5, dimensions)
    rows = [(i, (rng.normal(size=dimensions) * spread + 2).tolist()) for i in range(500)]
    check(spark, rows + [(1000 + i, rows[0][1]) for i in range(300)] + [(3, rows[7][1])])


def test_query(spark):
    result = QUERIES["op13_embedding_whitening"](spark, FOLDER)
    assert dict(result.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double",
    }
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    expected = plain(rows)
    got = result.collect()
    assert len(got) == 4 * len([v for _, v in rows if whole(v) is not None])
    for r in got:
        n, deviation, value, explained = expected[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(value), abs=1e-6)


def test_odd_vectors(spark, clash):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    odd = [(90, None), (91, [float("nan")] * 6), (92, [None] + [1.0] * 5), (93, [float("inf")] * 6), (94, [1.0] * 5), (95, []), (96, [1e300] * 6)]
    result = wh.whiten(clash(frame(spark, good + odd + [(None, good[0][1])])))
    found = {r.vec_id for r in result.collect()}
    assert found == {i for i, _ in good} | {None}
    check(spark, good + [(5, [0.0] * 6), (5, [-0.0] * 6)])


def test_few_vectors(spark):
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, None)])).count() == 0
    assert wh.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, -1.0, 3.0])])
    check(spark, [(1, [1.0]), (2, [2.0]), (3, [5.0])])


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * [2e12, 1e11, 1e10] + 3e13).tolist()) for i in range(200)]
    check(spark, rows)
    result = wh.whiten(frame(spark, [(i, [8e15 * i, float(i * i)]) for i in range(5)]))
    assert {r.vec_id: r.deviation is None for r in result.collect()} == {i: i != 2 for i in range(5)}


# ---- the eigenvalue solver


def random_matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("seed", range(5))
def test_inertia(seed):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=rng.integers(1, 30))
    assert wh.inertia(random_matrix(values, seed)) == ((values < 0).sum(), (values > 0).sum())
    assert wh.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1)


CASES = {
    "falling": np.linspace(1, 50, 60),
    "equal at the cut": np.array([9.0, 5, 5, 5, 5, 5, 1, 0.5]),
    "all equal": np.full(12, 3.0),
    "close": np.array([1 + 1e-9 * k for k in range(10)]),
    "far apart": 10.0 ** np.arange(-8, 8),
    "one": np.array([2.0]),
    "many dimensions": np.random.default_rng(1).gamma(2, size=200),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("wanted", [4, 40])
def test_components(name, wanted):
    matrix = random_matrix(CASES[name])
    matrix = (matrix + matrix.T) / 2
    values, vectors = wh.leading_components(matrix, wanted)
    exact = np.sort(CASES[name])[::-1][:wanted]
    exact = exact[exact > 1e-12 * exact[0]]
    assert abs(len(values) - len(exact)) <= (1 if name == "far apart" else 0)
    both = min(len(values), len(exact))
    assert values[:both] == pytest.approx(exact[:both], abs=1e-12 * exact[0] * len(matrix))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * exact[0] * len(matrix)


def test_no_spread():
    assert wh.leading_components(np.zeros((3, 3)), 4)[0].size == 0


def test_intervals_hold_what_they_say():
    values = np.random.default_rng(3).gamma(2, size=80)
    parts = wh.intervals(random_matrix(values), 50)
    assert sum(c for *_, c in parts) >= 50 and max(c for *_, c in parts) <= wh.PER_INTERVAL
    for low, high, count in parts:
        assert ((values > low) & (values < high)).sum() == count
