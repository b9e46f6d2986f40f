import random

import numpy as np
import pytest

from replyforest.llm import quality


def prose(rng):
    return " ".join(rng.choice(["the", "tion", "and", "here", "other", "of"]) + rng.choice(["", ".", ","]) for _ in range(rng.randint(20, 300)))


def junk(rng):
    return rng.choice([prose(rng).upper().replace(" ", "!! "), prose(rng).replace(" ", "$$$ "), "same same " * 100])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, (junk if i % 4 == 0 else prose)(rng), int(i % 4 != 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id bigint, quality int, toxic int")
    return docs, labels, dict((i, q) for i, _, q in rows)


def test_held_out_documents_are_told_apart(labelled):
    docs, labels, truth = labelled
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert 80 < len(held) < 250 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    again = quality.score(docs.repartition(7), quality.learn(docs.repartition(5), labels)).collect()
    assert {r.doc_id: round(r.score, 6) for r in rows} == {r.doc_id: round(r.score, 6) for r in again}
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_held_out_labels_are_not_used(labelled):
    from pyspark.sql import functions as F

    from replyforest.llm.common import crc32_of_id

    docs, labels, _ = labelled
    held = crc32_of_id(F.col("doc_id")) % 4 == 2
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(docs, labels), quality.learn(docs, wrong)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_odd_rows(spark, documents, clash, labelled):
    model = quality.learn(*labelled[:2])
    rows = quality.score(clash(documents([(None, "a"), (1, None), (1, ""), (2, "x" * 300_000), (3, "é")])), model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and not [r for r in rows if r.doc_id is None and r.held_out]
    assert quality.score(documents([]), model).count() == 0 and quality.keep_good(documents([]), model).count() == 0


def test_labels_of_one_kind_or_none(spark, documents):
    docs = documents(["a", "b"])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int")
    assert quality.learn(docs, labels([])).value == 1.0
    assert quality.learn(docs, labels([(0, 0), (None, 1), (1, None)])).value == 0.0
    assert quality.learn(docs, labels([(77, 0), (78, 1)])).value == 1.0


def test_the_whole_text_counts():
    x, counts = quality.encode_passages(["a" * 100_000 + "!!" * 300, "", None, "é" * 10])
    assert counts.tolist() == [196, 1, 1, 1] and x[:196, quality.KINDS[ord("!")]].sum() > 0.9
    assert abs((x[:196, -1] * quality.PASSAGE).sum() - 100_600) < 10
    assert quality.encode_passages([])[0].shape == (0, quality.FEATURES)


def test_gradient():
    rng = np.random.default_rng(0)
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    x, counts = rng.normal(size=(9, quality.FEATURES)), np.array([2, 4, 3])
    label, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 0.5, 2.0])

    def loss():
        y = model.forward(x, counts)["y"]
        fit = -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).mean()
        return fit + quality.DECAY / 2 * ((model.p["W"] ** 2).sum() + (model.p["c"] ** 2).sum())

    for k, g in model.gradient(x, counts, label, weight).items():
        at = tuple(rng.integers(0, n) for n in model.p[k].shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-5
        up = loss()
        model.p[k][at] = old - 1e-5
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k
