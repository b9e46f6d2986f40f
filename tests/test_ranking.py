import random

import pytest
from pyspark.sql import functions as F

from plan_texts import executed_plan
from replyforest.operators import ranking


def picked(df, positions, key="k"):
    rows = ranking.rows_at(df, list(enumerate(positions)), key).collect()
    found = {r.pick: r[key] for r in rows}
    assert len(found) == len(rows)
    return [found.get(i) for i in range(len(positions))]


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_picks_by_text(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW", few)
    rng = random.Random(few)
    keys = {"".join(rng.choices("abé\U0001d4b3", k=rng.randint(0, 6))) for _ in range(500)}
    keys |= {"prefix" * 5 + str(i) for i in range(60)} | {"z" * i for i in range(30)} | {"a\x00", "a", "a\x00\x00"}
    ordered = sorted(keys, key=lambda k: k.encode())
    df = spark.createDataFrame([(k, len(k)) for k in rng.sample(ordered, len(ordered))], "k string, n int").repartition(5)
    positions = [0, len(ordered) - 1, 17, 17, *rng.choices(range(len(ordered)), k=40)]
    assert picked(df, positions) == [ordered[p] for p in positions]
    assert picked(df, [len(ordered), 3, 10**12]) == [None, ordered[3], None]


def test_picks_by_number_and_null(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 3)
    keys = [0, -1, 1, 2**63 - 1, -(2**63), 255, 256, -256, *range(1000, 1200)]
    ordered = sorted(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert picked(df, range(len(keys))) == ordered
    with_null = df.unionByName(spark.createDataFrame([(None,)], "k bigint"))
    assert picked(with_null, [1, 2]) == ordered[:2]
    with pytest.raises(TypeError):
        ranking.row_at(df.select(F.col("k").cast("double").alias("k")), 0, "k")


def test_no_range_exchange_and_no_sort_of_all(spark):
    df = spark.range(300_000).select(F.concat(F.lit("t"), "id").alias("k"))
    row = ranking.row_at(df, 250_000, "k")
    assert "rangepartitioning" not in executed_plan(row)
    assert row.first().k == sorted(f"t{i}" for i in range(300_000))[250_000]
    assert ranking.row_at(df.limit(0), 0, "k").count() == 0


def test_ties_are_the_same_rows_for_every_n(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), F.hash("id").alias("v")).repartition(6)
    few = sorted(tuple(r) for r in ranking.first_rows(df, 500, "k").collect())
    monkeypatch.setattr(ranking, "SMALL_ROWS", 10)
    assert sorted(tuple(r) for r in ranking.first_rows(df, 500, "k").collect()) == few
