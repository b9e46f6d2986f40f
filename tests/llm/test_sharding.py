import random
import zlib

import pytest
from pyspark.sql import functions as F

from replyforest.llm import sharding


def check(rows, texts):
    assert len(rows) == len(texts)
    slots, bytes_of = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        bytes_of[r.shard] = bytes_of.get(r.shard, 0) + r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return bytes_of


def docs_of(spark, texts, source=lambda i: f"src{i % 20}"):
    rows = [(i, t, "en" if i % 3 else None, source(i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)


def test_bytes_are_nearly_equal_and_copies_together(spark, clash):
    rng = random.Random(2)
    texts = ["é" * rng.randint(0, 200) + str(i) for i in range(4000)] + ["copy"] * 900 + [None, ""]
    rows = sharding.shard(clash(docs_of(spark, texts, lambda i: "hot" if i % 3 else f"src{i % 20}"))).collect()
    sizes = check(rows, texts)
    assert len(sizes) == 16 and max(sizes.values()) <= 1.03 * min(sizes.values())
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body)
    assert len({r.shard for r in rows if texts[r.doc_id] == "copy"}) == 1


def test_a_group_of_a_third_has_a_shard_of_its_own(spark):
    texts = ["long copy " * 20] * 1000 + [f"{i} " * 100 for i in range(900)]
    rows = sharding.shard(docs_of(spark, texts)).collect()
    sizes = check(rows, texts)
    hot = next(r.shard for r in rows if r.doc_id == 0)
    rest = [n for shard, n in sizes.items() if shard != hot]
    assert len(rest) == 15 and max(rest) <= 1.1 * min(rest)


@pytest.mark.parametrize("texts", [[], ["a"], [None] * 3, ["x", "y", "z" * 100_000]])
def test_small_tables(spark, texts):
    check(sharding.shard(docs_of(spark, texts)).collect(), texts)


def test_repeated_rows_and_null_ids(spark):
    rows = docs_of(spark, ["a", "b"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    found = sharding.shard(rows.unionByName(rows)).collect()
    assert len(found) == 4 and len({(r.shard, r.slot) for r in found}) == 4
