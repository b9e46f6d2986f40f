import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from replyforest.llm import exact_dedup


def brute(rows):
    plain = [(i, re.sub("[ \t-\r]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in plain:
        groups.setdefault(t, []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain), key=str)


def texts():
    rng = random.Random(3)
    words = ["Ab. ", "cd ", "e! ", "f\t", "\n", "é? ", "x" * 30, " ", " ", "\x0b"]
    some = ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return some + some[:20] + [t.replace(" ", "  ") for t in some[20:40]] + [None, "", " ", "word " * 40_000, "word " * 40_000, "y" * 50_000]


@pytest.mark.parametrize("digest", [exact_dedup.weak_digest, lambda c: F.length(c).cast("bigint") % 3])
def test_groups_of_equal_texts(spark, documents, clash, digest):
    """Also with a digest that many chunks share."""
    rows = list(enumerate(texts()))
    found = exact_dedup.exact_dedup(clash(documents(rows)), shortest=20, longest=90, digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(rows)
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_null_and_repeated_ids(documents):
    rows = [(None, "a b"), (7, "a  b"), (7, "a b"), (3, "c"), (3, "c"), (None, "d"), (None, "d")]
    found = exact_dedup.exact_dedup(documents(rows)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found) == [
        ("3", "3", 2), ("3", "3", 2), ("7", "7", 3), ("7", "7", 3), ("None", "7", 3), ("None", "None", 2), ("None", "None", 2),
    ]
    assert sum(r.kept for r in found) == 3
    stay = exact_dedup.drop_copies(documents(rows)).collect()
    assert sorted((str(r.doc_id), re.sub(" +", " ", r.text)) for r in stay) == [("3", "c"), ("7", "a b"), ("None", "d")]


def test_copies_go_and_columns_stay(spark, documents, clash):
    rows = clash(documents(["a", "b", "a", None, ""]))
    stay = exact_dedup.drop_copies(rows)
    assert stay.columns == rows.columns and sorted(r.doc_id for r in stay.collect()) == [0, 1, 3]


def test_empty_table(documents):
    assert exact_dedup.exact_dedup(documents([])).count() == 0 and exact_dedup.drop_copies(documents([])).count() == 0


def test_a_long_group_of_copies_is_no_join_of_pairs(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.exact_dedup(rows)
    assert found.where("group_size > 1").count() == 6667 == found.agg(F.max("group_size")).first()[0]
