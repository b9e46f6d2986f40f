import re

import pytest

from plan_texts import executed_plan
from replyforest import fixtures
from replyforest.operators import filters, hierarchy, threads
from replyforest.session import stage
from replyforest.sources import layout

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    posts, comments = fixtures.forest(spark, FOLDER)
    folder = str(tmp_path_factory.mktemp("layout"))
    tables = layout.store_corpus(posts, comments, folder, "laid_out", 8)
    picked = stage(threads.longest_threads(threads.all_threads(hierarchy.unroll(posts, comments))), "threads")
    yield posts, comments, tables, picked, folder
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS laid_out_{name}")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def above_scan(plan, table):
    """The operators between the scan of a table and the join that it goes into, from below."""
    lines = [re.match(r"([ :]*)[+:]- (.*)", line) for line in plan.split("== Initial Plan ==")[0].split("\n")]
    lines = [(len(m.group(1)), m.group(2)) for m in lines if m]
    place = next(i for i, (_, text) in enumerate(lines) if "Scan" in text and table in text)
    depth, found = lines[place][0], []
    for above, text in reversed(lines[:place]):
        if above < depth:
            depth = above
            found.append(text.split("[")[0])
            if "Join" in text:
                return found
    raise AssertionError(plan)


def same(left, right):
    return sorted(map(repr, left.collect())) == sorted(map(repr, right.collect()))


def test_scores_without_an_exchange_of_the_comments(stored, no_broadcast):
    posts, comments, tables, picked, _ = stored
    facts = threads.thread_facts(picked, posts, tables["comment_facts"])
    plain = threads.thread_facts(picked, posts, comments)
    assert same(facts, plain)
    scores = facts.select("ctp_id", "length", "total_score")
    clean = filters.without_withdrawn(facts)
    for frame in (scores, clean):
        between = above_scan(executed_plan(frame), "laid_out_comment_facts")
        assert between and not [name for name in between if "Exchange" in name or "Aggregate" in name or "Shuffle" in name], between


def test_a_lookup_opens_one_bucket(stored):
    _, comments, tables, _, _ = stored
    one = comments.first()
    found = layout.look_up(tables["comments"], "id", one.id)
    assert found.rdd.getNumPartitions() == 1 < tables["comments"].rdd.getNumPartitions()
    assert same(found, comments.where(comments.id == one.id))
    assert layout.look_up(tables["posts"], "id", "nothing").count() == 0


def test_another_application_reads_it_in_place(spark, stored):
    _, comments, tables, _, folder = stored
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables["comments"].schema)
    again = layout.attach(spark, layout.Layout("laid_out_again", f"{folder}/comments", ("id",), 8), schema)
    assert same(again, comments) and layout.look_up(again, "id", "e101").rdd.getNumPartitions() == 1
    spark.sql("DROP TABLE laid_out_again")
    assert tables["comments"].count() == comments.count()


def test_buckets_by_size(spark):
    gb, least = 1024**3, int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [layout.buckets_for(spark, n) for n in (0, 1, gb, 100 * gb, 100 * gb + 1, 10**17)] == [least, least, least, 100, 101, layout.MOST_BUCKETS]
