import json
import random

import pytest
from pyspark.sql import functions as F

from forests import COMMENT_SCHEMA, POST_SCHEMA, comments_frame, posts_frame
from replyforest.operators import filters, hierarchy, ranking, sampling, series, stats, threads
from replyforest.plans import study
from replyforest.plans.corpus import Corpus
from replyforest.session import shared_dir
from replyforest.sources import exports

POSTS = [
    ("p", "t", "s", "cats", 1000, "op"),
    ("q", "[removed]", "s", "cats", 999, "op"),
    ("r", "t", "s", "dogs", None, "op"),
    ("e", "t", "s", "dogs", 5000, "op"),
]
COMMENTS = [
    ("a1", "x", 5, "ann", "t3_p"), ("a2", "x", None, "bob", "t1_a1"), ("a3", "x", 1, "ann", "t1_a2"), ("a4", "x", 2, "bob", "t1_a3"),
    ("a9", "[deleted]", 2, "cat", "t1_a1"),
    ("b1", "x", 5, None, "t3_p"), ("b2", "x", -9, "", "t1_b1"), ("b3", "x", -9, "NULL_AUTHOR", "t1_b2"),
    ("c1", "x", 1, "[deleted]", "t3_p"),
    ("d1", "x", 1, "ann", "t3_q"),
    ("f1", "x", 1, "ann", "t3_r"), ("f2", "x", 1, "ann", "t1_f1"),
    ("f2", "x", 1, "ann", "t1_f1"), ("f2", "x", 8, "zed", "t1_f1"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.createDataFrame(POSTS, POST_SCHEMA), spark.createDataFrame(COMMENTS, COMMENT_SCHEMA))


def test_facts(corpus):
    facts = {r.ctp_id: r for r in corpus.facts.collect()}
    assert sorted(facts) == ["a1", "b1", "c1", "d1", "f1"]
    a, b, c, d, f = (facts[k] for k in sorted(facts))
    assert (a.path, a.total_score, a.authors, a.named_authors, a.fewest_comments, a.withdrawn) == (["a1", "a2", "a3", "a4"], 8, 2, 2, 2, False)
    # Null and the marker are one author, empty is another; neither null nor empty is named.
    assert (b.authors, b.named_authors, b.total_score, b.withdrawn) == (2, 1, -13, False)
    assert c.withdrawn and d.withdrawn
    # The repeated comment counts once.
    assert (f.length, f.total_score, f.fewest_comments, f.post_score) == (2, 2, 2, None)


def test_choices(corpus):
    assert {r.ctp_id for r in corpus.clean.collect()} == {"a1", "b1", "f1"}
    assert {r.ctp_id for r in filters.with_authors(corpus.facts, 2).collect()} == {"a1"}
    assert {r.ctp_id for r in filters.with_authors(corpus.facts, 1).collect()} == {"f1"}
    assert {r.ctp_id for r in filters.by_score(corpus.clean, corpus.posts, True).collect()} == {"a1", "b1"}
    assert filters.by_score(corpus.clean, corpus.posts, False).count() == 0
    tags = {(r.family, r.segment, r.ctp_id) for r in filters.segments(corpus.facts, ["dogs"]).collect()}
    assert ("subreddits", "dogs_threads", "f1") in tags and ("participants", "threads_2_authors", "a1") in tags
    assert not {t for t in tags if t[0] == "virality" and t[2] == "f1"}


def test_lookup(corpus):
    rows = {r.posts: r for r in threads.lookup_table(corpus.posts, threads.lookup_long(corpus.nodes), 3).collect()}
    assert rows["p"].comments_to_posts == ["a1", "b1", "c1"] and rows["p"].comments_to_comments_1 == ["a2", "a9", "b2"]
    assert rows["e"].comments_to_posts is None and len(rows) == 4
    shapes = {r.posts: (r.levels, r.widest) for r in stats.lookup_shapes(corpus.posts, stats.level_widths(corpus.nodes)).collect()}
    assert shapes == {"p": (4, 3), "q": (1, 1), "r": (2, 1), "e": (0, 0)}


def test_crowded_level_is_spread(spark):
    posts = posts_frame(spark, ["p"])
    nodes = hierarchy.unroll(posts, comments_frame(spark, [(f"c{i}", "p") for i in range(500)]))
    assert len(threads.lookup_long(nodes).collect()) == 1
    long = threads.lookup_long(nodes, parts=10).collect()
    assert len(long) == 10 and max(len(r.ids) for r in long) < 100
    assert sorted(i for r in long for i in r.ids) == sorted(f"c{i}" for i in range(500))


def test_a_post_that_was_dumped_twice_counts_once(spark):
    once = posts_frame(spark, ["p"]).unionByName(posts_frame(spark, ["q"], subreddit=None))
    twice = once.unionByName(once)
    comments = comments_frame(spark, [("c1", "p"), ("c2", "p"), ("c3", "p"), ("d1", "q")])
    found = {}
    for name, posts in (("once", once), ("twice", twice)):
        c = Corpus(posts, comments)
        shapes = stats.lookup_shapes(posts, stats.level_widths(c.nodes))
        histograms, _ = study.all_histograms(c, study.Settings())
        found[name] = [
            sorted(map(tuple, rows.collect()), key=str)
            for rows in (
                stats.subreddit_distribution(c.threads, posts),
                shapes,
                threads.lookup_table(posts, threads.lookup_long(c.nodes), 1).select("posts", F.array_join("comments_to_posts", ",")),
                histograms.select("stat", "segment", "key", "value"),
            )
        ]
    assert found["once"] == found["twice"]
    assert found["twice"][0] == [("r", 3), (None, 1)] and len(found["twice"][1]) == 2
    # The histograms count threads without a community as the operator does.
    labels = [r for r in found["twice"][3] if r[0] == "subreddit_distribution" and r[1] == "threads"]
    assert sorted((r[2], r[3]) for r in labels if r[2]) == [("r", 3)] and sum(r[3] for r in labels) == 4


def test_random_tie_break_keeps_the_length(corpus):
    rows = threads.all_threads(corpus.nodes)
    lengths = {r.ctp_id: len(r.path) for r in threads.longest_threads(rows).collect()}
    for seed in (1, 2):
        assert {r.ctp_id: len(r.path) for r in threads.longest_threads(rows, seed).collect()} == lengths


def test_counts_add_up(spark, corpus):
    settings = study.Settings()
    rows, families = study.all_histograms(corpus, settings)
    value = {(r.stat, r.segment, r.key): r.value for r in rows.collect()}

    def total(stat, segment, but=()):
        return sum(v for (s, g, k), v in value.items() if (s, g) == (stat, segment) and k not in but)

    clean = corpus.clean.count()
    assert total("thread_lengths", "threads", but=("0",)) == clean == total("author_distribution", "threads")
    assert total("thread_score_distribution", "threads") == clean == value["number_of_threads", "threads", "0"]
    assert total("thread_lengths", "lookup_table") == corpus.posts.count() == total("thread_widths", "lookup_table")
    widths = sum(int(k) * v for (s, g, k), v in value.items() if (s, g) == ("all_widths", "lookup_table"))
    assert widths == corpus.nodes.count() == threads.all_threads(corpus.nodes).count()
    # Levels that no thread of a segment reaches still count 0.
    assert value["depth_distribution", "dogs_threads", "comments_to_comments_3"] == 0
    generic = {r.conversation_length: r.row_count for r in stats.depth_distribution(corpus.clean, corpus.levels).collect()}
    assert generic == {k: v for (s, g, k), v in value.items() if (s, g) == ("depth_distribution", "threads")}
    compared = {(r.family, r.segment) for r in series.compare_segments(rows, families).collect()}
    assert ("virality", "threads") in compared and ("subreddits", "cats_threads") in compared


def expanded(pairs):
    return [k for k, v in pairs for _ in range(max(v, 0))]


def test_quartiles_against_expansion(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for number in range(40):
        keys = sorted(rng.sample(range(-9000, 9000), rng.randint(1, 60)))
        pairs = [(k, rng.choice([0, -2, 1, 2, 7])) for k in keys]
        if not expanded(pairs):
            continue
        rows += [("score", str(number), k, str(k), v) for k, v in pairs]
        data = expanded(pairs)
        n = len(data)
        q1, q3 = data[-(-n // 4) - 1], data[-(-3 * n // 4) - 1]
        middle = data[n // 2] if n % 2 else (data[n // 2 - 1] + data[n // 2]) / 2
        expected[str(number)] = (q1, middle, q3, q3 - q1)
    frame = spark.createDataFrame(rows, "stat string, segment string, ord bigint, key string, value bigint")
    found = {r.segment: (r.q1, r.q2, r.q3, r.iqr) for r in stats.weighted_quartiles(frame).collect()}
    assert found == expected
    averages = {r.segment: r.average for r in stats.weighted_averages(frame).collect()}
    for segment, average in averages.items():
        mine = [(int(k), v) for _, s, _, k, v in rows if s == segment]
        assert average == pytest.approx(sum(k * v for k, v in mine) / (sum(v for _, v in mine) + 1e-4))


def test_label_quartiles(spark):
    rows = [("depth", "a", 0, "posts", 2), ("depth", "a", 1, "top", 2), ("depth", "b", 0, "posts", 3), ("depth", "b", 1, "top", 0)]
    frame = spark.createDataFrame(rows, "stat string, segment string, ord bigint, key string, value bigint")
    found = {r.segment: (r.q1, r.q2, r.q3, r.iqr) for r in stats.weighted_quartiles_labels(frame).collect()}
    assert found == {"a": ("posts", "Median between posts and top", "top", "top - posts"), "b": ("posts", "posts", "posts", "posts - posts")}


def test_positions(spark):
    rows = spark.range(5000).select(F.format_string("k%05d", F.pmod(F.col("id") * 7919, F.lit(5000))).alias("k"))
    found = ranking.numbered(rows, "k").collect()
    assert sorted((r.k, r.position) for r in found) == [(f"k{i:05}", i) for i in range(5000)]
    assert ranking.row_at(rows, 1234, "k").first().k == "k01234"
    assert [r.k for r in ranking.last_rows(rows, 2, "k").collect()] == ["k04999", "k04998"]


def test_positions_within_groups(spark, monkeypatch):
    rows = spark.range(300).select((F.col("id") % 3).alias("g"), F.format_string("k%03d", F.pmod(F.col("id") * 7, F.lit(300))).alias("k"))


    def found():
        places = ranking.numbered_within(rows, 300, "g", F.col("k").desc())
        return sorted(tuple(r) for r in places.select("g", "k", "position").collect())

    small = found()
    monkeypatch.setattr(ranking, "SMALL_ROWS", 10)
    large = found()
    assert small == large and max(p for _, _, p in small) == 99


def test_large_head_is_cut_by_position(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_ROWS", 10)
    assert sorted(r.id for r in ranking.first_rows(spark.range(100), 30, "id").collect()) == list(range(30))


@pytest.mark.parametrize("small", [0, 1000])
def test_seeded_picks(spark, corpus, monkeypatch, small):
    monkeypatch.setattr(ranking, "SMALL_ROWS", small)
    names = sorted(r.ctp_id for r in corpus.threads.collect())
    for seed in (0, 1, 202):
        offset = random.Random(seed).randint(0, len(names) - 1)
        assert sampling.random_thread(corpus.threads, seed).first().ctp_id == names[offset]
    empty = corpus.threads.where(F.lit(False))
    assert sampling.random_thread(empty, 1) is None and sampling.subset_tables(empty) is None
    picks = sampling.subset_tables(corpus.threads).collect()
    assert sorted((r.subset, r.pick) for r in picks) == [(i // 3 + 1, i) for i in range(9)]


def test_metadata_of_unknown_ids_is_null(spark, corpus):
    rows = spark.createDataFrame([(0, "gone", "a1", ["a1", "zz"])], "pick bigint, posts string, ctp_id string, path array<string>")
    full = sampling.with_metadata(rows, corpus.posts, corpus.comments)
    text = json.loads(sampling.as_json(full, 3).first().value)
    assert text["posts"] is None and text["comments_to_comments_1"] is None
    assert text["comments_to_posts"] is None or text["comments_to_posts"]["id"] == "a1"


def test_export_and_rebuild(spark, corpus, tmp_path):
    """Threads go out as CSV samples, come back and unroll to the same threads."""
    from replyforest.sources.tables import load_comments, load_posts
    from replyforest.schemas import COMMENT_FIELDS

    chosen = corpus.clean.select("posts", "ctp_id", "path")
    folders = str(tmp_path / "posts"), str(tmp_path / "comments")
    posts = corpus.posts.select("id", "title", "selftext", "subreddit", "score", F.lit(0.5).alias("upvote_ratio"), F.lit("").alias("media"), "author")
    exports.thread_to_samples(chosen, posts, corpus.comments, *folders)
    again = load_comments(spark, folders[1], corpus.comments.columns).withColumn("parent_id", F.concat(F.lit("t1_"), "parent_id"))
    rebuilt = Corpus(load_posts(spark, folders[0], posts.columns), again)
    assert {(r.ctp_id, tuple(r.path)) for r in rebuilt.threads.collect()} == {(r.ctp_id, tuple(r.path)) for r in chosen.collect()}
    assert again.columns == COMMENT_FIELDS


def test_series(spark):
    rows = [("thread_lengths", "threads", k, str(k), v) for k, v in ((0, -4), (1, 5), (4, 2), (60, 1))]
    rows += [("subreddit_distribution", "threads", 0, "cats", 3)]
    frame = spark.createDataFrame(rows, "stat string, segment string, ord bigint, key string, value bigint")
    dense = {(r.stat, r.x): r.y for r in series.dense_series(frame).collect()}
    assert dense == {("thread_lengths", str(i)): {1: 5, 4: 2}.get(i, 0) for i in range(5)} | {("subreddit_distribution", "cats"): 3}
    single = [(r.x, r.y) for r in series.single_series(frame).collect()]
    assert single == [(1, 5), (4, 2)]
    long = spark.createDataFrame([(0, 200_000)], "low bigint, high bigint")
    assert series._every_key(long).agg(F.count_distinct("x"), F.max("x")).first() == (200_001, 200_000)


def test_study_runs_on_small_input(spark):
    posts = posts_frame(spark, ["p", "q"], score=2000)
    links = [(f"c{i}", "p") for i in range(6)] + [(f"d{i}", f"c{i}") for i in range(4)]
    result = study.run(posts, comments_frame(spark, links), study.Settings(min_rows=1))
    assert {r.table_name: r.row_count for r in result.row_counts.collect()} == {"posts": 2, "comments_to_posts": 6, "comments_to_comments_1": 4}
    averages = {(r.stat, r.segment): r.average for r in result.averages.collect()}
    assert averages["thread_lengths", "threads"] == pytest.approx((-5 * 0 + 2 * 1 + 4 * 2) / (6 + 1e-4))


def test_tables_are_built_again_after_the_folder_was_cleared(spark, monkeypatch):
    from replyforest.plans import queries
    from replyforest.session import exists, remove

    built = []
    monkeypatch.setattr(queries, "_corpora", {})
    for expected in (1, 1, 2):
        if expected == 2:
            remove(spark, queries._corpora[next(iter(queries._corpora))][0])
        queries._once("kind", spark, "folder", lambda: built.append(1))
        assert len(built) == expected
    assert exists(spark, shared_dir(spark))


@pytest.mark.parametrize("kind", ["csv", "jsonl"])
def test_study_from_dumps_to_tables(spark, tmp_path, monkeypatch, kind):
    import csv
    import sys

    from replyforest import __main__ as command
    from replyforest.schemas import RAW_COMMENT_FIELDS, RAW_POST_FIELDS

    posts = [{"id": f"p{i}", "title": "a, title", "subreddit": "cats", "score": i * 900, "author": "op"} for i in range(3)]
    comments = [
        {"id": f"c{i}", "body": "two\nlines", "score": i, "author": f"u{i % 2}", "parent_id": f"t3_p{i % 3}" if i < 6 else f"t1_c{i - 6}"}
        for i in range(12)
    ]
    paths = []
    for name, rows, fields in (("posts", posts, RAW_POST_FIELDS), ("comments", comments, RAW_COMMENT_FIELDS)):
        paths.append(str(tmp_path / name))
        with open(paths[-1], "w", newline="", encoding="utf-8") as file:
            if kind == "csv":
                writer = csv.DictWriter(file, fields, lineterminator="\n")
                writer.writeheader()
                writer.writerows(rows)
            else:
                file.writelines(json.dumps(row) + "\n" for row in rows)
    out = str(tmp_path / "out")
    monkeypatch.setattr(sys, "argv", ["replyforest", *paths, out, "--min-rows", "1", *(["--jsonl"] if kind == "jsonl" else [])])
    command.main()
    counts = {r.table_name: r.row_count for r in spark.read.parquet(f"{out}/row_counts").collect()}
    assert counts == {"posts": 3, "comments_to_posts": 6, "comments_to_comments_1": 6}
    stored = spark.read.parquet(f"{out}/stats").where("stat = 'thread_lengths' AND segment = 'threads'")
    assert {r.key: r.value for r in stored.collect()} == {"0": -3, "1": 0, "2": 6}
    assert spark.read.parquet(f"{out}/threads").columns == ["posts", "comments_to_posts", "comments_to_comments_1"]


def test_study_of_the_first_posts(spark):
    posts = posts_frame(spark, ["p", "q"])
    result = study.run(posts, comments_frame(spark, [("a", "p"), ("b", "q")]), study.Settings(max_posts=1, min_rows=1))
    assert [r.id for r in result.corpus.nodes.collect()] == ["a"]


def test_study_without_comments(spark):
    result = study.run(posts_frame(spark, ["p"]), comments_frame(spark, [("a", "gone")]))
    assert {r.table_name: r.row_count for r in result.row_counts.collect()} == {"posts": 1}
    assert [(r.stat, r.key, r.value) for r in result.histograms.where("stat = 'thread_lengths'").collect()] == [("thread_lengths", "0", 1)]
    assert result.quartiles.count() == 2 and result.label_quartiles.count() == 0


def test_shuffles_grow_with_the_input(spark, tmp_path, monkeypatch):
    from replyforest import session

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "data").write_bytes(b"x" * 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.grow_shuffles(spark, str(tmp_path / "f")) == int(before)
        monkeypatch.setattr(session, "INPUT_PER_PARTITION", 10)
        assert session.grow_shuffles(spark, str(tmp_path / "f")) == 100
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
