"""One query per operator, on the discussions derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyforest import fixtures
from replyforest.functions import expressions as x
from replyforest.operators import ancestry, explore, filters, hierarchy, increments, ranking, sampling, series, stats, threads
from replyforest.plans import study
from replyforest.plans.corpus import Corpus
from replyforest.schemas import COMMENT_FIELDS, POST_FIELDS, RAW_COMMENT_FIELDS, RAW_POST_FIELDS, level_name
from replyforest.session import exists, grow_shuffles, mark, scratch_path, stage
from replyforest.sources import exports, jsonl, tables
from replyforest.sources import stats_store as store
from replyforest.streaming import counts, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LEVELS = 19  # id columns of the wide tables; a tree of the forest has at most 19 comments

_corpora: dict[tuple, tuple[str, object]] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _once(kind: str, spark: SparkSession, sf_dir: str, make: Callable[[], object]):
    """Tables are built once per session, as a database would keep them, and again if
    the shared folder was cleared."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _corpora or not exists(spark, _corpora[key][0]):
        _corpora[key] = (mark(spark), make())
    return _corpora[key][1]


def forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Posts and comments, with shuffles sized to the table they come from."""
    _once("shuffles", spark, sf_dir, lambda: grow_shuffles(spark, f"{sf_dir}/events.parquet"))
    return fixtures.forest(spark, sf_dir)


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _once("chain shuffles", spark, sf_dir, lambda: grow_shuffles(spark, f"{sf_dir}/conversations.parquet"))
    return fixtures.chains(spark, sf_dir)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return _once("forest", spark, sf_dir, lambda: Corpus(*forest(spark, sf_dir)))


def cut_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return _once("cut", spark, sf_dir, lambda: corpus(spark, sf_dir).cut_short_levels().cut_sparse_levels())


def chain_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return _once("chains", spark, sf_dir, lambda: Corpus(*chains(spark, sf_dir)))


def histograms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _once(
        "histograms", spark, sf_dir, lambda: study.all_histograms(corpus(spark, sf_dir), study.Settings())
    )


def wide_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus for tables with ``LEVELS`` columns, which must hold all of its levels."""
    c = corpus(spark, sf_dir)
    if c.levels > LEVELS:
        raise ValueError(f"{c.levels} levels do not fit in {LEVELS} columns")
    return c


def _path_text(column: str = "path"):
    return F.array_join(column, ">").alias("path")


def _thread_rows(rows: DataFrame) -> DataFrame:
    return rows.select("posts", "ctp_id", _path_text())


def _node_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "parent_id", "root_id", "ctp_id", "lvl", _path_text())


# --- sources and sinks ------------------------------------------------------------


def _raw_posts(posts: DataFrame) -> DataFrame:
    """Posts with the fields of a raw dump; media is a nested object."""
    return posts.select(
        (F.col("score") + 1588291200).alias("created_utc"),
        "id",
        F.concat(F.lit("t3_"), "id").alias("name"),
        "title",
        "selftext",
        "subreddit",
        "score",
        ((F.col("score") % 100) / 100).alias("upvote_ratio"),
        F.lit(0).cast("bigint").alias("num_comments"),
        (F.col("score") % 2 == 0).alias("archived"),
        "author",
        F.lit(None).cast("string").alias("distinguished"),
        F.when(F.col("score") % 3 == 0, F.struct(F.col("subreddit").alias("type"), F.col("score").alias("size"))).alias("media"),
    )


def _raw_comments(comments: DataFrame) -> DataFrame:
    return comments.select(
        (F.col("score") + 1588291200).alias("created_utc"),
        "id",
        "body",
        "score",
        (F.col("score") % 2).alias("controversiality"),
        "author",
        "parent_id",
    )


def _post_values(posts: DataFrame) -> DataFrame:
    """Raw posts as the readers should give them back."""
    return posts.select(*[x.typed(f).alias(f) for f in RAW_POST_FIELDS])


def _write_lines(records: DataFrame, path: str, broken: bool = False) -> str:
    """JSON lines in id order; ``broken`` adds malformed copies of every line.

    Records are put in order before their lines are made, so that copies are neither sampled nor shuffled.
    """
    ordered = records.repartitionByRange("id")
    lines = ordered.select("id", F.to_json(F.struct(*records.columns)).alias("value"))
    if broken:
        cut = F.expr("left(value, length(value) - 3)")
        twice = F.concat("value", "value")
        trailing = F.concat("value", F.lit(" xyz"))
        quoted = F.concat(F.lit("{'id':'"), "id", F.lit("'}"))
        lines = lines.select("id", F.explode(F.array("value", cut, twice, trailing, quoted)).alias("value"))
    lines.sortWithinPartitions("id", "value").select("value").write.mode("append").text(path)
    return path


def _write_csv(rows: DataFrame, path: str) -> str:
    tables.write_csv(rows, path)
    return path


@query
def jsonl_head(spark, sf_dir):
    path = _write_lines(_raw_posts(corpus(spark, sf_dir).posts), scratch_path(spark, "posts-jsonl"))
    return _post_values(jsonl.jsonl_head(spark, path, RAW_POST_FIELDS, 200))


@query
def jsonl_columns(spark, sf_dir):
    path = _write_lines(_raw_posts(corpus(spark, sf_dir).posts), scratch_path(spark, "posts-jsonl"), broken=True)
    return _post_values(jsonl.jsonl_columns(spark, path, RAW_POST_FIELDS))


@query
def ingest_resumable(spark, sf_dir):
    """Two runs of the stream: the second takes only the files that were added."""
    posts = _raw_posts(corpus(spark, sf_dir).posts)
    source, target, checkpoint = (scratch_path(spark, name) for name in ("source", "target", "checkpoint"))
    viral = F.col("score") >= filters.VIRAL_SCORE
    for part in (posts.where(viral), posts.where(~viral)):
        _write_lines(part, source, broken=True)
        ingest.ingest_resumable(spark, source, target, checkpoint, RAW_POST_FIELDS).awaitTermination()
    return _post_values(spark.read.parquet(target))


@query
def ingest_statistics(spark, sf_dir):
    """Posts per community and per author, kept up over two runs of the ingest."""
    posts = _raw_posts(corpus(spark, sf_dir).posts)
    source, target, checkpoint = (scratch_path(spark, name) for name in ("source", "counts", "checkpoint"))
    keys = {"subreddit": F.col("subreddit"), "author": F.col("author")}
    viral = F.col("score") >= filters.VIRAL_SCORE
    for part in (posts.where(viral), posts.where(~viral)):
        _write_lines(part, source, broken=True)
        counts.ingest_and_count(spark, source, target, checkpoint, RAW_POST_FIELDS, keys).awaitTermination()
    return counts.as_stats(counts.counted(spark, target))


@query
def ingest_after_id(spark, sf_dir):
    path = _write_lines(_raw_comments(corpus(spark, sf_dir).comments), scratch_path(spark, "comments-jsonl"), broken=True)
    target = scratch_path(spark, "comments-csv")
    written = tables.append_csv(jsonl.ingest_after_id(spark, path, RAW_COMMENT_FIELDS, "e105"), target)
    return (
        tables.csv_text(spark, target, RAW_COMMENT_FIELDS)
        .select(*[x.typed(f).alias(f) for f in RAW_COMMENT_FIELDS])
        .withColumn("written", F.lit(written).cast("bigint"))
    )


def _csv_posts(spark, sf_dir) -> str:
    """Posts as CSV; copies of all rows that are short, too long or have a wrong score are added."""
    posts = _raw_posts(corpus(spark, sf_dir).posts).select(*POST_FIELDS).withColumn("media", F.to_json("media"))
    path = _write_csv(posts, scratch_path(spark, "posts-csv"))
    _write_csv(posts.select(F.concat(F.lit("short_"), "id").alias("id"), "title"), path)
    _write_csv(posts.withColumn("author", F.lit("someone")).withColumn("more", F.lit("too long")), path)
    _write_csv(posts.withColumn("score", F.lit("none")), path)
    return path


@query
def csv_tolerant_scan(spark, sf_dir):
    return tables.csv_tolerant_scan(spark, _csv_posts(spark, sf_dir), POST_FIELDS).fillna(-1)


@query
def load_posts(spark, sf_dir):
    rows = tables.load_posts(spark, _csv_posts(spark, sf_dir), POST_FIELDS)
    return tables.overwrite(rows, scratch_path(spark, "posts")).fillna(-1)


@query
def csv_string_scan_cast(spark, sf_dir):
    path = _write_csv(corpus(spark, sf_dir).comments.select(*COMMENT_FIELDS), scratch_path(spark, "comments-csv"))
    return tables.append(tables.load_comments(spark, path, COMMENT_FIELDS), scratch_path(spark, "comments"))


@query
def csv_head_scan(spark, sf_dir):
    rows = corpus(spark, sf_dir).comments.select(*COMMENT_FIELDS)
    path = _write_csv(rows.repartitionByRange("id").sortWithinPartitions("id"), scratch_path(spark, "comments-csv"))
    return tables.csv_head(spark, path, COMMENT_FIELDS, 500)


@query
def table_overwrite(spark, sf_dir):
    """The threads table, then its clean version in the same place."""
    c, path = corpus(spark, sf_dir), scratch_path(spark, "threads")
    tables.overwrite(c.threads, path)
    return _thread_rows(tables.overwrite(c.clean.select("posts", "ctp_id", "path"), path))


@query
def table_append(spark, sf_dir):
    c, path = corpus(spark, sf_dir), scratch_path(spark, "threads")
    tables.append(filters.by_score(c.threads, c.posts, viral=True), path)
    return _thread_rows(tables.append(filters.by_score(c.threads, c.posts, viral=False), path))


@query
def delete_matching(spark, sf_dir):
    """Comments that answer no post."""
    c = corpus(spark, sf_dir)
    keys = c.posts.select(F.col("id").alias("parent_id"))
    return tables.delete_matching(hierarchy.stripped(c.comments), keys, ["parent_id"]).select("id", "parent_id", "score")


@query
def stats_store(spark, sf_dir):
    """Stores wrong counts for one segment, then all histograms over them, and reads the store."""
    rows, _ = histograms(spark, sf_dir)
    path = scratch_path(spark, "stats")
    store.save(rows.where(F.col("segment") == "threads").withColumn("value", F.lit(-1).cast("bigint")), path)
    store.save(rows, path)
    return store.load(spark, path).select("stat", "segment", "ord", "key", "value")


@query
def stats_store_json(spark, sf_dir):
    """The JSON form of the store, read back entry by entry."""
    rows, _ = histograms(spark, sf_dir)
    path = scratch_path(spark, "stats-json")
    store.export_json(rows, path)
    entry = F.from_json("value", "name string, ord bigint, key string, value bigint")
    return spark.read.text(path).select(entry.alias("entry")).select("entry.name", "entry.key", "entry.value")


@query
def threads_jsonl_export(spark, sf_dir):
    """Random threads written as JSON lines, read back with a few values of each."""
    c, path = corpus(spark, sf_dir), scratch_path(spark, "threads-jsonl")
    exports.threads_jsonl_export(c.threads, c.posts, c.comments, path, c.levels, n=100, seed=7)
    comment = "struct<id:string,score:bigint>"
    fields = ",".join(f"{level_name(i)}:{comment}" for i in range(c.levels))
    row = F.from_json("value", f"struct<posts:struct<id:string,title:string>,{fields}>")
    comments = F.array(*[F.col(f"row.{level_name(i)}") for i in range(c.levels)])
    found = F.filter(comments, lambda one: one.isNotNull())
    return spark.read.text(path).select(row.alias("row")).select(
        F.col("row.posts.title").alias("title"),
        F.array_join(F.transform(found, lambda one: one["id"]), ">").alias("path"),
        F.aggregate(found, F.lit(0).cast("bigint"), lambda total, one: total + one["score"]).alias("score"),
    )


@query
def thread_to_samples(spark, sf_dir):
    """The rows behind all clean threads as two CSV folders, read back together."""
    c = corpus(spark, sf_dir)
    to_posts, to_comments = scratch_path(spark, "posts-samples"), scratch_path(spark, "comments-samples")
    exports.thread_to_samples(c.clean.select("posts", "ctp_id", "path"), c.posts, c.comments, to_posts, to_comments)
    no_parent = F.lit(None).cast("string").alias("parent_id")
    of_posts = tables.csv_text(spark, to_posts, c.posts.columns)
    of_posts = of_posts.select("id", no_parent, "score", "author", "title", F.col("selftext").alias("body"))
    no_title = F.lit(None).cast("string").alias("title")
    of_comments = tables.csv_text(spark, to_comments, c.comments.columns).select("id", "parent_id", "score", "author", no_title, "body")
    return of_posts.unionByName(of_comments).withColumn("score", F.col("score").cast("bigint"))


# --- projections, filters, scalar expressions -------------------------------------


@query
def project_columns(spark, sf_dir):
    return corpus(spark, sf_dir).posts.select("id", "subreddit", "score")


@query
def strip_parent_prefix(spark, sf_dir):
    return corpus(spark, sf_dir).comments.select("id", x.strip_prefix(F.col("parent_id")).alias("parent_id"))


@query
def parent_type_prefix(spark, sf_dir):
    return explore.with_parent_parts(corpus(spark, sf_dir).comments).select("id", "post_id", "prefix")


@query
def filter_subreddit(spark, sf_dir):
    return corpus(spark, sf_dir).posts.where(F.col("subreddit") == "sub3").select("id")


@query
def filter_by_score(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = c.clean.select(filters.virality(F.col("post_score")).alias("segment"), "posts", "ctp_id")
    return rows.where(F.col("segment").isNotNull())


@query
def deleted_flag(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.posts.select("id", x.post_withdrawn().alias("withdrawn")).unionByName(
        c.comments.select("id", x.comment_withdrawn().alias("withdrawn"))
    )


@query
def withdrawn_ids(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return filters.withdrawn_ids(c.posts, c.nodes, c.comments)


@query
def non_null_filter(spark, sf_dir):
    return corpus(spark, sf_dir).comments.where(F.col("author").isNotNull()).select("id", "author")


@query
def thread_length(spark, sf_dir):
    """Non-null ids of every wide thread, with and without the post."""
    c = wide_corpus(spark, sf_dir)
    wide = threads.widen(threads.all_threads(c.nodes).withColumn("leaf", F.element_at("path", -1)), LEVELS)
    ids = [F.col(name) for name in wide.columns]
    return wide.select(
        "posts",
        level_name(0),
        x.non_null_count(*ids).alias("thread_length"),
        x.non_null_count(*ids[1:]).alias("comments"),
    )


@query
def null_default(spark, sf_dir):
    return corpus(spark, sf_dir).comments.select(
        "id", x.score_or_zero(F.col("score")).alias("score"), x.author_or_marker(F.col("author")).alias("author")
    )


@query
def pad_levels(spark, sf_dir):
    c = wide_corpus(spark, sf_dir)
    return threads.widen(threads.all_threads(c.nodes), LEVELS)


@query
def like_filter(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return stats.row_counts(c.posts, c.nodes).where(F.col("table_name").like("comments_%")).select("table_name", "row_count")


@query
def typed_cast(spark, sf_dir):
    """Scores through text and back, and texts that are no numbers."""
    c = corpus(spark, sf_dir)
    return c.comments.select(
        "id",
        F.col("score").cast("string").cast("int").alias("score"),
        F.coalesce(F.col("body").try_cast("int"), F.lit(-1)).alias("body_number"),
        F.col("score").cast("double").alias("score_double"),
    )


@query
def array_length(spark, sf_dir):
    c = corpus(spark, sf_dir)
    parts = threads.lookup_long(c.nodes, parts=3)
    return parts.groupBy("posts", "lvl").agg(F.sum(F.size("ids")).alias("width"))


@query
def parse_list_string(spark, sf_dir):
    c = corpus(spark, sf_dir)
    text = F.concat(F.lit("['"), F.array_join("ids", "', '"), F.lit("']"))
    parsed = threads.lookup_long(c.nodes).select("posts", "lvl", x.parse_text_list(text).alias("ids"))
    return parsed.select("posts", "lvl", F.size("ids").cast("bigint").alias("width"), F.array_join("ids", ",").alias("ids"))


@query
def json_parse(spark, sf_dir):
    """The number inside the JSON text of the posts."""
    body = F.from_json("selftext", "struct<k:bigint>")
    return corpus(spark, sf_dir).posts.select("id", body["k"].alias("k"))


@query
def json_write(spark, sf_dir):
    return corpus(spark, sf_dir).posts.select("id", F.to_json(F.struct("id", "subreddit", "score")).alias("record"))


@query
def regex_level(spark, sf_dir):
    c = corpus(spark, sf_dir)
    depth = stats.depth_of_all_threads(c.nodes, c.levels)
    level = F.coalesce(x.level_of_name(F.col("conversation_length")), F.lit(-1))
    return depth.select("conversation_length", level.alias("lvl"), "row_count")


@query
def clamp_negative(spark, sf_dir):
    c = corpus(spark, sf_dir)
    lengths = stats.thread_lengths(stats.depth_distribution(c.threads, c.levels))
    return lengths.select("length", x.clamp_negative(F.col("threads")).alias("threads"))


@query
def range_filter(spark, sf_dir):
    return corpus(spark, sf_dir).comments.where(F.col("score").between(-10, 30)).select("id", "score")


@query
def random_value(spark, sf_dir):
    """Random tie-break: which thread wins is random, how long it is is not."""
    c = corpus(spark, sf_dir)
    longest = threads.longest_threads(threads.all_threads(c.nodes), seed=11)
    return longest.select("ctp_id", F.size("path").cast("bigint").alias("length"))


# --- joins and hierarchy ----------------------------------------------------------


@query
def comments_to_posts(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return hierarchy.answers_to(hierarchy.stripped(c.comments), c.posts).select(*COMMENT_FIELDS)


@query
def comments_level_1(spark, sf_dir):
    c = corpus(spark, sf_dir)
    comments = hierarchy.stripped(c.comments)
    top = hierarchy.answers_to(comments, c.posts)
    return hierarchy.answers_to(comments, top).select(*COMMENT_FIELDS)


@query
def unroll_levels(spark, sf_dir):
    return _node_rows(hierarchy.unroll(*forest(spark, sf_dir)))


@query
def unroll_increments(spark, sf_dir):
    """A forest that is stored and takes in the rest in two steps."""
    posts, comments = forest(spark, sf_dir)
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    parts = [(posts.where(part == i), comments.where(part == i)) for i in range(3)]
    path = scratch_path(spark, "forest")
    increments.save(increments.start(*parts[0]), path)
    grown = increments.load(spark, path)
    for new_posts, new_comments in parts[1:]:
        grown = increments.grow(grown, new_posts, new_comments)
    return _node_rows(grown.nodes)


@query
def unroll_levels_chains(spark, sf_dir):
    return _node_rows(hierarchy.unroll(*chains(spark, sf_dir)))


@query
def unroll_levels_min_rows(spark, sf_dir):
    posts, comments = forest(spark, sf_dir)
    cut = Corpus(posts, comments, hierarchy.unroll(posts, comments, min_rows=100)).cut_short_levels(100)
    return cut.nodes.select("id", "parent_id", "root_id", "ctp_id", "lvl", "connected")


@query
def consume_matched(spark, sf_dir):
    """Comments that are left once the first two levels are taken out."""
    c = corpus(spark, sf_dir)
    placed = c.nodes.where(F.col("lvl") <= 1)
    return hierarchy.not_placed(hierarchy.stripped(c.comments), placed).select(*COMMENT_FIELDS)


@query
def orphans(spark, sf_dir):
    """Comments that never attach once withdrawn comments are gone: what hung on those."""
    c = corpus(spark, sf_dir)
    left = c.comments.where(~F.coalesce(x.comment_withdrawn(), F.lit(False)))
    return hierarchy.orphans(left, hierarchy.unroll(c.posts, left)).select(*COMMENT_FIELDS)


@query
def first_sparse_level(spark, sf_dir):
    """At the ratio of the main run and at a wider one."""
    counts = hierarchy.level_counts(corpus(spark, sf_dir).nodes)
    rows = [
        hierarchy.first_sparse_level(counts, ratio).withColumn("ratio", F.lit(ratio)) for ratio in (0.05, 0.3)
    ]
    return rows[0].unionByName(rows[1])


@query
def cascade_prune(spark, sf_dir):
    """Both cuts, one after the other."""
    nodes = cut_corpus(spark, sf_dir).nodes
    return nodes.select("id", "parent_id", "root_id", "ctp_id", "lvl", "connected")


@query
def cascade_prune_level_3(spark, sf_dir):
    return hierarchy.cascade_prune(corpus(spark, sf_dir).nodes, 3).select("id", "ctp_id", "lvl", "connected")


def numbers(spark: SparkSession, sf_dir: str, kind: str = "forest") -> DataFrame:
    """The intervals of all comments."""
    source = chains if kind == "chains" else forest
    return _once(f"numbers of {kind}", spark, sf_dir, lambda: ancestry.intervals(*source(spark, sf_dir)))


def _comment_values(comments: DataFrame) -> DataFrame:
    return comments.select(
        "id",
        F.lit(1).cast("bigint").alias("comments"),
        x.score_or_zero(F.col("score")).alias("score"),
        x.comment_withdrawn().cast("bigint").alias("withdrawn"),
    )


@query
def interval_prune(spark, sf_dir):
    """Both cuts on intervals, without paths."""
    nodes = numbers(spark, sf_dir)
    left = ancestry.prune(nodes, hierarchy.first_short_level(hierarchy.level_counts(nodes)))
    level = hierarchy.first_sparse_level(hierarchy.level_counts(left)).first().lvl
    if level is not None:
        left = ancestry.prune(left, level)
    return left.select("id", "parent_id", "root_id", "ctp_id", "lvl", "connected")


@query
def subtree_sums(spark, sf_dir):
    """Comments, score and withdrawn comments of every subtree."""
    nodes = numbers(spark, sf_dir)
    sums = ancestry.subtree_sums(nodes, _comment_values(forest(spark, sf_dir)[1]))
    return nodes.select("id", "lvl", (F.col("leave") - F.col("enter")).alias("size")).join(sums, "id")


@query
def path_sums_chains(spark, sf_dir):
    """The same from the top-level comment down to every comment; long chains."""
    nodes = numbers(spark, sf_dir, "chains")
    sums = ancestry.path_sums(nodes, _comment_values(chains(spark, sf_dir)[1]))
    return nodes.select("id", "root_id").join(sums, "id")


@query
def lookup_table(spark, sf_dir):
    c = wide_corpus(spark, sf_dir)
    wide = threads.lookup_table(c.posts, threads.lookup_long(c.nodes), LEVELS)
    return wide.select("posts", *[F.array_join(level_name(i), ",").alias(level_name(i)) for i in range(LEVELS)])


@query
def lookup_table_in_parts(spark, sf_dir):
    """The lookup with every level spread over parts; together the parts hold every id once."""
    c = wide_corpus(spark, sf_dir)
    wide = threads.lookup_table(c.posts, threads.lookup_long(c.nodes, parts=3), LEVELS)
    ids = F.flatten(F.array(*[F.coalesce(level_name(i), F.array().cast("array<string>")) for i in range(LEVELS)]))
    return wide.select("posts", F.explode(ids).alias("id"))


@query
def all_threads(spark, sf_dir):
    return _thread_rows(threads.all_threads(corpus(spark, sf_dir).nodes))


@query
def merge_fullname(spark, sf_dir):
    c = corpus(spark, sf_dir)
    posts = c.posts.withColumn("name", F.concat(F.lit("t3_"), "id"))
    return explore.merge(posts, c.comments, "name", "parent_id")


@query
def merge_stripped_id(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return explore.merge(c.posts, explore.with_parent_parts(c.comments), "id", "post_id")


@query
def subreddit_tables(spark, sf_dir):
    """Ids, lookup entries and threads of one community."""
    c = corpus(spark, sf_dir)
    of_community = c.posts.where(F.col("subreddit") == "sub3")
    ids = of_community.select(F.lit("ids").alias("part"), F.col("id").alias("posts"), F.lit("").alias("entry"))
    lookup = filters.by_subreddit(threads.lookup_long(c.nodes), c.posts, "sub3")
    chosen = filters.by_subreddit(c.threads, c.posts, "sub3")
    return ids.unionByName(
        lookup.select(F.lit("lookup").alias("part"), "posts", F.concat_ws(":", "lvl", F.array_join("ids", ",")).alias("entry"))
    ).unionByName(chosen.select(F.lit("threads").alias("part"), "posts", F.array_join("path", ">").alias("entry")))


@query
def threads_with_scores(spark, sf_dir):
    return corpus(spark, sf_dir).facts.select("ctp_id", "length", "total_score")


@query
def threads_with_authors(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = threads.members_with_facts(c.threads, c.comments)
    return rows.select("ctp_id", "lvl", "id", x.author_or_marker(F.col("author")).alias("author"))


@query
def threads_with_subreddit(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c.threads.join(threads.post_facts(c.posts), "posts").select("posts", "ctp_id", "subreddit")


@query
def point_lookup(spark, sf_dir):
    return corpus(spark, sf_dir).comments.where(F.col("id") == "e105").select(*COMMENT_FIELDS)


@query
def in_list_filter(spark, sf_dir):
    """Comments whose ids occur in the clean threads."""
    c = corpus(spark, sf_dir)
    return c.comments.join(threads.members(c.clean).select("id"), "id", "left_semi").select("id", "score")


# --- aggregations and statistics --------------------------------------------------


@query
def row_counts(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return stats.row_counts(c.posts, c.nodes).select("table_name", "row_count")


@query
def row_counts_after_cut(spark, sf_dir):
    c = cut_corpus(spark, sf_dir)
    return stats.row_counts(c.posts, c.nodes).select("table_name", "row_count")


@query
def number_of_threads(spark, sf_dir):
    return corpus(spark, sf_dir).clean.agg(F.count("*").alias("number_of_threads"))


@query
def depth_distribution(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return stats.depth_distribution(c.clean, c.levels).select("conversation_length", "row_count")


@query
def depth_distribution_all_threads(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return stats.depth_of_all_threads(c.nodes, c.levels).select("conversation_length", "row_count")


@query
def thread_lengths(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = c.clean.withColumn("segment", F.lit("threads"))
    lengths = rows.groupBy("segment", "length").agg(F.count("*").alias("threads"))
    return stats.thread_lengths(stats.depth_from_lengths(lengths, stats.segment_roots(rows), c.levels), ["segment"])


@query
def thread_score_distribution(spark, sf_dir):
    return stats.histogram(corpus(spark, sf_dir).clean, F.col("total_score"), "total_score", "thread_count")


@query
def subreddit_distribution(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return stats.subreddit_distribution(c.clean, c.posts)


@query
def author_distribution(spark, sf_dir):
    return stats.histogram(corpus(spark, sf_dir).clean, F.col("authors"), "number_of_authors", "number_of_threads")


@query
def lookup_lengths(spark, sf_dir):
    c = corpus(spark, sf_dir)
    shapes = stats.lookup_shapes(c.posts, stats.level_widths(c.nodes))
    return stats.histogram(shapes, F.col("levels"), "levels", "posts")


@query
def lookup_widths(spark, sf_dir):
    c = corpus(spark, sf_dir)
    shapes = stats.lookup_shapes(c.posts, stats.level_widths(c.nodes))
    return stats.histogram(shapes, F.col("widest"), "widest", "posts")


@query
def lookup_all_widths(spark, sf_dir):
    return stats.histogram(stats.level_widths(corpus(spark, sf_dir).nodes), F.col("width"), "width", "entries")


@query
def thread_table_widths(spark, sf_dir):
    return stats.thread_table_shapes(corpus(spark, sf_dir).threads)


def _averaged(spark, sf_dir) -> DataFrame:
    return histograms(spark, sf_dir)[0].where(F.col("stat") != "number_of_threads")


@query
def weighted_average(spark, sf_dir):
    return stats.weighted_averages(_averaged(spark, sf_dir))


@query
def weighted_quartiles(spark, sf_dir):
    return stats.weighted_quartiles(_averaged(spark, sf_dir))


@query
def weighted_quartiles_labels(spark, sf_dir):
    return stats.weighted_quartiles_labels(_averaged(spark, sf_dir))


@query
def value_counts(spark, sf_dir):
    c = corpus(spark, sf_dir)
    of_authors = stats.value_counts(c.comments, "author").withColumn("column", F.lit("author"))
    of_bodies = stats.value_counts(c.comments, "body").withColumn("column", F.lit("body"))
    return of_authors.unionByName(of_bodies)


@query
def value_percent(spark, sf_dir):
    posts = corpus(spark, sf_dir).posts.withColumn("archived", (F.col("score") % 2 == 0).cast("string"))
    return stats.value_percent(posts, "archived").withColumn("percent", F.round("percent", 6))


@query
def distinct_row_count(spark, sf_dir):
    return stats.distinct_row_count(corpus(spark, sf_dir).comments.select("body", "score", "author"))


@query
def total_comments(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return stats.total_comments(stats.row_counts(c.posts, c.nodes))


@query
def ids_per_level_agg(spark, sf_dir):
    long = threads.lookup_long(corpus(spark, sf_dir).nodes)
    return long.select("posts", "lvl", F.array_join("ids", ",").alias("ids"))


@query
def authors_per_thread(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = threads.members_with_facts(c.threads, c.comments).where(F.col("author") != "")
    return threads.authors_per_thread(rows).select("ctp_id", "author", "comments")


# --- thread selection, order, set operations --------------------------------------


@query
def longest_thread_per_ctp(spark, sf_dir):
    return _thread_rows(threads.longest_threads(threads.all_threads(corpus(spark, sf_dir).nodes)))


@query
def level_difference(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return stats.thread_lengths(stats.depth_of_all_threads(c.nodes, c.levels))


@query
def drop_deleted_threads(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return _thread_rows(filters.without_withdrawn(threads.thread_facts(c.threads, c.posts, c.comments)))


@query
def threads_k_authors(spark, sf_dir):
    """Threads of two to five authors, all from one pass."""
    chosen = filters.with_authors(corpus(spark, sf_dir).facts).where(F.col("named_authors").between(2, 5))
    return chosen.select("posts", "ctp_id", _path_text(), "named_authors")


@query
def threads_k_authors_chains(spark, sf_dir):
    return _thread_rows(filters.with_authors(chain_corpus(spark, sf_dir).facts, 2))


@query
def order_by(spark, sf_dir):
    c = corpus(spark, sf_dir)
    counts = stats.subreddit_distribution(c.threads, c.posts)
    return counts.orderBy(F.col("number_of_posts").desc(), "subreddit")


@query
def limit_n(spark, sf_dir):
    return ranking.first_rows(corpus(spark, sf_dir).posts, 300, "id").select("id", "subreddit", "score")


@query
def offset_pick(spark, sf_dir):
    """The thread in the middle of the table."""
    c = corpus(spark, sf_dir)
    rows = c.threads.count()
    return _thread_rows(ranking.row_at(c.threads, rows // 2, "ctp_id"))


@query
def top5_subreddits(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return stats.top_communities(stats.subreddit_distribution(c.clean, c.posts))


@query
def top10_series(spark, sf_dir):
    return series.top_series(histograms(spark, sf_dir)[0], "threads")


@query
def head_tail(spark, sf_dir):
    posts = corpus(spark, sf_dir).posts.select("id", "title", "score")
    head = ranking.first_rows(posts, 10, "id").withColumn("end", F.lit("head"))
    return head.unionByName(ranking.last_rows(posts, 5, "id").withColumn("end", F.lit("tail")))


@query
def union_all_levels(spark, sf_dir):
    """Threads of every depth in one table; the depth is a column of the nodes, so one scan has them all."""
    c = corpus(spark, sf_dir)
    return _thread_rows(threads.all_threads(c.nodes.where(F.col("lvl").between(0, c.levels - 1))))


@query
def union_all_authors(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = threads.members_with_facts(c.clean, c.comments)
    return rows.select("ctp_id", x.author_or_marker(F.col("author")).alias("author"))


@query
def concat_rows(spark, sf_dir):
    """Posts and comments one under the other; a column that one lacks is null."""
    c = corpus(spark, sf_dir)
    return c.posts.unionByName(c.comments, allowMissingColumns=True)


@query
def distinct_rows(spark, sf_dir):
    return corpus(spark, sf_dir).comments.select("body", "score", "author").dropDuplicates()


# --- sampling ---------------------------------------------------------------------


@query
def random_thread(spark, sf_dir):
    return _thread_rows(sampling.random_thread(corpus(spark, sf_dir).threads, 42))


@query
def bootstrap_threads(spark, sf_dir):
    """As many threads as there are, drawn with replacement: how many picks, their numbers, and how many are threads."""
    known = corpus(spark, sf_dir).threads
    drawn = sampling.sample_by_partitions(known, known.count(), seed=42)
    picked = known.withColumn("pick", F.lit(0).cast("bigint")) if drawn is None else drawn
    found = picked.join(known.select("posts", "ctp_id", "path", F.lit(1).alias("one")), ["posts", "ctp_id", "path"], "left")
    return found.agg(
        F.count("*").alias("picked"), F.count_distinct("pick").alias("numbers"), F.max("pick").alias("last"), F.count("one").alias("known")
    )


@query
def random_thread_unseeded(spark, sf_dir):
    """Whether the pick is one row, and one of the threads."""
    c = corpus(spark, sf_dir)
    pick = stage(sampling.random_thread_unseeded(c.threads), "pick")
    known = c.threads.select("posts", "ctp_id", "path", F.lit(1).alias("one"))
    found = pick.join(known, ["posts", "ctp_id", "path"], "left")
    return found.agg(F.count("*").alias("picked"), F.count("one").alias("known"))


@query
def subset_tables(spark, sf_dir):
    rows = sampling.subset_tables(corpus(spark, sf_dir).threads)
    return rows.select("subset", "pick", "posts", "ctp_id", _path_text())


@query
def thread_with_metadata(spark, sf_dir):
    """All clean threads with their rows, shown as text."""
    c = corpus(spark, sf_dir)
    rows = sampling.with_metadata(c.clean.select("posts", "ctp_id", "path"), c.posts, c.comments, by="ctp_id")

    def shown(name: str):
        return F.array_join(F.transform("comments", lambda one: F.coalesce(one[name].cast("string"), F.lit("-"))), ">").alias(name)

    return rows.select("ctp_id", F.col("post.title").alias("title"), shown("id"), shown("author"), shown("score"), shown("body"))


# --- series -----------------------------------------------------------------------


def _by_family(spark, sf_dir) -> DataFrame:
    rows, families = histograms(spark, sf_dir)
    return series.compare_segments(rows, families)


@query
def dense_series(spark, sf_dir):
    return series.dense_series(_averaged(spark, sf_dir))


@query
def unified_series(spark, sf_dir):
    return series.unified_series(_by_family(spark, sf_dir))


@query
def single_series(spark, sf_dir):
    rows, _ = histograms(spark, sf_dir)
    return series.single_series(rows.where(F.col("segment") == "threads"))


@query
def compare_segments(spark, sf_dir):
    return _by_family(spark, sf_dir).select("family", "stat", "segment", "key", "value")


# --- the whole study --------------------------------------------------------------


@query
def thread_study(spark, sf_dir):
    """Averages and quartiles of every segment, from the raw posts and comments on."""
    result = study.run(*forest(spark, sf_dir))
    quartiles = result.quartiles.select("stat", "segment", *[F.col(c).cast("double").alias(c) for c in ("q1", "q2", "q3", "iqr")])
    return result.averages.unpivot(["stat", "segment"], ["average"], "measure", "value").unionByName(
        quartiles.unpivot(["stat", "segment"], ["q1", "q2", "q3", "iqr"], "measure", "value")
    )


@query
def study_tables(spark, sf_dir):
    """A study saved twice to the same folder, and every table of it read back."""
    folder = scratch_path(spark, "study")
    result = study.run(*forest(spark, sf_dir))
    for _ in range(2):
        study.save(result, folder)
    read = {name: spark.read.parquet(f"{folder}/{name}") for name in ("threads", "segments", "lookup", "nodes", "averages", "quartiles")}
    levels = [c for c in read["threads"].columns if c != "posts"]

    def rows(name: str, *columns, value) -> DataFrame:
        three = [F.col(c).cast("string") if isinstance(c, str) else c for c in columns]
        named = [c.alias(n) for c, n in zip(three, ("a", "b"))]
        return read[name].select(F.lit(name).alias("table_name"), *named, value.cast("string").alias("value"))

    ids = F.flatten(F.array(*[F.coalesce(level, F.array().cast("array<string>")) for level in read["lookup"].columns if level in levels]))
    tables_read = [
        rows("threads", "posts", levels[0], value=F.array_join(F.array(*levels), ">")),
        rows("segments", "segment", "ctp_id", value=F.array_join("path", ">")),
        rows("lookup", "posts", F.lit(""), value=F.size(ids)),
        rows("nodes", "id", "parent_id", value=F.col("lvl")),
        rows("averages", "stat", "segment", value=F.round("average", 6)),
        rows("quartiles", "stat", "segment", value=F.concat_ws("/", "q1", "q2", "q3")),
    ]
    union = tables_read[0]
    for part in tables_read[1:]:
        union = union.unionByName(part)
    return union


@query
def longest_thread_lengths(spark, sf_dir):
    """Flagship: how long the longest threads are, from the raw posts and comments on."""
    nodes = hierarchy.unroll(*forest(spark, sf_dir))
    longest = nodes.groupBy("ctp_id").agg((F.max("lvl") + 1).alias("length"))
    return stats.histogram(longest, F.col("length"), "length", "threads")
