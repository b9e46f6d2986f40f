"""The same results as plain SQL over the given tables."""

from __future__ import annotations

import random

from replyforest import fixtures
from replyforest.schemas import level_name

LEVELS = 19
AUTHOR_MARK = "NULL_AUTHOR"
COMMENT_SUMS = """count(*) AS comments, CAST(sum(coalesce(c.score, 0)) AS BIGINT) AS score,
  count(CASE WHEN c.author IN ('[deleted]', '[removed]') OR c.body IN ('[deleted]', '[removed]') THEN 1 END) AS withdrawn"""


def _discussion(kind: str) -> str:
    if kind == "chains":
        posts, comments = fixtures.CHAIN_POSTS, fixtures.CHAIN_COMMENTS
    else:
        posts, comments = fixtures.FOREST_POSTS, fixtures.FOREST_COMMENTS
    names = {"events": "events", "conversations": "conversations", "div": "//"}
    return f"posts AS ({posts.format(**names)}), comments AS ({comments.format(**names)})"


def _tree(roots: str = "posts", comments: str = "comments") -> str:
    return f"""tree(id, parent_id, root_id, ctp_id, lvl, path) AS (
  SELECT c.id, p.id, p.id, c.id, CAST(0 AS BIGINT), [c.id]
  FROM {comments} c JOIN {roots} p ON substring(c.parent_id, 4) = p.id
  UNION ALL
  SELECT c.id, t.id, t.root_id, t.ctp_id, t.lvl + 1, list_append(t.path, c.id)
  FROM {comments} c JOIN tree t ON substring(c.parent_id, 4) = t.id)"""


CUTS = """
k1 AS (SELECT min(k) AS k FROM range(2, (SELECT greatest(coalesce(max(lvl), 0), 1) + 2 FROM tree)) r(k)
       LEFT JOIN (SELECT lvl, count(*) AS n FROM tree GROUP BY lvl) ON lvl = k WHERE coalesce(n, 0) < 100),
c1 AS (SELECT *, ctp_id NOT IN (SELECT ctp_id FROM tree WHERE lvl = (SELECT k FROM k1)) AS connected FROM tree
       WHERE lvl < (SELECT k FROM k1)
         AND id NOT IN (SELECT unnest(path[1:len(path) - 1]) FROM tree WHERE lvl = (SELECT k FROM k1))),
k2 AS (SELECT min(lvl) AS k FROM (SELECT lvl, count(*) AS n FROM c1 GROUP BY lvl)
       WHERE lvl >= 1 AND n / (SELECT count(*) FROM c1 WHERE lvl = 0) < 0.05),
c2 AS (SELECT * REPLACE (connected AND ctp_id NOT IN (SELECT ctp_id FROM c1 WHERE lvl = (SELECT k FROM k2)) AS connected)
       FROM c1
       WHERE lvl < coalesce((SELECT k FROM k2), 1000000)
         AND id NOT IN (SELECT unnest(path[1:len(path) - 1]) FROM c1 WHERE lvl = (SELECT k FROM k2)))"""


def _threads(nodes: str = "tree") -> str:
    return f"""
threads AS (SELECT root_id AS posts, ctp_id, path FROM
  (SELECT *, row_number() OVER (PARTITION BY ctp_id ORDER BY lvl DESC, id DESC) AS place FROM {nodes}) WHERE place = 1),
members AS (SELECT t.posts, t.ctp_id, u.id, CAST(u.place - 1 AS BIGINT) AS lvl
            FROM threads t, unnest(t.path) WITH ORDINALITY AS u(id, place)),
per_author AS (SELECT m.ctp_id, c.author, count(*) AS comments, sum(coalesce(c.score, 0)) AS score,
    max(CASE WHEN c.author IN ('[deleted]', '[removed]') OR c.body IN ('[deleted]', '[removed]') THEN 1 ELSE 0 END) AS gone
  FROM members m JOIN comments c ON c.id = m.id GROUP BY m.ctp_id, c.author),
per_thread AS (SELECT ctp_id, CAST(sum(score) AS BIGINT) AS total_score,
    count(DISTINCT coalesce(author, '{AUTHOR_MARK}')) AS authors,
    count(DISTINCT nullif(author, '')) AS named_authors,
    min(CASE WHEN author <> '' THEN comments END) AS fewest_comments, max(gone) AS gone
  FROM per_author GROUP BY ctp_id),
facts AS (SELECT t.posts, t.ctp_id, t.path, len(t.path) AS length, f.* EXCLUDE (ctp_id, gone), p.subreddit,
    p.score AS post_score,
    f.gone = 1 OR coalesce(p.author IN ('[deleted]', '[removed]'), FALSE) OR coalesce(p.title IN ('[deleted]', '[removed]'), FALSE)
      OR coalesce(p.selftext IN ('[deleted]', '[removed]'), FALSE) AS withdrawn
  FROM threads t JOIN per_thread f USING (ctp_id) JOIN posts p ON p.id = t.posts),
clean AS (SELECT * FROM facts WHERE NOT withdrawn)"""


def _stats(nodes: str = "tree", all_nodes: str = "tree") -> str:
    return f"""
top5 AS (SELECT subreddit FROM clean GROUP BY subreddit ORDER BY count(*) DESC, subreddit LIMIT 5),
seg AS (
  SELECT 'all' AS family, 'threads' AS segment, * FROM clean
  UNION ALL SELECT 'virality', CASE WHEN post_score >= 1000 THEN 'threads_viral' ELSE 'threads_non_viral' END, *
    FROM clean WHERE post_score IS NOT NULL
  UNION ALL SELECT 'participants', 'threads_' || named_authors || '_authors', *
    FROM clean WHERE fewest_comments >= 2 AND named_authors BETWEEN 2 AND 5
  UNION ALL SELECT 'subreddits', subreddit || '_threads', * FROM clean WHERE subreddit IN (SELECT subreddit FROM top5)),
families AS (SELECT DISTINCT family, segment FROM seg),
depth AS (SELECT segment, CAST(0 AS BIGINT) AS ord, count(DISTINCT posts) AS n FROM seg GROUP BY segment
  UNION ALL SELECT s.segment, r.o, count(CASE WHEN s.length >= r.o THEN 1 END)
    FROM seg s, range(1, (SELECT max(lvl) + 2 FROM {all_nodes})) r(o) GROUP BY s.segment, r.o),
lookup_ids AS (SELECT root_id AS posts, lvl, count(*) AS width, list_sort(list(id)) AS ids FROM {nodes} GROUP BY root_id, lvl),
shapes AS (SELECT p.id AS posts, p.subreddit, count(l.lvl) AS levels, coalesce(max(l.width), 0) AS widest
  FROM posts p LEFT JOIN lookup_ids l ON l.posts = p.id GROUP BY p.id, p.subreddit),
tables AS (SELECT 'lookup_table' AS segment, id AS posts FROM posts
  UNION ALL SELECT subreddit || '_lookup', id FROM posts WHERE subreddit IN (SELECT subreddit FROM top5)),
numbers AS (
  SELECT 'thread_score_distribution' AS stat, segment, total_score AS number, count(*) AS value FROM seg GROUP BY ALL
  UNION ALL SELECT 'author_distribution', segment, authors, count(*) FROM seg GROUP BY ALL
  UNION ALL SELECT 'number_of_threads', segment, CAST(0 AS BIGINT), count(*) FROM seg GROUP BY ALL
  UNION ALL SELECT 'thread_lengths', segment, ord, n - coalesce(lead(n) OVER (PARTITION BY segment ORDER BY ord), 0) FROM depth
  UNION ALL SELECT 'thread_lengths', segment, levels, count(*) FROM tables JOIN shapes USING (posts) GROUP BY ALL
  UNION ALL SELECT 'thread_widths', segment, widest, count(*) FROM tables JOIN shapes USING (posts) GROUP BY ALL
  UNION ALL SELECT 'all_widths', segment, width, count(*) FROM tables JOIN lookup_ids USING (posts) GROUP BY ALL),
stats AS (SELECT stat, segment, number AS ord, CAST(number AS VARCHAR) AS key, value FROM numbers
  UNION ALL SELECT 'depth_distribution', segment, ord,
    CASE ord WHEN 0 THEN 'posts' WHEN 1 THEN 'comments_to_posts' ELSE 'comments_to_comments_' || (ord - 1) END, n FROM depth
  UNION ALL SELECT 'subreddit_distribution', segment,
    row_number() OVER (PARTITION BY segment ORDER BY n DESC, subreddit) - 1, subreddit, n
    FROM (SELECT segment, subreddit, count(*) AS n FROM seg GROUP BY segment, subreddit)),
ranked AS (SELECT * FROM stats WHERE stat <> 'number_of_threads')"""


# Ranks of quartiles and middles by repeating every key as often as it was counted.
QUARTILES = """
expanded AS (SELECT stat, segment, key, row_number() OVER (PARTITION BY stat, segment ORDER BY ord) AS place,
    count(*) OVER (PARTITION BY stat, segment) AS n
  FROM (SELECT *, unnest(range(value)) FROM ranked WHERE value > 0)),
at_ranks AS (SELECT stat, segment,
    max(CASE WHEN place = ceil(0.25 * n) THEN key END) AS q1, max(CASE WHEN place = ceil(0.75 * n) THEN key END) AS q3,
    max(CASE WHEN place = (n + 1) // 2 THEN key END) AS low, max(CASE WHEN place = n // 2 + 1 THEN key END) AS high
  FROM expanded GROUP BY stat, segment),
quartiles AS (SELECT stat, segment, CAST(q1 AS BIGINT) AS q1, (CAST(low AS BIGINT) + CAST(high AS BIGINT)) / 2.0::DOUBLE AS q2,
    CAST(q3 AS BIGINT) AS q3, CAST(q3 AS BIGINT) - CAST(q1 AS BIGINT) AS iqr
  FROM at_ranks WHERE TRY_CAST(q1 AS BIGINT) IS NOT NULL),
label_quartiles AS (SELECT stat, segment, q1, CASE WHEN low = high THEN low ELSE 'Median between ' || low || ' and ' || high END AS q2,
    q3, q3 || ' - ' || q1 AS iqr FROM at_ranks WHERE TRY_CAST(q1 AS BIGINT) IS NULL)"""

AVERAGES = """
averages AS (SELECT stat, segment,
    CAST(sum(CASE WHEN stat = 'depth_distribution' THEN ord ELSE TRY_CAST(key AS BIGINT) END * value) AS DOUBLE)
      / (CAST(sum(CASE WHEN stat = 'thread_score_distribution' THEN value ELSE greatest(value, 0) END) AS DOUBLE) + 0.0001) AS average
  FROM ranked WHERE stat <> 'subreddit_distribution' GROUP BY stat, segment)"""

COMPARED = """
compared AS (SELECT f.family, s.stat, s.segment, s.key, s.value, CAST(s.key AS BIGINT) AS x
  FROM (SELECT family, segment FROM families WHERE family <> 'all'
        UNION SELECT family, 'threads' FROM families WHERE family <> 'all') f
  JOIN stats s USING (segment)
  WHERE (s.stat IN ('thread_lengths', 'thread_score_distribution'))
     OR (s.stat = 'author_distribution' AND f.family <> 'participants'))"""


def _sql(select: str, *parts: str, kind: str = "forest") -> str:
    return "WITH RECURSIVE " + ",\n".join([_discussion(kind), *parts]) + "\n" + select


def _on_posts(select: str) -> str:
    return _sql(select)


def _on_tree(select: str, kind: str = "forest") -> str:
    return _sql(select, _tree(), kind=kind)


def _on_cut(select: str) -> str:
    return _sql(select, _tree(), CUTS)


def _on_threads(select: str, kind: str = "forest") -> str:
    return _sql(select, _tree(), _threads(), kind=kind)


def _on_stats(select: str, *parts: str) -> str:
    return _sql(select, _tree(), _threads(), _stats(), *parts)


def _words(seed: int, count: int = 256) -> str:
    """The first 32-bit outputs of the generator a seed stands for, as SQL rows."""
    rng = random.Random(seed)
    return ", ".join(f"({seed}, {i}, {rng.getrandbits(32)})" for i in range(count))


def _picks(seeds: list[int], each: int) -> str:
    """Offsets below the number of threads, drawn as the generator draws them: the upper
    bits of each word, words that are too large left out."""
    rows = ", ".join(_words(seed) for seed in seeds)
    return f"""
words(seed, i, word) AS (VALUES {rows}),
size AS (SELECT count(*) AS n, CAST(floor(log2(count(*))) AS INTEGER) + 1 AS bits FROM threads),
drawn AS (SELECT seed, i, word >> (32 - bits) AS pos FROM words, size WHERE (word >> (32 - bits)) < n),
picks AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY i) - 1 AS draw, pos FROM drawn QUALIFY draw < {each}),
placed AS (SELECT *, row_number() OVER (ORDER BY ctp_id) - 1 AS pos FROM threads)"""


WIDE = ", ".join(f"path[{i + 1}] AS {level_name(i)}" for i in range(LEVELS))
PATH = "array_to_string(path, '>') AS path"
THREAD = f"posts, ctp_id, {PATH}"
LEVEL_NAME = "CASE WHEN lvl = 0 THEN 'comments_to_posts' ELSE 'comments_to_comments_' || lvl END"
COMMENT = "id, body, score, author, substring(parent_id, 4) AS parent_id"
NODE = f"id, parent_id, root_id, ctp_id, lvl, {PATH}"
RAW_POST = """score + 1588291200 AS created_utc, id, 't3_' || id AS name, title, selftext, subreddit, score,
  CAST(score % 100 AS DOUBLE) / 100 AS upvote_ratio, CAST(0 AS BIGINT) AS num_comments, score % 2 = 0 AS archived, author,
  CAST(NULL AS VARCHAR) AS distinguished,
  CASE WHEN score % 3 = 0 THEN '{"type":"' || subreddit || '","size":' || score || '}' END AS media"""
POST_TABLE = "SELECT id, title, selftext, subreddit, score, upvote_ratio, media, author FROM raw_posts"
RAW_POSTS = f"raw_posts AS (SELECT {RAW_POST} FROM posts)"
PADDED_POSTS = f"""padded AS ({POST_TABLE} UNION ALL
  SELECT 'short_' || id, title, NULL, NULL, -1, -1, NULL, NULL FROM posts)"""


def _row_counts(nodes: str) -> str:
    return f"""SELECT 'posts' AS table_name, count(*) AS row_count FROM posts
UNION ALL SELECT {LEVEL_NAME}, count(*) FROM {nodes} GROUP BY lvl"""


def _level_counts_by_name(rows: str) -> str:
    return f"""SELECT 'posts' AS conversation_length, count(DISTINCT root_id) AS row_count FROM {rows}
UNION ALL SELECT {LEVEL_NAME}, count(DISTINCT id) FROM {rows} GROUP BY lvl"""


CLEAN_DEPTH = f"""SELECT 'posts' AS conversation_length, count(DISTINCT posts) AS row_count FROM clean
UNION ALL SELECT {LEVEL_NAME}, count(DISTINCT id) FROM
  (SELECT r.lvl, u.id FROM range((SELECT max(lvl) + 1 FROM tree)) r(lvl)
   LEFT JOIN (SELECT m.lvl, m.id FROM members m JOIN clean USING (ctp_id)) u ON u.lvl = r.lvl) GROUP BY lvl"""

WIDE_LOOKUP = ", ".join(
    f"array_to_string(list_sort(list(t.id) FILTER (t.lvl = {i})), ',') AS {level_name(i)}" for i in range(LEVELS)
)

ALL_DEPTHS = """SELECT CAST(0 AS BIGINT) AS ord, count(DISTINCT root_id) AS n FROM tree
UNION ALL SELECT lvl + 1, count(*) FROM tree GROUP BY lvl"""


def oracles() -> dict[str, str]:
    return {
        # sources and sinks
        "jsonl_head": _sql("SELECT * FROM raw_posts ORDER BY id LIMIT 200", RAW_POSTS),
        "jsonl_columns": _sql("SELECT * FROM raw_posts", RAW_POSTS),
        "ingest_resumable": _sql("SELECT * FROM raw_posts", RAW_POSTS),
        "ingest_statistics": _sql(
            """SELECT row_number() OVER (PARTITION BY stat ORDER BY value DESC, key NULLS FIRST) AS ord, key, value, stat,
  'all' AS segment FROM counts""",
            RAW_POSTS,
            """counts AS (SELECT 'subreddit' AS stat, subreddit AS key, count(*) AS value FROM raw_posts GROUP BY subreddit
  UNION ALL SELECT 'author', author, count(*) FROM raw_posts GROUP BY author)""",
        ),
        "ingest_after_id": _on_posts(
            """SELECT score + 1588291200 AS created_utc, id, body, score, score % 2 AS controversiality, author, parent_id,
  count(*) OVER () AS written FROM comments WHERE id > 'e105'"""
        ),
        "csv_tolerant_scan": _sql("SELECT * FROM padded", RAW_POSTS, PADDED_POSTS),
        "load_posts": _sql("SELECT * FROM padded", RAW_POSTS, PADDED_POSTS),
        "csv_string_scan_cast": _on_posts("SELECT id, body, CAST(score AS INTEGER) AS score, author, parent_id FROM comments"),
        "csv_head_scan": _on_posts(
            "SELECT id, body, CAST(score AS VARCHAR) AS score, author, parent_id FROM comments ORDER BY id LIMIT 500"
        ),
        "table_overwrite": _on_threads(f"SELECT {THREAD} FROM clean"),
        "table_append": _on_threads(f"SELECT {THREAD} FROM threads"),
        "delete_matching": _on_posts(
            """SELECT id, substring(parent_id, 4) AS parent_id, score FROM comments
WHERE substring(parent_id, 4) NOT IN (SELECT id FROM posts)"""
        ),
        "stats_store": _on_stats("SELECT stat, segment, ord, key, value FROM stats"),
        "stats_store_json": _on_stats("SELECT stat || '_' || segment AS name, key, value FROM stats"),
        "threads_jsonl_export": _sql(
            """SELECT p.title, array_to_string(t.path, '>') AS path, f.total_score AS score
FROM picks k JOIN placed t USING (pos) JOIN posts p ON p.id = t.posts JOIN facts f USING (ctp_id)""",
            _tree(),
            _threads(),
            _picks([7], 100),
        ),
        "thread_to_samples": _on_threads(
            """SELECT id, CAST(NULL AS VARCHAR) AS parent_id, score, author, title, selftext AS body FROM posts
  WHERE id IN (SELECT posts FROM clean)
UNION ALL SELECT id, substring(parent_id, 4), score, author, NULL, body FROM comments
  WHERE id IN (SELECT m.id FROM members m JOIN clean USING (ctp_id))"""
        ),
        # projections, filters, scalar expressions
        "project_columns": _on_posts("SELECT id, subreddit, score FROM posts"),
        "strip_parent_prefix": _on_posts("SELECT id, substring(parent_id, 4) AS parent_id FROM comments"),
        "parent_type_prefix": _on_posts(
            "SELECT id, substring(parent_id, 4) AS post_id, substring(parent_id, 1, 3) AS prefix FROM comments"
        ),
        "filter_subreddit": _on_posts("SELECT id FROM posts WHERE subreddit = 'sub3'"),
        "filter_by_score": _on_threads(
            """SELECT 'threads_viral' AS segment, posts, ctp_id FROM clean WHERE posts IN (SELECT id FROM posts WHERE score >= 1000)
UNION ALL SELECT 'threads_non_viral', posts, ctp_id FROM clean WHERE posts IN (SELECT id FROM posts WHERE score < 1000)"""
        ),
        "deleted_flag": _on_posts(
            """SELECT id, coalesce(author IN ('[deleted]', '[removed]'), FALSE) OR coalesce(title IN ('[deleted]', '[removed]'), FALSE)
  OR coalesce(selftext IN ('[deleted]', '[removed]'), FALSE) AS withdrawn FROM posts
UNION ALL SELECT id, coalesce(author IN ('[deleted]', '[removed]'), FALSE) OR coalesce(body IN ('[deleted]', '[removed]'), FALSE)
FROM comments"""
        ),
        "withdrawn_ids": _on_posts(
            """SELECT id, 'post' AS kind FROM posts
WHERE author IN ('[deleted]', '[removed]') OR title IN ('[deleted]', '[removed]') OR selftext IN ('[deleted]', '[removed]')
UNION ALL SELECT id, 'comment' FROM comments WHERE author IN ('[deleted]', '[removed]') OR body IN ('[deleted]', '[removed]')"""
        ),
        "non_null_filter": _on_posts("SELECT id, author FROM comments WHERE author IS NOT NULL"),
        "thread_length": _on_tree(
            "SELECT root_id AS posts, ctp_id AS comments_to_posts, lvl + 2 AS thread_length, lvl + 1 AS comments FROM tree"
        ),
        "null_default": _on_posts(
            f"SELECT id, coalesce(score, 0) AS score, coalesce(author, '{AUTHOR_MARK}') AS author FROM comments"
        ),
        "pad_levels": _on_tree(f"SELECT root_id AS posts, {WIDE} FROM tree"),
        "like_filter": _on_tree(f"SELECT * FROM ({_row_counts('tree')}) WHERE table_name LIKE 'comments_%'"),
        "typed_cast": _on_posts(
            """SELECT id, CAST(CAST(score AS VARCHAR) AS INTEGER) AS score, coalesce(TRY_CAST(body AS INTEGER), -1) AS body_number,
  CAST(score AS DOUBLE) AS score_double FROM comments"""
        ),
        "array_length": _on_tree("SELECT root_id AS posts, lvl, count(*) AS width FROM tree GROUP BY root_id, lvl"),
        "parse_list_string": _on_tree(
            """SELECT root_id AS posts, lvl, count(*) AS width, string_agg(id, ',' ORDER BY id) AS ids
FROM tree GROUP BY root_id, lvl"""
        ),
        "json_parse": _on_posts(
            """SELECT id, CASE WHEN json_valid(selftext) THEN TRY_CAST(json_extract(CASE WHEN json_valid(selftext) THEN selftext END, '$.k') AS BIGINT) END AS k
FROM posts"""
        ),
        "json_write": _on_posts(
            """SELECT id, '{"id":"' || id || '","subreddit":"' || subreddit || '","score":' || score || '}' AS record FROM posts"""
        ),
        "regex_level": _on_tree(
            f"""SELECT conversation_length, row_count,
  CASE WHEN conversation_length = 'comments_to_posts' THEN 0
       WHEN conversation_length = 'posts' THEN -1
       ELSE CAST(regexp_extract(conversation_length, '^comments_to_comments_([0-9]+)$', 1) AS BIGINT) END AS lvl
FROM ({_level_counts_by_name('tree')})"""
        ),
        "clamp_negative": _on_threads(
            """SELECT ord AS length, greatest(n - coalesce(lead(n) OVER (ORDER BY ord), 0), 0) AS threads FROM (
  SELECT CAST(0 AS BIGINT) AS ord, count(DISTINCT posts) AS n FROM threads
  UNION ALL SELECT lvl + 1, count(DISTINCT id) FROM members GROUP BY lvl)"""
        ),
        "range_filter": _on_posts("SELECT id, score FROM comments WHERE score BETWEEN -10 AND 30"),
        "random_value": _on_tree("SELECT ctp_id, max(lvl) + 1 AS length FROM tree GROUP BY ctp_id"),
        # joins and hierarchy
        "comments_to_posts": _on_posts(f"SELECT {COMMENT} FROM comments WHERE substring(parent_id, 4) IN (SELECT id FROM posts)"),
        "comments_level_1": _on_posts(
            f"""SELECT {COMMENT} FROM comments WHERE substring(parent_id, 4) IN
  (SELECT id FROM comments WHERE substring(parent_id, 4) IN (SELECT id FROM posts))"""
        ),
        "unroll_levels": _on_tree(f"SELECT {NODE} FROM tree"),
        "unroll_increments": _on_tree(f"SELECT {NODE} FROM tree"),
        "unroll_levels_chains": _on_tree(f"SELECT {NODE} FROM tree", kind="chains"),
        "unroll_levels_min_rows": _on_cut("SELECT id, parent_id, root_id, ctp_id, lvl, connected FROM c1"),
        "consume_matched": _on_tree(f"SELECT {COMMENT} FROM comments WHERE id NOT IN (SELECT id FROM tree WHERE lvl <= 1)"),
        "orphans": _sql(
            f"SELECT {COMMENT} FROM remaining WHERE id NOT IN (SELECT id FROM tree)",
            """remaining AS (SELECT * FROM comments WHERE NOT coalesce(author IN ('[deleted]', '[removed]'), FALSE)
  AND NOT coalesce(body IN ('[deleted]', '[removed]'), FALSE))""",
            _tree(comments="remaining"),
        ),
        "first_sparse_level": _sql(
            """SELECT min(CASE WHEN lvl >= 1 AND n / top < ratio THEN lvl END) AS lvl, CAST(ratio AS DOUBLE) AS ratio
FROM counts, (VALUES (0.05), (0.3)) v(ratio), (SELECT n AS top FROM counts WHERE lvl = 0) GROUP BY ratio""",
            _tree(),
            "counts AS (SELECT lvl, count(*) AS n FROM tree GROUP BY lvl)",
        ),
        "cascade_prune": _on_cut("SELECT id, parent_id, root_id, ctp_id, lvl, connected FROM c2"),
        "cascade_prune_level_3": _on_tree(
            """SELECT id, ctp_id, lvl, ctp_id NOT IN (SELECT ctp_id FROM tree WHERE lvl = 3) AS connected FROM tree
WHERE lvl < 3 AND id NOT IN (SELECT unnest(path[1:3]) FROM tree WHERE lvl = 3)"""
        ),
        "interval_prune": _on_cut("SELECT id, parent_id, root_id, ctp_id, lvl, connected FROM c2"),
        "subtree_sums": _on_tree(
            f"""SELECT a.id, a.lvl, count(*) AS size, {COMMENT_SUMS}
FROM (SELECT id AS below, unnest(path) AS id FROM tree) u JOIN tree a ON a.id = u.id JOIN comments c ON c.id = u.below
GROUP BY a.id, a.lvl"""
        ),
        "path_sums_chains": _on_tree(
            f"""SELECT u.id, u.root_id, {COMMENT_SUMS}
FROM (SELECT id, root_id, unnest(path) AS above FROM tree) u JOIN comments c ON c.id = u.above GROUP BY u.id, u.root_id""",
            kind="chains",
        ),
        "lookup_table": _on_tree(
            f"SELECT p.id AS posts, {WIDE_LOOKUP} FROM posts p LEFT JOIN tree t ON t.root_id = p.id GROUP BY p.id"
        ),
        "lookup_table_in_parts": _on_tree("SELECT root_id AS posts, id FROM tree"),
        "all_threads": _on_tree(f"SELECT root_id AS posts, ctp_id, {PATH} FROM tree"),
        "merge_fullname": _on_posts(
            """SELECT p.id AS id_post, p.title, p.selftext, p.subreddit, p.score AS score_post, p.author AS author_post,
  't3_' || p.id AS name, c.id AS id_comment, c.body, c.score AS score_comment, c.author AS author_comment, c.parent_id
FROM posts p JOIN comments c ON 't3_' || p.id = c.parent_id"""
        ),
        "merge_stripped_id": _on_posts(
            """SELECT p.id AS id_post, p.title, p.selftext, p.subreddit, p.score AS score_post, p.author AS author_post,
  c.id AS id_comment, c.body, c.score AS score_comment, c.author AS author_comment, c.parent_id,
  substring(c.parent_id, 4) AS post_id, substring(c.parent_id, 1, 3) AS prefix
FROM posts p JOIN comments c ON p.id = substring(c.parent_id, 4)"""
        ),
        "subreddit_tables": _on_threads(
            """SELECT 'ids' AS part, id AS posts, '' AS entry FROM posts WHERE subreddit = 'sub3'
UNION ALL SELECT 'lookup', root_id, lvl || ':' || string_agg(id, ',' ORDER BY id) FROM tree
  WHERE root_id IN (SELECT id FROM posts WHERE subreddit = 'sub3') GROUP BY root_id, lvl
UNION ALL SELECT 'threads', posts, array_to_string(path, '>') FROM threads
  WHERE posts IN (SELECT id FROM posts WHERE subreddit = 'sub3')"""
        ),
        "threads_with_scores": _on_threads("SELECT ctp_id, length, total_score FROM facts"),
        "threads_with_authors": _on_threads(
            f"""SELECT m.ctp_id, m.lvl, m.id, coalesce(c.author, '{AUTHOR_MARK}') AS author
FROM members m LEFT JOIN comments c ON c.id = m.id"""
        ),
        "threads_with_subreddit": _on_threads("SELECT posts, ctp_id, subreddit FROM facts"),
        "point_lookup": _on_posts("SELECT id, body, score, author, parent_id FROM comments WHERE id = 'e105'"),
        "in_list_filter": _on_threads(
            "SELECT id, score FROM comments WHERE id IN (SELECT m.id FROM members m JOIN clean USING (ctp_id))"
        ),
        # aggregations and statistics
        "row_counts": _on_tree(_row_counts("tree")),
        "row_counts_after_cut": _on_cut(_row_counts("c2")),
        "number_of_threads": _on_threads("SELECT count(*) AS number_of_threads FROM clean"),
        "depth_distribution": _on_threads(CLEAN_DEPTH),
        "depth_distribution_all_threads": _on_tree(_level_counts_by_name("tree")),
        "thread_lengths": _on_stats(
            """SELECT segment, ord AS length, n - coalesce(lead(n) OVER (ORDER BY ord), 0) AS threads
FROM depth WHERE segment = 'threads'"""
        ),
        "thread_score_distribution": _on_threads("SELECT total_score, count(*) AS thread_count FROM clean GROUP BY total_score"),
        "subreddit_distribution": _on_threads("SELECT subreddit, count(*) AS number_of_posts FROM clean GROUP BY subreddit"),
        "author_distribution": _on_threads(
            "SELECT authors AS number_of_authors, count(*) AS number_of_threads FROM clean GROUP BY authors"
        ),
        "lookup_lengths": _on_stats("SELECT levels, count(*) AS posts FROM shapes GROUP BY levels"),
        "lookup_widths": _on_stats("SELECT widest, count(*) AS posts FROM shapes GROUP BY widest"),
        "lookup_all_widths": _on_stats("SELECT width, count(*) AS entries FROM lookup_ids GROUP BY width"),
        "thread_table_widths": _on_threads(
            """SELECT 'lengths' AS stat, len(path) AS key, count(*) AS value FROM threads GROUP BY len(path)
UNION ALL SELECT 'widths', 1, count(*) FROM threads
UNION ALL SELECT 'all_widths', 1, CAST(sum(len(path)) AS BIGINT) FROM threads"""
        ),
        "weighted_average": _on_stats("SELECT * FROM averages", AVERAGES),
        "weighted_quartiles": _on_stats("SELECT * FROM quartiles", QUARTILES),
        "weighted_quartiles_labels": _on_stats("SELECT * FROM label_quartiles", QUARTILES),
        "value_counts": _on_posts(
            """SELECT author AS value, count(*) AS count, 'author' AS column FROM comments WHERE author IS NOT NULL GROUP BY author
UNION ALL SELECT body, count(*), 'body' FROM comments WHERE body IS NOT NULL GROUP BY body"""
        ),
        "value_percent": _on_posts(
            """SELECT CASE WHEN score % 2 = 0 THEN 'true' ELSE 'false' END AS value,
  round(count(*) / (SELECT count(score) FROM posts) * 100, 6) AS percent FROM posts WHERE score IS NOT NULL GROUP BY 1"""
        ),
        "distinct_row_count": _on_posts(
            """SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT body, score, author FROM comments)) AS unique_rows
FROM comments"""
        ),
        "total_comments": _on_tree("SELECT count(*) AS total_comments FROM tree"),
        "ids_per_level_agg": _on_tree(
            "SELECT root_id AS posts, lvl, string_agg(id, ',' ORDER BY id) AS ids FROM tree GROUP BY root_id, lvl"
        ),
        "authors_per_thread": _on_threads("SELECT ctp_id, author, comments FROM per_author WHERE author <> ''"),
        # thread selection, order, set operations
        "longest_thread_per_ctp": _on_threads(f"SELECT {THREAD} FROM threads"),
        "level_difference": _sql(
            "SELECT ord AS length, n - coalesce(lead(n) OVER (ORDER BY ord), 0) AS threads FROM depths",
            _tree(),
            f"depths AS ({ALL_DEPTHS})",
        ),
        "drop_deleted_threads": _on_threads(f"SELECT {THREAD} FROM clean"),
        "threads_k_authors": _on_threads(
            f"SELECT {THREAD}, named_authors FROM clean WHERE fewest_comments >= 2 AND named_authors BETWEEN 2 AND 5"
        ),
        "threads_k_authors_chains": _on_threads(
            f"SELECT {THREAD} FROM clean WHERE fewest_comments >= 2 AND named_authors = 2", kind="chains"
        ),
        "bootstrap_threads": _on_threads(
            "SELECT count(*) AS picked, count(*) AS numbers, nullif(count(*), 0) - 1 AS last, count(*) AS known FROM threads"
        ),
        "order_by": _on_threads(
            """SELECT p.subreddit, count(*) AS number_of_posts FROM threads t JOIN posts p ON p.id = t.posts
GROUP BY p.subreddit ORDER BY number_of_posts DESC, subreddit"""
        ),
        "limit_n": _on_posts("SELECT id, subreddit, score FROM posts ORDER BY id LIMIT 300"),
        "offset_pick": _on_threads(
            f"SELECT {THREAD} FROM threads ORDER BY ctp_id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM threads)"
        ),
        "top5_subreddits": _on_threads(
            """SELECT subreddit, count(*) AS number_of_posts FROM clean GROUP BY subreddit
ORDER BY number_of_posts DESC, subreddit LIMIT 5"""
        ),
        "top10_series": _on_threads(
            "SELECT subreddit AS x, count(*) AS y FROM clean GROUP BY subreddit ORDER BY y DESC, x LIMIT 10"
        ),
        "head_tail": _on_posts(
            """(SELECT id, title, score, 'head' AS "end" FROM posts ORDER BY id LIMIT 10)
UNION ALL (SELECT id, title, score, 'tail' FROM posts ORDER BY id DESC LIMIT 5)"""
        ),
        "union_all_levels": _on_tree(f"SELECT root_id AS posts, ctp_id, {PATH} FROM tree"),
        "union_all_authors": _on_threads(
            f"""SELECT m.ctp_id, coalesce(c.author, '{AUTHOR_MARK}') AS author
FROM members m JOIN clean USING (ctp_id) JOIN comments c ON c.id = m.id"""
        ),
        "concat_rows": _on_posts("SELECT * FROM posts UNION ALL BY NAME SELECT * FROM comments"),
        "distinct_rows": _on_posts("SELECT DISTINCT body, score, author FROM comments"),
        # sampling
        "random_thread": _sql(f"SELECT {THREAD} FROM picks JOIN placed USING (pos)", _tree(), _threads(), _picks([42], 1)),
        "random_thread_unseeded": "SELECT CAST(1 AS BIGINT) AS picked, CAST(1 AS BIGINT) AS known",
        "subset_tables": _sql(
            f"""SELECT CAST(seed // 100 + 1 AS BIGINT) AS subset, CAST(seed // 100 * 3 + seed % 100 AS BIGINT) AS pick, {THREAD}
FROM picks JOIN placed USING (pos)""",
            _tree(),
            _threads(),
            _picks([100 * i + j for i in range(3) for j in range(3)], 1),
        ),
        "thread_with_metadata": _on_threads(
            """SELECT m.ctp_id, any_value(p.title) AS title, string_agg(m.id, '>' ORDER BY m.lvl) AS id,
  string_agg(coalesce(c.author, '-'), '>' ORDER BY m.lvl) AS author,
  string_agg(coalesce(CAST(c.score AS VARCHAR), '-'), '>' ORDER BY m.lvl) AS score,
  string_agg(coalesce(c.body, '-'), '>' ORDER BY m.lvl) AS body
FROM members m JOIN clean t USING (ctp_id) JOIN comments c ON c.id = m.id JOIN posts p ON p.id = m.posts GROUP BY m.ctp_id"""
        ),
        # series
        "dense_series": _on_stats(
            """SELECT a.stat, a.segment, CAST(a.x AS VARCHAR) AS x, greatest(coalesce(s.value, 0), 0) AS y
FROM (SELECT stat, segment, unnest(range(min(x), max(x) + 1)) AS x FROM shown GROUP BY stat, segment) a
LEFT JOIN shown s USING (stat, segment, x)
UNION ALL SELECT stat, segment, key, greatest(value, 0) FROM ranked WHERE stat IN ('depth_distribution', 'subreddit_distribution')""",
            """shown AS (SELECT stat, segment, CAST(key AS BIGINT) AS x, value FROM ranked
  WHERE stat NOT IN ('depth_distribution', 'subreddit_distribution')
    AND CASE stat WHEN 'thread_score_distribution' THEN ord BETWEEN -50 AND 400
                  WHEN 'thread_lengths' THEN ord <= 50 ELSE TRUE END)""",
        ),
        "unified_series": _on_stats(
            """SELECT a.family, a.stat, n.segment, a.x, greatest(coalesce(s.value, 0), 0) AS y
FROM (SELECT family, stat, unnest(range(min(x), max(x) + 1)) AS x FROM shown GROUP BY family, stat) a
JOIN (SELECT DISTINCT family, stat, segment FROM compared) n USING (family, stat)
LEFT JOIN shown s USING (family, stat, segment, x)""",
            COMPARED,
            """shown AS (SELECT * FROM compared WHERE CASE stat WHEN 'thread_score_distribution' THEN x BETWEEN -100 AND 400
  WHEN 'thread_lengths' THEN x BETWEEN 1 AND 50 ELSE x BETWEEN 1 AND 30 END)""",
        ),
        "single_series": _on_stats(
            """SELECT stat, segment, CAST(key AS BIGINT) AS x, greatest(value, 0) AS y FROM stats
WHERE segment = 'threads' AND CASE stat WHEN 'thread_score_distribution' THEN ord BETWEEN -10 AND 30
  WHEN 'thread_lengths' THEN ord BETWEEN 1 AND 10 WHEN 'author_distribution' THEN ord BETWEEN 1 AND 10 ELSE FALSE END"""
        ),
        "compare_segments": _on_stats("SELECT family, stat, segment, key, value FROM compared", COMPARED),
        # the whole study
        "thread_study": _sql(
            """SELECT stat, segment, 'average' AS measure, average AS value FROM averages
UNION ALL SELECT stat, segment, 'q1', CAST(q1 AS DOUBLE) FROM quartiles
UNION ALL SELECT stat, segment, 'q2', CAST(q2 AS DOUBLE) FROM quartiles
UNION ALL SELECT stat, segment, 'q3', CAST(q3 AS DOUBLE) FROM quartiles
UNION ALL SELECT stat, segment, 'iqr', CAST(iqr AS DOUBLE) FROM quartiles""",
            _tree(),
            CUTS,
            "kept AS (SELECT * FROM c2 WHERE connected)",
            _threads("kept"),
            _stats("kept", "c2"),
            QUARTILES,
            AVERAGES,
        ),
        "study_tables": _sql(
            """SELECT 'threads' AS table_name, posts AS a, path[1] AS b, array_to_string(path, '>') AS value FROM clean
UNION ALL SELECT 'segments', segment, ctp_id, array_to_string(path, '>') FROM seg
UNION ALL SELECT 'lookup', p.id, '', CAST(count(t.id) AS VARCHAR) FROM posts p LEFT JOIN kept t ON t.root_id = p.id GROUP BY p.id
UNION ALL SELECT 'nodes', id, parent_id, CAST(lvl AS VARCHAR) FROM c2
UNION ALL SELECT 'averages', stat, segment, CAST(round(average, 6) AS VARCHAR) FROM averages
UNION ALL SELECT 'quartiles', stat, segment, q1 || '/' || q2 || '/' || q3 FROM quartiles""",
            _tree(),
            CUTS,
            "kept AS (SELECT * FROM c2 WHERE connected)",
            _threads("kept"),
            _stats("kept", "c2"),
            QUARTILES,
            AVERAGES,
        ),
        "longest_thread_lengths": _on_tree(
            """SELECT length, count(*) AS threads FROM (SELECT max(lvl) + 1 AS length FROM tree GROUP BY ctp_id) GROUP BY length"""
        ),
    }
