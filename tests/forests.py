"""Literal discussions and a plain reading of the rules."""

POST_SCHEMA = "id string, title string, selftext string, subreddit string, score bigint, author string"
COMMENT_SCHEMA = "id string, body string, score bigint, author string, parent_id string"


def posts_frame(spark, ids, **fields):
    rows = [
        (i, fields.get("title", "t"), fields.get("selftext", "s"), fields.get("subreddit", "r"), fields.get("score", 1), fields.get("author", "op"))
        for i in ids
    ]
    return spark.createDataFrame(rows, POST_SCHEMA)


def comments_frame(spark, links):
    """Comments from ``(id, parent)`` pairs; a type prefix is put before the parent."""
    rows = [(i, "text", 1, "someone", None if p is None else "t1_" + p) for i, p in links]
    return spark.createDataFrame(rows, COMMENT_SCHEMA)


def attach(posts, links):
    """Place of every comment: level by level, the first level wins, then the smaller path and post."""
    posts = {p for p in posts if p is not None}
    links = {(i, p) for i, p in links if i is not None and p is not None}
    found = {}
    level = {i: min((([i], p) for j, p in links if j == i and p in posts), default=None) for i, _ in links}
    level = {i: place for i, place in level.items() if place}
    while level:
        found.update(level)
        following = {}
        for i, p in links:
            if i not in found and p in level and p not in posts:
                path, root = level[p]
                place = (path + [i], root)
                following[i] = min(place, following.get(i, place))
        level = following
    return {i: (root, tuple(path)) for i, (path, root) in found.items()}


def places(nodes):
    rows = nodes.collect()
    found = {r.id: (r.root_id, tuple(r.path)) for r in rows}
    assert len(found) == len(rows)
    for r in rows:
        assert r.lvl == len(r.path) - 1 and r.ctp_id == r.path[0] and r.path[-1] == r.id
        assert r.parent_id == (r.path[-2] if r.lvl else r.root_id)
    return found
