"""Runs the study on two dumps, CSV or JSON lines: ``python -m replyforest posts comments folder``."""

from __future__ import annotations

import argparse

from replyforest.plans import study
from replyforest.schemas import RAW_COMMENT_FIELDS, RAW_POST_FIELDS
from replyforest.session import build_session, grow_shuffles, remove, scratch_root
from replyforest.sources.tables import comments_of_dump, load_comments, load_posts, overwrite, posts_of_dump


def main() -> None:
    defaults = study.Settings()
    parser = argparse.ArgumentParser(prog="replyforest", description="Statistics of threaded discussions.")
    parser.add_argument("posts", help="dump of posts")
    parser.add_argument("comments", help="dump of comments")
    parser.add_argument("folder", help="where the tables go")
    parser.add_argument("--jsonl", action="store_true", help="the dumps are JSON lines, not CSV")
    parser.add_argument("--max-posts", type=int, default=defaults.max_posts)
    parser.add_argument("--min-rows", type=int, default=defaults.min_rows)
    parser.add_argument("--min-ratio", type=float, default=defaults.min_ratio)
    parser.add_argument("--viral", type=int, default=defaults.viral)
    parser.add_argument("--top", type=int, default=defaults.top_n)
    options = parser.parse_args()

    spark = build_session()
    # Dumps are read once; everything after works on columns of Parquet.
    if options.jsonl:
        posts, comments = posts_of_dump(spark, options.posts), comments_of_dump(spark, options.comments)
    else:
        posts = load_posts(spark, options.posts, RAW_POST_FIELDS)
        comments = load_comments(spark, options.comments, RAW_COMMENT_FIELDS)
    posts = overwrite(posts, f"{options.folder}/posts")
    comments = overwrite(comments, f"{options.folder}/comments")
    grow_shuffles(spark, f"{options.folder}/posts", f"{options.folder}/comments")
    settings = study.Settings(options.max_posts, options.min_rows, options.min_ratio, options.viral, options.top)
    study.save(study.run(posts, comments, settings), options.folder)
    remove(spark, scratch_root(spark))


if __name__ == "__main__":
    main()
