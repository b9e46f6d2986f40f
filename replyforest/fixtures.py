"""Discussions derived from the given tables; the same text runs in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AUTHOR = "CASE WHEN user_id%25=0 THEN '[deleted]' WHEN event_id%37=0 THEN NULL ELSE 'u'||(user_id%3) END"

FOREST_POSTS = f"""
  SELECT 'e'||event_id AS id, 'title '||event_id AS title,
         CASE WHEN event_id%31=0 THEN '[removed]' ELSE props END AS selftext,
         'sub'||(user_id%12) AS subreddit, CAST(floor(value*20) AS BIGINT) AS score, {AUTHOR} AS author
  FROM {{events}} WHERE event_id%20=0"""

FOREST_COMMENTS = f"""
  SELECT 'e'||event_id AS id, CASE WHEN event_id%31=0 THEN '[removed]' ELSE props END AS body,
         CAST(floor(value) AS BIGINT)-20 AS score, {AUTHOR} AS author,
         (CASE WHEN p%20=0 THEN 't3_' ELSE 't1_' END)||'e'||p AS parent_id
  FROM (SELECT *, event_id-1-(((event_id*2654435761)%4294967296) {{div}} 65536)%(event_id%20) AS p
        FROM {{events}} WHERE event_id%20<>0)"""

CHAIN_POSTS = """
  SELECT 'c'||conv_id||'_0' AS id, 'conversation '||conv_id AS title, text AS selftext, role AS subreddit,
         CAST(length(text)*7%2000 AS BIGINT) AS score, role AS author
  FROM {conversations} WHERE turn=0"""

CHAIN_COMMENTS = """
  SELECT 'c'||conv_id||'_'||turn AS id, text AS body, CAST(length(text)%100 AS BIGINT) AS score, role AS author,
         (CASE WHEN turn=1 THEN 't3_' ELSE 't1_' END)||'c'||conv_id||'_'||(turn-1) AS parent_id
  FROM {conversations} WHERE turn>0"""


def _from_table(spark: SparkSession, sf_dir: str, table: str, text: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text.format(div="div", **{table: "{rows}"}), rows=rows)


def forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Posts and comments of branching trees, from ``events``."""
    return _from_table(spark, sf_dir, "events", FOREST_POSTS), _from_table(spark, sf_dir, "events", FOREST_COMMENTS)


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Posts and comments of unbranched chains, from ``conversations``."""
    return (
        _from_table(spark, sf_dir, "conversations", CHAIN_POSTS),
        _from_table(spark, sf_dir, "conversations", CHAIN_COMMENTS),
    )
