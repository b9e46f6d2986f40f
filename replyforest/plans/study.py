"""The whole study: from posts and comments to averages and quartiles of every segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforest.operators import filters, hierarchy, stats
from replyforest.operators.ranking import first_rows
from replyforest.plans.corpus import Corpus
from replyforest.operators.threads import lookup_long, lookup_table, widen
from replyforest.session import stage
from replyforest.sources import stats_store


@dataclass(frozen=True)
class Settings:
    """Fixed values of the study, open to change."""

    max_posts: int | None = None
    min_rows: int = 100
    min_ratio: float = 0.05
    viral: int = filters.VIRAL_SCORE
    top_n: int = 5
    author_counts: tuple[int, ...] = (2, 3, 4, 5)


@dataclass(frozen=True)
class Study:
    corpus: Corpus
    tagged: DataFrame
    row_counts: DataFrame
    families: DataFrame
    histograms: DataFrame
    averages: DataFrame
    quartiles: DataFrame
    label_quartiles: DataFrame


def top_communities(corpus: Corpus, n: int) -> list[str]:
    """Names of the communities with the most clean threads."""
    sizes = corpus.clean.groupBy("subreddit").agg(F.count("*").alias("number_of_posts"))
    known = sizes.where(F.col("subreddit").isNotNull())
    return [row.subreddit for row in stats.top_communities(known, n).collect()]


def families(corpus: Corpus, communities: list[str], settings: Settings) -> DataFrame:
    """The segments by family, a dozen rows."""
    rows = [("all", "threads"), ("virality", "threads_viral"), ("virality", "threads_non_viral")]
    rows += [("participants", f"threads_{count}_authors") for count in settings.author_counts]
    rows += [("subreddits", f"{name}_threads") for name in communities]
    return corpus.posts.sparkSession.createDataFrame(rows, "family string, segment string")


def tagged_threads(corpus: Corpus, communities: list[str], settings: Settings) -> DataFrame:
    """The clean threads with the segments they are in."""
    return filters.tagged(corpus.facts, communities, settings.author_counts, settings.viral)


def all_histograms(corpus: Corpus, settings: Settings, communities: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Histograms of all segments and of the lookups, and the list of segments by family."""
    communities = top_communities(corpus, settings.top_n) if communities is None else communities
    tagged = tagged_threads(corpus, communities, settings)
    histograms = stats.segment_histograms(tagged, corpus.levels).unionByName(
        stats.lookup_histograms(corpus.posts, corpus.nodes, communities)
    )
    return stage(histograms, "histograms"), families(corpus, communities, settings)


def save(result: Study, folder: str) -> None:
    """Writes the tables of a study.

    ``threads`` are the longest threads without withdrawn content, a column per level; ``segments`` has the same
    threads once for each segment they are in; ``lookup`` and ``nodes`` are those of the cut tree.  Histograms,
    averages and quartiles go to stores in which only the statistics of this study are replaced.
    """
    corpus = result.corpus
    stats_store.save(result.histograms, f"{folder}/stats")
    for name in ("averages", "quartiles", "label_quartiles"):
        stats_store.save_rows(getattr(result, name), f"{folder}/{name}")
    tables = {
        "row_counts": result.row_counts,
        "families": result.families,
        "threads": widen(corpus.clean, corpus.levels),
        "segments": filters.in_segments(result.tagged).select("family", "segment", "posts", "ctp_id", "path"),
        "lookup": lookup_table(corpus.posts, lookup_long(corpus.nodes), corpus.levels),
        "nodes": corpus.nodes,
    }
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def run(posts: DataFrame, comments: DataFrame, settings: Settings = Settings()) -> Study:
    """Attach, cut twice, choose threads, and count, average and rank each segment."""
    if settings.max_posts is not None:
        posts = first_rows(posts, settings.max_posts, "id")
    nodes = hierarchy.unroll(posts, comments, settings.min_rows)
    corpus = Corpus(posts, comments, nodes).cut_short_levels(settings.min_rows).cut_sparse_levels(settings.min_ratio)
    communities = top_communities(corpus, settings.top_n)
    histograms, by_family = all_histograms(corpus, settings, communities)
    ranked = histograms.where(F.col("stat") != "number_of_threads")
    return Study(
        corpus=corpus,
        tagged=tagged_threads(corpus, communities, settings),
        row_counts=stats.row_counts(posts, corpus.nodes),
        families=by_family,
        histograms=histograms,
        averages=stats.weighted_averages(ranked),
        quartiles=stats.weighted_quartiles(ranked),
        label_quartiles=stats.weighted_quartiles_labels(ranked),
    )
