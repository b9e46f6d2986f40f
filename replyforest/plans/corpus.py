"""A discussion corpus and the tables derived from it, each staged once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforest.operators import filters, hierarchy, threads
from replyforest.session import stage


class Corpus:
    """Posts and comments, with the tables that all later steps read.

    Tables are written to the shared folder when they are first asked for.
    """

    def __init__(self, posts: DataFrame, comments: DataFrame, nodes: DataFrame | None = None):
        self.posts = posts
        self.comments = comments
        self._nodes = nodes

    @cached_property
    def nodes(self) -> DataFrame:
        """All attached comments."""
        if self._nodes is not None:
            return self._nodes
        return hierarchy.unroll(self.posts, self.comments)

    @cached_property
    def levels(self) -> int:
        """Number of comment levels."""
        deepest = self.nodes.agg(F.max("lvl")).first()[0]
        return 0 if deepest is None else deepest + 1

    @cached_property
    def threads(self) -> DataFrame:
        """The longest thread under each top-level comment."""
        return stage(threads.longest_threads(threads.all_threads(self.nodes)), "threads")

    @cached_property
    def facts(self) -> DataFrame:
        """The longest threads with all that filters and statistics need."""
        return stage(threads.thread_facts(self.threads, self.posts, self.comments), "facts")

    @property
    def clean(self) -> DataFrame:
        """The longest threads without withdrawn content."""
        return filters.without_withdrawn(self.facts)

    def cut_short_levels(self, min_rows: int = 100) -> Corpus:
        """Without the first level of fewer than ``min_rows`` comments, what is below and what leads there."""
        level = hierarchy.first_short_level(hierarchy.level_counts(self.nodes), min_rows)
        return Corpus(self.posts, self.comments, stage(hierarchy.cascade_prune(self.nodes, level), "nodes"))

    def cut_sparse_levels(self, min_ratio: float = 0.05) -> Corpus:
        """The same from the first level on that is sparse against the top level; unchanged if there is none."""
        level = hierarchy.first_sparse_level(hierarchy.level_counts(self.nodes), min_ratio).first().lvl
        if level is None:
            return self
        return Corpus(self.posts, self.comments, stage(hierarchy.cascade_prune(self.nodes, level), "nodes"))
