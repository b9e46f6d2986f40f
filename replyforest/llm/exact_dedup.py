"""Exact deduplication by recipes of content-defined chunks.

A text is cut where its content says so, every distinct chunk gets one identifier that SHA-256 and the length
of the chunk verify, and two texts are equal when their ordered lists of identifiers are.  Texts are read once:
from then on only digests, numbers and lists of numbers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforest.llm.common import rows_that_stay, text_of
from replyforest.session import passing_folder, stage

WHITE = r"[\x20\x09-\x0D]+"
SHORTEST, LONGEST = 512, 8192  # characters of a chunk; the last chunk of a text may be shorter


def normalised(text: Column) -> Column:
    """Runs of white space as one space; null as empty."""
    return F.regexp_replace(text_of(text), WHITE, " ")


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text in chunks that end after the first sentence end beyond ``shortest`` characters.

    Without a sentence end up to ``longest`` characters the chunk ends there.  An empty text is one empty chunk.
    """
    pattern = rf"(?s).{{{shortest},{longest}}}?(?<=[.!?]) |.{{1,{longest}}}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def weak_digest(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shortest: int = SHORTEST,
    longest: int = LONGEST,
    digest=weak_digest,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after every run of ASCII white space became one space; null counts as
    empty, and all empty texts are one group.  Of a group the row with the smallest id stays (null ids come last);
    of rows that repeat this id one stays.  Other columns are not read, an empty table gives no rows.  ``digest``
    groups chunks before they are compared; chunks that share a digest but differ get different identifiers.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), normalised(F.col(f"`{text}`")).alias("t"))
    cut = F.transform(
        chunks(F.col("t"), shortest, longest),
        lambda c: F.struct(
            digest(c).alias("digest"), F.octet_length(c).alias("length"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("sha")
        ),
    )
    folder = passing_folder(spark, "exact")
    with folder as steps:
        rows = stage(
            plain.select(
                F.monotonically_increasing_id().alias("row"),
                "id",
                F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"),
                cut.alias("chunks"),
            ),
            "rows",
            folder=steps,
        )
        # A text of one chunk and a text of many go the same way: one row per chunk, in order.
        pieces = rows.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", "c.*")
        # Chunks of one digest are compared by length and SHA-256.  The place where a chunk occurs first, as a pair
        # of row and position, is no other chunk's first place, so its number names the chunk.
        known = pieces.groupBy("digest", "length", "sha").agg(F.min(F.struct("row", "pos")).alias("first"), F.count("*").alias("times"))
        repeated = known.where("times > 1").select("digest", "length", "sha", "first")
        # Chunks that occur once name themselves, so only repeated ones are looked up.
        named = pieces.join(repeated, ["digest", "length", "sha"], "left")
        named = named.select("row", "pos", F.coalesce("first", F.struct("row", "pos")).alias("chunk"))
        recipe = F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"])
        recipes = stage(named.groupBy("row").agg(recipe.alias("recipe")), "recipes", folder=steps)
        # The smallest id of a group; the row number tells rows of one id apart.
        order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
        listed = recipes.join(rows.select("row", "id", "text_sha256"), "row")
        groups = listed.groupBy("recipe").agg(F.min(order).alias("keep"), F.count("*").alias("group_size"))
        large = groups.where("group_size > 1")
        result = listed.join(large, "recipe", "left").select(
            F.col("id").alias("doc_id"),
            F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
            (F.col("keep").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
            "text_sha256",
        )
        return stage(result, "exact")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, found by id and normalised text.
    """
    decided = exact_dedup(docs, text, doc_id).select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return rows_that_stay(docs, doc_id, F.sha2(normalised(F.col(f"`{text}`")).cast("binary"), 256), decided)
