"""Spelling variants: words one letter apart, found by an index of grams of variable length.

Grams of two to four characters are counted over all words, each between two marks; the frequent ones are the
dictionary.  A word is decomposed from every place into the shortest gram that is not frequent (at most ``LONGEST``),
without those that lie inside another.  For every word it is known how many of its grams one edit can touch at most, so
that two words one edit apart share all others.  Of each word only so many of its rarest grams are merged that a pair
must meet under one of them; pairs that meet are verified.  Words that one edit may rob of all grams meet each other
under the word and its deletions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforest.llm.common import crc32_of_text
from replyforest.session import passing_folder, stage, stage_and_count

SHORTEST, LONGEST = 2, 4  # characters of a gram
SHARE = 20_000  # a gram is frequent when it holds more than this part of all places, so no length has more of them
LEAST_LENGTH, LEAST_COUNT = 5, 3
THINNED = 97
BEGIN, END = "\x02", "\x03"  # no word holds them
WORDS_PER_BATCH = 4096


def words_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n``: how often every word of at least five code points occurs, where that is three times or more.

    A word is a run of Latin letters with A-Z in lower case.  Where 97 divides the checksum of ``<doc_id>:<run>`` its
    remainder by the run's length tells the letter that is missing.  Null texts have no words; runs of a null id are
    left as they are.
    """
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}+"), F.lit(0))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run"))
    found = docs.select(F.col(f"`{doc_id}`").alias("id"), F.explode(runs).alias("run")).select("id", plain.alias("run"))
    found = found.select("run", crc32_of_text(F.concat(F.col("id").cast("string"), F.lit(":"), "run")).alias("h"))
    place = F.pmod("h", F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % THINNED == 0, without).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word")
    return counted.agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Grams:
    """The dictionary: how many places every frequent gram holds."""

    def __init__(self, counts: dict[str, int], least: int):
        self.counts, self.least = counts, least
        # What a gram that begins before an edit may hold of the letters behind it.
        self.tails = {g[k:] for g in counts for k in range(1, len(g) - SHORTEST + 2)}

    def decompose(self, word: str) -> tuple[str, list[int], list[int]]:
        """The word between its marks, and where its grams start and end."""
        text = BEGIN + word + END
        size, frequent = len(text), self.counts
        starts, ends, last = [], [], 0
        for start in range(size - SHORTEST + 1):
            end = start + SHORTEST
            while end < size and end - start < LONGEST and text[start:end] in frequent:
                end += 1
            if end > last:
                starts.append(start)
                ends.append(end)
                last = end
        return text, starts, ends

    def untouched(self, text: str, starts: list[int], ends: list[int]) -> int:
        """How many grams any single edit leaves at least.

        Grams that end before the edit stay, as their letters alone decide on them.  Grams that begin behind it stay
        unless a gram from before it can reach their ends.
        """
        size, fewest = len(text), len(starts)
        for behind in range(1, size):
            reach = behind + SHORTEST - 1
            for end in range(min(behind + LONGEST - 1, size), reach, -1):
                if text[behind : end - 1] in self.tails:
                    reach = end
                    break
            right = len(starts) - max(bisect_left(starts, behind), bisect_right(ends, reach))
            left = bisect_right(ends, behind)  # an insertion before ``behind``
            if behind > 1:
                left = min(left, bisect_right(ends, behind - 1))  # a change or deletion of the letter there
            fewest = min(fewest, left + right)
        return fewest

    def rarity(self, gram: str) -> float:
        """About how many places a gram holds; of rare ones only their parts were counted."""
        if gram in self.counts or len(gram) == SHORTEST:
            return self.counts.get(gram, 0)
        get = self.counts.get
        return get(gram[:-1], self.least) * get(gram[1:], self.least) / get(gram[1:-1], self.least**2)

    def entry(self, word: str) -> tuple[int, list[str], list[int]]:
        """How many grams stay under any edit, and the rarest, with their places, that have to be merged."""
        text, starts, ends = self.decompose(word)
        stay = self.untouched(text, starts, ends)
        grams = sorted((self.rarity(text[s:e]), text[s:e], s) for s, e in zip(starts, ends))
        grams = grams[: len(grams) - max(stay, 1) + 1]
        return stay, [g for _, g, _ in grams], [s for _, _, s in grams]


def dictionary(words: DataFrame, share: int = SHARE) -> Grams:
    """The frequent grams of ``words (word)``.

    At most ``share`` of either length come to the driver, as each holds more than that part of all places.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["gram", "places"])

        for batch in batches:
            for word in batch.column(0).to_pylist():
                text = BEGIN + word + END
                for size in range(SHORTEST, LONGEST):
                    seen.update(text[i : i + size] for i in range(len(text) - size + 1))
                if len(seen) > 1 << 18:
                    yield rows()
                    seen.clear()
        yield rows()

    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    least = places // share
    grams = words.select("word").mapInArrow(counted, "gram string, places bigint")
    grams = grams.groupBy("gram").agg(F.sum("places").alias("places")).where(F.col("places") > least)
    return Grams({row.gram: row.places for row in grams.toLocalIterator()}, max(least, 1))


def _entries(words: DataFrame, grams: Grams) -> DataFrame:
    """``words`` with ``stay``, and the ``grams`` to merge with their ``places``."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, WORDS_PER_BATCH):
                part = batch.slice(begin, WORDS_PER_BATCH)
                stay, found, places = zip(*[grams.entry(w) for w in part.column(0).to_pylist()])
                columns = [part.column(0), part.column(1), pa.array(stay, pa.int32())]
                columns += [pa.array(found, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "stay", "grams", "places"])

    return words.mapInArrow(entries, "word string, n bigint, stay int, grams array<string>, places array<int>")


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs under one key that differ by exactly one edit; of two words of one length the smaller one comes first."""
    a, b = F.col("a"), F.col("b")
    left = left.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = right.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    ordered = (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a < b))
    near = (F.levenshtein(a, b, 1) == 1) & ordered
    return left.join(right, (left["key"] == right["key"]) & near).select("a", "n_a", "b", "n_b")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b`` for every two words of ``words (word, n)``, all distinct, that are one edit apart, once.

    ``a`` is the shorter word, or the smaller of two of one length.  A shared gram stands at the same place in both, or
    one further in the longer word, so a key is a gram, its place and the length of a word.
    """
    with passing_folder(words.sparkSession, "grams") as folder:
        entries = stage(_entries(words, dictionary(words)), "entries", folder=folder)
        size = F.length("word")
        gram = F.explode(F.arrays_zip("grams", "places")).alias("gram")
        merged = entries.select("word", "n", size.alias("size"), gram).select("word", "n", "size", "gram.grams", "gram.places")

        def key(further: int, longer: int) -> Column:
            return F.xxhash64("grams", F.col("places") + further, F.col("size") + longer)

        lists = merged.select(key(0, 0).alias("key"), "word", "n")
        probes = merged.select(F.explode(F.array(key(0, 0), key(0, 1), key(1, 1))).alias("key"), "word", "n")
        # Two words of which neither surely shares a gram with the other.
        rest = entries.where("stay <= 0")
        places = F.sequence(F.lit(0), size)
        shorter = F.transform(places, lambda i: F.concat(F.substring("word", F.lit(1), i), F.substring(F.col("word"), i + 2, size)))
        shorter = rest.select(F.explode(F.array_distinct(shorter)).alias("part"), "word", "n").select(F.xxhash64("part").alias("key"), "word", "n")
        pairs = _meet(probes, lists).unionByName(_meet(shorter, shorter))
        return stage(pairs.distinct(), "near")


def variants(words: DataFrame) -> DataFrame:
    """Each of ``words (word, n)`` with ``form, root, n_near, form_n``.

    ``form`` is the near word of largest n, of several the smallest in code-point order, if it occurs at least twice as
    often; ``root`` is where the forms end.  A form occurs twice as often as its word, so chains are as long as the
    logarithm of a count, and are followed by doubling.  Words are distinct; an empty table has no rows.
    """
    spark = words.sparkSession
    near = near_pairs(words)
    one = near.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
    )))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    of_word = one.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(of_word, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= 2 * F.col("n")
    formed = stage(
        joined.select(
            "word",
            F.when(is_form, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "formed",
    )
    with passing_folder(spark, "roots") as folder:
        steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
        open_rows = 1
        while open_rows:
            onward = steps.select(F.col("word").alias("root"), F.col("root").alias("onward"))
            onward = steps.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("went"))
            steps, open_rows = stage_and_count(onward, "steps", F.col("went"), folder=folder)
        steps = steps.select("word", "root")
        return stage(formed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``docs``; see ``words_of`` and ``variants``.

    Repeated rows count as often as they are there.  Other columns are not read, so their names don't matter.
    """
    words = stage(words_of(docs, text, doc_id), "words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
