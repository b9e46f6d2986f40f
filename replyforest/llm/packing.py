"""Best-fit packing of tokenised documents in bulk-synchronous rounds.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.  Pieces are sorted by length and numbered
among those of their length; the gaps of the sequences are sorted by size and numbered among those of their size.  A
round sweeps both orders from the largest down: every piece takes the smallest gap that is large enough and still
free, its successor, and where many want the same, their rank decides.  The sweep needs only how many there are of
each length and size, at most ``capacity`` numbers of either kind; from these the tasks tell each gap which ranks it
got.  Gaps shrink by what they took, and the next round begins.  A gap of several times the largest piece takes
several pieces in one round, so that rounds grow with the logarithm of the pieces in a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyforest.llm.common import numbered_in_groups, worker_cache
from replyforest.session import passing_folder, stage

CAPACITY = 4096
END = 1  # the id after the last one of a document
CACHED_WORDS = 450_000  # words with their ids that a worker keeps, twice at most
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # but no apostrophe, which may begin a word
SLOTS_AT_ONCE = 1 << 18
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


class WordIds:
    """Ids of words as little-endian bytes, kept in two generations so that frequent words stay.

    The tokenizer ignores case, drops white space, and no token crosses it, so a text has the ids of its words one
    after another.  Nor does a token cross from letters to marks, so a word with marks at its end has the ids of the
    word and those of the marks.

    Strings of the tokenizer's special tokens in a text are ordinary text, or get the ids of those tokens, as they
    do in the tokenizer ``as_loaded``.
    """

    def __init__(self, path: str, as_loaded: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not as_loaded
        # In lower case, as words are; a text in which a token's case differs must not have its words in lower case.
        added = self.tokenizer.get_added_tokens_decoder().values() if as_loaded else []
        self.added = [token.content.encode().lower() for token in added]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a run of letters
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encoded_runs(self, words: list[str]) -> list[bytes]:
        """The same for words of letters only, in one text; the ids tell where a word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words):
            return self._encoded(words)
        data, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
        return [data[i:j] for i, j in zip(starts, ends.tolist())]

    def _new(self, words: list[bytes]) -> None:
        for begin in range(0, len(words), 4096):
            some = words[begin : begin + 4096]
            texts = [word.decode() for word in some]
            runs = [i for i, text in enumerate(texts) if text.isalpha()]
            others = [i for i, text in enumerate(texts) if not text.isalpha()]
            for places, encoded in ((runs, self._encoded_runs), (others, self._encoded)):
                if places:
                    self.young.update(zip([some[i] for i in places], encoded([texts[i] for i in places])))

    def _learn(self, wanted: set[bytes]) -> None:
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        fresh = wanted - self.young.keys()
        again = fresh & self.old.keys()
        self.young.update((word, self.old[word]) for word in again)
        fresh -= again
        marked = {word: word.rstrip(MARKS) for word in fresh if word[-1] in MARKS}
        # Without letters before them, or with an apostrophe, marks are left to the tokenizer.
        marked = {word: core for word, core in marked.items() if core.isalpha()}
        parts = {word[len(core) :] for word, core in marked.items()} | set(marked.values()) | (fresh - marked.keys())
        self._new(list(parts - self.young.keys()))
        young = self.young
        young.update((word, young[core] + young[word[len(core) :]]) for word, core in marked.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        words: list[list[bytes] | None] = [None] * len(texts)
        for i, text in enumerate(texts):
            lower = (text or "").encode().lower()
            # White space of which tokenizers differ, or tokens that cross words.
            if text and ("\x0b" in text or "\x0c" in text or any(token in lower for token in self.added)):
                out[i] = self._encoded([text])[0]
            else:
                words[i] = lower.split()
        self._learn(set().union(*[w for w in words if w]))
        for i, own in enumerate(words):
            if own is not None:
                out[i] = b"".join(map(self.young.__getitem__, own))
        return out


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    with_ids: bool = False,
    as_loaded: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document, and ``ids`` on demand.

    Ids are those of the tokenizer file without special tokens, then ``END``; a null text has ``END`` alone.  A
    document of more than ``capacity`` ids is cut after every ``capacity`` of them.  With ``as_loaded``, a special
    token's string in a text has the id of that token, as in a plain call of the file's tokenizer.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        cache = worker_cache()
        key = "ids", tokenizer, as_loaded
        words = cache.get(key) or cache.setdefault(key, WordIds(tokenizer, as_loaded))
        end, size = np.array([END], "<u4").tobytes(), 4 * capacity
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                rows: list[tuple[int, int, int, int, int]] = []
                pieces: list[bytes] = []
                for i, ids in enumerate(words.encode(batch.column(1).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), size)):
                        piece = ids[at : at + size]
                        rows.append((i, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                        if with_ids:
                            pieces.append(piece)
                place, k, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
                columns = [batch.column(0).take(pa.array(place)), pa.array(k, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
                if with_ids:
                    ids = np.frombuffer(b"".join(pieces), "<u4").astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, ids))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {PIECES}" + ", ids array<int>" * with_ids
    return plain.mapInArrow(cut, schema)


class Sweep:
    """One round: which ranks of which lengths go to which ranks of gaps of which sizes.

    ``left`` and ``gaps`` count pieces by length and gaps by size; both are bounded by the capacity.
    """

    def __init__(self, left: dict[int, int], gaps: dict[int, int], begun: dict[int, int]):
        self.largest, smallest = max(left), min(left)
        self.gaps = {f: c for f, c in gaps.items() if f >= smallest}
        slots = []
        for free, count in self.gaps.items():
            slots.append((free - (self.times(free) - 1) * self.largest, free, 1, count))
            if self.times(free) > 1:
                slots.append((self.largest, free, 0, count * (self.times(free) - 1)))
        slots.sort()
        self.taken: dict[int, int] = {}
        found, open_slots = [], []
        for length in sorted(left, reverse=True):
            while slots and slots[-1][0] >= length:  # larger sizes first: the smallest that fits lies on top
                _, free, last, count = slots.pop()
                open_slots.append([free, last, count])
            rank, wanted = begun.get(length, 0), left[length]
            while wanted and open_slots:
                free, last, count = open_slots[-1]
                some = min(wanted, count)
                found.append((free * 2 + last, count - some, count, length, rank))
                rank, wanted, open_slots[-1][2] = rank + some, wanted - some, count - some
                if some == count:
                    open_slots.pop()
            if left[length] > wanted:
                self.taken[length] = left[length] - wanted
        self.found = np.array(sorted(found), np.int64).reshape(-1, 5)

    def times(self, free: int) -> int:
        return max(1, free // self.largest)

    def fill(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gaps ``(seq, free, rank)`` as ``(seq, free, lengths, ranks)`` after the round."""
        kind, low, high, length, rank = self.found.T
        starts = (kind << 40) + low
        largest, counts = self.largest, np.zeros(max(self.gaps, default=0) + 1, np.int64)
        for size, count in self.gaps.items():
            counts[size] = count
        for whole in batches:
            step = max(1, SLOTS_AT_ONCE // max(1, int(np.max(whole.column(1).to_numpy(), initial=1)) // largest))
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                free, place = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                times = np.maximum(1, free // largest)
                owner = np.repeat(np.arange(len(free)), times)
                slot = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
                last = slot == times[owner] - 1
                sizes = free[owner]
                of = np.where(sizes < len(counts), counts[np.minimum(sizes, len(counts) - 1)], 0)
                at = np.where(last, place[owner], slot * of + place[owner])
                own = sizes * 2 + last
                i = np.searchsorted(starts, (own << 40) + at, side="right") - 1
                hit = (i >= 0) & (of > 0)
                i = np.maximum(i, 0)
                if len(starts):
                    hit &= (kind[i] == own) & (at < high[i])
                    owner, i, at = owner[hit], i[hit], at[hit]
                    lengths, ranks = length[i], rank[i] + at - low[i]
                else:
                    owner, lengths, ranks = owner[:0], at[:0], at[:0]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(free)))]).astype(np.int32)
                used = np.bincount(owner, lengths, minlength=len(free)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(free - used), pa.ListArray.from_arrays(offsets, lengths), pa.ListArray.from_arrays(offsets, ranks)],
                    names=["seq", "free", "lengths", "ranks"],
                )


def _counts(df: DataFrame, column: str) -> dict[int, int]:
    """How often each length or size occurs; at most the capacity many."""
    return {row[0]: row[1] for row in df.groupBy(column).count().collect()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of 1 to ``capacity`` tokens with ``sequence_id`` and ``offset``, their place without gaps from 0.

    ``length`` tells the tokens of a piece; all other columns are carried along.  No sequence holds more than
    ``capacity`` tokens.  An empty table stays empty.
    """
    spark = pieces.sparkSession
    with passing_folder(spark, "packing") as steps:
        pieces = stage(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces", folder=steps)
        left = {length: n for length, n in _counts(pieces, "length").items() if length < capacity}
        small = sum(left.values())
        tokens = sum(length * n for length, n in left.items())
        begun: dict[int, int] = {}
        gaps, opened, tables = None, 0, []

        def more(of_tokens: int) -> DataFrame:
            nonlocal opened
            first, opened = opened, opened + -(-of_tokens // capacity)
            return spark.range(first, opened).select(F.col("id").alias("seq"), F.lit(capacity).cast("bigint").alias("free"))

        if left:
            gaps = more(tokens)
        sizes = {capacity: opened}
        while left:
            if max(sizes, default=0) < max(left):
                homeless = sum(length * n for length, n in left.items() if length > max(sizes, default=0))
                before, extra = opened, more(homeless)
                gaps = extra if gaps is None else gaps.unionByName(extra)
                sizes[capacity] = sizes.get(capacity, 0) + opened - before
            sweep = Sweep(left, sizes, begun)
            ranked = numbered_in_groups(gaps, "free", "seq", opened, "rank").select("seq", "free", "rank")
            filled = stage(ranked.mapInArrow(sweep.fill, "seq bigint, free bigint, lengths array<bigint>, ranks array<bigint>"), "gaps", folder=steps)
            tables.append(filled.where(F.size("lengths") > 0).select("seq", "lengths", "ranks"))
            for length, n in sweep.taken.items():
                begun[length] = begun.get(length, 0) + n
                left[length] -= n
            left = {length: n for length, n in left.items() if n}
            smallest = min(left, default=capacity)
            gaps = filled.where(F.col("free") >= smallest).select("seq", "free")
            sizes = _counts(gaps, "free") if left else {}
        whole = pieces.where(F.col("length") == capacity)
        whole = whole.withColumn("sequence_id", -1 - F.col("_piece")).withColumn("offset", F.lit(0).cast("bigint"))
        if not tables:
            return stage(whole.drop("_piece"), "packed")
        places = tables[0]
        for t in tables[1:]:
            places = places.unionByName(t)
        places = places.select("seq", F.explode(F.arrays_zip("lengths", "ranks")).alias("p"))
        places = places.select(F.col("seq").alias("sequence_id"), F.col("p.lengths").alias("length"), F.col("p.ranks").alias("_rank"))
        ranked = numbered_in_groups(pieces.where(F.col("length") < capacity), "length", "_piece", small, "_rank")
        # A sequence holds at most capacity pieces, so its window is bounded.
        before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_piece").rowsBetween(Window.unboundedPreceding, -1)
        placed = ranked.join(places, ["length", "_rank"]).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))
        columns = [*[c for c in pieces.columns if c != "_piece"], "sequence_id", "offset"]
        return stage(placed.select(columns).unionByName(whole.select(columns)), "packed")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    with_ids: bool = False,
    as_loaded: bool = False,
) -> DataFrame:
    """Tokenises, cuts and packs all documents: ``token_pieces`` with ``sequence_id`` and ``offset``.

    One row per piece; null and empty texts are one id long, ids that are null or repeat are packed like others,
    other columns are not read, an empty table gives no rows.
    """
    return pack(token_pieces(docs, tokenizer, text, doc_id, capacity, with_ids, as_loaded), capacity)
