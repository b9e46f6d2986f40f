"""Byte-level BPE with higher-order functions.

A word is an array of ids, at first one for each byte; a fold merges the pair of neighbours with the smallest rank,
the leftmost of equal ones, until no two can be merged.  The ranks are literals of the plan: a token's id is its rank,
and a flat hash table holds the rank of every pair of ids that make a token.

Texts are read once and split by Spark's regular expressions.  Some texts form a block, whose distinct words have numbers,
and a text is kept as the numbers of its words.  A block's words are dealt into lots by their hash; the same lot of all
blocks meets in one partition, so that every distinct word is folded once, and its ids go back to the blocks that hold it.
Words and ids travel as one packed row for each block and lot.  The kept texts lie in buckets by block and are not shuffled.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from itertools import batched
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyforest.llm.common import give_back_memory, text_of, worker_cache
from replyforest.session import scratch_path

BLOCK_WORDS = 1 << 19  # a block ends with the text that gives it so many distinct words,
BLOCK_LENGTH = 3 << 21  # or so many words,
BLOCK_BYTES = 1 << 27  # or so many bytes
LONG = 1 << 20  # characters: longer texts are split piece by piece, not in an array of all their words
DEALT = 4096  # words folded in a row, words of a text looked up at once
WRITTEN = 1 << 20  # words of texts in a batch, at least
DECODED = 1 << 20  # bytes of decoded texts in a batch, at least
JOINED = 1 << 22  # characters of joined ids in a chunk, at least
RANK_BITS = 20
NO_RANK = (1 << RANK_BITS) - 1  # of two ids that make no token
ID_BITS = 16
FACTORS = (1640531527, 2024237689)  # of the two hashes of a pair
GIANT = 256  # bytes: longer words are encoded by the library, as a fold takes the square of a word's length


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankTable:
    """Ranks of pairs of ids that make a token, in flat cells; a pair is in one of two that hashes of it give.

    A cell holds ``pair << RANK_BITS | rank``, with ``left << 16 | right`` for the pair.
    """

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ranks up to 65535 only")
        self.mask = (1 << max(8, (2 * len(pairs)).bit_length())) - 1
        cells = [-1] * (self.mask + 1)
        for pair, rank in pairs.items():
            cell, place = pair << RANK_BITS | rank, self.places(pair)[0]
            for _ in range(1000):
                cell, cells[place] = cells[place], cell
                if cell < 0:
                    break
                a, b = self.places(cell >> RANK_BITS)
                place = b if place == a else a
            else:
                raise ValueError("the table is too full")
        self.cells = np.array(cells, np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # The first ranks of a word are those of pairs of bytes, which need no hash.
        two = [ranks.get(bytes([a, b]), NO_RANK) for a in range(256) for b in range(256)]
        self.byte_pairs = np.array(two, np.int64)

    def places(self, pair):
        """The cells in which a pair may be; the same for numbers and columns."""
        both = [pair * factor for factor in FACTORS]
        if isinstance(pair, Column):
            return [F.shiftright(x, 24).bitwiseAND(F.lit(self.mask)).cast("int") for x in both]
        return [(x >> 24) & self.mask for x in both]


def _numbers(values: np.ndarray, kind: str) -> Column:
    """An array literal; the optimizer folds it before anything runs."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def _with_table(table: RankTable, body) -> Column:
    """``body`` of the table's arrays, each of which is one literal of the plan."""
    arrays = F.struct(
        _numbers(table.cells, "bigint").alias("cells"), _numbers(table.bytes, "int").alias("bytes"), _numbers(table.byte_pairs, "int").alias("pairs")
    )
    one = F.transform(F.array(arrays), lambda t: _let(t["cells"], lambda c: _let(t["bytes"], lambda b: _let(t["pairs"], lambda p: body(c, b, p)))))
    return one[0]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fold(word: Column, table: RankTable, cells: Column, of_byte: Column, byte_pairs: Column) -> Column:
    """The ids of a word; ``cells``, ``of_byte`` and ``byte_pairs`` are the table's arrays.

    While it is folded, an id shares a number with the rank of the pair that begins with it.
    """
    none = F.lit(NO_RANK).cast("bigint")

    def id_of(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("bigint"))

    def rank(pair: Column) -> Column:
        def of_pair(pair: Column) -> Column:
            hit = [_let(cells[p], lambda c: F.when(F.shiftright(c, RANK_BITS) == pair, c.bitwiseAND(none))) for p in table.places(pair)]
            return F.coalesce(*hit, none)

        return _let(pair, of_pair)

    def merge(state: Column, _: Column) -> Column:
        """Only the pairs on both sides of the merged one get new ranks."""

        def at(least: Column, p: Column) -> Column:
            left = rank(id_of(F.get(state, p - 1)) * (1 << ID_BITS) + least)
            right = rank(least * (1 << ID_BITS) + id_of(F.get(state, p + 2)))
            rest = F.filter(state, lambda _, i: i != p + 1)
            changed = lambda x, i: F.when(i == p, right * (1 << ID_BITS) + least).when(i == p - 1, left * (1 << ID_BITS) + id_of(x))
            return F.transform(rest, lambda x, i: changed(x, i).otherwise(x))

        def found(least: Column) -> Column:
            place = F.array_position(F.transform(state, lambda x: F.shiftright(x, ID_BITS)), least) - 1
            return F.when(least == none, state).otherwise(_let(place.cast("int"), lambda p: at(least, p)))

        return _let(F.shiftright(F.array_min(state), ID_BITS), found)

    # One character per byte.
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    single = F.transform(F.split(latin, ""), lambda c: F.ascii(c))

    def folded(values: Column) -> Column:
        first = lambda b, i: F.coalesce(byte_pairs[b * 256 + F.get(values, i + 1)].cast("bigint"), none)
        begin = F.transform(values, lambda b, i: first(b, i) * (1 << ID_BITS) + of_byte[b])
        ids = lambda s: F.transform(s, lambda x: id_of(x).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), F.size(values)), begin, merge, ids)

    return _let(single, folded)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as four bytes each, all lowest bytes first, as high ones are nearly all zero."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers_of(held: bytes | memoryview | pa.Buffer) -> np.ndarray:
    """The numbers that ``_planes`` wrote."""
    return np.frombuffer(held, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _pack(sizes: np.ndarray, data: bytes | memoryview) -> bytes:
    """Sizes of things and the things, one after another."""
    return zlib.compress(b"".join([len(sizes).to_bytes(4, "little"), _planes(sizes), data]), 1)


def _unpack(held: bytes) -> tuple[np.ndarray, memoryview]:
    whole = memoryview(zlib.decompress(held))
    data = 4 + 4 * int.from_bytes(whole[:4], "little")
    return _numbers_of(whole[4:data]), whole[data:]


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``begins``, one run after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(sizes.sum())


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Sizes and bytes of strings without nulls."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.diff(ends), memoryview(data or b"")[int(ends[0]) : int(ends[-1])]


def _distinct(words: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, in order of their first places, and the number of each word among them."""
    coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _split(docs: DataFrame, pattern: str) -> DataFrame:
    """``doc_id, rest, words`` of ``docs (doc_id, text)``: the words, or the text if its words are left to Python.

    That is so for long texts, and for those with characters that the JVM's Unicode tables don't know yet.
    """
    unknown = (F.octet_length("text") > F.length("text")) & F.col("text").rlike(r"\p{Cn}")
    rest = F.when((F.length("text") > LONG) | unknown, F.col("text"))
    words = F.when(F.col("rest").isNull(), F.regexp_extract_all("text", F.lit(f"(?U){pattern}"), F.lit(0)))
    return docs.withColumn("rest", rest).select("doc_id", "rest", words.alias("words"))


def _in_blocks(docs: DataFrame, pattern: str, block_words: int, lots: int) -> DataFrame:
    """``block, doc_id, codes, lots, lot, words`` of ``docs (doc_id, text)``.

    A row holds either a text, as the numbers of its words, or the lot of each word of its block, or the words of a lot, packed.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, doc_id {kind}, codes binary, lots binary, lot int, words binary"
    names = ["block", "doc_id", "codes", "lots", "lot", "words"]

    def pieces(batch: pa.RecordBatch, find) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
        """Ids of texts, their numbers of words, and all these words."""
        ids, rest, words = batch.columns
        alone, begin = np.flatnonzero(rest.is_valid().to_numpy(zero_copy_only=False)).tolist(), 0
        for i in [*alone, len(batch)]:
            # Not more texts at once than make a block.
            sizes = np.diff(words.offsets.to_numpy()[begin : i + 1])
            ends = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_LENGTH)) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(sizes)]):
                if b > a:
                    yield ids.slice(begin + a, b - a), sizes[a:b], words.slice(begin + a, b - a).flatten()
            if i < len(batch):
                found = map(itemgetter(0), find(rest[i].as_py()))
                own = pa.concat_arrays([pa.array([], pa.string()), *(pa.array(some, pa.string()) for some in batched(found, DEALT))])
                yield ids.slice(i, 1), np.array([len(own)]), own
            begin = i + 1

    def rows(block: int, kind: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
        """A batch with nulls in all other columns."""
        count = len(next(iter(columns.values())))
        kinds = dict(zip(names, [pa.int64(), kind, pa.binary(), pa.binary(), pa.int32(), pa.binary()]))
        columns["block"] = pa.array(np.full(count, block))
        return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(count, kinds[n]) for n in names], names=names)

    def written(block: int, ids: pa.Array, sizes: np.ndarray, codes: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff(ends // WRITTEN)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            held = [_planes(codes[e - n : e]) for e, n in zip(ends[a:b].tolist(), sizes[a:b].tolist())]
            yield rows(block, ids.type, doc_id=ids.slice(a, b - a), codes=pa.array(held, pa.binary()))
        lot = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.uint32, len(words)) % lots
        yield rows(block, ids.type, lots=pa.array([_planes(lot)], pa.binary()))
        order = np.argsort(lot, kind="stable")
        dealt, cuts = words.take(pa.array(order)), np.searchsorted(lot[order], np.arange(lots + 1))
        full = np.flatnonzero(np.diff(cuts))
        held = [_pack(*_bytes_of(dealt.slice(cuts[n], cuts[n + 1] - cuts[n]))) for n in full.tolist()]
        yield rows(block, ids.type, lot=pa.array(full, pa.int32()), words=pa.array(held, pa.binary()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, block, waiting = regex.compile(pattern).finditer, TaskContext.get().partitionId() << 32, []

        def ended(last: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of the texts that wait; all of them at the end."""
            nonlocal block, waiting
            while waiting and (last or sum(map(len, (w for _, _, w in waiting))) >= BLOCK_LENGTH or sum(w.nbytes for _, _, w in waiting) >= BLOCK_BYTES):
                ids, sizes = pa.concat_arrays([i for i, _, _ in waiting]), np.concatenate([s for _, s, _ in waiting])
                words, codes = _distinct([w for _, _, w in waiting])
                texts, most = len(ids), len(words)
                if most > block_words:
                    # Numbers rise with first places, so the highest so far tells how many words there are.
                    ends = np.cumsum(sizes)
                    seen = np.concatenate([[0], np.maximum.accumulate(codes) + 1])[ends]
                    texts = int(np.searchsorted(seen, block_words)) + 1
                    most, own = int(seen[texts - 1]), int(ends[texts - 1])
                    left = [(ids.slice(texts), sizes[texts:], words.take(pa.array(codes[own:])))] if texts < len(ids) else []
                    codes = codes[:own]
                else:
                    left = []
                waiting = left
                yield from written(block, ids.slice(0, texts), sizes[:texts], codes, words.slice(0, most))
                block += 1

        for batch in batches:
            for piece in pieces(batch, find):
                waiting.append(piece)
                yield from ended(False)
        yield from ended(True)
        give_back_memory()

    return _split(docs, pattern).mapInArrow(split, schema)


def _in_buckets(blocks: DataFrame) -> DataFrame:
    """``blocks``, written in buckets by block to the shared folder; what joins them by block comes to them."""
    spark, name = blocks.sparkSession, f"byte_bpe_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = blocks.write.bucketBy(buckets, "block").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    read = spark.table(name)
    # The files stay, and who reads them already knows their buckets.
    spark.sql(f"DROP TABLE {name}")
    return read


def _library(path: str, pattern: str):
    """The library's encoder, which a worker makes once."""
    import tiktoken

    cache = worker_cache()
    if (path, pattern) not in cache:
        cache[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return cache[path, pattern]


def _folded_lots(words: DataFrame, table: RankTable, path: str, pattern: str) -> DataFrame:
    """``of_block, lot, ids`` of ``words (block, lot, words)``: the ids of the words, packed in their order.

    All rows of a lot are in one partition, where each distinct word is folded once.  Three steps follow one another
    on the rows of a partition: distinct words and where they go, the fold, and the ids of each row.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lots, parts = [], [], []
        for batch in batches:
            blocks += batch.column(0).to_pylist()
            lots += batch.column(1).to_pylist()
            for held in batch.column(2):
                sizes, data = _unpack(held.as_py())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                parts.append(pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data)))
        if not parts:
            return
        known, codes = _distinct(parts)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        del parts
        none, names = pa.nulls, ["block", "lot", "picks", "words"]
        for at in range(0, len(known), DEALT):
            some = known.slice(at, DEALT)
            lists = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
            yield pa.RecordBatch.from_arrays([none(1, pa.int64()), none(1, pa.int32()), none(1, pa.binary()), lists], names=names)
        for block, lot, picks in zip(blocks, lots, np.split(codes, ends)):
            row = [pa.array([block]), pa.array([lot], pa.int32()), pa.array([picks.tobytes()], pa.binary()), none(1, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(row, names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, sizes, begins = [], [], None
        for batch in batches:
            for i, picks in enumerate(batch.column(2)):
                if not picks.is_valid:
                    ids, giant = batch.column(3)[i].values, iter(batch.column(4)[i].as_py())
                    own, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy().astype(np.uint16)
                    for at in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist():
                        found = np.array(_library(path, pattern).encode_ordinary(next(giant)), np.uint16)
                        place = own[:at].sum()
                        own[at], flat = len(found), np.concatenate([flat[:place], found, flat[place:]])
                    values.append(flat)
                    sizes.append(own.astype(np.int64))
                    continue
                if begins is None:
                    values, sizes = np.concatenate(values), np.concatenate(sizes)
                    begins = np.cumsum(sizes) - sizes
                chosen = np.frombuffer(picks.as_buffer(), np.int32)
                held = _pack(sizes[chosen], values[_runs(begins[chosen], sizes[chosen])].tobytes())
                row = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([held], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["of_block", "lot", "ids"])

    usual = lambda w: F.octet_length(w) <= GIANT
    ids = _with_table(table, lambda *arrays: F.transform("words", lambda w: F.when(usual(w), fold(w, table, *arrays))))
    steps = words.mapInArrow(distinct, "block bigint, lot int, picks binary, words array<string>")
    steps = steps.select("block", "lot", "picks", F.when(F.col("words").isNotNull(), ids).alias("ids"), F.filter("words", lambda w: ~usual(w)).alias("giant"))
    return steps.mapInArrow(packed, "of_block bigint, lot int, ids binary")


def fold_words(words: DataFrame, table: RankTable) -> DataFrame:
    """``words (block, number, word)`` with ``ids`` in place of the word, which is folded once however many blocks hold it.

    For words that come as rows; ``encode`` folds them in lots.  The first row of a word folds it, the others take the ids
    over, row by row.
    """
    rows = Window.partitionBy("word").orderBy("block")
    ids = F.when(F.row_number().over(rows) == 1, _packed(_with_table(table, lambda *arrays: fold(F.col("word"), table, *arrays))))
    first = F.first("ids", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return words.withColumn("ids", ids).select("block", "number", first.alias("ids"))


def _packed(ids: Column) -> Column:
    """Ids as two bytes each, high ones first."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 4, "0")), ""))


def _with_ids(coded: pa.Table, known: pa.Table) -> pa.Table:
    """``doc_id, ids`` of the texts of a block, from the ids of its words."""
    parts = [_unpack(held.as_py()) for held in known.sort_by("lot").column("ids")]
    values = np.concatenate([np.empty(0, np.uint16), *(np.frombuffer(data, np.uint16) for _, data in parts)])
    lengths = np.concatenate([np.empty(0, np.int64), *(of_words for of_words, _ in parts)]).astype(np.int64)
    del parts
    lots = _numbers_of(coded.column("lots").drop_null()[0].as_buffer())
    # The ids of a word are one string, cut out of a string of all.
    digits = [str(i) for i in range(1 << ID_BITS)]
    widths = np.concatenate([[0], np.cumsum(np.array([len(d) + 1 for d in digits])[values])])
    ends = widths[np.cumsum(lengths)]
    begins = np.concatenate([[0], ends[:-1]])
    whole = " ".join(map(digits.__getitem__, values.tolist()))
    of_word = np.empty(len(lengths), object)
    of_word[np.argsort(lots, kind="stable")] = [whole[a:b] for a, b in zip(begins.tolist(), (ends - 1).tolist())]
    del digits, widths, whole, values
    texts = coded.filter(coded.column("codes").is_valid())
    found, size, chunks = [], 0, []
    for held in texts.column("codes"):
        codes = np.frombuffer(held.as_buffer(), np.uint8).reshape(4, -1)
        slices = (codes[:, at : at + DEALT].T.copy().view(np.uint32).ravel() for at in range(0, codes.shape[1], DEALT))
        found.append(" ".join(" ".join(of_word[some].tolist()) for some in slices))
        size += len(found[-1])
        if size >= JOINED:
            chunks.append(pa.array(found, pa.string()))
            found, size = [], 0
    # Chunks are sent to the JVM one by one.
    rows = pa.table({"doc_id": texts.column("doc_id"), "ids": pa.chunked_array([*chunks, pa.array(found, pa.string())], pa.string())})
    del found, of_word
    give_back_memory()
    return rows


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    block_words: int = BLOCK_WORDS,
    table: RankTable | None = None,
) -> DataFrame:
    """``doc_id, ids`` of every row: the ids of the whole text, joined by spaces, as the library encodes it.

    Every match of ``pattern`` is a word; a word that is a token itself has its rank.  A null or empty text has no
    ids.  Ids of documents may be null or repeat; other columns are not read; an empty table gives no rows.
    A block holds the words of one text at least, however long it is.
    """
    table = table or RankTable(read_ranks(path))
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    lots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _in_buckets(_in_blocks(plain, pattern, block_words, lots))
    words = blocks.where("words is not null").select("block", "lot", "words").repartition(lots, "lot")
    known = _folded_lots(words, table, path, pattern)
    texts = blocks.where("words is null").select("block", "doc_id", "codes", "lots")
    kind = docs.schema[doc_id].dataType.simpleString()
    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_with_ids, f"doc_id {kind}, ids string")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows (doc_id, ids)`` with ``decoded``, the bytes of the ids: their pieces, one after another."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if ("pieces", path) not in cache:
            cache["pieces", path] = {str(rank): token for token, rank in read_ranks(path).items()}
        piece = cache["pieces", path].__getitem__
        for batch in batches:
            begin, held, size = 0, [], 0
            for i, ids in enumerate(batch.column(1)):
                held.append(b"".join(map(piece, ids.as_py().split())))
                size += len(held[-1])
                if size >= DECODED or i == len(batch) - 1:
                    columns = [*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])
                    begin, held, size = i + 1, [], 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(joined, f"doc_id {kind}, ids string, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    spaces = F.length("ids") - F.length(F.replace(F.col("ids"), F.lit(" "), F.lit("")))
    return decode(encode(docs, path, pattern, text, doc_id), path).select(
        "doc_id",
        F.when(F.col("ids") == "", 0).otherwise(spaces + 1).cast("bigint").alias("n_tokens"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
