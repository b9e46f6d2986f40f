import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from pyspark.sql import functions as F  # noqa: E402

from replyforest.llm import byte_bpe as bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["don't", "I'M", " word,", "a.b", "é,", "É!", "<|endoftext|>", "x!!", " hello?!", "’s", "日本語", " ß.", "ΣΑΣ", "1,2", " 3rd", "́", " ", "  ", "\n\n", "\t", "\x0b", " ", "\x85", "\x1c", "a'll", "😀", "ª", "²", "abababababab", "zzzzzzzzzz", "    ", "antidisestablishmentarianism", " internationalization", "x" * 300, " " * 300, "\x00", "\x7f"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_as_the_library(documents, clash, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "Long text. " * 9000, "q" * 20_000]
    rows = bpe.encode_and_decode(clash(documents(texts)), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_blocks_change_nothing(documents, library):
    texts = ["many many words, many words\n\ntwo"] * 5 + ["other", "", None, "\n", "four\r\nfive \x00", "a'S b'ſ \x1c\x85 x"]
    for block_words in (1, 4, 1000):
        rows = bpe.encode(documents(texts), PATH, public_tokenizers.PATTERN, block_words=block_words).collect()
        assert len(rows) == len(texts)
        assert all(r.ids == " ".join(map(str, library.encode_ordinary(texts[r.doc_id] or ""))) for r in rows)


def test_words_of_many_blocks(spark, library):
    words = ["x" * n for n in (1, 2, 255, 256)] + ["é" * 128, " word", "\n"]
    rows = [(block, n, w) for block in range(30) for n, w in enumerate(words)]
    found = bpe.fold_words(spark.createDataFrame(rows, "block bigint, number int, word string"), bpe.RankTable(bpe.read_ranks(PATH))).collect()
    packed = {n: b"".join(i.to_bytes(2) for i in library.encode_ordinary(w)) for n, w in enumerate(words)}
    assert len(found) == len(rows) and all(bytes(r.ids) == packed[r.number] for r in found)


def test_texts_are_not_shuffled(documents):
    from plan_texts import executed_plan

    plan = executed_plan(bpe.encode(documents(["some text"] * 50), PATH, public_tokenizers.PATTERN))
    texts = plan[plan.index("FlatMapCoGroupsInArrow"):].split("Bucketed: true")[0]
    assert "codes" in texts and "Exchange" not in texts and "Window" not in texts


def test_words_travel_packed(documents):
    from plan_texts import executed_plan

    plan = executed_plan(bpe.encode(documents(["some text", "more text"] * 50), PATH, public_tokenizers.PATTERN))
    assert "Generate" not in plan and "Window" not in plan  # no row for each block and word
    plain = documents([f"{n} words" for n in range(1000)] + [""]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = bpe._in_blocks(plain.coalesce(1), public_tokenizers.PATTERN, bpe.BLOCK_WORDS, 3).collect()
    assert len(rows) == 1001 + 1 + 3 and len({r.block for r in rows}) == 1
    sizes = [len(bpe._unpack(bytes(r.words))[0]) for r in rows if r.words is not None]
    assert sum(sizes) == 1001


def test_split_as_the_regex_module(spark):
    import regex

    points = [c for c in range(1 << 21) if c < 0x110000 and not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b1{c}2 {c} {c}{c}\n'{c}" for c in map(chr, points[i : i + 64])) for i in range(0, len(points), 64)]
    rows = bpe._split(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), public_tokenizers.PATTERN).collect()
    find = regex.compile(public_tokenizers.PATTERN).findall
    assert len(rows) == len(texts) and all((r.rest == texts[r.doc_id]) != (r.words == find(texts[r.doc_id])) for r in rows)
    assert sum(r.words is not None for r in rows) > 1000


def test_long_texts_and_unknown_characters(documents, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 12)
    texts = ["short", "a long text of some words", "\u0378 x", "", "more \U000e0fff\ufffe", "and so on and on", None, "é " * 5000, "end"]
    for monkey, most in (("JOINED", 9), ("DECODED", 2), ("WRITTEN", 1), ("BLOCK_LENGTH", 3), ("BLOCK_BYTES", 9)):
        monkeypatch.setattr(bpe, monkey, most)
        rows = bpe.decode(bpe.encode(documents(texts), PATH, public_tokenizers.PATTERN), PATH).collect()
        assert len(rows) == len(texts)
        assert all(r.ids == " ".join(map(str, library.encode_ordinary(texts[r.doc_id] or ""))) for r in rows)
        assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in rows)


def test_texts_without_words(documents):
    assert [r.ids for r in bpe.encode(documents(["", None]), PATH, public_tokenizers.PATTERN).collect()] == ["", ""]


def test_null_and_repeated_ids_and_empty_tables(documents):
    rows = bpe.encode(documents([(None, "a"), (1, "a"), (1, "a")]), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == 3 and len({r.ids for r in rows}) == 1
    assert bpe.encode_and_decode(documents([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_every_pair_is_found():
    table = bpe.RankTable(bpe.read_ranks(PATH))
    held = table.cells[table.cells >= 0]
    for cell in held[:: 97].tolist():
        assert cell in [table.cells[p] for p in table.places(cell >> bpe.RANK_BITS)]
    assert len(held) > 100_000 and F is not None
