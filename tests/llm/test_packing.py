import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from replyforest.llm import packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def pieces_of(spark, lengths):
    return spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id bigint, length bigint").repartition(4)


def check(rows, lengths, capacity):
    """Every piece once, sequences full or less, places without gaps; how many sequences."""
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("seed", range(3))
def test_about_as_few_sequences_as_best_fit_decreasing(spark, seed):
    rng = random.Random(seed)
    lengths = [min(100, max(1, int(rng.lognormvariate(2.5 + seed / 2, 1)))) for _ in range(1500)]
    count = check(packing.pack(pieces_of(spark, lengths), 100).collect(), lengths, 100)
    assert count <= best_fit_decreasing(lengths, 100) * 1.02 + 1


@pytest.mark.parametrize("lengths", [[], [100] * 5, [1] * 1000, [51] * 40, [50] * 41, [100, 99, 1, 1]])
def test_equal_and_extreme_lengths(spark, lengths):
    count = check(packing.pack(pieces_of(spark, lengths), 100).collect(), lengths, 100)
    assert count == best_fit_decreasing(lengths, 100)


def test_one_length_of_a_third_of_the_rows(spark):
    rng = random.Random(9)
    lengths = [37] * 5000 + [rng.randint(1, 100) for _ in range(10_000)]
    count = check(packing.pack(pieces_of(spark, lengths), 100).collect(), lengths, 100)
    assert count <= -(-sum(lengths) // 100) * 1.1


WORDS = ["don't", "I'M", "word,", "a.b", "é,", "É!", "<|startoftext|>", "<|endoftext|>.", "x!!", "hello?!", "’s", "日本", "ß.", "İstanbul", "ΣΑΣ", "ﬁ", "1,2", "3rd", "́", "é.", " ", " ", "\n", "\t", "\x0b", "\x0c", " ", "\x85", "\x1c", "a'll.", "'s", "'S", "s'", "---", ".", "..", "naïve;", "😀!", "a‍b", "Ⅷ", "ª", "%%%", "w&&&", "(x)", "$$$"]


def test_ids_are_those_of_the_tokenizer(spark, documents, clash):
    rng = random.Random(3)
    texts = ["".join(rng.choice(WORDS) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [None, "", "Long text. " * 9000, "x" * 20_000]
    whole = tokenizers.Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    expected = {}
    for i, e in enumerate(whole.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            expected[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()), ids[k : k + 4096].tolist())
    rows = packing.pack_documents(clash(documents(texts)), PATH, with_ids=True).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32, r.ids) for r in rows} == expected and len(rows) == len(expected)
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096)


def test_registered_packing_has_the_ids_of_the_plain_call(spark, documents, tmp_path):
    import corpus_pipeline
    from replyforest.llm.registry import QUERIES

    rng = random.Random(5)
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "x<|startoftext|>y", "<| endoftext|>", "<|endof text|>", "<|StartOfText|>!", None, ""]
    texts += ["".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(20)) for _ in range(100)]
    docs = documents(texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = tokenizers.Tokenizer.from_file(PATH)
    expected = {}
    for i, text in enumerate(texts):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert expected[0][0] == 4 and max(n for n, _ in expected.values()) < 4096
    for found in (QUERIES["op1_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in found.collect()} == expected


def test_small_caches_give_the_same_ids(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(WORDS) + " " for _ in range(20)) for _ in range(50)]
    usual = packing.WordIds(PATH).encode(texts)
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    small = packing.WordIds(PATH)
    assert [x for t in texts for x in small.encode([t])] == usual


def test_null_and_repeated_ids_and_empty_tables(documents):
    rows = packing.pack_documents(documents([(None, "a"), (None, "a"), (1, "b"), (1, "b c")]), PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 2), ("1", 3), ("None", 2), ("None", 2)]
    assert packing.pack_documents(documents([]), PATH).count() == 0
