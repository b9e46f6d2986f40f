import os
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from replyforest.llm import spelling
from replyforest.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_near(words):
    """Near words of each; words that are near share themselves or a deletion."""
    parts = {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            parts.setdefault(v, []).append(w)
    near = {w: set() for w in words}
    for some in parts.values():
        for a in some:
            near[a].update(b for b in some if one_edit(a, b))
    return near


def plain(words):
    near, form, rows = plain_near(words), {}, {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return rows


def found(frame):
    rows = frame.collect()
    result = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(result) == len(rows)
    return result


def of_words(spark, words):
    frame = spark.createDataFrame(sorted(words.items()), "word string, n bigint").repartition(3)
    return found(spelling.variants(frame))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    result = QUERIES["op12_spelling_variants"](spark, FOLDER)
    assert result.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(result) == plain(plain_words(rows))


@pytest.mark.parametrize("letters,share", [("ab", 40), ("abcde", 400), ("abcdefghij", 20_000)])
def test_dense_words(spark, monkeypatch, letters, share):
    """Few letters make grams frequent, words full of repeats, and many words that one edit robs of all grams."""
    monkeypatch.setattr(spelling.dictionary, "__defaults__", (share,))
    rng = random.Random(share)
    words = {"".join(rng.choices(letters, k=rng.randint(5, 9))): rng.randint(3, 200) for _ in range(700)}
    assert of_words(spark, words) == plain(words)


def test_both_ways_are_needed(spark):
    rng = random.Random(5)
    words = {"".join(rng.choices("abc", k=rng.randint(5, 12))): 3 for _ in range(600)}
    frame = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    entries = spelling._entries(frame, spelling.dictionary(frame)).collect()
    assert {e.stay > 0 for e in entries} == {True, False}


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_one_edit_leaves_as_many_grams_as_said(data):
    """The bound of a word holds for every edit of it, and words one edit apart meet under a merged gram."""
    letters = st.sampled_from("abc")
    some = data.draw(st.lists(st.text(letters, min_size=2, max_size=8), min_size=1, max_size=30))
    counts = Counter(t[i : i + k] for w in some for t in [f"\x02{w}\x03"] for k in (2, 3) for i in range(len(t) - k + 1))
    grams = spelling.Grams({g: n for g, n in counts.items() if n > data.draw(st.integers(0, 4))}, 1)
    grams.counts = {g: n for g, n in grams.counts.items() if len(g) == 2 or g[:-1] in grams.counts}
    a = data.draw(st.text(letters, min_size=5, max_size=10))
    i, kind = data.draw(st.integers(0, len(a) - 1)), data.draw(st.sampled_from("idr"))
    b = a[:i] + data.draw(letters) * (kind != "d") + a[i + (kind != "i") :]
    if a == b:
        return
    short, long = sorted((a, b), key=len)

    def whole(w):
        text, starts, ends = grams.decompose(w)
        return {(text[s:e], s) for s, e in zip(starts, ends)}, grams.untouched(text, starts, ends)

    (of_short, stay_short), (of_long, stay_long) = whole(short), whole(long)
    further = len(long) - len(short)
    shared = {(g, s) for g, s in of_short if (g, s) in of_long or (g, s + further) in of_long}
    assert len(shared) >= max(stay_short, stay_long)
    if max(stay_short, stay_long) > 0:
        merged = [set(zip(*grams.entry(w)[1:])) for w in (short, long)]
        assert any((g, s) in merged[1] or (g, s + further) in merged[1] for g, s in merged[0])


def test_chains_of_forms(spark):
    words = {"a" * k: 3 * 2**k for k in range(5, 30)}
    result = of_words(spark, words)
    assert result["aaaaa"] == ("aaaaaa", "a" * 29, 96, 1, 192) and result["a" * 29][:2] == (None, "a" * 29)


def test_ties_go_to_the_smaller_word(spark):
    result = of_words(spark, {"meinung": 4, "meinumg": 8, "meinong": 8, "meinuné": 7})
    assert result["meinung"] == ("meinong", "meinong", 4, 3, 8)
    assert result["meinong"] == (None, "meinong", 8, 1, None)


def test_words_of_texts(spark, documents, clash):
    long = "x" * 3000
    texts = [(i, "Straße STRASSE strasse Über über ab abcd " + long) for i in range(5)] + [(9, None), (10, ""), (None, "null null nullen nullen nullen"), (3, "strasse")]
    rows = found(spelling.spelling_variants(clash(documents(texts))))
    assert rows == plain(plain_words(texts))
    assert {"straße", "strasse", "nullen", long} <= set(rows) and rows["strasse"][2] == 11


def test_no_words(spark, documents):
    assert found(spelling.spelling_variants(documents([]))) == {}
    assert found(spelling.spelling_variants(documents([None, "", "ab cd", "once twice"]))) == {}
    assert of_words(spark, {"single": 3}) == {"single": (None, "single", 3, 0, None)}
