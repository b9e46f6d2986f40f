import hashlib
import os
import random
import re

import numpy as np
import pytest

from replyforest.llm import secret_scan as ss
from replyforest.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
# The rules as they are stated, without the shortcuts of the operator.
PLAIN = [
    (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
     r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(2)) >= 6),
    (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(PLAIN) for m in re.finditer(p, text or "") if good(m))


def listed(spans):
    return ",".join(f"{ss.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def token(rng, letters="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", size=32):
    return "".join(rng.choices(letters, k=size))


def prose(rng, n=12):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 12))) for _ in range(n))


def corpus(rng, rows=400):
    """Prose with secrets that rules name, and with paths, addresses and long words that are none."""
    texts = []
    for i in range(rows):
        kind = i % 4
        thing = {
            0: f'token = "{token(rng, "0123456789abcdef", 40)}"',
            1: f"password={token(rng, size=18)}",
            2: f"see docs/{'/'.join(prose(rng, 4).split())}/page{rng.randint(1, 9)}",
            3: f"{prose(rng, 1)}-{prose(rng, 1)}_{prose(rng, 1)}-long-hyphened-word-{rng.randint(10, 99)}",
        }[kind]
        texts.append(f"{prose(rng)} {thing} {prose(rng)}")
    return texts


@pytest.fixture(scope="module")
def network(spark):
    rows = [(t,) for t in corpus(random.Random(1), 2000)]
    return ss.learn(ss.labelled_findings(spark.createDataFrame(rows, "text string").repartition(4)))


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    result = QUERIES["op11_secret_scan"](spark, FOLDER)
    assert result.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows = rows_of(result)
    assert set(rows) == set(texts)
    for i, r in rows.items():
        check(r, texts[i])


def check(row, text):
    base = plain(text)
    assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
    assert row.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
    spans = [s for s in row.spans.split(",") if s]
    assert ",".join(s for s in spans if not s.startswith("key")) == listed(base)
    assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_rules_at_their_edges(spark, documents, clash, network):
    texts = [
        None, "", "x", "password=abcde", "password=abcdef", "PassWord' : \"a.b=c-d", "paſſword=abcdefgh tokeN:abcdef", "toKen=abcdefg",
        "api_key=" + "a" * 30, "apikey=xAKIA" + "B" * 20, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "9" * 11, "a" * 23 + "g" + "a" * 24,
        "é" * 5 + "0123456789abcdef01234567", "token" + " " * 20_000 + "=" + " " * 20_000 + "abcdefg", "secret=" * 5000, "deadbeef" * 20_000, "AKIA" * 20_000,
        "𝒳 token=𝒳 token=abcdef", "password=a password=abcdefgh", "token==abcdef", "x" * 60_000 + "1",
    ]
    rows = rows_of(ss.find_secrets(clash(documents(texts + [(None, "token=abcdef")])), network))
    for i, text in enumerate(texts):
        check(rows[i], text)
    check(rows[None], "token=abcdef")
    assert ss.find_secrets(documents([]), network).count() == 0
    assert ss.find_secrets(documents([(1, "token=abcdef")] * 3), network).count() == 3


def test_held_out_findings(spark, network):
    """Findings of the kinds it learned from, and of kinds that no rule names, against plain candidates."""
    rng = random.Random(2)
    secret = [f"{prose(rng)} {a}{token(rng, size=36)}{b} {prose(rng)}" for a, b in [("", ""), ("key is ", ""), ("bearer ", "")] * 60]
    harmless = corpus(rng, 800)
    found = [network.scores([(t, s, e) for s, k, e, _ in ss.candidates(t) if k == 3]) for t in secret]
    assert np.mean([max(f, default=0) >= network.threshold for f in found]) > 0.8
    others = [network.scores([(t, s, e) for s, k, e, _ in ss.candidates(t) if k == 3]) for t in harmless]
    assert np.mean([max(f, default=0) >= network.threshold for f in others]) < 0.02
    rules = [network.scores([(t, v, e) for s, k, e, v in ss.candidates(t) if k < 3]) for t in harmless]
    assert np.mean([x >= network.threshold for f in rules for x in f]) > 0.95


def test_added_spans(spark, documents, network):
    rng = random.Random(3)
    key = token(rng, size=40)
    text = f"{prose(rng)} deploy with {key} {prose(rng)}"
    row = rows_of(ss.find_secrets(documents([text, "password=" + key]), network))
    place = text.index(key)
    assert row[0].spans == f"key:{place}:{place + 40}" and row[0].n_assign == 0
    assert row[1].spans == "assign:0:49"


def answers(network, codes):
    """The convolution as a plain loop over places, filters and letters."""
    out = np.zeros((len(codes), ss.FILTERS))
    for i in range(len(codes)):
        for f in range(ss.FILTERS):
            out[i, f] = network.p["b"][f] + sum(network.p["K"][k][codes[i + k], f] for k in range(ss.WIDTH) if i + k < len(codes))
    return out


def test_network_against_a_plain_loop():
    network = ss.Network(3)
    network.p["b"] += np.linspace(-0.1, 0.1, ss.FILTERS)
    text = "before it password=Ab12/x+é and after"
    codes, lengths = next(ss.pieces(text, 10, 27))
    all_answers, ends = answers(network, codes), np.cumsum(lengths)
    largest = [all_answers[e - n : e].max(axis=0) for e, n in zip(ends, lengths)]
    x = np.maximum(np.concatenate(largest), 0)
    h = np.maximum(x @ network.p["W"] + network.p["a"], 0)
    assert network.logits([(text, 10, 27)])[0] == pytest.approx(float(h @ network.p["v"] + network.p["c"][0]))


def test_gradient():
    rng, network = np.random.default_rng(1), ss.Network(2)
    network.p["b"] -= 0.01  # a gap answers with the bias alone, and zero is a kink
    found = [("abc password=abcdef12 def", 4, 21), ("some-plain-word-here 12", 0, 20), ("x", 0, 1)]
    read = [next(ss.pieces(*f)) for f in found]
    codes, lengths = np.concatenate([c for c, _ in read]), np.concatenate([n for _, n in read])
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        z = network.dense(network.pooled(codes, lengths)[0])[2]
        decay = ss.DECAY / 2 * ((network.p["K"] ** 2).sum() + (network.p["W"] ** 2).sum())
        return float(np.mean(np.log1p(np.exp(z)) - label * z)) + decay

    for name, slope in network.gradient(codes, lengths, label).items():
        flat = network.p[name].reshape(-1)
        places = np.argsort(-np.abs(slope.reshape(-1)))[:3].tolist() + rng.integers(0, flat.size, 3).tolist()
        for i in places:
            if name == "K" and (i // ss.FILTERS) % ss.N_CLASSES == ss.ABSENT:
                continue
            keep, step = flat[i], 1e-6
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert slope.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_long_candidates_are_read_whole(monkeypatch):
    network, rng = ss.Network(4), random.Random(4)
    text = prose(rng) + " " + token(rng, size=3000) + " " + prose(rng)
    start, end = [(s, e) for s, k, e, _ in ss.candidates(text) if k == 3][0]
    for block, size in [(64, 100), (100, 1 << 15), (7, 50)]:
        monkeypatch.setattr(ss, "BLOCK", block)
        monkeypatch.setattr(ss, "SLICE", size)
        alone, both = network.logits([(text, start, end)]), network.logits([("x", 0, 1), (text, start, end)])
        assert both[1:] == pytest.approx(alone)
        codes = [c for c, _ in ss.pieces(text, start, end)]
        seen = set()
        for c in codes:
            seen.update(tuple(c[i : i + ss.WIDTH]) for i in range(len(c) - ss.WIDTH + 1))
        full = ss._codes(text[start:end])
        assert {tuple(full[i : i + ss.WIDTH]) for i in range(len(full) - ss.WIDTH + 1)} <= seen


def test_calibration_keeps_the_recall():
    rng, network = np.random.default_rng(5), ss.Network()
    label = (rng.random(4000) < 0.3).astype(float)
    logits = rng.normal(size=4000) * 2 + label * 3
    for recall in (0.5, 0.9, 0.98, 1.0):
        network.calibrate(logits, label, recall)
        p = ss._sigmoid(network.slope * logits + network.shift)
        assert recall <= (p[label == 1] >= network.threshold).mean() < recall + 0.01
        for low in np.arange(0.1, 0.9, 0.2):
            some = (p >= low) & (p < low + 0.2)
            assert abs(p[some].mean() - label[some].mean()) < 0.1


def test_nothing_to_learn_from(spark, documents):
    for texts in ([], ["plain words only"], ["token=abcdef"]):
        assert isinstance(ss.learn(ss.labelled_findings(documents(texts))), ss.NoNetwork)
    frame = spark.createDataFrame([(None, 0, 1, 1), ("a", None, 1, 0)], "text string, start int, end int, label int")
    assert isinstance(ss.learn(frame), ss.NoNetwork)
    row = ss.find_secrets(documents(["token=abcdef " + "aB3-" * 10]), ss.NoNetwork()).first()
    assert row.spans == "assign:0:12"


def test_all_findings_are_learned_from(spark, monkeypatch):
    """In every round each finding is in one block once, or held out for the calibration; none is left out."""
    rows = spark.createDataFrame([(t,) for t in corpus(random.Random(6), 3000)], "text string").repartition(4)
    labelled = ss.labelled_findings(rows)
    known = {tuple(r) for r in labelled.distinct().collect()}
    assert min(sum(r[3] == k for r in known) for k in (0, 1)) > 1500
    learned, held = [], []
    monkeypatch.setattr(ss, "_learn_in_blocks", lambda rows, *a, f=ss._learn_in_blocks: learned.append(rows.collect()) or f(rows, *a))
    monkeypatch.setattr(ss, "_logits", lambda rows, *a, f=ss._logits: held.extend(rows.collect()) or f(rows, *a))
    network = ss.learn(labelled, block=1000)
    plain = lambda found: [(r.text, r.start, r.end, r.label) for r in found]
    assert len(learned) == ss.ROUNDS and all(sorted(plain(r)) == sorted(plain(learned[0])) for r in learned)
    assert sorted(plain(learned[0]) + plain(held)) == sorted(known)
    assert len({r.block for r in learned[0]}) > 3
    others = [network.scores([(t, v, e) for _, k, e, v in ss.candidates(t) if k == 3]) for t in corpus(random.Random(7))]
    assert np.mean([x >= network.threshold for f in others for x in f]) < 0.02


def test_distributed_calibration(spark):
    rng = np.random.default_rng(8)
    label = (rng.random(3000) < 0.3).astype(float)
    logits = np.round(rng.normal(size=3000) * 2 + label * 3, 2)
    frame = spark.createDataFrame([(int(k), float(x)) for k, x in zip(label, logits)], "label int, logit double").repartition(3)
    plain, spread = ss.Network(), ss.Network()
    plain.calibrate(logits, label, 0.9)
    good = int(label.sum())
    falling = np.sort(logits[label == 1])[::-1]
    for n in (1, 2, good // 2, good):
        assert ss._nth_largest(frame.where("label = 1").select("logit"), n) == falling[n - 1]
    last = falling[ss._kept(0.9, good) - 1]
    spread.fit(lambda w: ss._newton_sums(frame, w, *ss._targets(good, len(label) - good)), last)
    assert [spread.slope, spread.shift, spread.threshold] == pytest.approx([plain.slope, plain.shift, plain.threshold])
