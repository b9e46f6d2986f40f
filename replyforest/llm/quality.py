"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded; gated attention, learned from labels of whole documents,
weighs the encoded passages; the weighted sum is scored.  Passages and scores are made where the texts are; only the
encoded passages of a bounded sample of labelled documents come to the driver, to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyforest.llm.common import crc32_of_id, give_back_memory

PASSAGE = 512  # bytes of a passage, half as much or as much again at the ends of what the even cut gives
PAIRS, FOURS = 128, 256  # buckets of byte pairs, and of runs of four bytes
SAMPLE = 2000  # labelled documents of either label that the model learns from, at most
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 32, 16, 30, 64, 3e-3, 1e-4


def _byte_kinds() -> np.ndarray:
    """A class for every byte: each kind of mark its own, letters by case, digits, space, line ends, the rest."""
    kinds = np.zeros(256, np.int64)
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1] = 1, 2
    kinds[ord("0") : ord("9") + 1], kinds[32], kinds[[9, 11, 12, 13]], kinds[10] = 3, 4, 5, 6
    kinds[128:192], kinds[192:] = 7, 8
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    kinds[marks] = 9 + np.arange(len(marks))
    return kinds


KINDS = _byte_kinds()
N_KINDS = int(KINDS.max()) + 1
FEATURES = N_KINDS + PAIRS + 2


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of every passage of every text, and how many passages each text has, one at least.

    A text is cut evenly; nothing of it is left out.
    """
    data = [(text or "").encode() for text in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    counts = np.maximum(1, (sizes + PASSAGE // 2) // PASSAGE)
    total = int(counts.sum())
    if not sizes.sum():
        return np.zeros((total, FEATURES), np.float32), counts
    all_bytes = np.frombuffer(b"".join(data), np.uint8)
    starts, first = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(data)), sizes)
    place = np.arange(len(all_bytes)) - starts[owner]
    passage = first[owner] + place * counts[owner] // sizes[owner]
    length = np.bincount(passage, minlength=total).astype(np.float32)
    per = 1 / np.maximum(length, 1)[:, None]
    kinds = np.bincount(passage * N_KINDS + KINDS[all_bytes], minlength=total * N_KINDS).reshape(total, N_KINDS)
    wide = all_bytes.astype(np.uint32)
    two = (wide[:-1] << 8 | wide[1:]) * np.uint32(2654435761)
    inside = passage[:-1] == passage[1:]
    pairs = np.bincount((passage[:-1] * PAIRS + (two >> 25))[inside], minlength=total * PAIRS).reshape(total, PAIRS)
    four = (wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]) * np.uint32(2246822519)
    inside = passage[:-3] == passage[3:]
    seen = np.bincount((passage[:-3] * FOURS + (four >> 24))[inside], minlength=total * FOURS).reshape(total, FOURS)
    distinct = (seen > 0).sum(axis=1, dtype=np.float32)[:, None] / FOURS
    return np.hstack([kinds * per, pairs * per, distinct, length[:, None] / PASSAGE]).astype(np.float32), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Gated attention over the passages of a document."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(counts)), counts)
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "of": of, "starts": starts, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, counts)
        h, t, g, a, of = f["h"], f["t"], f["g"], f["a"], f["of"]
        dy = (f["y"] - label) * weight / len(label)
        dz = (dy[:, None] * p["c"])[of]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, f["starts"])[of])
        dt = de[:, None] * p["w"] * g * (1 - t * t)
        dg = de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {
            "W": f["x"].T @ dh + DECAY * p["W"], "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg,
            "w": (t * g).T @ de, "c": f["z"].T @ dy + DECAY * p["c"], "d": dy.sum(keepdims=True),
        }

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x, counts = encode_passages(texts)
        return self.forward(x, counts)["y"]


class Constant:
    """Where there are not labels of both kinds to learn from."""

    def __init__(self, value: float):
        self.value = value

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.value)


def _slices(texts: list[str | None], most: int = 1 << 17) -> Iterator[list[str | None]]:
    """Texts in lists of at most 131,072 characters, one text at least."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text or "") > most:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text or "")
    if some:
        yield some


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model | Constant:
    """A model learned from ``labels (doc_id, quality)`` of the documents that are not held out.

    Of either label the ``sample`` documents come in whose ids have the smallest hashes.  Several labels of one id
    count by their mean; null ids and labels, and other columns, are not read.  Without any labels all documents
    score 1, with labels of one kind they all score that.
    """
    own = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col("quality").cast("double").alias("q")).dropna()
    own = own.where(crc32_of_id(F.col("id")) % FOLDS != HELD_OUT).groupBy("id").agg((F.avg("q") >= 0.5).cast("int").alias("label"))
    counts = {row["label"]: row["count"] for row in own.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Constant(float(next(iter(counts), 1)))
    # Two bounded tables.
    chosen = [own.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _slices(batch.column(2).to_pylist()):
                x, n = encode_passages(texts)
                ends = np.cumsum(n)
                rows = [x[e - k : e].tobytes() for e, k in zip(ends, n)]
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["id", "label", "x"])
        give_back_memory()

    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).join(chosen, "id")
    schema = f"id {plain.schema['id'].dataType.simpleString()}, label int, x binary"
    found = plain.select("id", "label", "t").mapInArrow(passages, schema).toArrow().to_pandas()
    found = found.sort_values(["id", "label"], kind="stable").drop_duplicates("id")
    if found["label"].nunique() < 2:
        return Constant(float(found["label"].iloc[0]) if len(found) else 1.0)
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in found["x"]]
    label = found["label"].to_numpy(np.float64)
    # A label weighs as often as it occurs among all labelled documents.
    weight = np.where(label == 1, counts[1] / (label == 1).sum(), counts[0] / (label == 0).sum())
    weight /= weight.mean()
    everything = np.concatenate(bags)
    model = Model(everything.mean(axis=0), everything.std(axis=0) + 1e-3)
    rng = np.random.default_rng(11)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, epochs = 0, max(EPOCHS, 60 * BATCH // len(bags))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for begin in range(0, len(order), BATCH):
            some = order[begin : begin + BATCH]
            n = np.array([len(bags[i]) for i in some])
            step += 1
            for k, v in model.gradient(np.concatenate([bags[i] for i in some]), n, label[some], weight[some]).items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def score(docs: DataFrame, model: Model | Constant, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null and empty texts are scored as one empty passage."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in _slices(batch.column(1).to_pylist()):
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(texts), pa.float64())], names=["doc_id", "score"])
        give_back_memory()

    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scored = plain.mapInArrow(scores, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, score double")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | Constant, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``THRESHOLD`` or more, unchanged."""
    place = docs.columns.index(text)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            scores = np.concatenate([model.scores(some) for some in _slices(texts)]) if texts else np.empty(0)
            yield batch.filter(pa.array(scores >= THRESHOLD, pa.bool_()))
        give_back_memory()

    return docs.mapInArrow(good, docs.schema)
