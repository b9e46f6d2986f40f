"""Secrets: patterns propose, a character network decides on what the plain rules leave open.

Assigned passwords and tokens, access keys and long hex numbers are findings by rule.  Every other run of key characters
is a candidate too.  A convolutional network in numpy reads each candidate and the characters around it; it learns
from all labelled findings, its scores are calibrated on findings it has not learned from, and the threshold is the
highest that still finds the wanted share of those.  Candidates are scored where the texts are, and labelled ones are
learned from in blocks where they lie; only networks, sums and counts come to the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyforest.session import passing_folder, stage

# Runs are matched whole, so a shorter run is skipped without trying its parts.
PATTERNS = {
    "assign": re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "key": re.compile(r"[A-Za-z0-9+/_=-]{16,}"),
}
BASE = ("assign", "access", "hex")
KINDS = tuple(PATTERNS)
LEAST_ASSIGNED = 6

BEFORE, AFTER = 32, 16  # characters of context
BLOCK = 4096  # characters of a candidate that are read at once
WIDTH, FILTERS, HIDDEN = 5, 24, 16
BATCH, RATE, DECAY = 64, 4e-3, 1e-4
ROUNDS = 4  # after each the networks of all blocks are averaged
STEPS = 48  # batches that a block learns from in all rounds, at least
BLOCK_ROWS = 1024  # labelled candidates of a block, some
BINS = 1024  # of logits that are counted at once
SAMPLE_SPAN = 512  # characters of a labelled candidate that are learned from, at most
CALIBRATED = 4  # one in so many labelled candidates is for calibration only
RECALL = 0.98  # share of true findings that the threshold must keep
SLICE = 1 << 15  # characters that are convolved at once
SEED = 5
ROWS = 256  # texts that are read at once


def _classes() -> np.ndarray:
    """A class for every character of a keyboard, one for line ends and tabs, one for other marks, one for all the rest."""
    kinds = np.arange(129)
    kinds[:32], kinds[[9, 10, 13]], kinds[127:] = 1, 2, 127
    return kinds


ABSENT, N_CLASSES = 0, 128
CLASSES = _classes()


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASSES[np.minimum(points, 128)]


# ---- candidates


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the findings by rule."""
    return [(start, kind, end) for start, kind, end, _ in _base(text)]


def _base(text: str) -> list[tuple[int, int, int, int]]:
    """As ``base_matches``, with the start of what is secret in it: of an assignment its value."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in PATTERNS["assign"].finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    for kind in (1, 2):
        found += [(m.start(), kind, m.end(), m.start()) for m in PATTERNS[KINDS[kind]].finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """Findings by rule, and the runs of key characters that meet none of them, in order of their places.

    ``(start, kind, end, value)``: the network reads from ``value`` on, so that the word before a password is context.

    A run of letters of one case, with or without a capital first, is a word, and one of digits a number; they are no
    candidates.
    """
    base = _base(text)
    found, i, covered = list(base), 0, 0
    place = KINDS.index("key")
    for m in PATTERNS["key"].finditer(text):
        start, end = m.span()
        while i < len(base) and base[i][0] < end:
            covered = max(covered, base[i][2])
            i += 1
        if covered > start:
            continue
        run = m.group()
        if run.isdigit() or (run.isalpha() and (run.isupper() or run[1:].islower())):
            continue
        found.append((start, place, end, start))
    return sorted(found)


def pieces(text: str, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes of a candidate and its context, and how long the three parts are: context, candidate, context.

    A candidate is read in pieces of at most ``BLOCK`` characters that overlap so that no run of ``WIDTH`` is missed; its
    context comes with the first and the last.  After each part is a gap that no filter reads across.
    """
    gap = np.full(WIDTH - 1, ABSENT, np.int64)
    begin = start
    while True:
        stop = min(end, begin + BLOCK)
        before = text[max(0, start - BEFORE) : start] if begin == start else ""
        after = text[end : end + AFTER] if stop == end else ""
        parts = [np.concatenate([_codes(part), gap]) for part in (before, text[begin:stop], after)]
        yield np.concatenate(parts), np.array([len(part) for part in parts])
        if stop == end:
            return
        begin = stop - WIDTH + 1


# ---- the network


class Network:
    """Convolution, the largest answer of every filter in each of the three parts, and two dense layers."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        shapes = {"K": (WIDTH, N_CLASSES, FILTERS), "b": (FILTERS,), "W": (3 * FILTERS, HIDDEN), "a": (HIDDEN,), "v": (HIDDEN,), "c": (1,)}
        scale = {"K": 0.3, "W": 1 / np.sqrt(3 * FILTERS), "v": 1 / np.sqrt(HIDDEN)}
        self.p = {k: rng.normal(0, scale[k], s) if k in scale else np.zeros(s) for k, s in shapes.items()}
        self.p["K"][:, ABSENT] = 0
        self.slope, self.shift = 1.0, 0.0  # calibration
        self.threshold = 0.5

    def pooled(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of every filter in each part, and where it is; ``lengths`` cuts ``codes`` into parts."""
        answers = np.repeat(self.p["b"][None], len(codes), axis=0)
        for k in range(WIDTH):
            answers[: len(codes) - k] += self.p["K"][k][codes[k:]]
        starts = np.cumsum(lengths) - lengths
        largest = np.maximum.reduceat(answers, starts)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        at = np.where(answers == largest[owner], np.arange(len(codes))[:, None], len(codes))
        return largest, np.minimum.reduceat(at, starts)

    def dense(self, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.maximum(largest, 0).reshape(-1, 3 * FILTERS)
        h = np.maximum(x @ self.p["W"] + self.p["a"], 0)
        return x, h, h @ self.p["v"] + self.p["c"]

    def gradient(self, codes: np.ndarray, lengths: np.ndarray, label: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        p = self.p
        largest, at = self.pooled(codes, lengths)
        x, h, logit = self.dense(largest)
        d = weight * (_sigmoid(logit) - label) / len(label)
        dh = np.outer(d, p["v"]) * (h > 0)
        dlargest = ((dh @ p["W"].T) * (x > 0)).reshape(-1, FILTERS)
        kernel = np.zeros_like(p["K"])
        for k in range(WIDTH):
            read = at + k
            seen = np.where(read < len(codes), codes[np.minimum(read, len(codes) - 1)], ABSENT)
            np.add.at(kernel[k], (seen, np.arange(FILTERS)[None]), dlargest)
        kernel[:, ABSENT] = 0
        return {
            "K": kernel + DECAY * p["K"], "b": dlargest.sum(axis=0), "W": x.T @ dh + DECAY * p["W"], "a": dh.sum(axis=0), "v": h.T @ d, "c": d.sum(keepdims=True),
        }

    def logits(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """The uncalibrated answer for every ``(text, start, end)``, however long the candidate is."""
        best = np.full((len(found), 3 * FILTERS), -np.inf)
        codes, lengths, owners, size = [], [], [], 0

        def flush():
            if codes:
                largest, _ = self.pooled(np.concatenate(codes), np.concatenate(lengths))
                np.maximum.at(best, owners, largest.reshape(-1, 3 * FILTERS))

        for i, (text, start, end) in enumerate(found):
            for part, cut in pieces(text, start, end):
                if size + len(part) > SLICE:
                    flush()
                    codes, lengths, owners, size = [], [], [], 0
                codes.append(part)
                lengths.append(cut)
                owners.append(i)
                size += len(part)
        flush()
        return self.dense(best)[2] if len(found) else np.empty(0)

    def scores(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities."""
        return _sigmoid(self.slope * self.logits(found) + self.shift)

    def learn(self, state: np.ndarray, read: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, steps: int, rng: np.random.Generator) -> np.ndarray:
        """Adam's steps over all of ``read`` (as ``pieces`` gives them), again and again until there are ``steps``.

        The state holds the parameters, both moments and the number of steps that were made.
        """
        numbers, first, second = np.split(state[:-1], 3)
        step, end = state[-1], state[-1] + steps
        self.set_flat(numbers)
        while step < end:
            turn = rng.permutation(len(read))
            for begin in range(0, len(turn), BATCH):
                some = turn[begin : begin + BATCH]
                codes, lengths = np.concatenate([read[i][0] for i in some]), np.concatenate([read[i][1] for i in some])
                step += 1
                slope = np.concatenate([v.reshape(-1) for v in self.gradient(codes, lengths, label[some], weight[some]).values()])
                first = 0.9 * first + 0.1 * slope
                second = 0.999 * second + 0.001 * slope * slope
                numbers = numbers - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                self.set_flat(numbers)
        return np.concatenate([numbers, first, second, [step]])

    def flat(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def set_flat(self, numbers: np.ndarray) -> None:
        ends = np.cumsum([v.size for v in self.p.values()])
        self.p = {k: part.reshape(v.shape) for (k, v), part in zip(self.p.items(), np.split(numbers, ends[:-1]))}

    def calibrate(self, logits: np.ndarray, label: np.ndarray, recall: float) -> None:
        """Fits the probabilities to ``label``, with Platt's smoothed targets, and sets the threshold for ``recall``."""
        good = label.sum()
        target = np.where(label == 1, *_targets(good, len(label) - good))
        x = np.stack([logits, np.ones_like(logits)], axis=1)

        def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            y = _sigmoid(x @ w)
            return (x * (y * (1 - y) + 1e-6)[:, None]).T @ x, x.T @ (y - target)

        falling = np.sort(logits[label == 1])[::-1]
        self.fit(sums, falling[_kept(recall, len(falling)) - 1])

    def fit(self, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], last: float) -> None:
        """Newton's steps by ``sums``, the curve and the slope at some weights; the threshold is the score of the logit ``last``."""
        w = np.array([1.0, 0.0])
        for _ in range(50):
            curve, slope = sums(w)
            change = np.linalg.solve(curve + 1e-6 * np.eye(2), slope)
            w -= change * min(1.0, 2 / max(np.abs(change).max(), 1e-12))
            if np.abs(change).max() < 1e-9:
                break
        self.slope, self.shift = max(float(w[0]), 1e-3), float(w[1])
        self.threshold = float(_sigmoid(self.slope * np.array([last]) + self.shift)[0])


def _targets(good: int, bad: int) -> tuple[float, float]:
    """Platt's targets of true and of false ones."""
    return (good + 1) / (good + 2), 1 / (bad + 2)


def _kept(recall: float, n: int) -> int:
    """How many of ``n`` true ones must score the threshold."""
    return int(np.ceil(recall * n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class NoNetwork:
    """Where there are not labelled findings of both kinds to learn from: nothing is added to the rules."""

    threshold = 1.0

    def scores(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        return np.zeros(len(found))


# ---- learning


def labelled_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text, start, end, label`` of findings that the rules label, with as much text as the network reads of them.

    Findings by rule are 1.  Candidates that meet none are 0, and so are some ordinary runs of eight characters and more,
    those whose hashes 101 divides.  Each comes with the text around it and without, so that the rules' own key words are
    not all that is learned.
    """
    words = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")

    def rows(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                found = []
                for value in batch.column(0).slice(begin, ROWS).to_pylist():
                    value = value or ""
                    some = candidates(value)
                    taken = [(v, e, int(k < len(BASE))) for _, k, e, v in some]
                    spans, i = sorted((s, e) for s, _, e, _ in some), 0
                    for m in words.finditer(value):
                        while i < len(spans) and spans[i][1] <= m.start():
                            i += 1
                        if zlib.crc32(m.group().encode()) % 101 == 0 and not (i < len(spans) and spans[i][0] < m.end()):
                            taken.append((m.start(), m.end(), 0))
                    for s, e, label in taken:
                        e = min(e, s + SAMPLE_SPAN)
                        first = max(0, s - BEFORE)
                        found.append((value[first : e + AFTER], s - first, e - first, label))
                        found.append((value[s:e], 0, e - s, label))
                columns = list(zip(*found)) or [(), (), (), ()]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["text", "start", "end", "label"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(rows, "text string, start int, end int, label int")


def learn(labelled: DataFrame, recall: float = RECALL, block: int = BLOCK_ROWS) -> Network | NoNetwork:
    """A network learned from all of ``labelled (text, start, end, label)``.

    Equal findings count once.  One in ``CALIBRATED``, by the hash, is not learned from: all of these fit the
    calibration, and the threshold is the highest that finds the share ``recall`` of the true ones among them.  The others
    are dealt over blocks of some ``block`` rows.  In each round every block goes on from the same network, and the same
    moments of Adam, and learns from all of its rows; the ends are averaged by the numbers of rows.  True and false ones have equal weight in
    all.  With no more than ``CALIBRATED`` of a label there is no network.  Rows with nulls are not read.
    """
    spark = labelled.sparkSession
    plain = labelled.select("text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("label").cast("int").alias("label"))
    with passing_folder(spark, "findings") as folder:
        hashed = plain.dropna().where(F.col("label").isin(0, 1)).distinct().withColumn("hash", F.xxhash64("text", "start", "end"))
        known = stage(hashed, "findings", folder=folder)
        by_hash = F.pmod("hash", F.lit(CALIBRATED)) == 0
        all_of = known.groupBy("label").agg(F.count("*").alias("n"), F.min("hash").alias("first"), F.max("hash").alias("last")).collect()
        if len(all_of) < 2 or any(row.n <= CALIBRATED or row.first == row.last for row in all_of):
            return NoNetwork()
        # Of either label the first is held out and the last is learned from, so that neither part is ever empty.
        ends = {row.label: row for row in all_of}
        end = lambda name: F.when(F.col("label") == 1, ends[1][name]).otherwise(ends[0][name])
        known = known.withColumn("held", (F.col("hash") == end("first")) | (by_hash & (F.col("hash") != end("last"))))
        numbers = {(row.held, row.label): row.n for row in known.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
        used, bad, good = numbers[False, 0] + numbers[False, 1], numbers[True, 0], numbers[True, 1]
        weights = np.array([used / (2 * numbers[False, label]) for label in (0, 1)])
        network = Network()
        state = np.concatenate([network.flat(), np.zeros(2 * network.flat().size + 1)])
        blocks = -(-used // block)
        learned = known.where(~F.col("held")).withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int"))
        for turn in range(ROUNDS):
            state = _average(_learn_in_blocks(learned.drop("held"), state, weights, turn), blocks)
        network.set_flat(state[: network.flat().size])
        logits = stage(_logits(known.where("held").drop("held", "hash"), network), "logits", folder=folder)
        last = _nth_largest(logits.where("label = 1").select("logit"), _kept(recall, good))
        network.fit(lambda w: _newton_sums(logits, w, *_targets(good, bad)), last)
    return network


def _learn_in_blocks(learned: DataFrame, state: np.ndarray, weights: np.ndarray, turn: int) -> DataFrame:
    """``block, rows, total``: the state of a network after every block went on learning from ``state`` alone, times its rows."""

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(name, "ascending") for name in ("hash", "text", "start", "end", "label")])
        found = zip(*[rows.column(name).to_pylist() for name in ("text", "start", "end")])
        read = [next(pieces(*one)) for one in found]
        label = rows.column("label").to_numpy()
        number = rows.column("block")[0].as_py()
        end = Network().learn(state, read, label.astype(np.float64), weights[label], -(-STEPS // ROUNDS), np.random.default_rng([SEED, turn, number]))
        columns = [pa.array([number], pa.int32()), pa.array([len(read)], pa.int64()), pa.array([(len(read) * end).tobytes()], pa.binary())]
        return pa.Table.from_arrays(columns, names=["block", "rows", "total"])

    return learned.groupBy("block").applyInArrow(learn, "block int, rows bigint, total binary")


def _average(ends: DataFrame, blocks: int) -> np.ndarray:
    """The mean of all rows of ``ends (block, rows, total)``, which are added up in their tasks, then in some tasks more."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, total = None, 0, 0.0
        for batch in batches:
            for number, rows, held in zip(*batch.columns):
                block = number.as_py() if block is None else block
                n, total = n + rows.as_py(), total + np.frombuffer(held.as_buffer(), np.float64)
        if n:
            columns = [pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "rows", "total"])

    kind = "block int, rows bigint, total binary"
    dealt = ends.mapInArrow(added, kind).repartition(int(np.ceil(np.sqrt(blocks))), F.spark_partition_id()).sortWithinPartitions("block")
    sums = sorted(dealt.mapInArrow(added, kind).collect())
    return sum(np.frombuffer(row.total, np.float64) for row in sums) / sum(row.rows for row in sums)


def _logits(rows: DataFrame, network: Network) -> DataFrame:
    """``label, logit`` of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[batch.column(name).to_pylist() for name in ("text", "start", "end")]))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(network.logits(found), pa.float64())], names=["label", "logit"])

    return rows.select("text", "start", "end", "label").mapInArrow(read, "label int, logit double")


def _newton_sums(logits: DataFrame, w: np.ndarray, true: float, false: float) -> tuple[np.ndarray, np.ndarray]:
    """The curve and the slope of all rows at the weights ``w``, as ``Network.calibrate`` has them."""
    x = F.col("logit")
    y = 1 / (1 + F.exp(-F.least(F.greatest(x * float(w[0]) + float(w[1]), F.lit(-30.0)), F.lit(30.0))))
    bend, off = y * (1 - y) + 1e-6, y - F.when(F.col("label") == 1, true).otherwise(false)
    a, b, c, d, e = logits.agg(F.sum(bend * x * x), F.sum(bend * x), F.sum(bend), F.sum(off * x), F.sum(off)).first()
    return np.array([[a, b], [b, c]]), np.array([d, e])


def _nth_largest(values: DataFrame, n: int) -> float:
    """The ``n``-th largest of ``values (logit)``: bins are counted, and the one that holds it is cut into bins again."""
    x = F.col("logit")
    low, high = values.agg(F.min(x), F.max(x)).first()
    while low < high:
        place = F.floor((x - low) / (high - low) * BINS)
        bins = values.where(x.between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for row in sorted(bins.collect(), reverse=True):
            if n <= row.n:
                low, high = row.low, row.high
                break
            n -= row.n
    return low


# ---- scanning


def with_findings(docs: DataFrame, network: Network | NoNetwork, text: str = "text", column: str = "findings") -> DataFrame:
    """``docs`` with an array of ``(start, kind, end, score)`` by start, then kind as in ``KINDS``.

    Places are in code points, the end exclusive; ``kind`` is a number.  Findings of the kinds in ``BASE`` are those of
    the rules, whatever the network says of them; a ``key`` is a candidate that scores the network's threshold or more.
    Null and empty texts have none, an empty table stays empty, rows that repeat each have theirs, and a column of the
    result's name is replaced.
    """
    place = docs.columns.index(text)
    fields = [f for f in docs.schema.fields if f.name != column]
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name != column]
    kind = "array<struct<start:bigint,kind:int,end:bigint,score:double>>"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("score", pa.float64())]))
    keys = KINDS.index("key")

    def rows(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                texts = [value or "" for value in part.column(place).to_pylist()]
                some = [(i, *one) for i, value in enumerate(texts) for one in candidates(value)]
                scores = network.scores([(texts[i], v, e) for i, _, _, e, v in some]).tolist()
                found = [[] for _ in texts]
                for (i, s, k, e, _), score in zip(some, scores):
                    if k != keys or score >= network.threshold:
                        found[i].append({"start": s, "kind": k, "end": e, "score": score})
                columns = [part.column(i) for i in kept] + [pa.array(found, arrow)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + [column])

    schema = T.StructType([*fields, T.StructField(column, T._parse_datatype_string(kind))])
    return docs.mapInArrow(rows, schema)


def listed(findings: Column) -> Column:
    """Findings as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(findings, one), ",")


def find_secrets(docs: DataFrame, network: Network | NoNetwork, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the id, the numbers of findings by rule, their digest, and all findings listed."""
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = with_findings(plain, network).drop("text")
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("findings", lambda s: s["kind"] < len(BASE))
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    digest = F.sha2(listed(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, listed(F.col("findings")).alias("spans"))
