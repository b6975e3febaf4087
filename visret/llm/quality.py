"""Quality classifier: naive Bayes support vector machine.

Features are indicators of n-grams of word shapes (1 to 4) and of words (1 and 2), hashed to
``BUCKETS`` numbers. Each is scaled by its class log-count ratio, counted over all labelled
training rows and smoothed, so that a rare feature says little; a linear hinge-loss model is fitted
on the scaled indicators of a bounded sample by dual coordinate descent and a logistic curve turns
its margin into a score. The training documents are read once, for the counts and the sample.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visret.llm.common import ALNUM, cut, texts
from visret.llm.lang_id import held_out

BUCKETS = 1 << 18
#: The margin model is fitted on so many rows of each class at most, those of the smallest hash of
#: their id, and on so many bytes of their feature numbers (rows beyond either are not fitted on).
SAMPLE_EACH, SAMPLE_BYTES = 1000, 32 << 20
#: Labels (16 bytes a row) are broadcast up to this size, beyond it documents and labels are shuffled.
BROADCAST_BYTES = 32 << 20
#: Pseudo-documents of each class with and without every feature.
SMOOTH = 4.0
#: Words that a worker remembers.
MEMORY = 200_000

MARKS = re.compile(rb"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")
P1, P2 = 0x9E3779B1, 0x85EBCA77  # odd multipliers that spread n-grams over the buckets


def shape(word: bytes) -> bytes:
    """Case and length class of the word's letters, and its closing marks."""
    core = MARKS.sub(b"", word)
    end = MARKS.findall(word[-4:])
    tail = end[-1][-3:] if end and word.endswith(end[-1]) else b""
    kind = (b"0" if not core else b"9" if core.isdigit() else b"H" if re.search(rb"\d", core)
            else b"U" if len(core) > 1 and core == core.upper() and core != core.lower()
            else b"T" if core[:1].isupper() else b"l")
    return kind + tail


class Seen(dict):
    """word -> number of the word << 32 | number of its shape, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        got = self[word] = zlib.crc32(word.translate(ALNUM).strip()) << 32 | zlib.crc32(shape(word), 1)
        return got


SEEN = Seen()


def buckets(text: bytes) -> np.ndarray:
    """Bucket numbers of the whole text's n-grams, repeats included."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(SEEN.__getitem__, words), np.uint64, len(words))
    word, form = both >> 32, both & 0xFFFFFFFF
    form[1:][word[1:] == word[:-1]] = 7  # the word before again
    grams = [word * P2 + 1, (word[:-1] * P1 + word[1:]) * P2 + 2]
    run = form
    for n in range(1, 5):
        grams.append(run * P2 + 2 + n)
        run = run[:-1] * P1 + form[n:]
    mixed = np.concatenate(grams)
    return (((mixed ^ mixed >> 29) * P1 >> 20) % BUCKETS).astype(np.int64)


class Distinct:
    """Distinct features, without sorting: of equal ones the last stays."""

    def __init__(self):
        self.place = np.zeros(BUCKETS, np.int64)

    def __call__(self, text: bytes) -> np.ndarray:
        f = buckets(text)
        at = np.arange(len(f))
        self.place[f] = at
        return f[self.place[f] == at]


def scanned(labelled: DataFrame, share: list[float]) -> DataFrame:
    """Of ``labelled(doc_id, text, y)``: rows (f, n0, n1), how many documents of each class a task
    has with feature f, f = BUCKETS counting all; and rows (y, draw, features) of the documents
    whose draw, a hash of their id, is under their class's ``share``. Kept, as both are read."""
    schema = "f long, n0 long, n1 long, y long, draw long, features array<int>"

    def scan(batches):
        total, features = np.zeros((2, BUCKETS + 1), np.int64), Distinct()
        for batch in batches:
            some = []
            for t, y, draw in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                f = features(t)
                total[y, f] += 1
                total[y, BUCKETS] += 1
                if draw < share[y] * (1 << 40):
                    some.append((y, draw, np.sort(f).astype(np.int32)))
            yield batch_of(len(some), dict(zip(("y", "draw", "features"), zip(*some, strict=True), strict=True)) if some else {})
        at = np.flatnonzero(total.any(0))
        yield batch_of(len(at), {"f": at, "n0": total[0, at], "n1": total[1, at]})

    kinds = {"f": pa.int64(), "n0": pa.int64(), "n1": pa.int64(), "y": pa.int64(), "draw": pa.int64(), "features": pa.list_(pa.int32())}

    def batch_of(n, columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))

    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    return cut(labelled.select("text", "y", draw.alias("draw")).mapInArrow(scan, schema))


def class_counts(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(documents of each class, documents of each class with each feature) of ``scanned``; the
    driver gets 2 x BUCKETS + 2 numbers at most, as Arrow's columns."""
    rows = found.where("f is not null").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, BUCKETS + 1))
    out[:, rows["f"].to_numpy()] = rows["n0"].to_numpy(), rows["n1"].to_numpy()
    return out[:, BUCKETS], out[:, :BUCKETS]


def sampled(found: DataFrame, sample_each: int, sample_bytes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and class of the sample: of each class the ``sample_each`` smallest draws of
    ``scanned``, as long as their features take no more than half of ``sample_bytes``. They come as
    Arrow's columns, four bytes a number: as rows the driver would hold an object for each."""
    rows, y = [], []
    for c in (0, 1):
        own = found.where(F.col("y") == c)
        few = own.select("draw", F.size("features").alias("n")).orderBy("draw", "n").limit(sample_each).toArrow()
        inside = few["draw"].to_numpy()[few["n"].to_numpy().cumsum(dtype=np.int64) * 4 <= sample_bytes // 2]
        if len(inside):
            some = own.where(F.col("draw") <= int(inside[-1])).select("features").orderBy("draw", "features").limit(len(inside)).toArrow()
            for part in filter(len, some["features"].chunks):
                at = np.asarray(part.offsets)
                rows += np.split(np.asarray(part.flatten()), at[1:-1] - at[0])
            y += [c] * len(some)
    return rows, np.array(y)


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Weights (bias last) of the L2-regularised hinge-loss model, by dual coordinate descent with
    a seeded order (Hsieh et al. 2008)."""
    w, alpha = np.zeros(len(scale) + 1), np.zeros(len(rows))
    values = [np.r_[scale[r] / np.sqrt(max(1, len(r))), 1.0] for r in rows]
    places = [np.r_[r, len(scale)] for r in rows]
    norm = np.array([v @ v for v in values])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = places[i], values[i]
            new = min(max(alpha[i] - (y[i] * (w[at] @ v) - 1) / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logistic(margin: np.ndarray, y01: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score's curve, by Newton steps on smoothed targets (Platt 1999)."""
    n1, n0 = weight[y01 > 0].sum(), weight[y01 == 0].sum()
    target = np.where(y01 > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.c_[margin, np.ones(len(margin))], np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(30):
        p = sigmoid(x @ b)
        h = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + 1e-6 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-6 * b), -2, 2)
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, *, sample_each: int = SAMPLE_EACH, sample_bytes: int = SAMPLE_BYTES):
    """Weights, bias, slope and offset from the rows of ``docs`` that ``labels`` marks 0 or 1.

    Null texts count as empty, null or other marks are left out, repeated rows count as often as
    they stand. With one class or none there is nothing to tell apart: every score is then the
    share of 1 (0.5 without rows).
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("y"))
    size = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    few = 16 * sum(size.values()) <= BROADCAST_BYTES
    share = [min(1.0, 2 * sample_each / max(1, size.get(c, 0))) for c in (0, 1)]
    found = scanned(docs.select("doc_id", "text").join(F.broadcast(marked) if few else marked, "doc_id"), share)
    n, seen = class_counts(found)
    if not n.all():
        return np.zeros(BUCKETS + 1), 1.0, float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    p, q = (seen[1] + SMOOTH) / (n[1] + 2 * SMOOTH), (seen[0] + SMOOTH) / (n[0] + 2 * SMOOTH)
    ratio = np.log(p / q)
    ratio[seen.sum(0) == 0] = 0
    rows, y = sampled(found, sample_each, sample_bytes)
    if not (y == 0).any() or not (y == 1).any():
        raise ValueError("sample_bytes holds no document of one class")
    each = np.array([n[c] / (y == c).sum() for c in (0, 1)])
    w = descend(rows, ratio, np.where(y > 0, 1.0, -1.0), np.where(y > 0, 1.0, len(y) / 2 / (y == 0).sum()))
    w[:-1] *= ratio
    margin = np.array([w[r].sum() / np.sqrt(max(1, len(r))) + w[-1] for r in rows])
    slope, offset = logistic(margin, y, each[y] / each.mean())
    return w, slope, offset


def scorer(docs: DataFrame, model):
    """A column function: text -> score, of whole texts; null as empty."""
    w, slope, offset = model
    kept = np.flatnonzero(w[:-1])
    shared = docs.sparkSession.sparkContext.broadcast((kept, w[kept], w[-1], slope, offset))

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        kept, weights, bias, slope, offset = shared.value
        out = []
        dense = np.zeros(BUCKETS)
        dense[kept] = weights
        features = Distinct()
        for t in texts(text):
            f = features(t)
            out.append(float(sigmoid(slope * (dense[f].sum() / np.sqrt(max(1, len(f))) + bias) + offset)))
        return pa.array(out, pa.float64())

    return score.asNondeterministic()


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, repeated ones and those of a null text
    or doc_id each, learned from rows not held out. Empty texts have the score of no feature;
    other columns, whatever their names, are not read."""
    out = held_out("doc_id", 3, 1)
    model = fit(docs.where(~out), labels)
    return (docs.select("doc_id", out.alias("held_out"), scorer(docs, model)(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, with their own columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    model = fit(docs.where(~held_out("doc_id", 3, 1)), labels)
    return docs.withColumn(name, scorer(docs, model)(F.col("text"))).where(F.col(name) >= 0.5).drop(name)
