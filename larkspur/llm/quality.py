"""Quality classifier: naive Bayes support vectors (NBSVM).

Method. A text's features are the character 4-grams of its bytes and of their shapes, the 4-grams of whether a word repeats the one
before, and the share of such words in eighths (indicators; the character grams are hashed to `BINS`). Each feature is
scaled by the log-ratio of its smoothed counts in the two classes, and a linear model with hinge loss is fitted on the scaled
features by dual coordinate descent. A logistic curve fitted to out-of-fold margins turns margins into scores, so 0.3 and 0.5 are
probabilities and not arbitrary cuts.

Fit. Labelled rows whose crc32(id as text) mod 5 is not `HELD_OUT`; at most `SAMPLE` of each class, by a hash of the id at a rate
from the class counts. Labels, lang, source and id are not features.

Scale. One pass in Arrow batches with a model of fixed size, no shuffle of texts but for the join of the sampled labels. What the
driver gets to fit on are feature indices, at most `SIZE` for a sampled row.

Edge cases. Null and empty texts hold no feature and get the model's bias as score. Labels other than 0 and 1 and null labels are
ignored; an id with several labels counts with each. With a single class or none learned, all scores are that class (or 0.5).
Repeated rows each get a row, so rows that tie in text get the same score; empty tables give empty results, and a model of an empty
table scores 0.5. Texts of any length are read whole. A column score is replaced, others may have any name. A null id is not held out and never labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import in_batches, read_table, small_side
from larkspur.llm.decontaminate import word_hashes
from larkspur.llm.textbuf import pieces

BINS = 1 << 18
SIZE = BINS + 25
#: Rows of each class that a fit aims at; remainder of crc32(id) mod 5 that is held out.
SAMPLE, HELD_OUT = 3000, 0
#: Smoothing of counts, cost of a margin violation, rounds of coordinate descent.
ALPHA, COST, ROUNDS = 1.0, 0.05, 20
CUT = 0.3

#: Byte classes of word shapes: lower, upper, digit, blank, line end, other ASCII (each its own), beyond ASCII.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 128


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Indices of the features that each row holds, ascending."""
    grams = np.zeros(0, np.int64)
    if len(data) >= 4:
        x = data.astype(np.uint32)
        h = ((x[:-3] * 257 + x[1:-2]) * 257 + x[2:-1]) * 257 + x[3:]
        s = _SHAPE[data].astype(np.uint32)
        g = ((s[:-3] * 257 + s[1:-2]) * 257 + s[2:-1]) * 257 + s[3:] + np.uint32(0x51ED270B)
        half = np.uint32(BINS // 2)
        grams = np.concatenate(((h * np.uint32(0x9E3779B1)) >> np.uint32(15), (((g * np.uint32(0x85EBCA77)) >> np.uint32(15)) + half))).astype(np.int64)
    n = len(grams) // 2
    words, rows = word_hashes(data, offsets)
    again = words[1:] == words[:-1]
    seen, out = np.zeros(SIZE, bool), []
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        some = grams[a : max(a, b - 3)], grams[n + a : n + max(a, b - 3)]
        for x in some:
            seen[x] = True
        same = again[rows[r] : max(rows[r], rows[r + 1] - 1)].astype(np.int64)
        if len(same):
            seen[BINS + 16 + int(8 * same.mean())] = True
            seen[BINS + 8 * same[:-3] + 4 * same[1:-2] + 2 * same[2:-1] + same[3:]] = True
        out.append(np.flatnonzero(seen).astype(np.int32))
        seen[BINS:] = False
        for x in some:
            seen[x] = False
    return out


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """(weights of scaled indicators, bias) of an L2-regularised hinge-loss model, by dual coordinate descent."""
    w, b = np.zeros(SIZE), 0.0
    # every row is brought to length 1, so that long texts do not dominate; the bias is one more constant feature
    norm = [1 / np.sqrt(np.square(scale[x]).sum() + 1e-12) for x in rows]
    cost = COST * len(rows) / (2 * np.maximum(1, np.array([(y < 0).sum(), (y > 0).sum()])))[(y > 0).astype(int)]
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(ROUNDS):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            v = scale[x] * norm[i]
            g = y[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), cost[i])
            if (d := new - alpha[i]) != 0:
                w[x] += d * y[i] * v
                b += d * y[i]
                alpha[i] = new
                most = max(most, abs(d))
        if most < 1e-4:
            break
    return w, b


def _margins(rows: list[np.ndarray], w: np.ndarray, b: float, scale: np.ndarray) -> np.ndarray:
    u, q = w * scale, np.square(scale)
    return np.array([u[x].sum() / np.sqrt(q[x].sum() + 1e-12) + b for x in rows])


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = np.full((2, SIZE), ALPHA)
    for x, good in zip(rows, y > 0):
        count[int(good), x] += 1
    p = count / count.sum(1, keepdims=True)
    return np.log(p[1] / p[0])


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton's method with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (p - t) + 1e-3 * a
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a = a - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


class Model:
    """Weight and squared scale of each feature, bias, and the logistic curve of margins."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """Learns from the feature indices and label of each row."""
        y = np.where(labels == 1, 1.0, -1.0)
        self.u, self.q, self.b, self.curve = np.zeros(SIZE), np.zeros(SIZE), 0.0, (1.0, 0.0)
        if not len(y) or abs(y.sum()) == len(y):
            self.curve = (0.0, 0.0 if not len(y) else 10.0 * y[0])
            return
        margins, fold = np.zeros(len(y)), np.random.default_rng(5).integers(0, 3, len(y))
        for k in range(3):
            ins, outs = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            scale = _ratios([rows[i] for i in ins], y[ins])
            w, b = descend([rows[i] for i in ins], y[ins], scale)
            margins[outs] = _margins([rows[i] for i in outs], w, b, scale)
        self.curve = _logistic(margins, y)
        scale = _ratios(rows, y)
        w, self.b = descend(rows, y, scale)
        self.u, self.q = w * scale, np.square(scale)

    def state(self) -> tuple:
        return self.u.astype(np.float32), self.q.astype(np.float32), self.b, self.curve


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where(F.col("__y").isin(0, 1) & ~held_out("__id"))
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("__y") == 1, sample / max(1, counts.get(1, 0))).otherwise(sample / max(1, counts.get(0, 0)))
    lot = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "__id"), 11) / float(1 << 53)
    some = known.where(lot < rate)
    rows = docs.select(F.col(id_col).alias("__id2"), F.col(text_col).alias("__text")).join(small_side(some, some.count()), F.col("__id2") == F.col("__id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([x.tobytes() for _, data, offsets in pieces(b.column(2)) for x in features(data, offsets)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], names=["th", "y", "found"])

    # the driver gets indices, at most SIZE for each of the sampled rows, and never texts
    drawn = in_batches(rows.select(F.xxhash64("__id", "__text").alias("th"), F.col("__y").cast("int").alias("y"), F.coalesce("__text", F.lit("")).alias("text")))
    got = sorted((r["th"], bytes(r["found"]), r["y"]) for r in drawn.mapInArrow(run, "th long, y int, found binary").toLocalIterator())
    return Model([np.frombuffer(x, np.int32) for _, x, _ in got], np.array([y for _, _, y in got]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a score column (replaced if there is one)."""
    docs = docs.select([c for c in docs.columns if c != "score"])
    at = docs.columns.index(text_col)
    spread = docs.sparkSession.sparkContext.broadcast(model.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, q, b, (slope, offset) = spread.value
        for batch in batches:
            m = [u[x].sum() / np.sqrt(q[x].sum() + 1e-12) + b for _, data, offsets in pieces(batch.column(at)) for x in features(data, offsets)]
            s = 1 / (1 + np.exp(-np.clip(slope * np.array(m, np.float64) + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
