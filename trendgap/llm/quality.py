"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` (512) bytes; only the bag has a label. Each
passage becomes a row of features: how often each pair of byte classes (capital, small
letter, digit, signs, blanks, ...) stands side by side, the share of words that repeat the
word before and of words that occur again in the passage, and the length of words. A layer
with tanh encodes it; a gated unit, tanh(Vh) * sigmoid(Uh) weighted, gives its attention;
the softmax of the attentions over the bag weighs the encoded passages, and a logistic
unit scores their sum. All weights are learnt together from the labels of documents, by
gradient descent with Adam, all in numpy.

The classifier is fitted on at most `sample_rows` labelled documents (by a hash order)
whose features alone are sent to the driver; scoring covers all passages of all texts.
Labels are balanced by weights in training and the intercept is then moved so that the
mean score agrees with the share of label 1, which keeps 0.5 a fair threshold.

Null and empty texts are bags without passages; their score is the share of label 1. Rows
without labels or with null labels are not learnt from; of repeated labels the mean counts
(1 from one half on). Without any labelled row, or with one label only, every score is the
share of label 1, or 0.5. Repeated ids are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trendgap.llm.batches import Texts, arrow_map, chunks, keep_rows, row_sums
from trendgap.llm.language import held_out
from trendgap.llm.suffixes import Hashes

PASSAGE = 512
SAMPLE_ROWS = 4_000
HIDDEN = 16
ATTENTION = 8
EPOCHS = 60

# Byte classes: what a byte says about the kind of text it stands in.
GROUPS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ",
    b"\n\r", b".,;:", b"!?", b"#$%&*@^~", b"|\t_=+", b"\"'()-", bytes(range(0x80, 0x100)),
)
CLASSES = len(GROUPS) + 1
CLASS = np.zeros(256, np.uint8)
for _number, _group in enumerate(GROUPS, 1):
    CLASS[list(_group)] = _number
FEATURES = CLASSES * CLASSES + 4


def passages(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of passages before each text) of a chunk."""
    data, lengths = texts.bytes, texts.lengths
    count = -(-lengths // PASSAGE)
    first = np.append(0, np.cumsum(count))
    total = int(first[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if not total:
        return out, first
    place = np.arange(len(data))
    row = texts.row_of_byte()
    passage = first[row] + (place - texts.starts[row]) // PASSAGE
    kind = CLASS[data].astype(np.int64)
    pair = kind * CLASSES
    pair[:-1] += kind[1:]
    size = np.bincount(passage, minlength=total)
    pairs = np.bincount(passage * CLASSES**2 + pair, minlength=total * CLASSES**2)
    out[:, : CLASSES**2] = np.sqrt(pairs.reshape(total, -1) / size[:, None])
    blank = (data <= 32) & (data != 0)
    begin = ~blank
    begin[1:] &= blank[:-1] | (row[1:] != row[:-1])
    end = ~blank
    end[:-1] &= blank[1:] | (row[1:] != row[:-1])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if len(starts):
        word = Hashes(data, 1).of(starts, ends, 0)
        home = passage[starts]
        words = np.maximum(np.bincount(home, minlength=total), 1)
        same = np.append(False, (word[1:] == word[:-1]) & (home[1:] == home[:-1]))
        order = np.lexsort((word, home))
        again = np.append(
            False, (word[order][1:] == word[order][:-1]) & (home[order][1:] == home[order][:-1])
        )
        out[:, -4] = np.bincount(home, same, total) / words
        out[:, -3] = np.bincount(home[order], again, total) / words
        out[:, -2] = np.log1p(np.bincount(home, ends - starts, total) / words)
    out[:, -1] = np.log(size) / np.log(PASSAGE)
    return out, first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return row_sums(values.astype(np.float64), first)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    share: float = 0.5
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, features: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """All steps for bags of at least one passage each."""
        w = self.weights
        x = (features - self.mean) / self.spread
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        a = (v * u) @ w["a"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        top = np.maximum.reduceat(a, first[:-1])
        e = np.exp(a - top[bag])
        attention = e / sums(e, first)[bag]
        z = sums(attention[:, None] * h, first)
        return {"x": x, "h": h, "v": v, "u": u, "bag": bag, "attention": attention, "z": z,
                "score": sigmoid(z @ w["c"] + w["d"])}

    def judge(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and largest attention of every bag; bags may be empty."""
        scores, top = np.full(len(first) - 1, self.share), np.zeros(len(first) - 1)
        full = np.diff(first) > 0
        if self.weights and full.any():
            bounds = np.append(first[:-1][full], first[-1])
            found = self.forward(features.astype(np.float64), bounds)
            scores[full] = found["score"]
            top[full] = np.maximum.reduceat(found["attention"], bounds[:-1])
        return scores, top


def gradients(model: Model, f: dict[str, np.ndarray], error: np.ndarray, first: np.ndarray) -> dict:
    """Of the weighted log loss; `error` is its derivative by the logit of each bag."""
    w, bag = model.weights, f["bag"]
    dz = error[:, None] * w["c"]
    weight = (f["h"] * dz[bag]).sum(1)
    da = f["attention"] * (weight - sums(f["attention"] * weight, first)[bag])
    gate = da[:, None] * w["a"]
    dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
    dh = f["attention"][:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {
        "W": f["x"].T @ dx, "b": dx.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
        "a": (f["v"] * f["u"]).T @ da, "c": f["z"].T @ error, "d": error.sum(),
    }


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """A model of bags with at least one passage each."""
    model = Model(float(labels.mean()) if len(labels) else 0.5)
    if len(np.unique(labels)) < 2:
        return model
    model.mean, model.spread = features.mean(0), features.std(0) + 0.01
    rng = np.random.default_rng(11)
    shapes = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION),
              "a": (ATTENTION,), "c": (HIDDEN,)}
    model.weights = {k: rng.normal(0, s[0] ** -0.5, s) for k, s in shapes.items()}
    model.weights |= {"b": np.zeros(HIDDEN), "d": np.zeros(())}
    slow = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in model.weights.items()}
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for part in np.array_split(order, max(1, len(order) // 64)):
            step += 1
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            bounds = np.append(0, np.cumsum(np.diff(first)[part]))
            f = model.forward(features[rows], bounds)
            error = balance[part] * (f["score"] - labels[part]) / len(part)
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for k, g in gradients(model, f, error, bounds).items():
                g = g + 1e-4 * model.weights[k]
                slow[k][0] = 0.9 * slow[k][0] + 0.1 * g
                slow[k][1] = 0.99 * slow[k][1] + 0.01 * g * g
                moved = slow[k][0] / (1 - 0.9**step)
                scale = np.sqrt(slow[k][1] / (1 - 0.99**step)) + 1e-8
                model.weights[k] = model.weights[k] - rate * moved / scale
    return centred(model, features, first)


def centred(model: Model, features: np.ndarray, first: np.ndarray) -> Model:
    """Move the intercept until the mean score is the share of label 1."""
    logit = model.forward(features, first)["z"] @ model.weights["c"]
    low, high = -30.0, 30.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if sigmoid(logit + middle).mean() > model.share else (middle, high)
    model.weights["d"] = np.array((low + high) / 2)
    return model


def labelled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and label of at most `sample_rows` documents that are not held out."""
    ids = F.col("doc_id").cast("bigint")
    return (
        labels.select(ids.alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    wanted = {r["doc_id"]: r["label"] for r in labelled(labels, sample_rows).collect()}
    if not wanted:
        return Model()
    chosen = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(
        F.col("doc_id").isin(list(wanted))
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in chunks(batches):
            features, first = passages(Texts(part))
            rows = [features[a:b].astype("<f4").tobytes() for a, b in zip(first, first[1:])]
            yield [part.column("doc_id"), rows]

    bags = sorted(
        (r["doc_id"], bytes(r["bag"]))
        for r in arrow_map(chosen, emit, "doc_id bigint, bag binary").collect()
        if r["bag"]
    )
    if not bags:
        return Model(float(np.mean(list(wanted.values()))))
    sizes = [len(b) // 4 // FEATURES for _, b in bags]
    features = np.frombuffer(b"".join(b for _, b in bags), "<f4").reshape(-1, FEATURES)
    target = np.array([wanted[i] for i, _ in bags], float)
    return fit(features.astype(np.float64), np.append(0, np.cumsum(sizes)), target)


OUT = (
    "doc_id bigint, held_out boolean, score double, predicted int, "
    "n_passages int, top_attention double"
)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Columns as in OUT for every row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for part in chunks(batches):
            features, first = passages(Texts(part))
            scores, top = model.judge(features, first)
            yield [
                part.column("doc_id"), part.column("held_out"), scores,
                (scores >= 0.5).astype(np.int32), np.diff(first), top,
            ]

    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "text",
    )
    return arrow_map(rows, emit, OUT)


def accepted(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, unchanged, whose score is at least `least`."""
    return keep_rows(documents, lambda texts: model.judge(*passages(texts))[0] >= least)
