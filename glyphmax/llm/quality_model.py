"""Operator 1, quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage is encoded (hashed byte trigrams and byte-class
shares through a tanh layer), gated attention weights are learned from document labels alone, and the
attention-weighted passage representation is scored by a logistic unit. The model is trained in numpy on a bounded
sample of labelled documents (``TRAIN_DOCS``, of at most ``TRAIN_BYTES`` each); scoring reads every whole text.

Defined results: null or empty text is one empty passage and has that passage's score; repeated rows each get a row;
without usable labels, or with one class only, every score is the share of label 1 (0.5 with none); an empty table
gives an empty result; further columns are ignored. Ids, languages, sources and labels are no inputs of a score. A
text over ``STRETCH`` bytes is scored a stretch of passages at a time; of rows that share a labelled id one text is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmax.llm.common import flat_text, held_out, lean, slices

PASSAGE = 400
#: Bytes of a longer text whose passages are held at once.
STRETCH = PASSAGE * 2500
BUCKETS = 512
TRAIN_DOCS = 3000
TRAIN_BYTES = 1 << 16
HIDDEN, GATE, EPOCHS, BATCH, RATE, SEED = 24, 12, 25, 64, 0.01, 7
#: Steps that a small sample gets by more epochs.
LEAST_STEPS = 600
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

CLASSES = np.zeros((256, 6), np.float32)
CLASSES[65:91, 0] = 1  # upper case
CLASSES[48:58, 1] = 1  # digits
CLASSES[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"], 2] = 1  # marks
CLASSES[[9, 10, 11, 12, 13, 32], 3] = 1  # white space
CLASSES[128:, 4] = 1  # beyond ASCII
CLASSES[[44, 46], 5] = 1
FEATURES = BUCKETS + CLASSES.shape[1] + 1


def passage_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a slice, and the first passage of each document (n + 1 places)."""
    sizes = np.diff(ends)
    parts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(parts)])
    n = int(first[-1])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    passage = first[doc] + (np.arange(len(data)) - ends[doc]) // PASSAGE
    counts = np.zeros((n, BUCKETS), np.float32)
    if len(data) > 2:
        x = data.astype(np.uint32)
        h = ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77)) + x[2:]) * np.uint32(0xC2B2AE3D)
        inside = np.arange(2, len(data)) < ends[doc[:-2] + 1]
        at = passage[:-2][inside] * BUCKETS + (h[inside] >> np.uint32(23)).astype(np.int64)
        counts = np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out = np.empty((n, FEATURES), np.float32)
    np.sqrt(counts / total, out=out[:, :BUCKETS])
    length = np.maximum(np.bincount(passage, minlength=n), 1).astype(np.float32)
    for k in range(CLASSES.shape[1]):
        out[:, BUCKETS + k] = np.bincount(passage, CLASSES[data, k], minlength=n) / length
    out[:, -1] = (counts > 0).sum(axis=1) / total[:, 0]
    return out, first


@dataclass
class Weights:
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    d: np.ndarray

    def all(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v, self.u, self.a, self.c, self.d]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def attended(m: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages' representations, the two factors of their gated attention, and its logits."""
    h = np.tanh(x @ m.w + m.b)
    t, g = np.tanh(h @ m.v), sigmoid(h @ m.u)
    return h, t, g, (t * g) @ m.a


def forward(m: Weights, x: np.ndarray, first: np.ndarray) -> tuple:
    h, t, g, e = attended(m, x)
    at = first[:-1]
    bag = np.repeat(np.arange(len(at)), np.diff(first))
    p = np.exp(e - np.maximum.reduceat(e, at)[bag])
    p /= np.add.reduceat(p, at)[bag]
    z = np.add.reduceat(p[:, None] * h, at, axis=0)
    return sigmoid(z @ m.c + m.d[0]), h, t, g, p, z, bag


def long_score(m: Weights, data: np.ndarray) -> float:
    """:func:`forward` of one text of any length, ``STRETCH`` bytes of it at a time."""
    top, weight, z = -np.inf, 0.0, np.zeros(len(m.c))
    for a in range(0, len(data), STRETCH):
        part = data[a : a + STRETCH + 2]  # trigrams that begin in the stretch reach two bytes further
        x = passage_features(part, np.array([0, len(part)]))[0][: -(-min(STRETCH, len(data) - a) // PASSAGE)]
        h, _, _, e = attended(m, x)
        new = max(top, float(e.max()))
        p, old = np.exp(e - new), np.exp(top - new)
        top, weight, z = new, weight * old + float(p.sum()), z * old + p @ h
    return float(sigmoid(z / weight @ m.c + m.d[0]))


def scores(model: Weights | float, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores of the documents of a slice."""
    if isinstance(model, float):
        return np.full(len(ends) - 1, model)
    if len(ends) == 2 and len(data) > STRETCH:
        return np.array([long_score(model, data)])
    return forward(model, *passage_features(data, ends))[0].astype(np.float64)


def gradients(m: Weights, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    s, h, t, g, p, z, bag = forward(m, x, first)
    ds = (s - y) / len(y)
    dz = ds[:, None] * m.c
    dp = (dz[bag] * h).sum(axis=1)
    de = p * (dp - np.add.reduceat(p * dp, first[:-1])[bag])
    dt, dg = de[:, None] * m.a * g * (1 - t * t), de[:, None] * m.a * t * g * (1 - g)
    dh = (p[:, None] * dz[bag] + dt @ m.v.T + dg @ m.u.T) * (1 - h * h)
    return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ ds, np.array([ds.sum()])]


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = SEED) -> Weights:
    """Adam over mini-batches of bags; the order and the start are fixed by ``seed``."""
    r = np.random.default_rng(seed)
    f = x.shape[1]
    m = Weights(*(k.astype(np.float32) for k in (r.normal(0, 1 / np.sqrt(8), (f, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.2, (HIDDEN, GATE)), r.normal(0, 0.2, (HIDDEN, GATE)), r.normal(0, 0.2, GATE), r.normal(0, 0.2, HIDDEN), np.zeros(1))))
    one, two, step = [np.zeros_like(k) for k in m.all()], [np.zeros_like(k) for k in m.all()], 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(y) // BATCH)))
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in some])
            starts = np.concatenate([[0], np.cumsum(first[some + 1] - first[some])])
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k, p, q, grad in zip(m.all(), one, two, gradients(m, x[rows], starts, y[some])):
                p += 0.1 * (grad - p)
                q += 0.001 * (grad * grad - q)
                k -= rate * (p / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return m


def training_bags(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, bag borders and labels of up to ``train_docs`` labelled documents that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    # at most train_docs rows of two numbers
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_text(batch.column(2))
            for i, j in slices(ends):
                x, first = passage_features(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                bags = [x[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i).cast(pa.int32()), pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])

    found = sorted(rows.mapInArrow(run, "doc_id long, quality int, bag binary").collect())
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, FEATURES) for r in found]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, FEATURES), np.float32)
    return x, first, np.array([float(r["quality"] > 0) for r in found], np.float32)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Weights | float:
    """A trained model, or the constant score if the labels show no two classes."""
    x, first, y = training_bags(docs, labels, train_docs)
    if not len(y):
        return 0.5
    if y.min() == y.max():
        return float(y[0])
    return train(x, first, y)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` (score >= threshold) for every row of ``docs``."""
    model = fit(docs, labels, train_docs)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_text(batch.column(2))
            for i, j in slices(ends):
                score = scores(model, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    model = fit(docs, labels, train_docs)
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_text(batch.column(at))
            for i, j in slices(ends):
                good = scores(model, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]) >= threshold
                yield batch.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
