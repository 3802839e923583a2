"""Operator 10, mixing sources to target weights by soft membership.

A softmax classifier, trained on the labelled table, gives each document posteriors over the domains. Every document
d (n_d tokens, posteriors P_d) gets a rate r_d >= 0 so that the expected domain totals s = sum r_d n_d P_d match the
target totals T. Least squares, ``sum_k (s_k - T_k)^2 / (2 T_k N) + ridge / 2 * sum_d n_d (r_d - 1)^2 / N`` (N: all
tokens), has its minimum where ``r_d = max(0, 1 - P_d . g / ridge)`` and ``g_k = s_k / T_k - 1``: a rate depends on its
posteriors and the domains' relative misses g only. So g is found by Newton's method on the convex dual function,
until the two sides differ by at most ``RESIDUAL``; else an error is raised. A step needs sums by domain only, one
distributed pass, in which shorter steps are evaluated along with the whole one. Totals that still miss their targets by
over ``MISS`` at the minimum (no rates reach them, or the ridge outweighs a rare domain) are warned of.

Defined results: null or empty text has 0 tokens and takes the posteriors of a text without words; repeated rows each
get a rate; without labels all posteriors are equal; an empty table gives an empty result; further columns are
ignored; a long text is read in stretches that end at white space; of rows that share a labelled id one text is learned.
Tokens are words, ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmax.llm.common import SLICE_BYTES, flat_text, held_out, lean, shared_table, slices
from glyphmax.llm.quality_model import CLASSES
from glyphmax.llm.quality_rules import SPACE

BUCKETS = 1 << 13
FEATURES = BUCKETS + CLASSES.shape[1] + 1
#: Documents whose feature rows (32 KB each, and 64 KB of counts) are held at once.
SLICE_DOCS = 128
TRAIN_DOCS = 2500
TRAIN_BYTES = 1 << 16
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 100, 0.05, 1e-4, 11
#: Shares of all tokens.
TARGETS = {"clean": 0.93, "low": 0.02, "toxic": 0.05}
#: Newton steps at most, the residual that ends them, and the relative miss of a target that is warned of.
RIDGE, STEPS, RESIDUAL, MISS = 1e-3, 60, 1e-8, 0.05
#: Fractions of a Newton step that are evaluated in one pass.
FRACTIONS = 0.5 ** np.arange(12)

LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
POWERS = np.multiply.accumulate(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def domain_of() -> Column:
    """The labelled table's domain: toxic, else by quality; null labels have none."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")


def raw_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of hashed lower-case words and of bytes of each class per document, and of words."""
    n = len(ends) - 1
    out = np.zeros((n, FEATURES), np.float32)
    words = np.zeros(n, np.int64)
    if not len(data):
        return out, words
    doc = np.repeat(np.arange(n), np.diff(ends))
    word = ~SPACE[data]
    start = word.copy()
    start[1:] &= ~(word[:-1] & (doc[1:] == doc[:-1]))
    at = np.flatnonzero(start)
    if len(at):
        offset = np.arange(len(data)) - at[np.maximum(np.cumsum(start) - 1, 0)]
        value = np.where(word, (LOWER[data] + np.uint64(1)) * POWERS[np.clip(offset, 0, 63)], np.uint64(0))
        h = np.add.reduceat(value, at)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = (h >> np.uint64(51)).astype(np.int64)
        words = np.bincount(doc[at], minlength=n)
        out[:, :BUCKETS] = np.bincount(doc[at] * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    for k in range(CLASSES.shape[1]):
        out[:, BUCKETS + k] = np.bincount(doc, CLASSES[data, k], minlength=n)
    return out, words


def word_stretches(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of one text of about ``SLICE_BYTES`` that end at white space; a longer word is in one range."""
    at = 0
    while at < len(data):
        to = min(at + SLICE_BYTES, len(data))
        while to < len(data) and not SPACE[data[to]]:
            found = np.flatnonzero(SPACE[data[to : to + (1 << 16)]])
            to = to + int(found[0]) if len(found) else min(to + (1 << 16), len(data))
        yield at, to
        at = to


def document_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rooted shares of hashed lower-case words and of byte classes per document, and word counts."""
    if len(ends) == 2 and len(data) > SLICE_BYTES:
        out, words = np.zeros((1, FEATURES), np.float32), np.zeros(1, np.int64)
        for a, b in word_stretches(data):
            part, n = raw_features(data[a:b], np.array([0, b - a]))
            out, words = out + part, words + n
    else:
        out, words = raw_features(data, ends)
    shares = out[:, :BUCKETS]
    out[:, -1] = (shares > 0).sum(axis=1) / np.maximum(words, 1)
    np.sqrt(shares / np.maximum(words, 1)[:, None], out=shares)
    out[:, BUCKETS:-1] /= np.maximum(np.diff(ends), 1)[:, None]
    return out, words


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_domains: int, seed: int = SEED) -> np.ndarray:
    """Softmax regression by Adam on sparse rows (places, values); returns (FEATURES + 1, domains)."""
    w, one, two = (np.zeros((FEATURES + 1, n_domains), np.float32) for _ in range(3))
    step = 0
    r, hot = np.random.default_rng(seed), np.eye(n_domains, dtype=np.float32)[y]
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            x = np.zeros((len(some), FEATURES + 1), np.float32)
            x[:, -1] = 1
            for k, j in enumerate(some):
                x[k, bags[j][0]] = bags[j][1]
            grad = x.T @ ((softmax(x @ w) - hot[some]) / len(some)) + DECAY * w
            step += 1
            one += 0.1 * (grad - one)
            two += 0.001 * (grad * grad - two)
            w -= RATE * (1 - epoch / EPOCHS) * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Classifier weights from up to ``train_docs`` labelled documents of at most ``TRAIN_BYTES`` each, none held out."""
    known = labels.select("doc_id", domain_of().alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    # at most train_docs short rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("domain").alias("domain"), F.min("text").alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_text(batch.column(2))
            for i, j in slices(ends, rows=SLICE_DOCS):
                x, _ = document_features(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                places = [np.flatnonzero(v).astype(np.uint16) for v in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i).cast(pa.string()), pa.array([p.tobytes() for p in places], pa.binary()), pa.array([v[p].astype(np.float16).tobytes() for v, p in zip(x, places)], pa.binary())],
                    names=["doc_id", "domain", "places", "shares"],
                )

    found = sorted(rows.mapInArrow(run, "doc_id long, domain string, places binary, shares binary").collect())
    if not found:
        return np.zeros((FEATURES + 1, len(domains)), np.float32)
    bags = [(np.frombuffer(r["places"], np.uint16).astype(np.int64), np.frombuffer(r["shares"], np.float16).astype(np.float32)) for r in found]
    return train(bags, np.array([domains.index(r["domain"]) for r in found]), len(domains))


def posteriors(docs: DataFrame, weights: np.ndarray, domains: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` (the text among them is not returned), ``n_tokens`` and one posterior ``p_<domain>`` each."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long", *(f"p_{d} double" for d in domains)])
    names = [*keep, "n_tokens", *(f"p_{d}" for d in domains)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_text(batch.column(len(keep)))
            for i, j in slices(ends, rows=SLICE_DOCS):
                x, words = document_features(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                p = softmax((x @ weights[:-1] + weights[-1]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), pa.array(words), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(domains)))], names=names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def rates(p: np.ndarray, g: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The optimal rates at the domains' relative misses ``g``."""
    return np.maximum(0, 1 - p @ g / ridge)


def dual_sums(p: np.ndarray, n: np.ndarray, g: np.ndarray, ridge: float) -> np.ndarray:
    """Of the dual function's sums over documents: its value, the domain totals, and the curvature row by row."""
    r = rates(p, g, ridge)
    active = p * np.where(r > 0, n, 0)[:, None]
    return np.concatenate([[ridge / 2 * (n @ (r * r))], (r * n) @ p, (p.T @ active).ravel() / ridge])


def fit_misses(found: DataFrame, targets: Mapping[str, float], ridge: float = RIDGE, steps: int = STEPS, residual: float = RESIDUAL) -> np.ndarray:
    """The relative misses at the minimum, from which :func:`rates` gives every document's rate."""
    names = list(targets)
    k = len(names)
    total = found.agg(F.sum("n_tokens").cast("double").alias("n")).first()["n"] or 0.0
    if not total:
        return np.zeros(k)
    goal = np.array([targets[d] for d in names]) / sum(targets.values())
    goal = np.maximum(goal, 1e-6)  # a domain of weight 0 keeps a finite scale
    width = 1 + k + k * k

    def evaluated(points: list[np.ndarray]) -> list[np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(points) * width)
            for batch in batches:
                p = np.stack([batch.column(1 + i).to_numpy() for i in range(k)], axis=1)
                n = batch.column(0).to_numpy() / total
                out += np.concatenate([dual_sums(p, n, g, ridge) for g in points])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["i", "v"])

        rows = found.select("n_tokens", *(f"p_{d}" for d in names)).mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return list(np.array([r["v"] for r in sorted(rows)]).reshape(len(points), width))

    def value(g: np.ndarray, s: np.ndarray) -> float:
        return s[0] + goal @ (g * g / 2 + g)

    g = np.zeros(k)
    s = evaluated([g])[0]
    for step in range(steps + 1):
        slope = goal * (g + 1) - s[1 : 1 + k]
        left = np.max(np.abs(slope) / goal)
        if left <= residual:
            break
        if step == steps:
            raise RuntimeError(f"rates not settled after {steps} steps: residual {left:.3g} over {residual:.3g}")
        move = -np.linalg.solve(np.diag(goal) + s[1 + k :].reshape(k, k), slope)
        points = [g + f * move for f in FRACTIONS]
        every = evaluated(points)
        # at the end values differ by rounding only, so a step that settles the residual is taken first
        calm = [np.max(np.abs(goal * (a + 1) - b[1 : 1 + k]) / goal) for a, b in zip(points, every)]
        best = int(np.argmin(calm)) if min(calm) <= residual else int(np.argmin([value(a, b) for a, b in zip(points, every)]))
        g, s = points[best], every[best]
    if np.max(np.abs(g)) > MISS:
        warnings.warn("targets missed: " + ", ".join(f"{d} {t * (1 + x):.4f} of {t:.4f}" for d, t, x in zip(names, goal, g)), stacklevel=2)
    return g


def mix_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, keep: tuple[str, ...] = ("doc_id",), weights: np.ndarray | None = None) -> DataFrame:
    """``keep``, ``n_tokens``, posteriors and ``rate`` for every row of ``docs``."""
    names = list(targets)
    if weights is None:
        weights = fit(docs, labels, names)
    found = shared_table(posteriors(docs, weights, names, list(keep)), "posteriors")
    misses = fit_misses(found, targets)
    width = len(keep) + 1

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(width + k).to_numpy() for k in range(len(names))], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, misses))], names=[*batch.schema.names, "rate"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema), "rate double"])
    return found.mapInArrow(rate, schema)


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """Rows of ``docs`` as often as their rate says: its whole part, and once more with its fraction's probability,
    drawn from a hash of the row."""
    key = F.xxhash64("doc_id", "text")
    rates = mix_rates(docs.select("doc_id", "text", key.alias("rk")), labels, targets, keep=("doc_id", "rk"))
    rates = rates.groupBy(F.col("doc_id").alias("rate_id"), F.col("rk").alias("rate_rk")).agg(F.first("rate").alias("rate"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", key.alias("rk"))
    rows = rows.join(rates, (F.col("rk") == F.col("rate_rk")) & F.col("doc_id").eqNullSafe(F.col("rate_id")))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "rk"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    rows = rows.select("row", copies.alias("copies")).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
