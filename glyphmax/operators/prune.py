"""Redundancy clustering, codebooks, retrieval-space saliency, winners and the pruning plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmax.functions import vec
from glyphmax.operators.similarity import page_rows, token_matches
from glyphmax.plans.running import running

BLOCK = 1024


def greedy_clusters(unit: np.ndarray, threshold: float) -> np.ndarray:
    """Leader of each row in visiting order: the first leader within ``threshold`` (cosine), else the row itself."""
    n = len(unit)
    leader = np.arange(n)
    if threshold >= 1 or n < 2:
        return leader
    leaders: list[int] = []
    for a in range(0, n, BLOCK):
        part = unit[a : a + BLOCK]
        to_old = part @ unit[leaders].T if leaders else np.zeros((len(part), 0))
        within = part @ part.T
        new: list[int] = []
        old_n = len(leaders)
        for i in range(len(part)):
            near = np.flatnonzero(to_old[i] >= threshold) if old_n else ()
            if len(near):
                leader[a + i] = leaders[near[0]]
                continue
            mine = [j for j in new if within[i, j] >= threshold]
            if mine:
                leader[a + i] = a + mine[0]
            else:
                new.append(i)
        leaders += [a + i for i in new]
    return leader


def redundancy(patches: DataFrame, threshold: float, order: str | None = None) -> DataFrame:
    """``page_id, tok, leader``: clusters of near-duplicate patches of a page.

    Patches are visited by descending ``order`` (ties, and without one, by token); a page is one task's group.
    """
    rows = patches.select("page_id", "tok", (F.col(order) if order else F.lit(0.0)).cast("double").alias("o"), "v")

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["o", "tok"], ascending=[False, True])
        x = np.stack(page["v"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        tok = page["tok"].to_numpy()
        return pd.DataFrame({"page_id": page["page_id"].to_numpy(), "tok": tok, "leader": tok[greedy_clusters(x, threshold)]})

    return rows.groupBy("page_id").applyInPandas(run, "page_id long, tok int, leader int")


def merged(patches: DataFrame, clusters: DataFrame, merge: bool = True) -> DataFrame:
    """One unit vector per cluster: its mean, or with ``merge`` off its leader's; ``page_id, tok, size, v``."""
    rows = patches.select("page_id", "tok", "v").join(clusters, ["page_id", "tok"])
    if not merge:
        sizes = clusters.groupBy("page_id", F.col("leader").alias("tok")).agg(F.count("*").cast("int").alias("size"))
        return patches.select("page_id", "tok", "v").join(sizes, ["page_id", "tok"]).select("page_id", "tok", "size", vec.normalise(F.col("v")).alias("v"))
    size = rows.groupBy("page_id", "leader").agg(F.count("*").cast("int").alias("size"))
    mean = rows.select("page_id", "leader", F.posexplode("v").alias("k", "x")).groupBy("page_id", "leader", "k").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("page_id", "leader").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("v"))
    return mean.join(size, ["page_id", "leader"]).select("page_id", F.col("leader").alias("tok"), "size", vec.normalise(F.col("v")).alias("v"))


def clustered(patches: DataFrame, threshold: float, order: str | None = None, merge: bool = True) -> DataFrame:
    """:func:`merged` of :func:`redundancy`, made while a page is at hand: no join and no row a component."""
    rows = patches.select("page_id", "tok", (F.col(order) if order else F.lit(0.0)).cast("double").alias("o"), "v")

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["o", "tok"], ascending=[False, True])
        x = np.stack(page["v"].to_numpy()).astype(np.float64)
        leader = greedy_clusters(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), threshold)
        size = np.bincount(leader, minlength=len(x))
        kept = np.flatnonzero(size)
        if merge:
            total = np.zeros_like(x)
            np.add.at(total, leader, x)
            x = total / np.maximum(size, 1)[:, None]
        v = x[kept] / np.maximum(np.linalg.norm(x[kept], axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"page_id": page["page_id"].to_numpy()[kept], "tok": page["tok"].to_numpy()[kept], "size": size[kept].astype(np.int32), "v": list(v)})

    return rows.groupBy("page_id").applyInPandas(run, "page_id long, tok int, size int, v array<double>")


def sample_vectors(patches: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """The ``n`` vectors that come first by a hash of their place: the same for any partitioning."""
    return patches.orderBy(F.xxhash64(F.lit(seed), "page_id", "tok"), "page_id", "tok").limit(n)


def random_codebook(dim: int, size: int, seed: int = 7) -> np.ndarray:
    c = np.random.default_rng(seed).normal(size=(size, dim))
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def farthest_codebook(unit: np.ndarray, size: int, first: int = 0) -> np.ndarray:
    """Rows chosen one after another: the one least similar to its most similar chosen row, the first on ties."""
    chosen, best = [first], unit @ unit[first]
    while len(chosen) < min(size, len(unit)):
        k = int(np.argmin(np.round(best, 12)))
        chosen.append(k)
        best = np.maximum(best, unit @ unit[k])
    return np.array(chosen)


def farthest_first(patches: DataFrame, size: int) -> np.ndarray:
    """:func:`farthest_codebook` over all patches: from the first by page and token on, each round takes the unit vector
    least similar (to 9 digits, the first on ties) to its most similar chosen one. One scan a round, one row a task."""
    schema = "best double, page_id long, tok int, v array<double>"
    first = patches.orderBy("page_id", "tok").select("v").first()
    if first is None:
        return np.zeros((0, 0))
    chosen = [np.array(first["v"]) / max(np.linalg.norm(first["v"]), 1e-12)]
    for _ in range(min(size, patches.count()) - 1):
        book = np.array(chosen)

        def run(batches: Iterator[pa.RecordBatch], book: np.ndarray = book) -> Iterator[pa.RecordBatch]:
            least: tuple | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                best, page, tok = np.round((x @ book.T).max(axis=1), 9), batch.column(0).to_numpy(), batch.column(1).to_numpy()
                k = np.lexsort((tok, page, best))[0]
                here = (float(best[k]), int(page[k]), int(tok[k]), x[k].tolist())
                least = here if least is None or here[:3] < least[:3] else least
            if least is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(("best", "page_id", "tok", "v"), least))], pa.schema([("best", pa.float64()), ("page_id", pa.int64()), ("tok", pa.int32()), ("v", pa.list_(pa.float64()))]))

        row = patches.select("page_id", "tok", "v").mapInArrow(run, schema).agg(F.min_by("v", F.struct("best", "page_id", "tok")).alias("v")).first()
        chosen.append(np.array(row["v"]))
    return np.array(chosen)


def kmeans_codebook(unit: np.ndarray, size: int, seed: int = 7, iterations: int = 10) -> np.ndarray:
    """Spherical k-means; an empty cell starts again at a random row."""
    r = np.random.default_rng(seed)
    c = unit[r.choice(len(unit), min(size, len(unit)), replace=False)].copy()
    for _ in range(iterations):
        near = np.argmax(unit @ c.T, axis=1)
        for k in range(len(c)):
            mine = unit[near == k]
            c[k] = mine.mean(axis=0) if len(mine) else unit[r.integers(len(unit))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_codebook(patches: DataFrame, size: int = 256, source: str = "farthest", seed: int = 7, sample: int = 20_000) -> np.ndarray:
    """Unit probe vectors fitted on a bounded sample of patches."""
    rows = sample_vectors(patches.select("page_id", "tok", "v"), sample, seed).collect()
    x = np.array([r["v"] for r in rows], np.float64)
    if source == "random":
        return random_codebook(x.shape[1], size, seed)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if source == "farthest":
        return x[farthest_codebook(x, size)]
    if source == "kmeans":
        return kmeans_codebook(x, size, seed)
    raise ValueError(f"unknown codebook source {source!r}")


def small_matrix(rows: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a small table (probes or centres), sorted by key."""
    found = sorted((r[key], list(r["v"])) for r in rows.select(key, "v").collect())
    return np.array([k for k, _ in found], np.int64), np.array([v for _, v in found], np.float64)


def assigned(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """The rows of ``vectors`` with their nearest centre (``probe, v``) by inner product, to 9 digits, the lower probe on
    ties: adds ``probe, sim``. Centres are few and are sent to the workers."""
    probe, c = small_matrix(centres, "probe")
    at = vectors.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.round(batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ c.T, 9) if batch.num_rows else np.zeros((0, len(c)))
            best = s.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probe[best].astype(np.int32)), pa.array(s[np.arange(len(s)), best])], names=[*batch.schema.names, "probe", "sim"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema), "probe int, sim double"])
    return vectors.mapInArrow(run, schema)


def kmeans_step(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """One distributed spherical k-means step, from partial sums a task: ``probe, n, v`` of the cells that are not empty."""
    probe, c = small_matrix(centres, "probe")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c), np.int64), np.zeros_like(c)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = np.round(x @ c.T, 9).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            n += np.bincount(near, minlength=len(c))
            np.add.at(total, near, x)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(probe[full].astype(np.int32)), pa.array(n[full]), pa.array(list(total[full]), pa.list_(pa.float64()))], names=["probe", "n", "s"])

    parts = vectors.select("v").mapInArrow(sums, "probe int, n long, s array<double>")
    whole = parts.groupBy("probe").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(c.shape[1])])
    return whole.select("probe", "n", vec.normalise(F.array(*[F.col(f"s{k}") for k in range(c.shape[1])])).alias("v"))


def probe_saliency(patches: DataFrame, probes: DataFrame) -> DataFrame:
    """Retrieval-space saliency per patch: probes that it wins on its page, and how close its best probe is.

    wins / max wins + 0.5 / probes * (best - least) / (most - least), divided by the page's largest value. Probes are few
    and are sent to the workers; a page is one row.
    """
    _, c = small_matrix(probes, "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, toks, wins_of, out = batch.column(0).to_numpy(), [], [], []
            sizes = batch.column(1).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch.column(3).flatten()), -1)
            for a, b in zip(ends[:-1], ends[1:]):
                s = np.round(x[a:b] @ c.T, 9)
                wins, best = np.bincount(s.argmax(axis=0), minlength=b - a), s.max(axis=1)
                spread = best.max() - best.min()
                value = wins / max(wins.max(), 1) + 0.5 / len(c) * ((best - best.min()) / spread if spread > 0 else 0.0)
                wins_of.append(wins)
                out.append(value / value.max() if value.max() > 0 else np.zeros(b - a))
            if len(pages):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(pages, sizes)), batch.column(3).flatten().cast(pa.int32()), pa.array(np.concatenate(wins_of)), pa.array(np.concatenate(out))], names=["page_id", "tok", "wins", "saliency"])

    rows = page_rows(patches, "v", "tok").mapInArrow(run, "page_id long, tok int, wins long, saliency double")
    return rows.withColumn("saliency", F.round("saliency", 6))


def winners(patches: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, qtok, page_id, tok``: the patch that answers each query token on each page, the lower token on ties."""
    return token_matches(patches, queries).select("qid", "qtok", "page_id", "tok")


def winner_coverage(won: DataFrame, queries: DataFrame) -> DataFrame:
    """``n_queries, n_winners``: distinct winning patches after the first n queries (by id); ``won``:
    :func:`glyphmax.operators.similarity.winner_counts` of ``queries``."""
    per = queries.select("qid").distinct().join(won.groupBy(F.col("first").alias("qid")).agg(F.count("*").alias("n")), "qid", "left")
    return running(per, ["qid"], n_queries=F.lit(1), n_winners=F.coalesce("n", F.lit(0))).select(F.col("n_queries").cast("int").alias("n_queries"), "n_winners")


def pruned(patches: DataFrame, saliency: DataFrame | None, *, keep_ratio: float | None = None, threshold: float | None = None, min_keep: int = 1, redundancy_threshold: float = 1.0, merge: bool = True, keep_text_tokens: bool = True) -> DataFrame:
    """Patches that survive the spatial budget and redundancy clustering: ``page_id, tok, size, v``.

    ``saliency``: ``page_id, tok, saliency``; its column ``keep``, if there, is the budget; None keeps all. Structural tokens are never pruned, but left out without ``keep_text_tokens``.
    """
    body, text = patches.where(~F.col("is_text")), patches.where("is_text")
    if saliency is None:
        body = body.withColumn("saliency", F.lit(1.0))
    elif "keep" in saliency.columns:
        body = body.join(saliency.where("keep").select("page_id", "tok", "saliency"), ["page_id", "tok"])
    else:
        body = body.join(saliency.select("page_id", "tok", "saliency"), ["page_id", "tok"])
        page = Window.partitionBy("page_id")
        rank, n = F.row_number().over(page.orderBy(F.desc("saliency"), "tok")), F.count("*").over(page)
        chosen = rank <= F.greatest(F.lit(1.0), F.rint(n * keep_ratio)) if keep_ratio is not None else F.col("saliency") > (threshold or 0.0)
        body = body.withColumn("keep", chosen | (rank <= F.least(F.lit(min_keep), n))).where("keep").drop("keep")
    if redundancy_threshold < 1:
        out = clustered(body, redundancy_threshold, "saliency", merge)
    else:
        out = body.select("page_id", "tok", F.lit(1).alias("size"), "v")
    return out.unionByName(text.select("page_id", "tok", F.lit(1).alias("size"), "v")) if keep_text_tokens else out


def pruning_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """``page_id, n_before, n_after, keep_ratio`` per page; pages that lost everything have 0."""
    b = before.groupBy("page_id").agg(F.count("*").alias("n_before"))
    a = after.groupBy("page_id").agg(F.count("*").alias("n_after"))
    n = F.coalesce("n_after", F.lit(0))
    return b.join(a, "page_id", "left").select("page_id", "n_before", n.alias("n_after"), F.round(n / F.greatest("n_before", F.lit(1)), 6).alias("keep_ratio"))


def stage_counts(patches: DataFrame, spatial: DataFrame, kept: DataFrame) -> DataFrame:
    """Tokens of every page by stage: before, on the grid, after the spatial budget, after redundancy, and in the end, with
    the share of the grid that the budget dropped and the number of clusters.

    ``spatial``: grid tokens that the budget kept; ``kept``: :func:`pruned` (``size``: members of a cluster).
    """
    b = patches.groupBy("page_id").agg(F.count("*").alias("n_before"), F.count_if(~F.col("is_text")).alias("n_patches"))
    s = spatial.groupBy("page_id").agg(F.count("*").alias("n_after_spatial"))
    a = kept.join(patches.select("page_id", "tok", "is_text"), ["page_id", "tok"]).groupBy("page_id").agg(F.count_if(~F.col("is_text")).alias("n_after_redundancy"), F.count("*").alias("n_after"), F.count_if(F.col("size") > 1).alias("n_merged"))
    out = b.join(s, "page_id", "left").join(a, "page_id", "left").fillna(0)
    return out.withColumn("blank_fraction", F.round(1 - F.col("n_after_spatial") / F.greatest("n_patches", F.lit(1)), 6))


def random_subset(patches: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """``k`` patches of each page, the first by md5 of seed, page and token: a control for selectors."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "page_id", "tok").cast("binary"))
    return patches.withColumn("turn", F.row_number().over(Window.partitionBy("page_id").orderBy(order, "tok"))).where(F.col("turn") <= k).drop("turn")


def pooled(patches: DataFrame, k: int, method: str = "kmeans", seed: int = 0) -> DataFrame:
    """Pages pooled to ``k`` unit vectors by spherical k-means or average-link clustering: ``page_id, tok, v``."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(page.sort_values("tok")["v"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if len(x) <= k:
            c = x
        elif method == "kmeans":
            c = kmeans_codebook(x, k, seed, 15)
        else:
            sim, size, alive = x @ x.T, np.ones(len(x)), list(range(len(x)))
            member = np.arange(len(x))
            np.fill_diagonal(sim, -np.inf)
            while len(alive) > k:
                sub = sim[np.ix_(alive, alive)]
                i, j = sorted(alive[t] for t in divmod(int(np.argmax(sub)), len(alive)))
                row = (sim[i] * size[i] + sim[j] * size[j]) / (size[i] + size[j])
                sim[i], sim[:, i], sim[i, i] = row, row, -np.inf
                size[i] += size[j]
                member[member == j] = i
                alive.remove(j)
            c = np.stack([x[member == i].mean(axis=0) for i in alive])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"page_id": page["page_id"].iloc[0], "tok": np.arange(len(c), dtype=np.int32), "v": list(c)})

    return patches.select("page_id", "tok", "v").groupBy("page_id").applyInPandas(run, "page_id long, tok int, v array<double>")


def rotate(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Vectors times a fixed (dim x dim) matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("v")
            x = np.array(batch.column(at).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            y = x @ matrix if batch.num_rows else x
            yield batch.set_column(at, batch.schema.field(at), pa.array(list(y), batch.schema.field(at).type))

    return vectors.mapInArrow(run, vectors.schema)


def random_rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def covariance(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count, from per-batch partial sums (dim^2 numbers each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, dim)
            n, s, c = n + len(x), s + x.sum(axis=0), c + x.T @ x
        flat = np.concatenate([[n], s, c.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "x"])

    flat = np.array([r["x"] for r in vectors.select("v").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()])
    n = int(flat[0])
    mean = flat[1 : dim + 1] / max(n, 1)
    return mean, flat[dim + 1 :].reshape(dim, dim) / max(n, 1) - np.outer(mean, mean), n


def pca_rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    return np.linalg.eigh(covariance(vectors, dim)[1])[1][:, ::-1]


def itq_rotation(vectors: DataFrame, dim: int, iterations: int = 50, seed: int = 7, sample: int = 20_000) -> np.ndarray:
    """Iterative quantization: alternate signs of the rotated sample and the rotation nearest to them."""
    x = np.array([r["v"] for r in sample_vectors(vectors.select("page_id", "tok", "v"), sample, seed).collect()])
    r = random_rotation(dim, seed)
    for _ in range(iterations):
        u, _, w = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
        r = (u @ w).T
    return r
