"""Operator 5, exact top-k search by no-random-access aggregation.

Components become integers, floor(256 x). Candidates are cut into blocks; in a block, every dimension is a list sorted
by component, which a query reads from its high end for a positive weight and from its low end for a negative one. Lists are read
in rounds; after reading all to a depth, a candidate's score lies between its seen terms plus the worst unseen ones and its seen
terms plus the terms at the lists' current ends. Reading stops as soon as no outsider's upper bound reaches the k-th
lower bound (or the k-th best score that an earlier block gave); the remaining candidates' scores are then resolved in
full. A round's new terms and both bounds of all queries of a block are matrix products; queries with few candidates left
and candidates that no query needs are not read for again.

Queries go to the workers in rounds of a bounded number; a task keeps its k best of each and lets its later blocks begin
with their scores as bounds. Per task k rows a query are passed on and ranked.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; a query's own row is no candidate, all other rows are, those of its vec_id too; each row of a
repeated query is answered; ties go to the smaller vec_id; empty tables give an empty result; further columns
are ignored. Scores beyond 64 bits are not supported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmax.llm.common import lean, shared_table

K = 5
QUERY_EVERY = 50
CANDIDATE_ROWS = 4096
QUERY_ROWS = 2048
#: Queries that are sent to the workers in one round, 16 MB of 64 components; more are more rounds.
ROUND_QUERIES = 1 << 15
#: Shares of a block's lists that are read before bounds are compared.
DEPTHS = (0.2, 0.45, 0.7)
RESULT = "query_row long, query_id long, vec_id long, score long"


def integers(vector: Column) -> Column:
    """floor(256 x) per component; null for vectors that take no part."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(whole, lambda x: F.coalesce((x > F.lit(float("-inf"))) & (x < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return F.when(fine, F.transform(whole, lambda x: F.floor(x * 256)))


def block_top_k(weights: np.ndarray, x: np.ndarray, query_row: np.ndarray, row: np.ndarray, vec_id: np.ndarray, k: int, floor_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of a block per query (query, candidate, score); ``floor_``: per query a score that k candidates
    elsewhere are known to reach, raised in place."""
    n, dims = x.shape
    reach = float(np.abs(weights).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims
    exact = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    up, down = np.maximum(weights, 0).astype(exact), np.minimum(weights, 0).astype(exact)
    values = x.astype(exact)
    order = np.argsort(-x, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    low_score = np.iinfo(np.int64).min if exact is np.int64 else -np.inf
    least, most = values.min(axis=0), values.max(axis=0)
    # queries and candidates that are still read for, the seen part of their scores, and the pairs not yet ruled out
    qs, cs = np.arange(len(weights)), np.arange(n)
    seen = np.zeros((len(qs), n), exact)
    live = query_row[:, None] != row[None, :]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    before = 0
    for depth in DEPTHS:
        d = int(n * depth)
        if d < k + 1:
            continue
        at, v = place[cs], values[cs]
        high, low = at < d, at >= n - d
        # entries read since the depth before
        seen += up[qs] @ (v * (high & (at >= before))).T + down[qs] @ (v * (low & (at < n - before))).T
        before = d
        end_high, end_low = np.take_along_axis(values, order[d - 1 : d], 0)[0], np.take_along_axis(values, order[n - d : n - d + 1], 0)[0]
        open_high, open_low = (~high).T.astype(exact), (~low).T.astype(exact)
        upper = seen + (up[qs] * end_high) @ open_high + (down[qs] * end_low) @ open_low
        lower = seen + (up[qs] * least) @ open_high + (down[qs] * most) @ open_low
        if len(cs) > k:
            lower[query_row[qs, None] == row[None, cs]] = low_score
            floor_[qs] = np.maximum(floor_[qs], np.partition(lower, len(cs) - k, axis=1)[:, len(cs) - k])
        live &= upper >= floor_[qs, None]
        settled = np.count_nonzero(live, axis=1) <= 4 * k
        if settled.any():
            q, c = np.nonzero(live & settled[:, None])
            found.append((qs[q], cs[c]))
        stay = np.flatnonzero(~settled)
        keep = np.flatnonzero(live[stay].any(axis=0))
        qs, cs, seen, live = qs[stay], cs[keep], seen[np.ix_(stay, keep)], live[np.ix_(stay, keep)]
        if not len(qs):
            break
    q, c = np.nonzero(live)
    q, c = (np.concatenate(p) for p in zip(*found, (qs[q], cs[c])))
    score = np.empty(len(q), np.int64)
    wide, whole = weights.astype(np.int64), x.astype(np.int64)
    for i in range(0, len(q), 1 << 16):
        score[i : i + (1 << 16)] = np.einsum("ij,ij->i", wide[q[i : i + (1 << 16)]], whole[c[i : i + (1 << 16)]])
    order = np.lexsort((vec_id[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.searchsorted(q, np.arange(len(weights)))
    rank = np.arange(len(q)) - first[q]
    full = np.flatnonzero(rank == k - 1)
    floor_[q[full]] = np.maximum(floor_[q[full]], score[full])
    keep = rank < k
    return q[keep], c[keep], score[keep]


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def search(sent, k: int, dims: int, candidate_rows: int, query_rows: int):
    """Candidates (row, vec_id, v) to the ``k`` best of this task for each query that was sent (row, vec_id, matrix)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_row, query_id, w = sent.value
        floor_ = np.full(len(w), -np.inf)
        best = [np.zeros((3, 0), np.int64) for _ in range(0, len(w), query_rows)]  # query, vec_id and score of each block's queries

        def met(x: np.ndarray, row: np.ndarray, vec_id: np.ndarray) -> None:
            for n, a in enumerate(range(0, len(w), query_rows)):
                part = slice(a, a + query_rows)
                q, c, s = block_top_k(w[part], x, query_row[part], row, vec_id, k, floor_[part])
                q, i, s = np.concatenate([best[n], np.stack([q, vec_id[c], s])], axis=1)
                order = np.lexsort((i, -s, q))
                q, i, s = q[order], i[order], s[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                best[n] = np.stack([q, i, s])[:, rank < k]
                full = best[n][:, np.flatnonzero(np.arange(best[n].shape[1]) - np.searchsorted(best[n][0], best[n][0]) == k - 1)]
                floor_[part][full[0]] = np.maximum(floor_[part][full[0]], full[2])

        for batch in batches:
            for i in range(0, batch.num_rows, candidate_rows):
                part = batch.slice(i, candidate_rows)
                met(matrix(part.column(2), dims), part.column(0).to_numpy(), part.column(1).to_numpy())
        for n, a in enumerate(range(0, len(w), query_rows)):
            q, i, s = best[n]
            yield pa.RecordBatch.from_arrays([pa.array(query_row[a + q]), pa.array(query_id[a + q]), pa.array(i), pa.array(s)], names=["query_row", "query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS, round_queries: int = ROUND_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows whose vec_id is divisible by ``query_every`` the k best other rows."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", integers(F.col("embedding")).alias("v")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    # the number of a row, fixed by writing it, tells rows of one vec_id apart
    rows = shared_table(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    is_query = F.col("vec_id") % query_every == 0
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("dims")).first()
    dims, rounds = max(1, sizes["dims"] or 1), max(1, -(-sizes["q"] // round_queries))
    # a task holds the best of a round's queries only, so it may read many candidates
    spread = rows.repartition(max(1, -(-sizes["n"] // (4 * candidate_rows))))
    found = None
    for r in range(rounds):
        q = rows.where(is_query & (F.pmod("row", F.lit(rounds)) == r)).toArrow()
        ids = [q.column(c).to_numpy() for c in ("row", "vec_id")]
        sent = spark.sparkContext.broadcast((*ids, matrix(q.column("v").combine_chunks(), dims)))
        part = spread.mapInArrow(search(sent, k, dims, candidate_rows, query_rows), RESULT)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.n <> q.n WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
