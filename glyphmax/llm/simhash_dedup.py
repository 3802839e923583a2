"""Operator 6, SimHash near-duplicates with pivot distance tables.

Fingerprints are collapsed to distinct values with their number of documents. Two fingerprints within 6 bits share at
least two of eight 8-bit blocks, so each goes to the 28 buckets of its block pairs. In a bucket, the Hamming distances
to many fixed reference fingerprints (the pivots) are tabled; rows are ordered by the first pivot's distance, so pairs
further apart there are never formed, pairs whose largest coordinate difference exceeds the bound are discarded, and
survivors are verified by the exact distance. A pair is counted in the first of its common buckets only. A bucket
sends out per-fingerprint link counts and a star per local component, never its pairs; buckets beyond
``BUCKET_ROWS`` are split into blocks of pairs of sub-buckets.

Defined results: null or empty text (or no word) has fingerprint zero and is linked like any other; one word is
hashed alone; repeated rows count as documents; null ids keep their row, and a component of null ids only has a null
component_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmax.llm.common import broadcast_small, flat_text, lean, row_key, shared_table
from glyphmax.llm.components import connected_components

BOUND = 6
BLOCKS = 8
TABLES = list(combinations(range(BLOCKS), BLOCKS - BOUND))
PIVOTS = 16
#: Rows of a bucket that one task compares; larger buckets are split into pairs of sub-buckets.
BUCKET_ROWS = 50_000
#: Hot buckets that may be broadcast (16 bytes each); with more of them the join is left to the optimizer.
HOT_BUCKETS = 100_000
CHUNK_ROWS = 200_000
WORDS = 1 << 16


def fingerprint(raw: bytes) -> bytes:
    """The 8 bytes of a UTF-8 text's fingerprint, most significant first."""
    words = raw.lower().split()
    digest, sums, n = xxhash.xxh64_digest, np.zeros(64, np.int64), max(len(words) - 1, 1)
    if not words:
        return bytes(8)
    for i in range(0, n, WORDS):
        part = words[i : i + WORDS + 1]
        shingles = [a + b" " + b for a, b in zip(part, part[1:])] or part
        hashes = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8)
        sums += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * sums > n).tobytes()


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, rk, fp``: the row's content key and the fingerprint, as signed 64-bit integers."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_text(batch.column(2))
            marks = b"".join([fingerprint(data[i:j].tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(np.frombuffer(marks, ">i8").astype(np.int64))], names=["doc_id", "rk", "fp"])

    return docs.select(key, row_key(key, text).alias("rk"), text).mapInArrow(run, "doc_id long, rk long, fp long")


def pivots() -> np.ndarray:
    x = np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def first_table(x: np.ndarray) -> np.ndarray:
    """Number of the first block pair in which two fingerprints agree, by the xor of the two."""
    same = np.stack([(x >> np.uint64(8 * i)) & np.uint64(255) == 0 for i in range(BLOCKS)])
    out = np.full(len(x), len(TABLES), np.int64)
    for t in range(len(TABLES) - 1, -1, -1):
        out[np.logical_and.reduce([same[i] for i in TABLES[t]])] = t
    return out


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        n = parent[r]
        if np.array_equal(n, r):
            return r
        r = n


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = roots(parent, a), roots(parent, b)
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)


def link_buckets(group: np.ndarray, table: np.ndarray, fp: np.ndarray, weight: np.ndarray, side: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of whole buckets: the linked fingerprints, the documents linked to each, and each one's local root.

    ``group``: bucket (or pair of sub-buckets) of each row; ``table``: number of its block pair; ``side``: sub-bucket;
    where ``cross`` is set only pairs from different sub-buckets are compared.
    """
    value = fp.view(np.uint64)
    near_pivot = np.stack([np.bitwise_count(value ^ p).astype(np.int8) for p in pivots()])
    order = np.lexsort((near_pivot[0], group))
    group, value, weight, side, cross, table, near_pivot = group[order], value[order], weight[order], side[order], cross[order], table[order], near_pivot[:, order]
    node_fp, node = np.unique(value, return_inverse=True)
    parent, near = np.arange(len(node_fp)), np.zeros(len(node_fp), np.int64)
    live, step = np.arange(len(group) - 1), 1
    while len(live):
        far = live + step
        live = live[far < len(group)]
        far = live + step
        go = (group[live] == group[far]) & (near_pivot[0][far] - near_pivot[0][live] <= BOUND)
        live = live[go]
        a, b = live, live + step
        for p in near_pivot[1:]:
            if not len(a):
                break
            keep = np.abs(p[a] - p[b]) <= BOUND
            a, b = a[keep], b[keep]
        if len(a):
            x = value[a] ^ value[b]
            keep = (np.bitwise_count(x) <= BOUND) & (x != 0) & ~(cross[a] & (side[a] == side[b]))
            a, b, x = a[keep], b[keep], x[keep]
            keep = first_table(x) == table[a]
            a, b = a[keep], b[keep]
            np.add.at(near, node[a], weight[b])
            np.add.at(near, node[b], weight[a])
            unite(parent, node[a], node[b])
        step += 1
    linked = np.flatnonzero(near)
    return node_fp[linked].view(np.int64), near[linked], node_fp[roots(parent, linked)].view(np.int64)


@lean
def link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets arrive sorted; whole ones are linked a chunk at a time."""

    def result(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(6)]
        group = np.unique(np.stack([cols[0], cols[4].astype(np.int64), cols[5].astype(np.int64)]), axis=1, return_inverse=True)[1].ravel() if cols[5].any() else cols[0]
        fp, near, root = link_buckets(group, cols[0] >> 16, cols[1], cols[2], cols[3], cols[4] != cols[5])
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(near), pa.array(root)], names=["fp", "near", "root"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = np.stack([whole.column(i).to_numpy() for i in (0, 4, 5)])
            cut = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            if len(cut):
                yield result([whole.slice(0, int(cut[-1]) + 1)])
                whole = whole.slice(int(cut[-1]) + 1)
            held, rows = [whole], whole.num_rows
    if rows:
        yield result(held)


def placed_fingerprints(marks: DataFrame) -> DataFrame:
    """``fp, n_near, component_id, component`` of every distinct fingerprint of ``doc_id, fp`` rows."""
    distinct = marks.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least_id"))
    block = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(BLOCKS)]
    buckets = F.explode(F.array(*[F.lit(t << 16) + block[i] * 256 + block[j] for t, (i, j) in enumerate(TABLES)]))
    rows = distinct.select(buckets.alias("bucket"), "fp", "n")
    hot = rows.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > BUCKET_ROWS)
    hot = shared_table(hot.select("bucket", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("parts")), "hot-buckets")
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= HOT_BUCKETS else hot, "bucket", "left")
        rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("bucket", "fp", "n", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    else:
        zero = F.lit(0)
        rows = rows.select("bucket", "fp", "n", zero.alias("side"), zero.alias("lo"), zero.alias("hi"))
    rows = rows.select(F.col("bucket").cast("long"), "fp", "n", "side", "lo", "hi")
    linked = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(link_sorted, "fp long, near long, root long")
    linked = shared_table(linked, "links")
    near = linked.groupBy("fp").agg(F.sum("near").alias("near"))
    groups = connected_components(linked.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    placed = distinct.join(near, "fp", "left").join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "least_id", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return placed.join(least, "component").select("fp", "n_near", "component_id", "component")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, n_near, component_id`` for every row of ``docs``."""
    marks = shared_table(fingerprints(docs, text, key), "fingerprints")
    return marks.join(placed_fingerprints(marks), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which each group of near-duplicates keeps the one with the least doc_id."""
    marks = shared_table(fingerprints(docs), "fingerprints")
    rows = marks.join(placed_fingerprints(marks).select("fp", "component"), "fp")
    rows = shared_table(rows.groupBy("component", "doc_id", "rk").agg(F.count("*").alias("n")), "grouped")
    stays = rows.groupBy("component").agg(F.min(F.struct("doc_id", "rk")).alias("stays"))
    gone = rows.join(stays, "component").where(F.struct("doc_id", "rk") != F.col("stays"))
    gone = broadcast_small(shared_table(gone.select(F.col("doc_id").alias("gone_id"), F.col("rk").alias("gone_rk")), "near-duplicates"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("rk"))
    kept = keyed.join(gone, (F.col("rk") == F.col("gone_rk")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    if not rows.where("n > 1").isEmpty():  # repeated rows: the least by all columns that have an order
        order = [F.col(f"row.`{f.name}`").cast("string") for f in docs.schema.fields]
        one = kept.groupBy("doc_id", "rk").agg(F.min_by("row", F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in order])).alias("row"))
        kept = one
    return kept.select("row.*")
