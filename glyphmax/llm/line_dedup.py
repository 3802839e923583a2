r"""Operator 8, line dedup: earliest lines stay, those within a few edits of an earlier one go.

Lines are what ``\n`` separates; those of white space only take no part, unless they have ``MIN_CHARS`` code points. A line is removed if an
earlier line of the corpus, by (doc_id, content key, line number), equals it, or is within the bound of edits (insertion,
deletion or substitution of a code point): one for every ``EDIT_CHARS`` code points of the shorter line of the two, one at
least and ``EDITS`` at most, for lines of at least ``MIN_CHARS`` code points. The earlier line need not stay itself. With
``byte_edits`` the edits are of UTF-8 bytes, as those of the SQL's ``levenshtein`` are, and :func:`line_digest` counts them so;
lengths are code points all the same.

Equal lines: a scan writes every line's 128-bit hash and place; a worker that has met a line earlier in the order decides
at once, so of a hot line about one row a task is exchanged. Rows sorted by hash give each line's first place.

Near lines: the deletion neighbourhood of a line of 60 code points within three edits has 36,000 variants, so it is not
emitted whole. Two lines within e edits agree, after deleting what differs, in one of e + 1 segments of the shorter one,
moved by no more than the edits on its either side. So a line emits its variants with all but one segment deleted, as
hashed keys (26 for three edits); keys are exchanged as sorted blocks of 32-bit numbers, the few that a line's own segment
shares with another line come back, and only lines that have such a key are joined and verified by their edit distance.

Defined results: null text is an empty one (one empty line); short blank lines always stay; repeated rows are one document and
are decided alike; rows with null doc_id come first in the order; an empty table gives an empty result; further columns
are kept, and may have any names but those that :func:`deduplicated` adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from glyphmax.llm.common import flat_text, lean, row_key, shared_table, slices

MIN_CHARS = 16
#: Edits at most, and code points of the shorter line for each of them.
EDITS, EDIT_CHARS = 3, 16
#: Lines whose earliest place a task remembers.
SEEN_LINES = 100_000
#: Keys of a line, about, and those of a bucket of the exchange; a key has 31 bits within its bucket.
KEYS_A_LINE, BUCKET_KEYS, KEY_BITS = 26, 1 << 20, 31
#: Lines whose keys are made at once.
KEY_LINES = 1 << 14
#: Shared keys that are sent to all workers (8 bytes each); more are joined.
SENT_KEYS = 8_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

PLACE = ["doc_id", "rk", "line"]
LINE = "h1 long, h2 long, doc_id long, rk long, line int, again boolean, text string"


def occurrences(min_chars: int):
    """(doc_id, rk, text) to a row a line, but for short blank ones; ``again``: this task has met it at an earlier place. Texts of
    at least ``min_chars`` code points come along, unless it is met again."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            data, ends = flat_text(batch.column(2))
            ids, keys = batch.column(0).cast(pa.int64()), batch.column(1)
            for i, j in slices(ends):
                digests, owner, number, again, texts = [], [], [], [], []
                for d, doc_id, rk in zip(range(i, j), ids.slice(i, j - i).to_pylist(), keys.slice(i, j - i).to_pylist()):
                    for n, line in enumerate(data[ends[d] : ends[d + 1]].tobytes().split(b"\n")):
                        if len(line) < min_chars and (not line or line.isspace()):
                            continue
                        digest = xxh3_128_digest(line)
                        here, before = (doc_id is not None, doc_id or 0, rk, n), seen.get(digest)
                        known = before is not None and before < here
                        if not known:
                            if len(seen) >= SEEN_LINES:
                                seen.clear()
                            seen[digest] = here
                        digests.append(digest)
                        owner.append(d)
                        number.append(n)
                        again.append(known)
                        # a line has no more code points than bytes, and no fewer than a quarter of them
                        long = not known and len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars)
                        texts.append(line if long else None)
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at = pa.array(owner, pa.int64())
                columns = [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), ids.take(at), keys.take(at), pa.array(number, pa.int32()), pa.array(again, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()).cast(pa.string())], names=["h1", "h2", *PLACE, "again", "text"])

    return run


@lean
def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash and place: ``again`` is set for all but a line's first; rows at the first's very place go."""
    last = None
    for batch in batches:
        some = np.flatnonzero(~batch.column(5).to_numpy(zero_copy_only=False))
        keep = np.ones(batch.num_rows, bool)
        again = np.ones(batch.num_rows, bool)
        if len(some):
            doc_id = batch.column(2)
            cols = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False), doc_id.fill_null(0).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()]).astype(np.int64)[:, some]
            cols = np.concatenate([cols[:, :1] if last is None else last[:, None], cols], axis=1)
            new = (cols[:2, 1:] != cols[:2, :-1]).any(axis=0)
            if last is None:
                new[0] = True
            first = np.maximum.accumulate(np.where(new, np.arange(1, len(new) + 1), 0))  # 0: the first stood in a batch before
            at_first = (cols[:, 1:] == cols[:, first]).all(axis=0)
            again[some] = ~at_first
            keep[some] = new | ~at_first
            last = cols[:, first[-1]]
        out = pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(again), batch.column(6)], names=batch.schema.names)
        yield out.filter(pa.array(keep))


def seeds(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of lines and their seeds, the lowest bit set for a line's own segments, unset where it may hold another's."""
    n = np.array([len(x) for x in lines], np.int64)
    c = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    power, inverse = (np.full(len(c) + 1, b) for b in (BASE, BASE_INVERSE))
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(c * power[:-1], out=total[1:])
    at = np.cumsum(n) - n
    places, found = [], []
    for delta in range(edits + 1):
        short = n - delta
        bound = np.clip(short // EDIT_CHARS, 1, edits)
        for k in range(max(1, delta), edits + 1):
            who = np.flatnonzero((bound == k) & (short > 0))
            for i in range(k + 1):
                start, end = short[who] * i // (k + 1), short[who] * (i + 1) // (k + 1)
                for move in range(max(-i, delta - k + i), min(i, delta + k - i) + 1):
                    fits = (start + move >= 0) & (end + move <= n[who])
                    w = who[fits]
                    a, b = (at[w] + x[fits] + move for x in (start, end))
                    v = (total[b] - total[a]) * inverse[a] + short[w].astype(np.uint64) * BASE + np.uint64(i << 50)
                    v = (v ^ (v >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    v = (v ^ (v >> np.uint64(29))) & ~np.uint64(1) | np.uint64(delta == 0 and move == 0)
                    places.append(w)
                    found.append(v.view(np.int64))
    return np.concatenate(places), np.concatenate(found)


def located(seed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit number of seeds; the number's lowest bit is the seed's."""
    u = seed.view(np.uint64) >> np.uint64(1)
    low = (u & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(1) | seed.view(np.uint64) & np.uint64(1)
    return ((u >> np.uint64(KEY_BITS)) % np.uint64(buckets)).astype(np.int64), low.astype(np.uint32)


def key_blocks(edits: int, buckets: int):
    """(text) to rows (bucket, block): the numbers of many lines' keys."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            lines = batch.column(0)
            for i, j in slices(flat_text(lines)[1], rows=KEY_LINES):
                held.append(seeds(lines.slice(i, j - i).to_pylist(), edits)[1])
            if sum(map(len, held)) >= 1 << 21:
                yield coded(np.concatenate(held))
                held = []
        if held:
            yield coded(np.concatenate(held))

    def coded(seed: np.ndarray) -> pa.RecordBatch:
        bucket, low = located(seed, buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        bucket, low = bucket[order], low[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        blocks = [x.tobytes() for x in np.split(low, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return run


@lean
def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket to the keys that a line owns and another key equals."""

    def found(bucket: int, held: list[bytes]) -> pa.RecordBatch:
        low = np.sort(np.frombuffer(b"".join(held), np.uint32))
        start = np.flatnonzero(np.diff(low >> np.uint32(1), prepend=~(low[:1] >> np.uint32(1))))
        some = start[(np.add.reduceat(low & np.uint32(1), start) > 0) & (np.diff(start, append=len(low)) > 1)]
        return pa.RecordBatch.from_arrays([pa.array((low[some] >> np.uint32(1)).astype(np.int64) | np.int64(bucket) << KEY_BITS)], names=["key"])

    at, held = -1, []
    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != at and held:
                yield found(at, held)
                held = []
            at = bucket
            held.append(block)
    if held:
        yield found(at, held)


def lines_of_edits(distinct: DataFrame, edits: int, sent_keys: int = SENT_KEYS, *, byte_edits: bool = False) -> DataFrame:
    """The places of distinct lines (h1, h2, place, text; null texts have no part) with an earlier one within the bound."""
    texts = distinct.where("text IS NOT NULL")
    spark = distinct.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.count() * KEYS_A_LINE // BUCKET_KEYS)
    blocks = texts.select("text").mapInArrow(key_blocks(edits, buckets), "bucket int, block binary")
    shared = blocks.repartition(min(buckets, 1 << 16), "bucket").sortWithinPartitions("bucket").mapInArrow(shared_keys, "key long")
    shared = shared_table(shared, "line-keys")
    few = shared.count() <= sent_keys
    known = spark.sparkContext.broadcast(np.sort(np.array(shared.toArrow().column(0), np.int64))) if few else None

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines to a row a key; with the keys known, to those only, the line's place and text beside the first of them."""
        for batch in batches:
            for i, j in slices(flat_text(batch.column(5))[1], rows=KEY_LINES):
                part = batch.slice(i, j - i)
                at, seed = seeds(part.column(5).to_pylist(), edits)
                bucket, low = located(seed, buckets)
                key = (low >> np.uint32(1)).astype(np.int64) | bucket << KEY_BITS
                first = np.zeros(len(at), bool)
                if known is not None:
                    place = np.searchsorted(known.value, key)
                    there = np.flatnonzero(known.value[np.minimum(place, len(known.value) - 1)] == key) if len(known.value) else np.zeros(0, np.int64)
                    at, key, low, first = at[there], key[there], low[there], first[there]
                    first[np.unique(at, return_index=True)[1]] = True
                pick, shown = pa.array(at), pa.array(np.where(first, at, 0), mask=~first)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), *(part.column(k).take(shown) for k in range(2, 6)), pa.array(key), pa.array((low & np.uint32(1)).astype(bool))], names=["h1", "h2", *PLACE, "text", "key", "own"])

    held = texts.select("h1", "h2", *PLACE, "text").mapInArrow(rows, "h1 long, h2 long, doc_id long, rk long, line int, text string, key long, own boolean")
    held = shared_table(held if few else held.join(shared, "key", "left_semi"), "key-lines")
    own = held.where("own").select("key", F.struct("h1", "h2").alias("a")).distinct()
    pairs = own.join(held.select("key", F.struct("h1", "h2").alias("b")).distinct(), "key").where("a != b")
    pairs = shared_table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    if few:
        ends = held.where("text IS NOT NULL")
    else:
        ends = texts.join(shared_table(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().select("h.*"), "pair-lines"), ["h1", "h2"], "left_semi")
        ends = shared_table(ends, "pair-texts")
    ends = ends.select("h1", "h2", F.struct(*PLACE).alias("first"), "text")
    a, b = (ends.select(F.struct("h1", "h2").alias(x), F.struct("first", "h1", "h2", "text").alias(f"line_{x}")) for x in ("a", "b"))
    n = F.least(F.length("line_a.text"), F.length("line_b.text"))
    bound = F.greatest(F.lit(1), F.least(F.lit(edits), F.floor(n / EDIT_CHARS)))
    near = pairs.join(a, "a").join(b, "b").where(F.levenshtein("line_a.text", "line_b.text", edits).between(0, bound))
    if byte_edits:
        # texts are never fewer byte edits apart than edits of code points: every edited code point has an edited byte of its own
        one, two = (F.decode(F.encode(f"line_{x}.text", "UTF-8"), "ISO-8859-1") for x in ("a", "b"))
        near = near.where(F.levenshtein(one, two, edits).between(0, bound))
    return near.select(F.greatest("line_a", "line_b").alias("late")).select("late.first.*").distinct()


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id", edits: int = EDITS, byte_edits: bool = False) -> DataFrame:
    """``doc_id, rk, lines``: the numbers (from 0) of removed lines, for documents that have any."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(key, text).alias("rk"), F.coalesce(text, F.lit("")).alias("text"))
    rows = src.mapInArrow(occurrences(min_chars), LINE)
    # rows that are decided need not meet the others of their line
    rows = rows.repartition(F.when(F.col("again"), F.xxhash64("doc_id", "line")).otherwise(F.col("h1")))
    lines = shared_table(rows.sortWithinPartitions("h1", "h2", *PLACE).mapInArrow(settled, LINE), "lines")
    gone = lines.where("again").select(*PLACE).unionByName(lines_of_edits(lines.where("NOT again").drop("again"), edits, byte_edits=byte_edits))
    return gone.groupBy("doc_id", "rk").agg(F.collect_set("line").alias("lines"))


ADDED = ("kept_text", "n_lines", "n_removed")


def kept_rows(docs: DataFrame, columns: list[str], text: str, key: str, **how) -> DataFrame:
    """``row`` (a struct of ``columns``), ``kept_text``, ``n_lines`` and ``n_removed`` of every row of ``docs``."""
    gone = removed_lines(docs, text=text, key=key, **how)
    src = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), F.coalesce(text, F.lit("")).alias("text"), row_key(key, text).alias("rk"), F.col(key).cast("long").alias("doc_id"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("rk").alias("gone_rk"), F.col("lines").alias("gone_lines"))
    # documents stream past a table of their partition's removed lines, 4 bytes each; a merge join would hold and sort the texts
    rows = src.join(gone.hint("shuffle_hash"), (F.col("rk") == F.col("gone_rk")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone_lines", i)), "\n")
    return rows.select(
        "row",
        F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_removed"),
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, all columns, and ``kept_text``, ``n_lines`` and ``n_removed``, which take the place of columns of
    these names. ``how``: ``min_chars``, ``edits`` and ``byte_edits`` of :func:`removed_lines`."""
    return kept_rows(docs, [c for c in docs.columns if c not in ADDED], text, key, **how).select("row.*", *ADDED)


def cleaned(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with the same columns, whose ``text`` is what is kept and whose ``n_chars``, if there, is its length."""
    rows = kept_rows(docs, docs.columns, "text", "doc_id", **how)
    own = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return rows.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, **how) -> DataFrame:
    """Sizes and digests of what is kept, edits counted in bytes."""
    out = deduplicated(docs.select("doc_id", "text"), **{"byte_edits": True} | how)
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i - 1 AS line, ls[i] AS t FROM d, unnest(range(1, len(ls) + 1)) AS u(i)
  WHERE length(ls[i]) >= 16 OR regexp_matches(ls[i], '[^\\x20\\x09-\\x0D]')
),
f AS (SELECT t, length(t) AS n, min((doc_id, line)) AS first FROM l GROUP BY t),
near AS (
  SELECT DISTINCT x.t FROM f x JOIN f y ON y.n BETWEEN x.n - 3 AND x.n + 3
  WHERE x.n >= 16 AND y.n >= 16 AND y.first < x.first AND levenshtein(x.t, y.t) <= least(3, least(x.n, y.n) // 16)
),
gone AS (
  SELECT l.doc_id, l.line FROM l JOIN f USING (t) LEFT JOIN near USING (t) WHERE near.t IS NOT NULL OR (l.doc_id, l.line) <> f.first
),
g AS (SELECT doc_id, list(line) AS lines FROM gone GROUP BY doc_id),
k2 AS (
  SELECT doc_id, len(ls) AS n_lines, coalesce(len(lines), 0) AS n_removed,
    array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(coalesce(lines, []), i - 1)], chr(10)) AS kept
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM k2
"""
