"""Pieces that the training-data operators share: Arrow text access and shared-storage tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel handles at once; working arrays are a small multiple of it.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096
#: Rows of an Arrow batch of texts, so that a batch and its copies stay small beside an executor's memory.
BATCH_ROWS = 2000
#: Rows that Spark's Parquet reader decodes at once; its array of their texts doubles as it grows, so 4,096 texts, the default,
#: are tens of MB in one object.
READ_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Have Spark read texts ``READ_ROWS`` at a time and send them to Python in batches of ``BATCH_ROWS``; for queries and
    pipelines, operators leave it alone."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="glyphmax-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame, rows: int = 500_000, items: str | None = None) -> DataFrame:
    """A broadcast hint where a written table of narrow rows is counted and has at most ``rows``; else none.

    ``items``: an array column, of which a row may hold any number; its elements are counted too (16 a row at most).
    """
    found = df.agg(F.count("*").alias("n"), (F.sum(F.size(items)) if items else F.lit(0)).alias("i")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["i"] or 0) <= 16 * rows else df


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 byte offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and at most ``rows`` rows each; a longer row stands alone."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        yield first, last
        first = last


#: Where a text may be cut: a single space or newline follows, and a letter, mark or ideograph stands on its either side.
BORDER = re.compile(rb"(?:[!-~]|[\xe4-\xe9][\x80-\xbf]{2})(?=(?: [A-Za-z]|\n(?:[!-~]|[\xe4-\xe9])))")


def stretches(raw: bytes, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of a long text of about ``limit`` bytes, cut at word borders (the space or newline begins a stretch); one without any is whole."""
    at = 0
    while at < len(raw):
        found = BORDER.search(raw, at + limit) if at + limit < len(raw) else None
        to = found.end() if found else len(raw)
        yield at, to
        at = to


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``; a worker that has run it gives the memory it freed back to the system."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content, so that rows may repeat or share their id without being mixed up."""
    return F.xxhash64(*[F.col(c) for c in columns])


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
