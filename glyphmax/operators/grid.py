"""Page rasters, saliency and keep masks.

A raster is laid over a text: 64 characters a row, white space is paper (1.0), letters and digits ink (0.25), other
characters grey (0.6); what is missing of the last cells is paper. A page's pixels stay together in one row, so the
pixel work is one numpy pass per page and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS, CELL = 64, 8
CELLS_SCHEMA = "page_id long, r int, c int, saliency double"


#: Gray of the code points below 128; the last entry is that of all others.
GRAY = np.full(129, 0.6)
GRAY[[9, 10, 11, 12, 13, 32]] = 1.0
GRAY[[c for c in range(128) if chr(c).isalnum()]] = 0.25


def percentile(x: np.ndarray, pct: float) -> float:
    """Linear between the two nearest ranks, as ``np.percentile``, by partition."""
    at = (x.size - 1) * pct / 100
    low = int(at)
    high = min(low + 1, x.size - 1)
    part = np.partition(x, (low, high), axis=None)
    return float(part[low] + (part[high] - part[low]) * (at - low))


def raster(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gray = GRAY[np.minimum(points, len(GRAY) - 1)]
    rows = max(CELL, -(-len(gray) // COLUMNS))
    rows = -(-rows // CELL) * CELL
    out = np.ones(rows * COLUMNS)
    out[: len(gray)] = gray
    return out.reshape(rows, COLUMNS)


def block_mean(x: np.ndarray, cell: int = CELL) -> np.ndarray:
    return x.reshape(x.shape[0] // cell, cell, x.shape[1] // cell, cell).mean(axis=(1, 3))


def robust_unit(x: np.ndarray, pct: float = 99.0) -> np.ndarray:
    """Divided by its high percentile and clipped to [0, 1]; zeros where nothing stands out."""
    high = percentile(x, pct)
    return np.clip(x / high, 0, 1) if high > 1e-8 else np.zeros_like(x)


def saliency(gray: np.ndarray, ink_weight: float = 0.6, edge_weight: float = 0.4) -> np.ndarray:
    """Weighted ink (darker than the paper level, the 95th percentile) and edges per cell of a gray raster."""
    if gray.size == 0 or gray.shape[0] % CELL or gray.shape[1] % CELL:
        raise ValueError("a raster must hold whole cells")
    ink = np.maximum(percentile(gray, 95) - gray, 0)
    edge = np.zeros_like(gray)
    edge[1:] += np.abs(np.diff(gray, axis=0))
    edge[:, 1:] += np.abs(np.diff(gray, axis=1))
    whole = max(ink_weight + edge_weight, 1e-8)
    return (ink_weight * robust_unit(block_mean(ink)) + edge_weight * robust_unit(block_mean(edge))) / whole


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, for numbers that are not negative."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def dilated(mask: np.ndarray, iterations: int = 1) -> np.ndarray:
    """A cell is set if a set one is at most ``iterations`` steps away (4-neighbours, no wrap-around)."""
    out = mask.copy()
    for _ in range(iterations):
        m = out.copy()
        out[1:] |= m[:-1]
        out[:-1] |= m[1:]
        out[:, 1:] |= m[:, :-1]
        out[:, :-1] |= m[:, 1:]
    return out


def mask_of(s: np.ndarray, blank_threshold: float = 0.02, keep_ratio: float | None = None, min_keep: int = 16, dilation: int = 1) -> np.ndarray:
    """Kept cells of a page: salient ones, dilated; or the ``keep_ratio`` most salient (half to even, at least one).

    Then the most salient dropped cells are promoted until ``min_keep`` (or all cells) are kept. Ties go by row and column.
    """
    order = np.argsort(-s, axis=None, kind="stable")
    if keep_ratio is None:
        keep = dilated(s > blank_threshold, dilation)
    else:
        keep = np.zeros(s.size, bool)
        keep[order[: max(1, min(s.size, round(s.size * keep_ratio)))]] = True
        keep = keep.reshape(s.shape)
    missing = min(min_keep, s.size) - int(keep.sum())
    if missing > 0:
        keep.ravel()[order[~keep.ravel()[order]][:missing]] = True
    return keep


#: Cells of an Arrow batch that a page pass sends.
BATCH_CELLS = 1 << 16


def resized(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of the source area under every pixel of a ``rows`` x ``cols`` raster (bilinear where it is larger)."""
    for axis, size in ((0, rows), (1, cols)):
        n = gray.shape[axis]
        if size == n:
            continue
        if size > n:
            at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
            low = np.floor(at).astype(int)
            part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
            gray = np.take(gray, low, axis) * (1 - part) + np.take(gray, np.minimum(low + 1, n - 1), axis) * part
            continue
        total = np.concatenate([np.zeros_like(np.take(gray, [0], axis)), np.cumsum(gray, axis)], axis)
        edge = np.arange(size + 1) * n / size
        low = np.minimum(np.floor(edge).astype(int), n)
        part = (edge - low).reshape((-1, 1) if axis == 0 else (1, -1))
        at_edge = np.take(total, low, axis) * (1 - part) + np.take(total, np.minimum(low + 1, n), axis) * part
        gray = np.diff(at_edge, axis=axis) * size / n
    return gray


def downscaled(gray: np.ndarray, max_side: int) -> np.ndarray:
    """A raster whose longer side is at most ``max_side``; never larger than it was, and of one pixel at least."""
    factor = max_side / max(gray.shape)
    return gray if factor >= 1 else resized(gray, *(max(1, round(x * factor)) for x in gray.shape))


def saliency_on_grid(gray: np.ndarray, rows: int, cols: int, ink_weight: float = 0.6, edge_weight: float = 0.4) -> np.ndarray:
    """:func:`saliency` of a raster of any size, on a ``rows`` x ``cols`` grid of cells."""
    if rows <= 0 or cols <= 0:
        raise ValueError("a grid has at least one row and column")
    return saliency(resized(gray, rows * CELL, cols * CELL), ink_weight, edge_weight)


def page_pass(pages: DataFrame, weights: tuple[float, float], digits: int, negative: bool, mask: dict | None) -> DataFrame:
    schema = CELLS_SCHEMA + ("" if mask is None else ", keep boolean")
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        cells = 0

        def sent() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c)) for c in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                gray = raster(text.as_py() or "")
                s = rounded(saliency(1 - gray if negative else gray, *weights), digits)
                r, c = np.indices(s.shape, np.int32)
                held.append([np.full(s.size, page), r.ravel(), c.ravel(), s.ravel(), *([] if mask is None else [mask_of(s, **mask).ravel()])])
                cells += s.size
                if cells >= BATCH_CELLS:
                    yield sent()
                    cells = 0
        if held:
            yield sent()

    return pages.select("page_id", "text").mapInArrow(run, schema)


def page_saliency(pages: DataFrame, ink_weight: float = 0.6, edge_weight: float = 0.4, digits: int = 6, negative: bool = False) -> DataFrame:
    """``page_id, r, c, saliency`` of every cell of ``page_id, text`` rows; of the inverted raster with ``negative``."""
    return page_pass(pages, (ink_weight, edge_weight), digits, negative, None)


def page_polarity(pages: DataFrame, share: float = 0.25, digits: int = 6) -> DataFrame:
    """``page_id, overlap, r`` of ``page_id, text`` rows: :func:`glyphmax.operators.geometry.saliency_overlap` of the raster and
    its negative, made while the page is at hand; neither is rounded, and ``r`` is null where a saliency is constant."""

    def page(text: str) -> tuple[float, float | None]:
        gray = raster(text)
        x, y = (rounded(saliency(g), digits).ravel() for g in (gray, 1 - gray))
        k = max(1, int(np.floor(x.size * share)))
        top = [np.argsort(-s, kind="stable")[:k] for s in (x, y)]
        a, b = x - x.mean(), y - y.mean()
        r = float(a @ b / np.sqrt((a @ a) * (b @ b))) if x.max() > x.min() and y.max() > y.min() else None
        return len(np.intersect1d(*top, assume_unique=True)) / k, r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["page_id", "overlap", "r"])

    return pages.select("page_id", "text").mapInArrow(run, "page_id long, overlap double, r double")


def page_masks(pages: DataFrame, ink_weight: float = 0.6, edge_weight: float = 0.4, digits: int = 6, **mask) -> DataFrame:
    """:func:`page_saliency` and ``keep`` (:func:`mask_of`), both made while the page is at hand."""
    return page_pass(pages, (ink_weight, edge_weight), digits, False, mask)


def masks_on_grid(pages: DataFrame, rows: int, cols: int, **mask) -> DataFrame:
    """``page_id, tok, saliency, keep`` of ``page_id, text`` rows on an encoder's grid, tokens row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = np.arange(rows * cols, dtype=np.int32)
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = rounded(saliency_on_grid(raster(text or ""), rows, cols), 6)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tok), page)), pa.array(tok), pa.array(s.ravel()), pa.array(mask_of(s, **mask).ravel())], names=["page_id", "tok", "saliency", "keep"])

    return pages.select("page_id", "text").mapInArrow(run, "page_id long, tok int, saliency double, keep boolean")


def dilate(cells: DataFrame, iterations: int = 1, mask: str = "mask") -> DataFrame:
    """:func:`dilated` for a table of cells."""
    out = cells
    for _ in range(iterations):
        along_row = Window.partitionBy("page_id", "r").orderBy("c")
        along_column = Window.partitionBy("page_id", "c").orderBy("r")
        near = [F.coalesce(f(mask).over(w), F.lit(False)) for w in (along_row, along_column) for f in (F.lag, F.lead)]
        out = out.withColumn(mask, F.col(mask) | near[0] | near[1] | near[2] | near[3])
    return out


def keep_mask(cells: DataFrame, blank_threshold: float = 0.02, keep_ratio: float | None = None, min_keep: int = 16, dilation: int = 1) -> DataFrame:
    """:func:`mask_of` for a table of cells, from wherever its saliency comes: adds ``keep``."""
    page = Window.partitionBy("page_id")
    order = page.orderBy(F.desc("saliency"), "r", "c")
    n = F.count("*").over(page)
    if keep_ratio is None:
        out = dilate(cells.withColumn("mask", F.col("saliency") > blank_threshold), dilation)
    else:
        budget = F.greatest(F.lit(1.0), F.least(n.cast("double"), F.rint(n * keep_ratio)))
        out = cells.withColumn("mask", F.row_number().over(order) <= budget)
    out = out.withColumn("missing", F.least(F.lit(min_keep), n) - F.sum(F.col("mask").cast("int")).over(page))
    turn = F.row_number().over(Window.partitionBy("page_id", "mask").orderBy(F.desc("saliency"), "r", "c"))
    return out.withColumn("keep", F.col("mask") | (turn <= F.col("missing"))).drop("mask", "missing")


def blank_pages(cells: DataFrame, threshold: float = 0.004) -> DataFrame:
    """``page_id, mean_saliency, blank`` per page; the mean in whole millionths, rounded down."""
    mean = F.floor(F.sum(F.rint(F.col("saliency") * 1e6).cast("long")) / F.count("*")) / 1e6
    return cells.groupBy("page_id").agg(mean.alias("mean_saliency"), (mean < threshold).alias("blank"))


def mask_text(cells: DataFrame, keep: str = "keep") -> DataFrame:
    """Keep masks drawn as text, one line per grid row: ``page_id, r, line``."""
    mark = F.when(F.col(keep), "#").otherwise(".")
    return cells.groupBy("page_id", "r").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", mark.alias("m")))), lambda x: x["m"]), "").alias("line"))
