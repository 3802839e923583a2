"""Encoders: pages and queries to vectors.

An encoder has ``dim``, ``encode_pages`` (``page_id, text`` rows to ``page_id, tok, r, c, is_text, v``) and
``encode_queries`` (``qid, query`` rows to ``qid, qtok, v``). A neural one runs its model in ``mapInPandas``, loaded once a
worker; the one here stands in for it without a model: a page's words, hashed, are added where their boxes lie.
"""

from __future__ import annotations

import hashlib
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmax.operators import grid, tokens
from glyphmax.sources.storage import exists

try:
    from _md5 import md5  # starts faster than hashlib's
except ImportError:
    from hashlib import md5

PATCHES = "page_id long, tok int, r int, c int, is_text boolean, v array<double>"
#: Structural tokens after a page's grid.
TAIL = 4
#: Words whose boxes are held at once, words whose vectors a task keeps, and numbers of a batch of encoded pages.
BATCH_WORDS, KNOWN_WORDS, BATCH_NUMBERS = 1 << 16, 1 << 17, 1 << 18


class Encoder(ABC):
    dim: int

    @abstractmethod
    def encode_pages(self, pages: DataFrame) -> DataFrame: ...

    @abstractmethod
    def encode_queries(self, queries: DataFrame) -> DataFrame: ...


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), 1e-12)


@lru_cache(maxsize=50_000)
def word_vector(word: str, dim: int) -> np.ndarray:
    """:func:`glyphmax.operators.tokens.hash_vector` of one word."""
    return unit(np.array([int(hashlib.md5(f"{word}:{k}".encode()).hexdigest()[:8], 16) / (1 << 32) - 0.5 for k in range(dim)]))


def word_vectors(words: list[str], dim: int) -> np.ndarray:
    """:func:`word_vector` of many words, one a row."""
    ends = [f":{k}".encode() for k in range(dim)]
    raw = b"".join([md5(w + end).digest() for w in map(str.encode, words) for end in ends])
    return unit(np.frombuffer(raw, ">u4")[::4].reshape(-1, dim) / (1 << 32) - 0.5)


class WordSums:
    """Sums of word vectors by the cells of a stretch of pages, held until ``BATCH_WORDS`` words of a page or whole pages.

    A page's words are added in their order and cut at the same places whatever pages stand beside it.
    """

    def __init__(self, dim: int, grid: int, vectors: Callable[[str, int], np.ndarray]) -> None:
        self.dim, self.grid, self.vectors = dim, grid, vectors
        self.known: dict[str, int] = {}
        self.rows = np.zeros((KNOWN_WORDS, dim))
        self.held: list[tuple[int, list[str], np.ndarray]] = []
        self.n_held = self.n_page = 0

    def begin(self, pages: int) -> None:
        self.acc, self.full = np.zeros((pages * self.grid**2, self.dim)), np.zeros(pages, bool)

    def add(self, page: int, words: list[str], boxes: np.ndarray) -> None:
        """``boxes``: x0, y0, x1, y1 of the page's next words, one a row."""
        self.held.append((page, words, boxes))
        self.full[page] |= bool(words)
        self.n_held += len(words)
        self.n_page += len(words)
        if self.n_page >= BATCH_WORDS:
            self.flush()

    def end_page(self) -> None:
        self.n_page = 0
        if self.n_held >= BATCH_WORDS:
            self.flush()

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the distinct words, and the number of each word's."""
        number: dict[str, int] = {}
        at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        distinct = list(number)
        new = [w for w in distinct if w not in self.known]
        out = np.empty((len(distinct), self.dim))
        made = word_vectors(new, self.dim) if self.vectors is word_vector else np.array([self.vectors(w, self.dim) for w in new], np.float64).reshape(-1, self.dim)
        place = {w: i for i, w in enumerate(new)}
        from_new = np.fromiter((place.get(w, -1) for w in distinct), np.int64, len(distinct))
        from_known = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        out[from_new >= 0] = made[from_new[from_new >= 0]]
        out[from_known >= 0] = self.rows[from_known[from_known >= 0]]
        for i, w in enumerate(new[: KNOWN_WORDS - len(self.known)]):
            self.rows[len(self.known)] = made[i]
            self.known[w] = len(self.known)
        return out, at

    def flush(self) -> None:
        if self.n_held:
            g = self.grid
            v, at = self.of([w for _, words, _ in self.held for w in words])
            page = np.repeat([p for p, _, _ in self.held], [len(words) for _, words, _ in self.held])
            c0, r0, c1, r1 = np.clip(np.floor(np.concatenate([b for _, _, b in self.held]) * g), 0, g - 1).astype(np.int64).T
            wide, n = np.maximum(c1 - c0 + 1, 0), np.maximum(c1 - c0 + 1, 0) * np.maximum(r1 - r0 + 1, 0)
            word = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            cell = (page[word] * g + r0[word] + k // wide[word]) * g + c0[word] + k % wide[word]
            at = at[word]
            for d in range(self.dim):
                self.acc[:, d] += np.bincount(cell, v[at, d], len(self.acc))
        self.held, self.n_held, self.n_page = [], 0, 0


class HashedEncoder(Encoder):
    """Words of a layout on a ``grid`` x ``grid`` page of hashed vectors.

    ``layout``: a table ``page_id, token, x0, y0, x1, y1``, which is gathered by pages, or a number of characters a line:
    then a page's words are those of its own text (:func:`glyphmax.operators.tokens.layout`), laid out while it is at hand.
    A page without words has its raster's 2 x 2 pixels a cell instead, weighted by their ink. ``noise`` times the cell's
    ink scales a vector drawn from seed, page and cell, so results do not depend on the order of pages; a thousandth of
    the blank paper's vector keeps empty cells from having none.
    """

    def __init__(self, dim: int = 64, grid: int = 16, layout: DataFrame | int | None = None, noise: float = 0.05, seed: int = 7, vectors: Callable[[str, int], np.ndarray] = word_vector) -> None:
        self.dim, self.grid, self.layout, self.noise, self.seed, self.vectors = dim, grid, layout, noise, seed, vectors

    def missing(self, pages: DataFrame) -> int:
        """Pages that the layout lacks; warned of, for their ids may have drifted."""
        if self.layout is None:
            return 0
        n = (pages.where(~tokens.has_words(F.col("text"))) if isinstance(self.layout, int) else pages.join(self.layout.select("page_id").distinct(), "page_id", "left_anti")).count()
        if n:
            warnings.warn(f"{n} pages are not in the layout; their pixels are hashed instead", RuntimeWarning, stacklevel=2)
        return n

    def encode_pages(self, pages: DataFrame) -> DataFrame:
        g, dim, noise, seed, vectors = self.grid, self.dim, self.noise, self.seed, self.vectors
        rows, width = pages.select("page_id", "text"), self.layout if isinstance(self.layout, int) else None
        if self.layout is None or width:
            rows = rows.withColumn("words", F.lit(None).cast("array<struct<token:string,x0:double,y0:double,x1:double,y1:double>>"))
        else:
            box = F.struct("token", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
            rows = rows.join(self.layout.groupBy("page_id").agg(F.sort_array(F.collect_list(box)).alias("words")), "page_id", "left")

        def page_words(text: str | None, words: pa.ListScalar) -> Iterator[tuple[list[str], np.ndarray]]:
            if width:
                held, cols, sizes, lines, n = [], [], [], [], 1

                def boxed() -> tuple[list[str], np.ndarray]:
                    b = np.empty((len(held), 4))
                    b[:, 0] = cols
                    b[:, 2] = b[:, 0] + np.fromiter(map(len, held), np.int64, len(held))
                    b[:, [0, 2]] /= width
                    line = np.repeat(lines, sizes)
                    b[:, 1], b[:, 3] = line / n, (line + 1) / n
                    return held, b

                for line, n, found, at in tokens.text_words(text or "", width):
                    held += found
                    cols += at
                    sizes.append(len(found))
                    lines.append(line)
                    if len(held) >= BATCH_WORDS:
                        yield boxed()
                        held, cols, sizes, lines = [], [], [], []
                if held:
                    yield boxed()
            elif words.is_valid:
                for at in range(0, len(words), BATCH_WORDS):
                    part = words.values.slice(at, BATCH_WORDS)
                    yield part.field("token").to_pylist(), np.stack([part.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], axis=1)

        def whole(key: int, text: str | None, acc: np.ndarray, full: bool) -> np.ndarray:
            acc = acc.reshape(g, g, dim)
            if noise or not full:
                gray = grid.raster(text or "")
            if not full:
                cells = grid.resized(gray, 2 * g, 2 * g).reshape(g, 2, g, 2).transpose(0, 2, 1, 3).reshape(g, g, 4)
                acc = acc + (1 - cells) @ np.stack([vectors(f"__pixel{i}", dim) for i in range(4)])
            if noise:
                drawn = np.stack([word_vector(f"{seed}:{key}:{t}", dim) for t in range(g * g)]).reshape(g, g, dim)
                acc = acc + noise * (1 - grid.resized(gray, g, g))[..., None] * drawn
            return unit(acc + 1e-3 * vectors("__blank", dim)).reshape(g * g, dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tail = np.stack([vectors(f"__tail{i}", dim) for i in range(TAIL)])
            n = g * g + TAIL
            tok = np.arange(n, dtype=np.int32)
            r, c = np.where(tok < g * g, tok // g, -1).astype(np.int32), np.where(tok < g * g, tok % g, -1).astype(np.int32)
            sums, stretch = WordSums(dim, g, vectors), max(1, BATCH_NUMBERS // (n * dim))
            for batch in batches:
                for at in range(0, batch.num_rows, stretch):
                    part = batch.slice(at, stretch)
                    m = part.num_rows
                    sums.begin(m)
                    for i in range(m):
                        for words, boxes in page_words(part.column(1)[i].as_py(), part.column(2)[i]):
                            sums.add(i, words, boxes)
                        sums.end_page()
                    sums.flush()
                    keys = part.column(0).to_numpy()
                    v = np.concatenate([np.stack([whole(keys[i], part.column(1)[i].as_py(), x, sums.full[i]) for i, x in enumerate(sums.acc.reshape(m, g * g, dim))]), np.broadcast_to(tail, (m, TAIL, dim))], axis=1)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m * n * dim + 1, dim, dtype=np.int32)), pa.array(v.ravel()))
                    rr, cc = np.tile(r, m), np.tile(c, m)
                    columns = [pa.array(np.repeat(keys, n)), pa.array(np.tile(tok, m)), pa.array(rr, mask=rr < 0), pa.array(cc, mask=cc < 0), pa.array(np.tile(tok >= g * g, m)), flat]
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "tok", "r", "c", "is_text", "v"])

        return rows.mapInArrow(run, PATCHES)

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        words = queries.select("qid", F.posexplode(tokens.query_words(F.col("query"))).alias("qtok", "word"))
        if self.vectors is word_vector:
            return words.select("qid", "qtok", tokens.hash_vector(F.col("word"), self.dim).alias("v"))
        found = tokens.seeded_vectors(words.select(F.col("word").alias("token")).distinct(), self.dim)
        return words.join(found, words["word"] == found["token"]).select("qid", "qtok", "v")


ENCODERS: dict[str, Callable[..., Encoder]] = {
    "hashed": HashedEncoder,
    "seeded": lambda **k: HashedEncoder(vectors=lambda w, d: tokens.seeded_vector(w, d).astype(np.float64), **k),
}


def encoder(name: str, **settings) -> Encoder:
    """An encoder by its registered name."""
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; there are {sorted(ENCODERS)}")
    return ENCODERS[name](**settings)


def cached_queries(model: Encoder, queries: DataFrame, path: str) -> DataFrame:
    """Encoded queries, stored under ``path`` by the exact set of ids and texts: other queries are encoded anew."""
    spark = queries.sparkSession
    mark = queries.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("qid", "query")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "qid", "query")).alias("b")).first()
    at = f"{path.rstrip('/')}/{mark['n']}-{(mark['a'] or 0) % (1 << 64):016x}{(mark['b'] or 0) % (1 << 64):016x}-{model.dim}"
    if not exists(spark, f"{at}/_SUCCESS"):
        model.encode_queries(queries).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
