"""Token runs, tile stitching, grid shapes, query tokens, hashed encoders and word layouts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmax.functions import vec
from glyphmax.plans.running import running


def token_runs(positions: DataFrame, group: str, pos: str) -> DataFrame:
    """Maximal runs of consecutive positions: ``group, start, length``."""
    island = F.col(pos) - F.row_number().over(Window.partitionBy(group).orderBy(pos))
    return positions.withColumn("island", island).groupBy(group, "island").agg(F.min(pos).alias("start"), F.count("*").alias("length")).drop("island")


def token_kinds(patches: DataFrame, thumbnail: int = 64) -> DataFrame:
    """``page_id, tok, kind``: grid tokens, and structural ones by their runs. A run of at least ``thumbnail`` tokens begins
    with a thumbnail of that size; what follows it in the page's last run are instructions; all others are markers."""
    text = patches.where("is_text").select("page_id", "tok")
    island = F.col("tok") - F.row_number().over(Window.partitionBy("page_id").orderBy("tok"))
    run = Window.partitionBy("page_id", "island")
    text = text.withColumn("island", island).withColumn("size", F.count("*").over(run)).withColumn("at", F.row_number().over(run.orderBy("tok")))
    text = text.withColumn("final", F.max("island").over(Window.partitionBy("page_id")) == F.col("island"))
    kind = F.when(F.col("size") < thumbnail, "marker").when(F.col("final") & (F.col("at") > thumbnail), "instruction").otherwise("thumbnail")
    grid = patches.where(~F.col("is_text")).select("page_id", "tok", F.lit("grid").alias("kind"))
    return grid.unionByName(text.select("page_id", "tok", kind.alias("kind")))


SUBSETS = {"grid": ("grid",), "grid+thumb": ("grid", "thumbnail"), "grid+instr": ("grid", "instruction", "marker"), "all": ("grid", "thumbnail", "instruction", "marker")}


def token_subset(patches: DataFrame, keep: str, thumbnail: int = 64) -> DataFrame:
    """The tokens of some kinds, numbered anew from 0 per page: the grid first, then thumbnail, instructions and markers."""
    if keep not in SUBSETS:
        raise ValueError(f"unknown token subset {keep!r}")
    kinds = SUBSETS[keep]
    rows = patches.join(token_kinds(patches, thumbnail), ["page_id", "tok"]).where(F.col("kind").isin(*kinds))
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy(place, "tok")) - 1
    return rows.withColumn("tok", number.cast("int")).select(*patches.columns, "kind")


def head_pages(patches: DataFrame, n: int) -> DataFrame:
    """The rows of the first ``n`` pages by id."""
    pages = patches.select("page_id").distinct().orderBy("page_id").limit(n)
    return patches.join(F.broadcast(pages), "page_id", "left_semi")  # n ids


def attended(tokens: DataFrame, mask: str = "attention") -> DataFrame:
    """Tokens whose attention mask is 1, of unit length; the others are padding."""
    return tokens.where(F.col(mask) == 1).withColumn("v", vec.normalise(F.col("v")))


def contiguous_grid(pages: DataFrame, offset: int = 0) -> DataFrame:
    """``page_id, r, c, tok`` of every cell of ``page_id, rows, cols``: tokens row by row from ``offset``."""
    cells = pages.select("page_id", "rows", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"))
    cells = cells.select("page_id", "r", "cols", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    return cells.select("page_id", "r", "c", (F.col("r") * F.col("cols") + F.col("c") + offset).cast("int").alias("tok"))


def image_positions(tokens: DataFrame, image_id: int | None) -> DataFrame:
    """``page_id, pos`` of the image patches in a page's tokens (``page_id, pos, input_id``): those of the image token's id; on
    pages without any, the first ones, as many as the largest square holds."""
    hit = F.lit(False) if image_id is None else F.coalesce(F.col("input_id") == image_id, F.lit(False))
    page = Window.partitionBy("page_id")
    n, any_hit = F.count("*").over(page), F.max(hit).over(page)
    side = F.floor(F.sqrt(n))
    at = F.row_number().over(page.orderBy("pos"))
    return tokens.withColumn("is_patch", F.when(any_hit, hit).otherwise(at <= side * side)).where("is_patch").select("page_id", "pos")


def stitched_grid(positions: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, pos, r, c`` of image patches (``page_id, pos``; pages: ``page_id, width, height``).

    More than two runs of one square length are tiles of the page, row by row, and a thumbnail, which has null cells; else
    patches lie on the grid whose shape is nearest to the page's.
    """
    page = Window.partitionBy("page_id")
    rows = positions.withColumn("island", F.col("pos") - F.row_number().over(page.orderBy("pos")))
    run = Window.partitionBy("page_id", "island")
    rows = rows.withColumn("size", F.count("*").over(run)).withColumn("at", F.row_number().over(run.orderBy("pos")) - 1).withColumn("tile", F.dense_rank().over(page.orderBy("island")) - 1)
    shape = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("island").alias("runs"), F.min("size").alias("size"), F.max("size").alias("most"))
    side = F.floor(F.sqrt("size"))
    tiled = (F.col("runs") > 2) & (F.col("size") == F.col("most")) & (side * side == F.col("size"))
    shape = shape.join(pages.select("page_id", "width", "height"), "page_id").select("page_id", tiled.alias("tiled"), side.alias("side"), (F.col("runs") - 1).alias("tiles"), "width", "height", F.when(tiled, F.col("runs") - 1).otherwise(F.col("n")).alias("n"))
    shape = shape.join(grid_factors(shape), "page_id")
    rows = rows.drop("size").join(shape.select("page_id", "tiled", "side", "tiles", "rows", "cols"), "page_id")
    order = F.row_number().over(page.orderBy("pos")) - 1
    r, c = stitched(F.col("tile"), F.col("at"), F.col("side"), F.col("cols"))
    inside = F.col("tile") < F.col("tiles")
    plain_r, plain_c = F.floor(order / F.col("cols")).cast("int"), (order % F.col("cols")).cast("int")
    return rows.select("page_id", "pos", F.when(~F.col("tiled"), plain_r).when(inside, r).alias("r"), F.when(~F.col("tiled"), plain_c).when(inside, c).alias("c"))


def grid_factors(pages: DataFrame) -> DataFrame:
    """``page_id, rows, cols``: the factorisation of ``n`` patches nearest to the aspect ratio ``height / width``."""
    rows = pages.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).where(F.col("n") % F.col("rows") == 0)
    error = F.round(F.abs(F.col("rows") / (F.col("n") / F.col("rows")) - F.col("height") / F.col("width")), 9)
    best = rows.groupBy("page_id", "n").agg(F.min_by("rows", F.struct(error, "rows")).alias("rows"))
    return best.select("page_id", "rows", (F.col("n") / F.col("rows")).cast("int").alias("cols"))


def stitched(tile: Column, offset: Column, side: Column, tile_cols: Column) -> tuple[Column, Column]:
    """Grid row and column of a patch: tile number, offset in its ``side`` x ``side`` tile, tiles per row."""
    r = F.floor(tile / tile_cols) * side + F.floor(offset / side)
    return r.cast("int"), ((tile % tile_cols) * side + offset % side).cast("int")


def query_words(text: Column) -> Column:
    """Lower-case words with letters and digits only; ``__empty`` if there are none."""
    words = F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("__empty")))


def hash_vector(token: Column, dim: int) -> Column:
    """A unit vector per token from md5: component k is the first 32 bits of md5(token:k), scaled to +-0.5."""
    part = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.conv(F.substring(F.md5(F.concat(token, F.lit(":"), k.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32) - 0.5)
    return vec.normalise(part)


def seeded_vector(token: str, dim: int) -> np.ndarray:
    """Normal vector seeded by the first eight little-endian bytes of blake2b-256 of the lower-cased token."""
    seed = int.from_bytes(hashlib.blake2b(token.lower().encode(), digest_size=32).digest()[:8], "little")
    x = np.random.default_rng(seed).standard_normal(dim)
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def seeded_vectors(tokens: DataFrame, dim: int, column: str = "token") -> DataFrame:
    """``token, v`` of :func:`seeded_vector`, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": b[column], "v": [seeded_vector(t, dim).astype(float) for t in b[column]]})

    return tokens.select(column).mapInPandas(run, "token string, v array<double>")


def layout(docs: DataFrame, width: int = 64) -> DataFrame:
    """Words with their boxes on a page of ``width`` characters a line: ``doc_id, word, line, col, x0, y0, x1, y1``.

    A text's line breaks end a line; longer lines are wrapped at the width, and words are cut there.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "t"))
    n = F.greatest(F.lit(1), F.ceil(F.length("t") / width)).cast("int")
    parts = lines.select("doc_id", "p", F.explode(F.sequence(F.lit(0), n - 1)).alias("q"), "t").select("doc_id", "p", "q", F.substring("t", F.col("q") * width + 1, F.lit(width)).alias("t"))
    order = Window.partitionBy("doc_id").orderBy("p", "q")
    rows = parts.withColumn("line", F.row_number().over(order) - 1).withColumn("lines", F.count("*").over(Window.partitionBy("doc_id")))
    starts = F.filter(F.sequence(F.lit(1), F.length("t")), lambda i: (F.substring("t", i, F.lit(1)) != " ") & ((i == 1) | (F.substring("t", i - 1, F.lit(1)) == " ")))
    words = rows.where(F.length("t") > 0).select("doc_id", "line", "lines", "t", F.explode(starts).alias("at"))
    words = words.withColumn("word", F.substring_index(F.substring("t", F.col("at"), F.lit(width)), " ", 1))
    col = F.col("at") - 1
    return words.select("doc_id", "word", "line", col.alias("col"), (col / width).alias("x0"), (F.col("line") / F.col("lines")).alias("y0"), ((col + F.length("word")) / width).alias("x1"), ((F.col("line") + 1) / F.col("lines")).alias("y1"))


def text_words(text: str, width: int = 64) -> Iterator[tuple[int, int, list[str], list[int]]]:
    """:func:`layout` of one text, a line at a time: its number, the number of lines, its words and their columns."""
    rows = text.split("\n")
    n = sum(max(1, -(-len(t) // width)) for t in rows)
    line = 0
    for t in rows:
        for at in range(0, max(1, len(t)), width):
            words, cols, col = [], [], 0
            for w in t[at : at + width].split(" "):
                if w:
                    words.append(w)
                    cols.append(col)
                col += len(w) + 1
            if words:
                yield line, n, words, cols
            line += 1


def has_words(text: Column) -> Column:
    """Whether :func:`layout` finds a word in a text."""
    return F.coalesce(F.translate(text, " \n", "") != "", F.lit(False))


def layout_grid(words: DataFrame, grid: int, dim: int) -> DataFrame:
    """Hashed word vectors added to every cell that a word's box covers: ``doc_id, r, c, v`` (unit length)."""

    def cell(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(x * grid).cast("int")))

    cells = words.select("doc_id", "word", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))).alias("r"), "x0", "x1").select("doc_id", "word", "r", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1")))).alias("c"))
    counts = cells.groupBy("doc_id", "r", "c", "word").agg(F.count("*").alias("n"))
    sums = counts.select("doc_id", "r", "c", "n", F.posexplode(hash_vector(F.col("word"), dim)).alias("k", "x")).groupBy("doc_id", "r", "c", "k").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
    rows = sums.groupBy("doc_id", "r", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("v"))
    return rows.select("doc_id", "r", "c", vec.normalise(F.col("v")).alias("v"))


KINDS = ("invoice", "contract", "report", "memo", "manual", "receipt")
SUBJECTS = ("audit", "budget", "energy", "freight", "health", "housing", "logistics", "payroll", "pension", "safety", "travel", "water")


def page_catalogue(spark: SparkSession, n_docs: int, pages_per_doc: int, seed: int = 7) -> DataFrame:
    """A generated corpus's pages: ``doc_id, page_no, page_id, kind, code, subject``."""
    rows = spark.range(n_docs * pages_per_doc).select(F.floor(F.col("id") / pages_per_doc).cast("int").alias("d"), (F.col("id") % pages_per_doc).cast("int").alias("p"), F.col("id").cast("int").alias("i"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("d") % len(KINDS) + 1)
    doc = F.concat(kind, F.lit("_"), F.format_string("%03d", "d"))
    return rows.select(
        doc.alias("doc_id"), (F.col("p") + 1).alias("page_no"), F.concat(doc, F.lit("::p"), F.col("p") + 1).alias("page_id"), kind.alias("kind"),
        F.concat(F.upper(F.substring(kind, 1, 3)), F.lit(f"{seed:02d}"), F.format_string("%03d", "d"), (F.col("p") + 1).cast("string")).alias("code"),
        F.element_at(F.array(*map(F.lit, SUBJECTS)), F.col("i") % len(SUBJECTS) + 1).alias("subject"),
    )


def query_set(pages: DataFrame) -> DataFrame:
    """One precise query a page, then one topical query a subject with all its pages: ``qid, kind, query, relevant``."""
    precise = pages.select(F.lit(0).alias("part"), F.col("page_id").alias("key"), F.lit("precise").alias("kind"), F.concat(F.col("kind"), F.lit(" "), F.col("code")).alias("query"), F.array("page_id").alias("relevant"))
    topical = pages.groupBy("subject").agg(F.sort_array(F.collect_set("page_id")).alias("relevant")).select(F.lit(1).alias("part"), F.col("subject").alias("key"), F.lit("topical").alias("kind"), F.concat(F.lit("documents about "), F.col("subject")).alias("query"), "relevant")
    rows = running(precise.unionByName(topical), ["part", "key"], n=F.lit(1))
    return rows.select(F.format_string("q%04d", "n").alias("qid"), "kind", "query", "relevant")
