"""Sources: page files, query sets, layouts; and the JSON forms of manifests and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FORMATS = (".pdf", ".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".pgm", ".txt")
QUERY_SCHEMA = "qid string, query string, relevant array<string>, kind string, type string"


def scan_files(spark: SparkSession, root: str, formats: tuple[str, ...] = FORMATS, content: bool = True) -> DataFrame:
    """Files below ``root`` by suffix (any case): ``doc_id`` (relative path without suffix), ``suffix, path, length``
    and, unless pruned, ``content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    base = root.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + _quoted(base) + "/?", "")
    relative = F.when(relative == "", F.regexp_extract("path", r"([^/]+)$", 1)).otherwise(relative)
    out = files.where(suffix.isin(*[f.lower() for f in formats])).select(F.regexp_replace(relative, r"\.[^./]+$", "").alias("doc_id"), suffix.alias("suffix"), "path", "length", *(["content"] if content else []))
    return out


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in text)


def form_feed_pages(content: bytes, suffix: str) -> list[bytes]:
    """Pages of a text file are parted by form feeds; an image is one page."""
    return content.split(b"\f") if suffix == ".txt" else [content]


def read_pages(files: DataFrame, splitter: Callable[[bytes, str], list[bytes]] = form_feed_pages) -> DataFrame:
    """``page_id, doc_id, page_no`` (from 1), ``source_path, content`` of every page; a splitter for PDF files must be given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{d}::p{i}", d, i, p, page) for d, s, p, c in zip(b["doc_id"], b["suffix"], b["path"], b["content"]) for i, page in enumerate(splitter(c, s), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "doc_id", "page_no", "source_path", "content"])

    return files.select("doc_id", "suffix", "path", "content").mapInPandas(run, "page_id string, doc_id string, page_no int, source_path string, content binary")


def count_pages(files: DataFrame, splitter: Callable[[bytes, str], list[bytes]] = form_feed_pages, whole: tuple[str, ...] = (".pgm", ".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp")) -> int:
    """Pages of files; those of the suffixes ``whole`` have one each and are not read."""
    images = F.col("suffix").isin(*whole)
    return files.where(images).select("path").count() + read_pages(files.where(~images), splitter).count()


def load_page(files: DataFrame, doc_id: str, page_no: int = 1) -> bytes:
    rows = read_pages(files.where(F.col("doc_id") == doc_id)).where(F.col("page_no") == page_no).select("content").collect()
    if not rows:
        raise ValueError(f"{doc_id} has no page {page_no}")
    return bytes(rows[0]["content"])


def read_pgm(content: bytes) -> Any:
    """A binary or text PGM image as a float array in [0, 1]."""
    import numpy as np

    fields: list[bytes] = []
    at = 0
    while len(fields) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        fields.append(content[at:end])
        at = end
    kind, w, h, top = fields[0], int(fields[1]), int(fields[2]), int(fields[3])
    if kind == b"P5":
        data = np.frombuffer(content, np.uint8 if top < 256 else ">u2", w * h, at + 1)
    elif kind == b"P2":
        data = np.array(content[at:].split()[: w * h], np.int64)
    else:
        raise ValueError("not a PGM image")
    return data.reshape(h, w) / top


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(QUERY_SCHEMA).json(path)


def qrels(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode("relevant").alias("page_id")).distinct()


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {page_id: [[token, [x0, y0, x1, y1]], ...]} as ``page_id, token, x0, y0, x1, y1``."""
    text = spark.read.text(path, wholetext=True)
    pages = text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("page_id", "words"))
    words = pages.select("page_id", F.explode("words").alias("w"))
    token, box = F.get_json_object("w", "$[0]"), [F.get_json_object("w", f"$[1][{i}]").cast("double") for i in range(4)]
    return words.select("page_id", token.alias("token"), *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))])


def first_per_text(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each distinct text."""
    w = Window.partitionBy(text).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def write_json(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def to_markdown(rows: DataFrame, formats: dict[str, str], limit: int = 100) -> str:
    """A report table of a few rows; missing values are a dash."""
    lines = ["| " + " | ".join(formats) + " |", "|" + "---|" * len(formats)]
    for r in rows.select(*formats).limit(limit).collect():
        lines.append("| " + " | ".join("-" if r[c] is None else format(r[c], f) for c, f in formats.items()) + " |")
    return "\n".join(lines)
