"""A generated corpus's pages as lines and word boxes, and its JSON files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmax.operators.metrics import drawn
from glyphmax.operators.tokens import query_set
from glyphmax.sources.storage import write_text

FIELDS = ("Issue Date", "Total Amount", "Grade", "Reference")
WORDS = (
    "the", "office", "keeps", "a", "copy", "of", "every", "letter", "that", "leaves", "or", "enters", "the", "house", "and", "files", "it", "by", "year", "so", "that", "clerks", "can",
    "find", "what", "was", "agreed", "when", "a", "question", "comes", "up", "later", "while", "drafts", "are", "burnt", "at", "the", "end", "of", "each", "quarter",
)
#: A page's width in characters, and its height in lines.
WIDTH, HEIGHT = 80, 40


def choice(n: int, *key: Column | str) -> Column:
    """A number below ``n`` drawn by hash of columns, the same for any order of rows."""
    return (drawn(11, *key) % n).cast("int")


def field_value(field: Column, *key: Column | str) -> Column:
    """A value by the field's name: dates, amounts, grades, else a number of four digits."""
    n = lambda size, name: choice(size, *key, F.lit(name))
    date = F.format_string("%02d-%02d-202%d", n(28, "d") + 1, n(12, "m") + 1, n(4, "y") + 3)
    amount = F.format_string("%d.%02d", n(969, "a") + 12, n(90, "b") + 10)
    grade = F.format_string("%d.%02d", n(4, "g") + 6, n(100, "h"))
    return F.when(field.contains("Date"), date).when(field.contains("Amount"), amount).when(field.contains("Grade"), grade).otherwise((n(9000, "n") + 1000).cast("string"))


def page_lines(pages: DataFrame) -> DataFrame:
    """``page_id, line, kind, text`` of catalogue pages: title, code, fields, subject, and 6 to 13 body lines of 8 to 12 words."""
    fields = [F.struct(F.lit("field").alias("kind"), F.concat(F.lit(f"{f}: "), field_value(F.lit(f), "page_id", F.lit(f))).alias("text")) for f in FIELDS]
    head = [F.struct(F.lit("title").alias("kind"), F.initcap("kind").alias("text")), F.struct(F.lit("code").alias("kind"), F.concat(F.lit("Code: "), F.col("code")).alias("text")), *fields]
    head.append(F.struct(F.lit("subject").alias("kind"), F.concat(F.lit("Subject: "), F.col("subject")).alias("text")))
    words = F.array(*map(F.lit, WORDS))

    def body(i: Column) -> Column:
        n = choice(5, "page_id", i, F.lit("words")) + 8
        start = drawn(11, "page_id", i, F.lit("start")) % (len(WORDS) - n)
        return F.struct(F.lit("body").alias("kind"), F.array_join(F.slice(words, (start + 1).cast("int"), n), " ").alias("text"))

    lines = F.concat(F.array(*head), F.transform(F.sequence(F.lit(1), choice(8, "page_id", F.lit("lines")) + 6), body))
    return pages.select("page_id", F.posexplode(lines).alias("line", "x")).select("page_id", "line", "x.kind", "x.text")


def word_boxes(lines: DataFrame, code_scale: float = 1.0) -> DataFrame:
    """``page_id, line, token, x0, y0, x1, y1``: words of lines with their boxes, in shares of the page. Characters have one
    width; those of the code's line are ``code_scale`` times as wide and high."""
    scale = F.when(F.col("kind") == "code", F.lit(float(code_scale))).otherwise(F.lit(1.0))
    words = F.split("text", " ")
    before = F.transform(words, lambda w, i: F.aggregate(F.slice(words, 1, i), F.lit(0), lambda s, x: s + F.length(x) + 1))
    rows = lines.select("page_id", "line", scale.alias("scale"), F.explode(F.arrays_zip(words.alias("token"), before.alias("at"))).alias("w"))
    x0, y0 = F.col("w.at") * F.col("scale") / WIDTH, F.col("line") / HEIGHT
    x1, y1 = (F.col("w.at") + F.length("w.token")) * F.col("scale") / WIDTH, (F.col("line") + F.col("scale")) / HEIGHT
    return rows.select("page_id", "line", F.col("w.token").alias("token"), *[F.round(F.least(F.lit(1.0), b), 6).alias(n) for b, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def write_corpus(pages: DataFrame, path: str, code_scale: float = 1.0) -> None:
    """Write ``layout``, ``queries`` and ``lines`` as JSON rows and a manifest with their numbers below a folder."""
    lines, queries = page_lines(pages), query_set(pages)
    for name, rows in (("layout", word_boxes(lines, code_scale)), ("queries", queries), ("lines", lines)):
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
    n = pages.agg(F.count("*").alias("pages"), F.countDistinct("doc_id").alias("docs")).first()
    kinds = {r["kind"]: r["count"] for r in queries.groupBy("kind").count().collect()}
    write_text(pages.sparkSession, f"{path.rstrip('/')}/manifest.json", json.dumps({"n_docs": n["docs"], "n_pages": n["pages"], "n_queries": sum(kinds.values()), "kinds": kinds, "code_scale": code_scale}))
