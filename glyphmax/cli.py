"""Command line: ``python -m glyphmax.cli init-config|make-corpus|index|search|stats|explain|bench``.

Pages are Parquet rows ``page_id, text``, or patch vectors ``page_id, tok, is_text, v``; queries ``qid, query`` or ``qid, qtok, v``,
or a text.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmax.config import Config
from glyphmax.engine import Engine
from glyphmax.operators import corpus, grid, tokens
from glyphmax.operators.index import PageIndex, storage_summary


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmax")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("init-config")
    a.add_argument("out")
    a = sub.add_parser("make-corpus")
    a.add_argument("out")
    a.add_argument("--docs", type=int, default=30)
    a.add_argument("--pages", type=int, default=2)
    a.add_argument("--seed", type=int, default=7)
    a.add_argument("--code-scale", type=float, default=1.0)
    for name in ("index", "search", "stats", "explain", "bench"):
        a = sub.add_parser(name)
        a.add_argument("--config")
        if name != "stats":
            a.add_argument("source", help="pages (index, explain), queries or a text (search), an sf folder (bench)")
        if name in ("index", "search"):
            a.add_argument("--layout", help="word boxes: page_id, token, x0, y0, x1, y1")
        if name == "index":
            a.add_argument("--append", action="store_true")
        if name == "search":
            a.add_argument("--top-k", type=int)
        if name == "explain":
            a.add_argument("--page", type=int, required=True)
    return p


def search(engine: Engine, source: str, top_k: int | None) -> DataFrame:
    engine.open()
    if not source.endswith(".parquet"):
        return engine.search_text(engine.spark.createDataFrame([(0, source)], "qid long, query string"), top_k)
    rows = engine.spark.read.parquet(source)
    return engine.search_text(rows, top_k) if "query" in rows.columns else engine.search(rows, top_k)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init-config":
        Config().dump(args.out)
        return 0
    spark = SparkSession.builder.appName("glyphmax").getOrCreate()
    if args.command == "make-corpus":
        corpus.write_corpus(tokens.page_catalogue(spark, args.docs, args.pages, args.seed), args.out, args.code_scale)
        return 0
    config = Config.load(args.config)
    layout = spark.read.parquet(args.layout) if getattr(args, "layout", None) else None
    if args.command == "index":
        engine, pages, mode = Engine(spark, config, layout), spark.read.parquet(args.source), "append" if args.append else "overwrite"
        (engine.build(pages, mode=mode) if "v" in pages.columns else engine.build_documents(pages, mode)).show(truncate=False)
    elif args.command == "search":
        search(Engine(spark, config, layout), args.source, args.top_k).orderBy("qid", "rank").show(1000, truncate=False)
    elif args.command == "stats":
        stats = PageIndex.open(spark, config.index.path).stats()
        stats.show(truncate=False)
        storage_summary(stats).show(truncate=False)
    elif args.command == "explain":
        c = config.pruning
        page = spark.read.parquet(args.source).where(F.col("page_id") == args.page)
        masks = grid.page_masks(page, blank_threshold=c.threshold, keep_ratio=c.keep_ratio, min_keep=c.min_keep, dilation=c.dilation)
        print("\n".join(r["line"] for r in grid.mask_text(masks).orderBy("r").collect()))
    else:
        from glyphmax.catalog import ablation_table
        from glyphmax.operators.ablation import REPORT_FORMATS
        from glyphmax.sources.documents import to_markdown

        print(to_markdown(ablation_table(spark, args.source).orderBy(F.desc("bytes_per_page")), REPORT_FORMATS))
    return 0


if __name__ == "__main__":
    sys.exit(main())
