"""Build and search an index of pages, given as texts or as patch vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmax.config import Config
from glyphmax.encoders import Encoder, encoder
from glyphmax.functions import vec
from glyphmax.operators import grid, prune, similarity
from glyphmax.operators.index import PageIndex
from glyphmax.sources import storage


class Engine:
    """``build`` prunes and codes pages into an index; ``search`` answers queries, optionally re-ranked with full vectors."""

    def __init__(self, spark: SparkSession, config: Config | None = None, layout: DataFrame | int | None = None) -> None:
        self.spark, self.config, self.layout = spark, config or Config(), layout
        self.index: PageIndex | None = None

    def encoder(self) -> Encoder:
        c = self.config.encoder
        return encoder(c.backend, dim=c.dim, grid=c.grid, layout=self.layout, noise=c.noise, seed=self.config.seed)

    def open(self) -> PageIndex:
        """The index under the path, opened once."""
        if self.index is None:
            self.index = PageIndex.open(self.spark, self.config.index.path)
        return self.index

    def build_documents(self, pages: DataFrame, mode: str = "overwrite") -> DataFrame:
        """Encode and index ``page_id, text`` rows; pixel saliency is of the text's raster on the encoder's grid.

        Encodings are stored under the index's path while it is built, for its tables read them several times.
        """
        c, model = self.config, self.encoder()
        if self.layout is not None:
            model.missing(pages)
        mask = None
        if c.pruning.enabled and c.pruning.saliency == "pixel":
            mask = grid.masks_on_grid(pages, c.encoder.grid, c.encoder.grid, blank_threshold=c.pruning.threshold, keep_ratio=c.pruning.keep_ratio, min_keep=c.pruning.min_keep, dilation=c.pruning.dilation)
        at = f"{c.index.path.rstrip('/')}/encoded-{uuid.uuid4().hex}"
        try:
            model.encode_pages(pages).write.option("compression", "zstd").parquet(at)
            return self.build(storage.encodings(self.spark, at), mask, mode)
        finally:
            storage.remove(self.spark, at)

    def build(self, patches: DataFrame, saliency: DataFrame | None = None, mode: str = "overwrite") -> DataFrame:
        """Index ``page_id, tok, is_text, v`` rows; returns the index statistics.

        Modes append and upsert add to the index under the path, where there is one; its manifest sets dimension and codec.
        With ``pruning.saliency`` "codebook" probes are fitted here; "pixel" needs ``saliency`` (page_id, tok, saliency, and
        ``keep`` where the choice is made already).
        """
        c = self.config
        if c.pruning.enabled and c.pruning.saliency == "codebook":
            book = prune.fit_codebook(patches, c.pruning.codebook_size, c.pruning.codebook_source, c.seed)
            probes = self.spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(book)], "probe int, v array<double>")
            saliency = prune.probe_saliency(patches, probes)
        kept = patches.select("page_id", "tok", F.lit(1).alias("size"), "v")
        if c.pruning.enabled:
            if saliency is None:
                raise ValueError("pruning needs a saliency table or the codebook setting")
            kept = prune.pruned(
                patches, saliency, keep_ratio=c.pruning.keep_ratio, threshold=c.pruning.threshold, min_keep=c.pruning.min_keep, redundancy_threshold=c.pruning.redundancy,
                merge=c.pruning.merge, keep_text_tokens=c.pruning.keep_text_tokens,
            )
        if self.index is None and mode != "overwrite" and PageIndex.there(self.spark, c.index.path):
            self.open()
        if self.index is None:
            self.index = PageIndex(self.spark, c.index.path, c.encoder.dim, c.compression.method, c.compression.norms, c.search.rerank)
        self.index.write(patches, kept, mode)
        return self.index.stats()

    def search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """``qid, page_id, score, rank`` for ``qid, qtok, v`` rows, the ``top_k`` best; ``rescored`` after a re-ranking, which
        needs an index that stores full vectors."""
        if self.index is None:
            raise ValueError("no index")
        c, k = self.config, self.config.search.top_k if top_k is None else top_k
        if k < 1:
            raise ValueError("top_k must be at least 1")
        q = queries if c.compression.asymmetric else queries.withColumn("v", vec.signs(F.col("v")))
        every = self.index.pages.select("page_id").distinct()
        rows = every.join(similarity.page_rows(self.index.vectors()), "page_id", "left")
        rows = rows.select("page_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("flat", F.array().cast("array<double>")).alias("flat"))
        full = self.index.floats if c.search.rerank else None
        first = k if full is None else max(k, c.search.prefilter_k)
        hits = similarity.ranked(similarity.maxsim(rows, q, k=first), first)
        return hits if full is None else similarity.rerank(hits, similarity.page_rows(full), queries, k)

    def search_text(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """:meth:`search` for ``qid, query`` rows."""
        return self.search(self.encoder().encode_queries(queries), top_k)

    def search_many(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """Results one row a query: ``qid, hits`` (rank, page_id, score)."""
        hits = self.search(queries, top_k)
        return hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "page_id", "score"))).alias("hits"))
