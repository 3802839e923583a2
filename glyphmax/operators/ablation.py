"""Compression settings replayed over one encoded corpus, and the report on them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmax.operators import codecs, metrics, prune, similarity
from glyphmax.operators.index import index_stats, page_accounts


@dataclass(frozen=True)
class Variant:
    name: str
    pruning: dict[str, Any] | None = None
    method: str = "none"
    note: str = ""
    saliency: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)


def default_variants() -> list[Variant]:
    spatial = {"keep_ratio": 0.5, "min_keep": 2}
    both = spatial | {"redundancy_threshold": 0.3}
    return [
        Variant("baseline", note="float32, nothing pruned"),
        Variant("binary", method="binary"),
        Variant("int8", method="int8"),
        Variant("spatial", spatial),
        Variant("spatial+redundancy", both),
        Variant("pruned+int8", both, "int8"),
        Variant("full", both, "binary"),
        Variant("aggressive", {"keep_ratio": 0.25, "min_keep": 1, "redundancy_threshold": 0.2}, "binary"),
    ]


def keep_ratio_sweep(ratios: tuple[float, ...] = (0.5, 0.4, 0.3, 0.2, 0.1)) -> list[Variant]:
    return [Variant(f"keep-{round(100 * r)}pct", {"keep_ratio": r, "min_keep": 1, "redundancy_threshold": 0.3}, "binary") for r in ratios]


def codebook_sweep(ratios: tuple[float, ...] = (0.5, 0.3, 0.1), sources: tuple[str, ...] = ("farthest", "random", "kmeans")) -> list[Variant]:
    return [Variant(f"probe-{s}-{round(100 * r)}pct", {"keep_ratio": r, "min_keep": 1, "redundancy_threshold": 0.3}, "binary", saliency=s) for r in ratios for s in sources]


def codebook_saliencies(patches: DataFrame, sources: tuple[str, ...], size: int, seed: int = 7) -> dict[str, DataFrame]:
    """A saliency table for each source of codebooks, for the variants that name it."""
    out = {}
    for source in sources:
        book = prune.fit_codebook(patches, size, source, seed)
        out[source] = prune.probe_saliency(patches, patches.sparkSession.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(book)], "probe int, v array<double>"))
    return out


def variant_vectors(patches: DataFrame, variant: Variant, saliency: DataFrame | dict[str, DataFrame], dim: int) -> tuple[DataFrame, DataFrame]:
    """Vectors a variant keeps, and the same decoded from their codes. ``saliency``: a table, or one by the variants' source."""
    if isinstance(saliency, dict):
        if variant.pruning is not None and variant.saliency not in saliency:
            raise ValueError(f"no saliency of source {variant.saliency!r}")
        saliency = saliency.get(variant.saliency) if variant.pruning is not None else None
    kept = prune.pruned(patches, saliency, **variant.pruning) if variant.pruning is not None else patches.select("page_id", "tok", F.lit(1).alias("size"), "v")
    return kept, codecs.decoded(codecs.compressed(kept, variant.method, dim), variant.method, dim)


def run_variants(patches: DataFrame, queries: DataFrame, qrels: DataFrame, saliency: DataFrame | dict[str, DataFrame], variants: list[Variant], dim: int, depth: int = 10) -> DataFrame:
    """One report row a variant: sizes, metrics, and agreement with the first one's ranking.

    The first variant is the baseline of retention and tau. What variants share is kept while they run; a report is a
    few rows, so it is gathered and returned as a small table.
    """
    spark = patches.sparkSession
    held = [x.persist() for x in (patches, queries, qrels, *(saliency.values() if isinstance(saliency, dict) else [saliency]))]
    rows, base_run, base = [], None, None
    for v in variants:
        kept, decoded = variant_vectors(patches, v, saliency, dim)
        run = similarity.ranked(similarity.maxsim(similarity.page_rows(decoded), queries), depth).persist()
        held.append(run)
        base_run = run if base_run is None else base_run
        tau = metrics.tau_b(base_run, run).agg(F.round(F.avg("tau"), 6).alias("tau"))
        row = metrics.evaluate(run, qrels).crossJoin(index_stats(page_accounts(patches, kept, v.method, dim))).crossJoin(tau).first()
        base = row["ndcg_5"] if base is None else base
        rows.append((v.name, *(row[c] for c in ("vectors_per_page", "bytes_per_page", "compression_ratio", "ndcg_5", "recall_1", "hit_5", "mrr_10")), row["ndcg_5"] / base if base else None, row["tau"]))
    for x in held:
        x.unpersist()
    return spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'variant' else 'double'}" for n in REPORT_FORMATS))


REPORT_FORMATS = {"variant": "", "vectors_per_page": ".1f", "bytes_per_page": ".1f", "compression_ratio": ".1f", "ndcg_5": ".4f", "recall_1": ".4f", "hit_5": ".4f", "mrr_10": ".4f", "retention": ".3f", "tau": ".3f"}
