"""Which patches to keep: selectors against the patches that queries need, on queries that the selector has not seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmax.operators import metrics, similarity


def is_held_out(column: str = "qid", seed: int = 7):
    """Half of the queries (or subjects), by md5."""
    return metrics.drawn(seed, column) % 2 == 1


def top_mask(scores: DataFrame, k: int) -> DataFrame:
    """``page_id, tok`` of the ``k`` highest scored patches (``page_id, tok, score``) of each page, lower tokens on ties."""
    turn = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "tok"))
    return scores.withColumn("turn", turn).where(F.col("turn") <= k).select("page_id", "tok")


def winner_scores(won: DataFrame, patches: DataFrame) -> DataFrame:
    """The oracle selector: how many query tokens of ``won`` (page_id, tok, wins) each patch answers."""
    return patches.select("page_id", "tok").join(won.select("page_id", "tok", "wins"), ["page_id", "tok"], "left").select("page_id", "tok", F.coalesce("wins", F.lit(0)).cast("double").alias("score"))


def random_scores(patches: DataFrame, seed: int = 7) -> DataFrame:
    """The control: scores by md5 of seed, page and token."""
    return patches.select("page_id", "tok", metrics.drawn(seed, "page_id", "tok").cast("double").alias("score"))


def winners_only(patches: DataFrame, won: DataFrame) -> DataFrame:
    """Patches that answered any token of the queries of ``won``."""
    return patches.join(won.select("page_id", "tok").distinct(), ["page_id", "tok"], "left_semi")


def recalls(masks: dict[str, DataFrame], won: DataFrame) -> DataFrame:
    """``selector, recall``: share of the wins of ``won`` (page_id, tok, wins) that each mask (``page_id, tok``) keeps."""
    kept = reduce(DataFrame.unionByName, [m.select(F.lit(name).alias("selector"), "page_id", "tok") for name, m in masks.items()])
    rows = won.join(kept.groupBy("page_id", "tok").agg(F.collect_set("selector").alias("by")), ["page_id", "tok"], "left")
    names = list(masks)
    sums = rows.agg(F.sum("wins").alias("every"), *[F.sum(F.when(F.array_contains("by", name), F.col("wins")).otherwise(0)).alias(f"kept_{i}") for i, name in enumerate(names)])
    each = [F.struct(F.lit(name).alias("selector"), F.round(F.col(f"kept_{i}") / F.col("every"), 6).alias("recall")) for i, name in enumerate(names)]
    return sums.select(F.inline(F.array(*each)))


def evaluate_selectors(patches: DataFrame, queries: DataFrame, qrels: DataFrame, selectors: dict[str, DataFrame], k: int) -> DataFrame:
    """``selector, recall, ndcg_5`` of selectors (``page_id, tok, score``) at ``k`` patches a page, on held-out queries.

    Selectors that are fitted on queries must be fitted on the others. Wins are counted in a page pass
    (:func:`glyphmax.operators.similarity.winner_counts`), once for all selectors. One small row a selector.
    """
    held = queries.where(is_held_out())
    judged = qrels.join(held.select("qid").distinct(), "qid", "left_semi")
    masks, gains = {name: top_mask(scores, k) for name, scores in selectors.items()}, []
    for name, mask in masks.items():
        kept = patches.join(mask, ["page_id", "tok"], "left_semi")
        run = similarity.ranked(similarity.maxsim(similarity.page_rows(kept), held, k=5), 5)
        gain = metrics.per_query(run, judged, (5,)).agg(F.round(F.avg("ndcg_5"), 6).alias("ndcg_5"))
        gains.append(gain.select(F.lit(name).alias("selector"), "ndcg_5"))
    return recalls(masks, similarity.winner_counts(patches, held)).join(reduce(DataFrame.unionByName, gains), "selector")
