"""Retrieval metrics and rank agreement, as joins and aggregates over rankings (qid, page_id, rank)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmax.plans.running import running

KS = (1, 3, 5, 10)


def ideal_gain(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, mrr_k: int = 10) -> DataFrame:
    """ndcg, recall and hit at each k and mrr per judged query; a query without results has zeros."""
    n = qrels.groupBy("qid").agg(F.countDistinct("page_id").alias("n_rel"))
    hits = run.join(qrels.distinct(), ["qid", "page_id"]).groupBy("qid").agg(
        *[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"g{k}") for k in ks],
        *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks],
        F.min("rank").alias("first"),
    )
    rows = n.join(hits, "qid", "left")
    out = [F.col("qid")]
    for k in ks:
        found = F.coalesce(f"h{k}", F.lit(0))
        out += [
            (F.coalesce(f"g{k}", F.lit(0.0)) / ideal_gain(F.least("n_rel", F.lit(k)))).alias(f"ndcg_{k}"),
            (found / F.least("n_rel", F.lit(k))).alias(f"recall_{k}"),
            F.when(found > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
        ]
    return rows.select(*out, F.when(F.col("first") <= mrr_k, 1 / F.col("first")).otherwise(0.0).alias(f"mrr_{mrr_k}"))


def evaluate(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Macro averages over all judged queries, and their number."""
    q = per_query(run, qrels, ks)
    return q.agg(*[F.round(F.avg(c), 6).alias(c) for c in q.columns if c != "qid"], F.count("*").alias("n_queries"))


def restricted(qrels: DataFrame, pages: DataFrame) -> DataFrame:
    """Judgements of indexed pages; queries without any left disappear. An error if none is left at all."""
    out = qrels.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    if out.isEmpty():
        raise ValueError("no judged page is indexed")
    return out


def both_ranks(a: DataFrame, b: DataFrame, how: str = "outer") -> DataFrame:
    """``qid, page_id, ra, rb``: ranks in two lists; an item outside a list ranks behind its last."""
    x, y = a.select("qid", "page_id", F.col("rank").alias("ra")), b.select("qid", "page_id", F.col("rank").alias("rb"))
    joined = x.join(y, ["qid", "page_id"], how)
    if how == "inner":
        return joined
    na, nb = a.groupBy("qid").agg((F.count("*") + 1).alias("na")), b.groupBy("qid").agg((F.count("*") + 1).alias("nb"))
    joined = joined.join(na, "qid", "left").join(nb, "qid", "left")
    return joined.select("qid", "page_id", F.coalesce("ra", "na", F.lit(1)).alias("ra"), F.coalesce("rb", "nb", F.lit(1)).alias("rb"))


def item_pairs(ranks: DataFrame) -> DataFrame:
    y = ranks.select("qid", F.col("page_id").alias("other"), F.col("ra").alias("ra2"), F.col("rb").alias("rb2"))
    return ranks.join(y, "qid").where(F.col("page_id") < F.col("other"))


def tau_b(a: DataFrame, b: DataFrame) -> DataFrame:
    """``qid, tau``: Kendall's tau-b over the union of two top lists, absent items tied behind the last; 1 without pairs."""
    pool = both_ranks(a, b)
    x, y = F.signum(F.col("ra") - F.col("ra2")), F.signum(F.col("rb") - F.col("rb2"))
    n = item_pairs(pool).groupBy("qid").agg(
        F.count_if(x * y > 0).alias("c"), F.count_if(x * y < 0).alias("d"), F.count_if((x == 0) & (y != 0)).alias("ta"), F.count_if((y == 0) & (x != 0)).alias("tb")
    )
    cd = F.col("c") + F.col("d")
    den = F.sqrt((cd + F.col("ta")) * (cd + F.col("tb")))
    n = n.select("qid", F.when(den == 0, 1.0).otherwise((F.col("c") - F.col("d")) / den).alias("tau"))
    return pool.select("qid").distinct().join(n, "qid", "left").select("qid", F.round(F.coalesce("tau", F.lit(1.0)), 6).alias("tau"))


def tau_shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """``qid, tau``: concordance over items in both lists only, without tie correction; 1 for fewer than two."""
    shared = both_ranks(a, b, "inner")

    def run(query: pd.DataFrame) -> pd.DataFrame:
        n = len(query)
        agreed = smaller_before(query["rb"].to_numpy()[np.argsort(query["ra"].to_numpy(), kind="stable")]).sum()
        return pd.DataFrame({"qid": query["qid"].iloc[:1], "tau": [4 * agreed / (n * (n - 1)) - 1 if n > 1 else 1.0]})

    n = shared.groupBy("qid").applyInPandas(run, "qid long, tau double")
    return a.select("qid").distinct().join(n, "qid", "left").select("qid", F.round(F.coalesce("tau", F.lit(1.0)), 6).alias("tau"))


def tau_ap(reference: DataFrame, other: DataFrame) -> DataFrame:
    """``qid, tau_ap``: for each item of ``reference`` but the first, the share of items above it that ``other`` has above it too."""
    r = both_ranks(reference, other, "inner")

    def run(query: pd.DataFrame) -> pd.DataFrame:
        ra, rb = (query[c].to_numpy() for c in ("ra", "rb"))
        order = np.argsort(ra, kind="stable")
        share = smaller_before(rb[order])[1:] / (ra[order][1:] - 1)
        return pd.DataFrame({"qid": query["qid"].iloc[:1], "tau_ap": [2 * share.mean() - 1 if len(share) else None]})

    return r.groupBy("qid").applyInPandas(run, "qid long, tau_ap double").where("tau_ap IS NOT NULL").select("qid", F.round("tau_ap", 6).alias("tau_ap"))


def smaller_before(x: np.ndarray) -> np.ndarray:
    """For each item the number of smaller ones in front of it, by merging sorted halves."""
    out, order, width = np.zeros(len(x), np.int64), np.arange(len(x)), 1
    while width < len(x):
        for a in range(0, len(x) - width, 2 * width):
            left, right = order[a : a + width], order[a + width : a + 2 * width]
            out[right] += np.searchsorted(x[left], x[right], "left")
            both = order[a : a + 2 * width]
            order[a : a + 2 * width] = both[np.argsort(x[both], kind="stable")]
        width *= 2
    return out


def rbo(a: DataFrame, b: DataFrame, p: float = 0.9) -> DataFrame:
    """``qid, rbo``: rank-biased overlap of two full permutations, agreement 1 beyond their end."""
    r = both_ranks(a, b, "inner")
    at = r.groupBy("qid", F.greatest("ra", "rb").alias("depth")).agg(F.count("*").alias("n"))
    # an item common from depth m on adds (1 - p) p^(d-1) / d at every depth d >= m: rests of the sum, looked up; those that are 0 in doubles are left out
    d = np.arange(1, 2 + (int(np.log(1e-30) / np.log(p)) if 0 < p < 1 else 0), dtype=np.float64)
    rest = np.cumsum(((1 - p) * p ** (d - 1) / d)[::-1])[::-1]
    rests = F.broadcast(a.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(rest)], "depth long, rest double"))  # 656 rows for p = 0.9
    inside = at.join(rests, "depth", "left").groupBy("qid").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.coalesce("rest", F.lit(0.0))).alias("s"))
    whole = inside.join(rests.withColumn("depth", F.col("depth") - 1).withColumnRenamed("depth", "size"), "size", "left")
    beyond = F.col("size") * F.coalesce("rest", F.lit(0.0))
    return whole.select("qid", F.round(F.col("s") - beyond + F.pow(F.lit(p), F.col("size")), 6).alias("rbo"))


def agreement(base: DataFrame, other: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Share of equal top results, mean overlap of the top k, and how many right top results are kept."""
    x = base.where(F.col("rank") <= k).select("qid", "page_id").join(other.where(F.col("rank") <= k).select("qid", "page_id"), ["qid", "page_id"]).groupBy("qid").agg(F.count("*").alias("n"))
    one = base.where("rank = 1").select("qid", "page_id").join(other.where("rank = 1").select("qid", F.col("page_id").alias("top")), "qid")
    gold = one.join(qrels.distinct().withColumn("right", F.lit(True)), ["qid", "page_id"], "left").withColumn("same", F.col("page_id") == F.col("top"))
    return gold.join(x, "qid", "left").agg(
        F.round(F.avg(F.col("same").cast("int")), 6).alias("top1"),
        F.round(F.avg(F.coalesce("n", F.lit(0)) / k), 6).alias("overlap"),
        F.round(F.avg(F.when(F.col("right"), F.col("same").cast("int"))), 6).alias("gold_kept"),
    )


def drawn(seed: int, *of: Column | str) -> Column:
    """A number below 2^32 from the md5 of a seed and columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *of).cast("binary")), 1, 8), 16, 10).cast("long")


def bootstrap(per_query_a: DataFrame, per_query_b: DataFrame, metric: str, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """Paired bootstrap of the mean difference: 2.5 and 97.5 percentiles and the share above zero.

    Resampling is by hash: round r draws, for each place i from 1, the query of place md5(seed, r, i) modulo n, counted from
    0 in the order of ids. Queries are numbered and joined with the draws by number.
    """
    d = per_query_a.select("qid", F.col(metric).alias("a")).join(per_query_b.select("qid", F.col(metric).alias("b")), "qid")
    d = d.select("qid", (F.col("b") - F.col("a")).alias("d")).persist()  # a row a query, read by every step below
    d_numbered = running(d, ["qid"], i=F.lit(1)).select("i", "d")
    n = d.count()
    draws = d_numbered.select("i", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).select("round", ((drawn(seed, "round", "i") % max(n, 1)) + 1).alias("i"))
    means = draws.join(d_numbered, "i").groupBy("round").agg(F.round(F.avg("d"), 9).alias("m"))
    out = means.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.975), 6).alias("high"), F.round(F.avg((F.col("m") > 0).cast("int")), 6).alias("above_zero"))
    row = tuple(out.first())
    d.unpersist()
    return out.sparkSession.createDataFrame([row], out.schema)


def first_hit_gain(run: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """``qid, gain``: 1 / log2(rank + 1) of the first relevant result within ``k``, else 0. Equals nDCG only for queries with
    one relevant page; :func:`per_query` is right for all."""
    first = run.where(F.col("rank") <= k).join(qrels.distinct(), ["qid", "page_id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    return qrels.select("qid").distinct().join(first, "qid", "left").select("qid", F.round(F.coalesce(1 / F.log2(F.col("first") + 1), F.lit(0.0)), 6).alias("gain"))


def chance_levels(spark: SparkSession, sizes: tuple[int, ...] = (60, 500), rounds: int = 200, seed: int = 0, k: int = 5) -> DataFrame:
    """Mean agreement of random permutations with the identity: ``size, tau, rbo, tau_ap, overlap``.

    A round's permutation orders the items by md5 of seed, size, round and item; rounds are independent rows.
    """
    cases = spark.range(1, rounds + 1).select(F.col("id").alias("round"), F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    items = cases.select("round", "size", F.explode(F.sequence(F.lit(1), "size")).alias("page_id"))
    order = Window.partitionBy("size", "round").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "size", "round", "page_id").cast("binary")), "page_id")
    qid = (F.col("size") * 1_000_000 + F.col("round")).cast("long").alias("qid")
    other = items.select(qid, F.col("page_id").cast("long").alias("page_id"), F.row_number().over(order).alias("rank"))
    same = items.select(qid, F.col("page_id").cast("long").alias("page_id"), F.col("page_id").alias("rank"))
    tops = same.where(F.col("rank") <= k).join(other.where(F.col("rank") <= k).select("qid", "page_id"), ["qid", "page_id"]).groupBy("qid").agg((F.count("*") / k).alias("overlap"))
    rows = tau_shared(same, other).join(rbo(same, other), "qid").join(tau_ap(same, other), "qid").join(tops, "qid", "left").fillna(0.0, ["overlap"])
    by = rows.groupBy(F.floor(F.col("qid") / 1_000_000).cast("int").alias("size"))
    return by.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("tau", "rbo", "tau_ap", "overlap")])
