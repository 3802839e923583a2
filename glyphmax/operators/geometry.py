"""Statistics of vectors and of scores under coding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmax.functions import vec
from glyphmax.operators.prune import covariance


def rho_stats(vectors: DataFrame) -> DataFrame:
    r = vectors.select(vec.rho(F.col("v")).alias("rho"), vec.half_mass_dims(F.col("v")).alias("dims"))
    return r.agg(
        F.round(F.avg("rho"), 6).alias("mean"), F.round(F.stddev_pop("rho"), 6).alias("std"), F.round(F.percentile("rho", 0.05), 6).alias("p05"),
        F.round(F.percentile("rho", 0.95), 6).alias("p95"), F.round(F.avg((F.col("rho") > vec.GAUSS_RHO).cast("int")), 6).alias("above_gauss"), F.round(F.avg("dims"), 6).alias("half_mass_dims"),
    )


def sign_entropy(vectors: DataFrame) -> DataFrame:
    """Per component: share of positive signs, its entropy in bits, mean and deviation; dead below half a bit."""
    x = vectors.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg((F.col("x") > 0).cast("int")).alias("p"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("p")))
    h = -p * F.log2(p) - (1 - p) * F.log2(1 - p)
    return x.select("k", F.round("p", 6).alias("p"), F.round(h, 6).alias("entropy"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), (h < 0.5).alias("dead"))


def participation_ratio(vectors: DataFrame, dim: int, top: int = 8) -> DataFrame:
    """tr(C)^2 / ||C||_F^2 of the covariance C, and the share of its ``top`` largest eigenvalues; C comes from partial sums."""
    c = covariance(vectors, dim)[1]
    values = np.sort(np.linalg.eigvalsh(c))[::-1]
    return vectors.sparkSession.createDataFrame([(round(float(np.trace(c) ** 2 / (c * c).sum()), 4), round(float(values[:top].sum() / values.sum()), 6))], "participation_ratio double, top_share double")


def mean_pairwise_cosine(vectors: DataFrame, by: str) -> DataFrame:
    """Mean cosine over all pairs of unit vectors per group, from the length of their sum."""
    unit = vectors.select(by, vec.normalise(F.col("v")).alias("v"))
    n = unit.groupBy(by).agg(F.count("*").alias("n"))
    s = unit.select(by, F.posexplode("v").alias("k", "x")).groupBy(by, "k").agg(F.sum("x").alias("x")).groupBy(by).agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    return s.join(n, by).select(by, "n", F.round(F.when(F.col("n") > 1, (F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1))), 6).alias("cosine"))


def argmax_flips(matches: DataFrame) -> DataFrame:
    """Share of winning patches (:func:`glyphmax.operators.similarity.token_matches`) that sign codes replace."""
    return matches.agg(F.count("*").alias("n"), F.round(F.avg((F.col("tok") != F.col("sign_tok")).cast("int")), 6).alias("flip_rate"))


def distractor_promotion(matches: DataFrame) -> DataFrame:
    """Share of winning patches that are structural tokens, under float and sign codes."""
    share = [F.round(F.avg(F.col(c).cast("int")), 6).alias(n) for c, n in (("is_text", "float_share"), ("sign_text", "sign_share"))]
    return matches.agg(*share)


def winner_shares(matches: DataFrame, types: DataFrame) -> DataFrame:
    """Winners and their share of the score by token type (``page_id, tok, kind``): ``kind, wins, win_share, score_share``."""
    by = matches.join(types, ["page_id", "tok"]).groupBy("kind").agg(F.count("*").alias("wins"), F.sum("best").alias("score"))
    whole = Window.partitionBy()  # over one row a type
    return by.select("kind", "wins", F.round(F.col("wins") / F.sum("wins").over(whole), 6).alias("win_share"), F.round(F.col("score") / F.sum("score").over(whole), 6).alias("score_share"))


def winners_by_position(matches: DataFrame) -> DataFrame:
    """Per place in the query: share of winners that are structural tokens, and the mean best similarity."""
    return matches.groupBy("qtok").agg(F.round(F.avg(F.col("is_text").cast("int")), 6).alias("text_share"), F.round(F.avg("best"), 6).alias("mean_best"))


def score_noise(scores: DataFrame) -> DataFrame:
    """Least-squares fit of coded (``s``) on exact (``f``) scores per query: slope, intercept, rest deviation, SNR."""
    g = scores.groupBy("qid").agg(F.regr_slope("s", "f").alias("slope"), F.regr_intercept("s", "f").alias("intercept"), F.stddev_pop("f").alias("sd"), F.regr_r2("s", "f").alias("r2"), F.stddev_pop("s").alias("ss"))
    rest = F.col("ss") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r2")))
    return g.select("qid", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round(rest, 4).alias("noise"), F.round(F.abs(F.col("slope")) * F.col("sd") / rest, 3).alias("snr"))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's correlation as an aggregate, null where either is constant: ``corr`` divides by zero there, an error in ANSI mode."""
    return F.when((F.max(x) > F.min(x)) & (F.max(y) > F.min(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def snr_correlation(noise: DataFrame, tau: DataFrame) -> DataFrame:
    """Correlation over queries of the logarithm of ``snr`` with ``tau``; NaN, as in SQL, where either is constant."""
    r = F.when(F.count("*") > 0, F.coalesce(correlation(F.log("snr"), "tau"), F.lit(float("nan"))))
    return noise.where("snr > 0").join(tau, "qid").agg(F.count("*").alias("n"), F.round(r, 4).alias("r"))


def score_floor(matches: DataFrame) -> DataFrame:
    """Per query token: least and mean best similarity over pages, mean number of patches near the best, and the share of
    the score that structural tokens give."""
    text = F.sum(F.when(F.col("is_text"), F.col("best")).otherwise(0.0)) / F.sum("best")
    return matches.groupBy("qid", "qtok").agg(F.round(F.min("best"), 6).alias("floor"), F.round(F.avg("best"), 6).alias("mean_best"), F.round(F.avg("near"), 6).alias("near_best"), F.round(text, 6).alias("text_share"))


def saliency_overlap(a: DataFrame, b: DataFrame, share: float = 0.25) -> DataFrame:
    """Agreement of two saliency tables (``page_id, r, c, saliency``), as of an image and its negative: per page the overlap
    of their most salient ``share`` of cells, and the correlation of their values."""
    page = Window.partitionBy("page_id")

    def ranked(x: DataFrame, s: str) -> DataFrame:
        return x.select("page_id", "r", "c", F.col("saliency").alias(s), F.row_number().over(page.orderBy(F.desc("saliency"), "r", "c")).alias(f"rank_{s}"))

    k = F.greatest(F.lit(1), F.floor(F.count("*").over(page) * share))
    both = ranked(a, "x").join(ranked(b, "y"), ["page_id", "r", "c"]).withColumn("k", k)
    overlap = F.count_if((F.col("rank_x") <= F.col("k")) & (F.col("rank_y") <= F.col("k"))) / F.first("k")
    return both.groupBy("page_id").agg(F.round(overlap, 6).alias("overlap"), F.round(correlation("x", "y"), 4).alias("r"))
