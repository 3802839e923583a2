"""Vector codecs by name: encode to a ``code`` column, decode to ``v``, bytes per vector."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmax.functions import vec

METHODS = ("none", "binary", "int8", "two_bit")


def encode(v: Column, method: str, dim: int, sigma: Column | None = None) -> Column:
    if method == "none":
        return F.transform(v, lambda x: x.cast("float"))
    if method == "binary":
        return vec.pack_bits(v, dim)
    if method == "int8":
        return vec.int8(v)
    if method == "two_bit":
        return F.transform(vec.two_bit(v, sigma if sigma is not None else F.lit(1 / math.sqrt(dim))), lambda x: x.cast("tinyint"))
    raise ValueError(f"unknown compression method {method!r}")


def decode(code: Column, method: str, dim: int, sigma: Column | None = None) -> Column:
    if method == "none":
        return vec.doubles(code)
    if method == "binary":
        return vec.unpack_signs(code, dim)
    if method == "int8":
        return vec.from_int8(code)
    if method == "two_bit":
        return vec.from_two_bit(code, sigma if sigma is not None else F.lit(1 / math.sqrt(dim)))
    raise ValueError(f"unknown compression method {method!r}")


def bytes_per_vector(method: str, dim: int, norms: bool = False) -> int:
    size = {"none": 4 * dim, "binary": vec.code_bytes(dim), "int8": dim, "two_bit": (2 * dim + 7) // 8}
    if method not in size:
        raise ValueError(f"unknown compression method {method!r}")
    return size[method] + 4 * norms


def compressed(vectors: DataFrame, method: str, dim: int, norms: bool = False) -> DataFrame:
    """``page_id, tok, code`` (and ``scale``, the vector's norm, if asked for)."""
    extra = [vec.l2(F.col("v")).cast("float").alias("scale")] if norms else []
    return vectors.select("page_id", "tok", encode(F.col("v"), method, dim).alias("code"), *extra)


def decoded(codes: DataFrame, method: str, dim: int) -> DataFrame:
    return codes.select("page_id", "tok", decode(F.col("code"), method, dim).alias("v"))


def dimension_means(vectors: DataFrame) -> DataFrame:
    """One row with the mean of every component."""
    m = vectors.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"))
    return m.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda e: e["m"]).alias("mean"))


def centred_signs(vectors: DataFrame, by: str | None = None) -> DataFrame:
    """``page_id, tok, v, weight``: signs around the corpus mean, or the mean of the rows that share ``by`` (a token type, of
    few values), and the norm of what is left, by which a score may be weighted."""
    centred = F.zip_with("v", "mean", lambda x, m: x - m)
    if by is None:
        rows = vectors.crossJoin(F.broadcast(dimension_means(vectors)))
    else:
        m = vectors.select(by, F.posexplode("v").alias("k", "x")).groupBy(by, "k").agg(F.avg("x").alias("m"))
        rows = vectors.join(F.broadcast(m.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda e: e["m"]).alias("mean"))), by)
    return rows.select("page_id", "tok", vec.signs(centred).alias("v"), vec.l2(centred).alias("weight"))


def ladder(dim: int, centres: tuple[int, ...] = (16, 64, 256)) -> list[tuple[str, float]]:
    """Codecs and their bytes per vector, largest first."""
    rows = [("float32", 4.0 * dim), ("float16", 2.0 * dim), ("int8", float(dim)), ("two_bit", dim / 4), ("binary", dim / 8), ("centred+norm", dim / 8 + 2)]
    return sorted(rows + [(f"residual-{k}", residual_bytes(dim, k)) for k in centres], key=lambda r: (-r[1], r[0]))


def residual_codes(assigned: DataFrame, centres: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Nearest centre plus one bit per component of the rest: ``page_id, tok, probe, bits, beta, v``.

    ``assigned``: rows ``page_id, tok, v, probe``; ``v`` becomes centre + beta * sign(rest), beta the mean of the rests'
    absolute components over ``fitted`` (such rows too, the same by default), so that it may come from other pages.
    """
    few = F.broadcast(centres.select("probe", F.col("v").alias("centre")))  # as many rows as a codebook has

    def rests(rows: DataFrame) -> DataFrame:
        return rows.select("page_id", "tok", "v", "probe").join(few, "probe").withColumn("rest", F.zip_with("v", "centre", lambda x, c: x - c))

    rows = rests(assigned)
    beta = (rows if fitted is None else rests(fitted)).agg((F.sum(vec.l1(F.col("rest"))) / F.sum(F.size("rest"))).alias("beta"))
    out = rows.crossJoin(F.broadcast(beta))  # one row
    coded = F.zip_with("centre", "rest", lambda c, x: F.struct(c.alias("c"), (x > 0).alias("up")))
    return out.select("page_id", "tok", "probe", vec.bits(F.col("rest")).alias("bits"), "beta", F.transform(coded, lambda e: e["c"] + F.when(e["up"], F.col("beta")).otherwise(-F.col("beta"))).alias("v"))


def residual_bytes(dim: int, centres: int) -> float:
    return dim / 8 + math.ceil(math.log2(max(2, centres))) / 8
