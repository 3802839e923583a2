"""Column builders for vectors held as ``array<double>``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INT8_RANGE = 0.5


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l1(v: Column) -> Column:
    return total(F.transform(v, lambda x: F.abs(x)))


def l2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column, eps: float = 1e-12) -> Column:
    """Unit length; vectors shorter than ``eps`` are divided by ``eps``."""
    n = F.greatest(l2(v), F.lit(eps))
    return F.transform(v, lambda x: x / n)


def bits(v: Column) -> Column:
    """Sign bits: true for components above zero, so zero and below are false."""
    return F.transform(v, lambda x: x > 0)


def signs(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(-1.0))


def code_bytes(dim: int) -> int:
    return (dim + 7) // 8


def pack_bits(v: Column, dim: int) -> Column:
    """Sign bits as binary, most significant bit first, padded with zeros to whole bytes."""
    octets = []
    for b in range(code_bytes(dim)):
        value = F.lit(0)
        for k in range(8):
            if 8 * b + k < dim:
                value = value + F.when(F.get(v, F.lit(8 * b + k)) > 0, 128 >> k).otherwise(0)
        octets.append(F.lpad(F.hex(value), 2, "0"))
    return F.unhex(F.concat(*octets))


def unpack_signs(code: Column, dim: int) -> Column:
    """Plus and minus ones of a packed code's first ``dim`` bits."""
    octets = [F.conv(F.hex(F.substring(code, b + 1, 1)), 16, 10).cast("int") for b in range(code_bytes(dim))]
    return F.array(*[F.when(octets[k // 8].bitwiseAND(F.lit(128 >> k % 8)) != 0, 1.0).otherwise(-1.0) for k in range(dim)])


def int8(v: Column) -> Column:
    """Symmetric 8-bit codes over +-0.5, rounded half to even and clipped to +-127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / INT8_RANGE * 127))).cast("tinyint"))


def from_int8(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double") * (INT8_RANGE / 127))


def two_bit(v: Column, sigma: Column) -> Column:
    """Lloyd-Max levels of a normal distribution: cells -2, -1, 0, 1 cut at +-0.9816 sigma and 0."""
    edge = 0.9816
    return F.transform(v, lambda x: F.when(x < -edge * sigma, -2).when(x < 0, -1).when(x < edge * sigma, 0).otherwise(1))


def from_two_bit(c: Column, sigma: Column) -> Column:
    return F.transform(c, lambda x: F.when(x == -2, -1.510 * sigma).when(x == -1, -0.4528 * sigma).when(x == 0, 0.4528 * sigma).otherwise(1.510 * sigma))


def hamming_agreement(a: Column, b: Column) -> Column:
    """(equal bits - different bits) / dimensions of two bit arrays."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(-1)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def rho(v: Column) -> Column:
    """l1 / (l2 sqrt(dim)): how evenly a vector's mass lies; sqrt(2 / pi) for Gaussian components."""
    return l1(v) / (l2(v) * F.sqrt(F.size(v)))


def half_mass_dims(v: Column) -> Column:
    """Number of largest components that hold half of the l1 mass."""
    mass = F.reverse(F.array_sort(F.transform(v, lambda x: F.abs(x))))
    whole = total(mass)
    fold = F.aggregate(mass, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + F.when((a["s"] + x) / whole < 0.5, 1).otherwise(0)).alias("n")))
    return fold["n"] + 1


GAUSS_RHO = math.sqrt(2 / math.pi)
