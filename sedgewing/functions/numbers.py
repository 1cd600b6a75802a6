"""Exact and wide numbers: rationals, numbers of several limbs, polynomials, Bernoulli numbers, products of matrices and sequences."""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sedgewing.functions.arithmetic import gcd, gcd_steps

#: A rational as two 128-bit decimal numbers would overflow in chains; whole ratios of 64-bit numbers don't.
RATIONAL = "struct<num:decimal(38,0),den:decimal(38,0)>"


def _gcd(a: Column, b: Column) -> Column:
    """Of decimals, by Euclid's steps; of those of up to 18 digits over 64-bit numbers."""
    zero, whole = F.lit(0).cast("decimal(38,0)"), "decimal(38,0)"
    x, y = F.abs(a).cast(whole), F.abs(b).cast(whole)
    step = lambda s, _: F.when(s["b"] == zero, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == zero, F.lit(1).cast(whole)).otherwise(s["b"])).cast(whole).alias("b")))
    long_way = F.aggregate(gcd_steps(x, y), F.struct(x.alias("a"), y.alias("b")), step, lambda s: s["a"])
    small = F.greatest(x, y) < F.lit(10**18).cast(whole)
    fits = lambda v: F.when(small, v).cast("long")
    return F.when(a.isNotNull() & b.isNotNull(), F.when(small, gcd(fits(x), fits(y)).cast(whole)).otherwise(long_way))


def rational(num: Column, den: Column) -> Column:
    """num / den in lowest terms with a positive denominator; null for a denominator of 0."""
    n, d = num.cast("decimal(38,0)"), den.cast("decimal(38,0)")
    sign = F.when(d < 0, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(38,0)")

    def low(g: Column) -> Column:
        return F.struct(_divided(n * sign, g).alias("num"), _divided(d * sign, g).alias("den"))

    return F.when(d != 0, F.get(F.transform(F.array(_gcd(n, d)), low), 0))


def _divided(x: Column, by: Column) -> Column:
    """x / by without a remainder."""
    return F.call_function("div", x, by).cast("decimal(38,0)")


def plus(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def times(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["num"], a["den"] * b["den"])


def limbs(hexa: Column, width: int, digits: int = 8) -> Column:
    """A hex number as ``width`` numbers of 32 bits, the lowest first."""
    padded = F.lpad(hexa, width * digits, "0")
    return F.array(*[F.conv(F.substring(padded, (width - 1 - i) * digits + 1, digits), 16, 10).cast("long") for i in range(width)])


def limbs_plus(a: Column, b: Column) -> Column:
    """The sum of two numbers of equally many limbs modulo their width."""
    step = lambda s, x: F.struct(F.concat(s["out"], F.array((x["x"] + x["y"] + s["carry"]).bitwiseAND(0xFFFFFFFF))).alias("out"), F.shiftright(x["x"] + x["y"] + s["carry"], 32).alias("carry"))
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(both, F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry")), step, lambda s: s["out"])


def limbs_modulo(a: Column, by: Column) -> Column:
    """A number of limbs modulo a number below 2**31, from the highest limb down."""
    return F.aggregate(F.reverse(a), F.lit(0).cast("long"), lambda r, x: ((r * F.lit(1 << 32) + x) % by).cast("long"))


def limbs_hex(a: Column) -> Column:
    return F.array_join(F.transform(F.reverse(a), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


@pandas_udf(T.ArrayType(T.LongType()))
def convolution(a: pd.Series, b: pd.Series) -> pd.Series:
    """The product of two polynomials of whole numbers. Exact as long as the results stay below 2**52, by a Fourier transform where
    that is shorter."""

    def product(x: np.ndarray, y: np.ndarray) -> list[int]:
        if not len(x) or not len(y):
            return []
        n = len(x) + len(y) - 1
        if min(len(x), len(y)) < 64:
            return np.convolve(np.asarray(x, np.int64), np.asarray(y, np.int64)).tolist()
        size = 1 << (n - 1).bit_length()
        return np.rint(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[:n]).astype(np.int64).tolist()

    return pd.Series([None if x is None or y is None else product(x, y) for x, y in zip(a, b, strict=True)])


def bernoulli_numbers(n: int) -> list[Fraction]:
    """B(0) .. B(n), B(1) being -1/2."""
    out: list[Fraction] = []
    for m in range(n + 1):
        out.append(Fraction(int(m == 0)) - sum((Fraction(comb(m, k), m - k + 1) * out[k] for k in range(m)), Fraction(0)))
    return out


def power_sum(p: int, n: Column) -> Column:
    """1**p + .. + n**p by Faulhaber's polynomial, whose coefficients are made whole; exact while they fit 38 digits."""
    b = [abs(x) if k == 1 else x for k, x in enumerate(bernoulli_numbers(p))]
    terms = [(p + 1 - k, Fraction(comb(p + 1, k)) * b[k] / (p + 1)) for k in range(p + 1)]
    whole = 1
    for _, c in terms:
        whole = whole * c.denominator // np.gcd(whole, c.denominator)
    out = F.lit(0).cast("decimal(38,0)")
    x = n.cast("decimal(38,0)")
    for power, c in terms:
        t = F.lit(int(c * int(whole))).cast("decimal(38,0)")
        for _ in range(power):
            t = (t * x).cast("decimal(38,0)")
        out = (out + t).cast("decimal(38,0)")
    return _divided(out, F.lit(int(whole)).cast("decimal(38,0)"))


def evaluated(coefficients: list[float] | list[int], x: Column) -> Column:
    """A polynomial, the coefficient of x**0 first, by Horner's rule."""
    out = F.lit(0)
    for c in reversed(coefficients):
        out = out * x + F.lit(c)
    return out


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of two matrices given by their entries other than 0."""
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    both = a.withColumnRenamed("j", "_k").join(right, "_k")
    return both.groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


# fixed values: the number that stands for one third of two words, and the shifts of the public mix of three words
_THIRD = 0x9E3779B97F4A7C13
_SHIFTS = ((43, 9, 8), (38, 23, 5), (35, 49, 11), (12, 18, 22))


def _mixed(rows: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each row of a table of 64-bit words."""
    u = np.uint64
    a, b, c = (np.full(len(rows), x, dtype=u) for x in (_THIRD, _THIRD, seed))
    width = rows.shape[1]
    padded = np.concatenate([rows, np.zeros((len(rows), -width % 3), dtype=u)], axis=1)
    for k in range(0, padded.shape[1], 3):
        a, b, c = a + padded[:, k], b + padded[:, k + 1], c + padded[:, k + 2]
        for x, y, z in _SHIFTS:
            a = (a - b - c) ^ (c >> u(x))
            b = (b - c - a) ^ (a << u(y))
            c = (c - a - b) ^ (b >> u(z))
    return c ^ u(width)


@pandas_udf(T.LongType())
def mixed_hash(values: pd.Series) -> pd.Series:
    """A hash of 64 bits of an array of numbers; arrays of one length are hashed together."""
    sizes = values.map(lambda v: -1 if v is None else len(v)).to_numpy()
    out = pd.Series([None] * len(values), dtype="Int64")
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        rows = np.stack([np.asarray(values.iloc[i], dtype=np.int64) for i in at]).astype(np.uint64) if n else np.zeros((len(at), 0), np.uint64)
        out.iloc[at] = _mixed(rows, 0).view(np.int64)
    return out
