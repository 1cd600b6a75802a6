"""Numbers: bits, roots, parsing, units, binomial and Poisson weights."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def gcd_steps(a: Column, b: Column) -> Column:
    """A number for each of Euclid's steps: five a digit of the smaller number are enough, and one that exchanges both."""
    return F.sequence(F.lit(1), 5 * F.length(F.least(a, b).cast("string")) + 1)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, by Euclid's steps over 64-bit numbers."""
    x, y = F.abs(a.cast("long")), F.abs(b.cast("long"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b")))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(gcd_steps(x, y), F.struct(x.alias("a"), y.alias("b")), step, lambda s: s["a"]))


def isqrt(n: Column) -> Column:
    """The largest r with r * r <= n, also where the double is off by one."""
    r = F.floor(F.sqrt(n.cast("double"))).cast("long")
    return F.when(r * r > n, r - 1).when((r + 1) * (r + 1) <= n, r + 1).otherwise(r)


def bit_length(n: Column) -> Column:
    return F.when(n == 0, F.lit(0)).otherwise(F.length(F.bin(n)))


def ilog2(n: Column) -> Column:
    return bit_length(n) - 1


def popcount(n: Column) -> Column:
    return F.bit_count(n)


def parse_decimal(text: Column) -> Column:
    """The unsigned number of a text of digits; null where it is none or beyond 64 bits."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("decimal(38,0)").try_cast("long"))


def unit_number(text: Column) -> Column:
    """``12k``, ``3m``, ``1g``: powers of 1024."""
    factor = F.create_map(*[F.lit(x) for k, s in enumerate(("", "k", "m", "g", "t")) for x in (s, 1 << 10 * k)])
    return F.regexp_extract(text, "^([0-9]+)([kmgtKMGT]?)$", 1).try_cast("long") * F.try_element_at(factor, F.lower(F.regexp_extract(text, "^([0-9]+)([kmgtKMGT]?)$", 2))).cast("long")


def bloom_bits(n: Column, p: float) -> Column:
    """Bits of a Bloom filter for n keys at false-positive rate p: a power of 2."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(-n * math.log(p) / math.log(2) ** 2))).cast("long")


def bloom_hashes(m: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.round(m * math.log(2) / n)).cast("int")


def _joined(high: Column, low: Column) -> Column:
    """high times 2**32 and low, modulo 2**64."""
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(low.bitwiseAND(F.lit((1 << 32) - 1)))


def wrapped_sum(*terms: Column) -> Column:
    """The sum of 64-bit numbers modulo 2**64, in two's complement: in halves of 32 bits, as + stops at an overflow."""
    high, low = [F.shiftright(t.cast("long"), 32) for t in terms], [t.cast("long").bitwiseAND(F.lit((1 << 32) - 1)) for t in terms]
    return _joined(reduce(add, high), reduce(add, low))


def wrapped_times(n: Column, factor: int) -> Column:
    """A 64-bit number times a factor of 0 to 2**31 - 1, modulo 2**64, in two's complement."""
    n = n.cast("long")
    return _joined(F.shiftright(n, 32) * factor, n.bitwiseAND(F.lit((1 << 32) - 1)) * factor)


@pandas_udf(T.DoubleType())
def binomial_upper(p: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
    """P(X >= k) for n draws of probability p."""

    def tail(p: float, k: int, n: int) -> float:
        return float(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(max(0, k), n + 1)))

    return pd.Series([tail(float(a), int(b), int(c)) for a, b, c in zip(p, k, n, strict=True)])


@pandas_udf(T.DoubleType())
def poisson_pmf(lam: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([math.exp(-a + b * math.log(a) - math.lgamma(b + 1)) if a > 0 else float(b == 0) for a, b in zip(lam.astype(float), k.astype(int), strict=True)])
