"""Random draws that a key and a seed decide, so that they are the same on every machine and after every retry; read noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """A number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def normal(mean: float, deviation: float, *keys: Column) -> Column:
    u, v = uniform(*keys, F.lit(1)), uniform(*keys, F.lit(2))
    return F.lit(mean) + F.lit(deviation) * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def log_normal(mean: float, deviation: float, *keys: Column) -> Column:
    return F.exp(normal(mean, deviation, *keys))


def poisson(rate: float, *keys: Column, most: int | None = None) -> Column:
    """By the inverse of the distribution, up to ``most`` (by default ten deviations above the rate)."""
    most = most or int(rate + 10 * math.sqrt(rate) + 10)
    u = uniform(*keys)
    state = F.struct(F.lit(0).alias("k"), F.lit(math.exp(-rate)).alias("p"), F.lit(math.exp(-rate)).alias("sum"), F.lit(False).alias("done"))

    def step(s: Column, i: Column) -> Column:
        done = s["done"] | (u < s["sum"])
        p = s["p"] * rate / i
        return F.when(done, F.struct(s["k"], s["p"], s["sum"], F.lit(True).alias("done"))).otherwise(F.struct(i.alias("k"), p.alias("p"), (s["sum"] + p).alias("sum"), F.lit(False).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, step, lambda s: s["k"])


def subsample(df: DataFrame, key: str, keep: int, of: int, seed: int = 0) -> DataFrame:
    """Rows whose key draws one of ``keep`` out of ``of``; rows of one key stay together, as the reads of a pair do."""
    if of <= 0 or keep > of:
        raise ValueError("keep and of must be 0 <= keep <= of, of > 0")
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(of)) < keep)


def noisy(df: DataFrame, key: str, seq: str, substitution: float, insertion: float, deletion: float, seed: int = 0, out: str = "noisy") -> DataFrame:
    """df with a copy of the sequence in which each base may be replaced, doubled by another base before it, or left out. Bursts are had by
    giving rates as functions of the key and calling it by parts."""
    letters = F.filter(F.split(F.col(seq), ""), lambda c: c != "")

    def base(c: Column, i: Column) -> Column:
        u = uniform(F.col(key), i, F.lit(seed))
        other = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.pmod(F.call_function("instr", F.lit("ACGT"), c) + F.pmod(F.xxhash64(F.col(key), i, F.lit(seed + 1)), F.lit(3)), F.lit(4)) + 1).cast("int"))
        return F.when(u < substitution, other).when(u < substitution + insertion, F.concat(other, c)).when(u < substitution + insertion + deletion, F.lit("")).otherwise(c)

    return df.withColumn(out, F.array_join(F.transform(letters, base), ""))


def by_digest(df: DataFrame, key: str, share: int) -> DataFrame:
    """Rows whose key's MD5 begins with a byte below ``share`` of 256; the same rows everywhere."""
    return df.filter(F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 2), 16, 10).cast("int") < share)
