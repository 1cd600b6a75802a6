"""Filters and rewrites that a caller puts together: predicates over rows, sets of read groups, replaced fields, sets of duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_read_groups(df: DataFrame, groups: DataFrame, col: str) -> DataFrame:
    """df with ``_pass``: whether the row's read group is among the groups; rows without one are not. The groups come from a header."""
    some = groups.select(F.col(groups.columns[0]).alias(col)).distinct().withColumn("_in", F.lit(True))
    return df.join(some, col, "left").withColumn("_pass", F.coalesce("_in", F.lit(False))).drop("_in")


def marked(df: DataFrame, *tests: Callable[[DataFrame], DataFrame | Column]) -> DataFrame:
    """df with ``passes``: whether all tests hold. A test gives a condition, or the rows with one in ``_pass``."""
    out = df.withColumn("passes", F.lit(True))
    for test in tests:
        found = test(out)
        if isinstance(found, DataFrame):
            out = found.withColumn("passes", F.col("passes") & F.col("_pass")).drop("_pass")
        else:
            out = out.withColumn("passes", F.col("passes") & F.coalesce(found, F.lit(False)))
    return out


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows that pass, those that were removed)."""
    return df.filter("passes").drop("passes"), df.filter("NOT passes").drop("passes")


def replaced(records: DataFrame, **fields: Column) -> DataFrame:
    """records with fields replaced, and ``error``: the field that does not fit the bases, else null."""
    from sedgewing.functions import cigar as C

    out = records.withColumns(fields)
    bases = F.when(F.col("seq") == "*", 0).otherwise(F.length("seq"))
    size = C.read_length(C.parse(F.col("cigar")))
    error = F.when((F.col("qual") != "*") & (F.length("qual") != bases), "qual").when((F.col("cigar") != "*") & (bases > 0) & (size != bases), "cigar")
    return out.withColumn("error", error.when(~F.col("name").rlike("^[!-?A-~]{1,254}$"), "name"))


def per_set(df: DataFrame, keys: list[str], *found: Column) -> DataFrame:
    """(keys, members, found): aggregates over each set of two rows or more of one key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), *found).filter("members > 1")
