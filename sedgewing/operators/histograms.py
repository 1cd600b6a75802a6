"""Histograms, their median rule, truncated prints, and N-statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewing.operators.ordered import running_sum


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def summary(hist: DataFrame) -> DataFrame:
    """One row: points, total, average and median of a histogram; the median is the first value whose cumulative count exceeds
    half of the points, rounded down."""
    cum = running_sum(hist.filter(F.col("value").isNotNull()), ["value"], F.col("n"), "cum")
    points = hist.filter(F.col("value").isNotNull()).agg(F.sum("n").alias("points"), F.sum(F.col("value") * F.col("n")).alias("total"))
    half = cum.join(F.broadcast(points)).filter(F.col("cum") > F.floor(F.col("points") / 2)).agg(F.min("value").alias("median"))
    return points.join(F.broadcast(half)).select("points", "total", (F.col("total") / F.col("points")).alias("average"), "median")


def head_fraction(hist: DataFrame, fraction: float) -> DataFrame:
    """(value, n, share): the values from the least on whose cumulative share is at most the fraction."""
    total = hist.agg(F.sum("n").alias("_all"))
    cum = running_sum(hist, ["value"], F.col("n"), "_cum").join(F.broadcast(total))
    return cum.withColumn("share", F.col("_cum") / F.col("_all")).filter(F.col("share") <= fraction).drop("_cum", "_all")


def merged(*histograms: DataFrame) -> DataFrame:
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy("value").agg(F.sum("n").alias("n"))


def n_statistic(df: DataFrame, order: list[str], length: str, part: int, whole: int) -> DataFrame:
    """One row (n, avg): the length at the position (whole - part) / whole of the total of all lengths in the given order, which is not
    changed here (order by the lengths for the usual statistic); the mean of two neighbours where the position falls between
    them; 0 for no or zero lengths."""
    cum = running_sum(df.select(*order, F.col(length).cast("long").alias("_len")), order, F.col("_len"), "_cum")
    total = df.agg(F.coalesce(F.sum(F.col(length).cast("long")), F.lit(0)).alias("_total"), F.count(F.lit(1)).alias("_rows"))
    cum = cum.join(F.broadcast(total))
    goal = F.col("_total") * (whole - part) / whole
    low, high = F.col("_cum") - F.col("_len"), F.col("_cum")
    hit = cum.filter((F.col("_len") > 0) & (low <= goal) & (goal <= high)).agg(F.avg("_len").alias("n"))
    return total.join(F.broadcast(hit)).select(F.coalesce("n", F.lit(0.0)).alias("n"), F.when(F.col("_rows") > 0, F.col("_total") / F.col("_rows")).otherwise(F.lit(0.0)).alias("avg"))


def degree_distribution(edges: DataFrame, node: str = "src") -> DataFrame:
    """(degree, n): how many nodes have so many edges."""
    return edges.groupBy(node).agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def read_group_counts(df: DataFrame, by: list[str], numbers: list[str]) -> DataFrame:
    """Sums of columns per group, as the statistics of alignments and read lengths are added up."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in numbers])
