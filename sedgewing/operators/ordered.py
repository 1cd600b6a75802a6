"""Global order: running sums, ranks and positions over all rows without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewing.scratch import written


def running_sum(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """df with the sum of value up to and with each row in the given order, which must be unique.

    Rows are dealt into ranges; each range sums by itself, and a small table of the ranges' totals gives what lies before."""
    ranged = written(df.withColumn("_v", value).repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(F.sum("_v").alias("_t"))
    before = totals.select("_part", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row per range: as many as there are tasks
    return ranged.join(F.broadcast(before), "_part").withColumn(out, F.sum("_v").over(w) + F.col("_before")).drop("_v", "_part", "_before")


def numbered(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """df with 0-based positions in the given order."""
    return running_sum(df, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) - 1)


def exclusive_sums(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    return running_sum(df, order, F.col(value), out).withColumn(out, F.col(out) - F.col(value))


def at_positions(df: DataFrame, order: list[str], positions: list[int]) -> DataFrame:
    """The rows at the given positions of the order."""
    return numbered(df, order, "_rank").filter(F.col("_rank").isin(positions)).withColumnRenamed("_rank", "rank")


def every(df: DataFrame, order: list[str], step: int) -> DataFrame:
    """Every step-th row of the order, with its position: a sparse index."""
    return numbered(df, order, "rank").filter(F.col("rank") % step == 0)


def select_nth(df: DataFrame, order: list[str], flag: str, n: int) -> DataFrame:
    """The row with the n-th (0-based) set flag in the order."""
    return running_sum(df, order, F.col(flag).cast("long"), "_n").filter((F.col("_n") == n + 1) & F.col(flag)).drop("_n")


def is_sorted(df: DataFrame, stamp: str, keys: list[Column]) -> DataFrame:
    """One row: whether the keys never fall in the order of ``stamp``, and the number of rows that do. Ranges are looked at
    by themselves; then the last row of each is compared with the first of the next."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    ranged = written(df.select(F.col(stamp).alias("_s"), key.alias("_k")).repartitionByRange("_s").withColumn("_part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("_part").orderBy("_s")
    inner = ranged.withColumn("_p", F.lag("_k").over(w)).agg(F.count_if(F.col("_p") > F.col("_k")).alias("n"))
    ends = ranged.groupBy("_part").agg(F.min_by("_k", "_s").alias("_a"), F.max_by("_k", "_s").alias("_b"))
    seams = ends.withColumn("_p", F.lag("_b").over(Window.orderBy("_part"))).agg(F.count_if(F.col("_p") > F.col("_a")).alias("n"))
    return inner.unionByName(seams).agg(F.sum("n").cast("long").alias("falls")).select((F.col("falls") == 0).alias("is_sorted"), "falls")


def previous_set(df: DataFrame, order: str, flag: str, out: str = "prev", keys: list[str] | None = None) -> DataFrame:
    """df with the greatest flagged position up to each row."""
    w = Window.partitionBy(*(keys or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(F.col(flag), F.col(order)), ignorenulls=True).over(w))


def next_set(df: DataFrame, order: str, flag: str, out: str = "next", keys: list[str] | None = None) -> DataFrame:
    """df with the least flagged position from each row on."""
    w = Window.partitionBy(*(keys or [])).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.first(F.when(F.col(flag), F.col(order)), ignorenulls=True).over(w))


def window_minimum(df: DataFrame, keys: list[str], order: str, value: str, before: int, after: int, out: str = "least") -> DataFrame:
    """Range minimum over rows around each row of its key."""
    return df.withColumn(out, F.min(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)))


def peeked(df: DataFrame, keys: list[str], order: str, value: str, out: str = "peeked") -> DataFrame:
    """df with a value of the next row of its key."""
    return df.withColumn(out, F.lead(value).over(Window.partitionBy(*keys).orderBy(order)))


def run_lengths(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, value, first, last, n): runs of rows of one value that follow each other."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.select(*keys, order, value, new.alias("_new")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")
