"""Joins of rows with the one row of their key, where few keys hold most rows; small tables whose rows cost much."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewing.scratch import written

#: A key is hot if it holds more than 1/HOT_SHARE of all rows and HOT_LEAST rows, so that there are HOT_SHARE hot keys at most.
HOT_SHARE, HOT_LEAST = 1024, 100_000


def with_key_rows(rows: DataFrame, found: DataFrame, keys: list[str], count: str, least: int = HOT_LEAST) -> DataFrame:
    """Inner join of rows with found, one row per key with the number of its rows in ``count`` (dropped). Rows of hot keys are not
    shuffled: what was found of those keys, HOT_SHARE rows at most, is broadcast."""
    found = written(found, "key-rows")
    total = found.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    bound = max(least, total // HOT_SHARE)
    hot = found.filter(F.col(count) > bound).drop(count)
    cold = found.filter(F.col(count) <= bound).drop(count)
    if total <= least or hot.isEmpty():
        return rows.join(cold, keys)
    some = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return some.unionByName(rest.join(cold, keys))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores by its keys, for rows of few bytes that cost much each: one file of them would be one task. The number of
    partitions is given, or small ones would be put together again."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
