"""As-of lookups: the nearest smaller or greater key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, stretch: int | None = None, strict: bool = False, direction: str = "backward", out: str | None = None) -> DataFrame:
    """left with the ``value`` of the right row of its keys whose ``at`` is the greatest up to (or, strict, below) its own; forward: the least from
    its own on.

    With ``stretch`` (at being a number) both sides are dealt by key and stretch of ``at``; a second, small window over one row per stretch carries
    values on, so that one key with very many rows is shared by many tasks."""
    out, back = out or value, direction == "backward"
    cols = left.columns
    l = left.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), *keys, F.col(at).alias("_at"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(0 if strict == back else 1).alias("_side"))  # noqa: E741
    r = right.select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), *keys, F.col(at).alias("_at"), F.col(value).alias("_v"), F.lit(1 if strict == back else 0).alias("_side"))
    if not back:
        l, r = l.withColumn("_side", F.lit(1 if strict else 0)), r.withColumn("_side", F.lit(0 if strict else 1))  # noqa: E741
    both = l.unionByName(r.filter(F.col("_v").isNotNull()))
    order = [F.col("_at"), F.col("_side")]
    pick = F.last if back else F.first
    frame = (Window.unboundedPreceding, 0) if back else (0, Window.unboundedFollowing)
    if stretch is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        found = both.withColumn("_f", pick("_v", ignorenulls=True).over(w))
    else:
        both = both.withColumn("_s", F.floor(F.col("_at") / stretch).cast("long"))
        w = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(*frame)
        edge = F.max_by if back else F.min_by
        ends = both.groupBy(*keys, "_s").agg(edge("_v", F.when(F.col("_v").isNotNull(), F.struct("_at", "_side"))).alias("_e"))
        carry = Window.partitionBy(*keys).orderBy("_s").rowsBetween(*((Window.unboundedPreceding, -1) if back else (1, Window.unboundedFollowing)))
        ends = ends.withColumn("_c", pick("_e", ignorenulls=True).over(carry)).drop("_e")
        found = both.withColumn("_f", pick("_v", ignorenulls=True).over(w)).join(ends, [*keys, "_s"]).withColumn("_f", F.coalesce("_f", "_c"))
    return found.filter(F.col("_row").isNotNull()).select("_row.*", F.col("_f").alias(out))


def largest_smaller(queries: DataFrame, index: DataFrame, key: str, out: str = "found", stretch: int | None = None) -> DataFrame:
    """queries with the largest key of the index that is strictly smaller; where none is, the index's least key. Keys are dealt by
    stretches of numbers, by default a few for each task."""
    if stretch is None:
        low, high = index.agg(F.min(key), F.max(key)).first()
        tasks = 4 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        stretch = max(1, int(((high or 0) - (low or 0)) // tasks) + 1)
    one = queries.withColumn("_k", F.lit(0))
    keys = index.select(F.lit(0).alias("_k"), key, F.col(key).alias("_v"))
    found = asof_join(one, keys, ["_k"], key, "_v", stretch, strict=True, out=out)
    least = index.agg(F.min(key).alias("_least"))
    return found.join(F.broadcast(least)).withColumn(out, F.coalesce(out, "_least")).drop("_k", "_least")
