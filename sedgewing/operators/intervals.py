"""Intervals: merging, difference, stabbing and range joins.

Closed intervals [from, to]; from > to is empty and ignored. Columns are ``start`` and ``stop``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("stop").over(w)
    new = F.when(seen.isNull() | (seen + gap < F.col("start")), 1).otherwise(0)
    marked = df.withColumn("_new", new)
    run = Window.partitionBy(*keys).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_island", F.sum("_new").over(run)).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def merged(df: DataFrame, keys: list[str], gap: int = 0, width: int | None = None) -> DataFrame:
    """Maximal unions per key. gap 0 joins intervals that share a point, 1 those that touch, more those that lie so near.

    Intervals are merged per key and stretch of ``width`` positions first (by default 1/256 of all that are reached), so that one key's
    rows are reduced by many tasks before they meet."""
    rows = df.filter("start <= stop").select(*keys, "start", "stop")
    if not width:
        low, high = rows.agg(F.min("start"), F.max("stop")).first()
        width = max(1, int(((high or 0) - (low or 0)) // 256))
    rows = _islands(rows.withColumn("_stretch", F.floor(F.col("start") / width)), [*keys, "_stretch"], gap).drop("_stretch")
    return _islands(rows, keys, gap)


#: Bins that one interval takes at its level; a longer one goes to a level of bins so many times as wide.
MOST_BINS = 64


def _level(width: int) -> Column:
    """0 for intervals of up to MOST_BINS bins, 1 for those of up to MOST_BINS as many, and so on."""
    bins = (F.col("stop") - F.col("start")) / F.lit(width) / F.lit(MOST_BINS)
    return F.when(bins < 1, F.lit(0)).otherwise((F.floor(F.log(float(MOST_BINS), bins)) + 1).cast("int"))


def _highest(width: int, *sides: DataFrame) -> int:
    """The highest level of any interval; a few at most."""
    return max(d.filter("start <= stop").agg(F.coalesce(F.max(_level(width)), F.lit(0))).first()[0] for d in sides)


def _binned(df: DataFrame, width: int, highest: int) -> DataFrame:
    """df with ``_level`` and ``_bin``, a row for each bin that an interval reaches at its own level and at those above it, up to the
    highest: MOST_BINS + 1 rows and two for each further level, however long it is. _own is the interval's level, _first its first
    bin at ``_level``."""
    own = df.filter("start <= stop").withColumn("_own", _level(width) if highest else F.lit(0))
    own = own.withColumn("_level", F.explode(F.sequence(F.col("_own"), F.lit(highest)))) if highest else own.withColumn("_level", F.lit(0))
    size = F.lit(width) * F.pow(F.lit(MOST_BINS), F.col("_level")) if highest else F.lit(width)
    first, last = F.floor(F.col("start") / size).cast("long"), F.floor(F.col("stop") / size).cast("long")
    return own.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def range_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """All pairs of intervals that share a point; columns of b get the suffix _b. Both sides are cut into bins and joined on
    them; a pair is taken at the level of the longer one, in the first bin that both reach, so none comes twice."""
    b = b.select(*keys, *[F.col(c).alias(f"{c}_b" if c not in keys else c) for c in b.columns if c not in keys])
    plain = b.withColumnsRenamed({"start_b": "start", "stop_b": "stop"})
    highest = _highest(width, a, plain)
    right = _binned(plain, width, highest).withColumnsRenamed({"start": "start_b", "stop": "stop_b", "_first": "_first_b", "_own": "_own_b"})
    on = (F.col("start") <= F.col("stop_b")) & (F.col("start_b") <= F.col("stop")) & (F.col("_bin") == F.greatest("_first", "_first_b")) & (F.col("_level") == F.greatest("_own", "_own_b"))
    joined = _binned(a, width, highest).join(right, [*keys, "_level", "_bin"]).filter(on).drop("_bin", "_level", "_first", "_first_b", "_own", "_own_b")
    if how == "inner":
        return joined
    if how == "left_semi":
        return joined.select(*a.columns).distinct()
    raise ValueError(how)


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, width: int) -> DataFrame:
    """points with the number of intervals that hold them."""
    highest = _highest(width, intervals)
    bins = _binned(intervals, width, highest).filter("_level = _own").select(*keys, "_level", "_bin", "start", "stop")
    each = points.select(*keys, point).distinct().withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(highest))))
    each = each.withColumn("_bin", F.floor(F.col(point) / (F.lit(width) * F.pow(F.lit(MOST_BINS), F.col("_level")))).cast("long"))
    inside = F.count_if((F.col("start") <= F.col(point)) & (F.col(point) <= F.col("stop"))).alias("hits")
    cells = each.join(bins, [*keys, "_level", "_bin"]).groupBy(*keys, point).agg(inside)
    return points.join(cells, [*keys, point], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))


def difference(a: DataFrame, b: DataFrame, keys: list[str], id_col: str, width: int) -> DataFrame:
    """What is left of each interval of a without those of b: (id, start, stop) of the pieces."""
    cuts = range_join(a, merged(b, keys, 1), keys, width).groupBy(*keys, id_col, "start", "stop").agg(F.array_sort(F.collect_list(F.struct("start_b", "stop_b"))).alias("_cuts"))
    whole = a.filter("start <= stop").join(cuts.select(id_col, "_cuts"), id_col, "left")
    none = F.array().cast("array<struct<start_b:bigint,stop_b:bigint>>")
    found = F.coalesce(F.col("_cuts").cast("array<struct<start_b:bigint,stop_b:bigint>>"), none)
    lows = F.concat(F.array(F.col("start").cast("long")), F.transform(found, lambda x: x["stop_b"] + 1))
    highs = F.concat(F.transform(found, lambda x: x["start_b"] - 1), F.array(F.col("stop").cast("long")))
    pieces = F.filter(F.zip_with(lows, highs, lambda lo, hi: F.struct(lo.alias("start"), hi.alias("stop"))), lambda p: p["start"] <= p["stop"])
    return whole.select(*keys, id_col, F.explode(pieces).alias("_p")).select(*keys, id_col, "_p.start", "_p.stop")


def intersection(a: Column, b: Column) -> Column:
    """(from, to) of two closed intervals; empty where from > to."""
    return F.struct(F.greatest(a["from"], b["from"]).alias("from"), F.least(a["to"], b["to"]).alias("to"))


def span(a: Column, b: Column) -> Column:
    empty_a, empty_b = a["from"] > a["to"], b["from"] > b["to"]
    both = F.struct(F.least(a["from"], b["from"]).alias("from"), F.greatest(a["to"], b["to"]).alias("to"))
    return F.when(empty_a, b).when(empty_b, a).otherwise(both)


def contains(a: Column, b: Column) -> Column:
    return (b["from"] > b["to"]) | (a["from"] <= b["from"]) & (b["to"] <= a["to"])


def hausdorff(a: Column, b: Column) -> Column:
    """The largest distance of an end of one interval to the other's."""
    return F.greatest(F.abs(a["from"] - b["from"]), F.abs(a["to"] - b["to"]))


def leaf_of(points: DataFrame, borders: list[int], point: str, out: str = "leaf") -> DataFrame:
    """points with the number of the consecutive interval [borders[i], borders[i+1]) that holds them; values outside count to
    the first or last. The borders are a parameter, so the lookup is an expression."""
    inner = borders[1:-1]
    leaf = F.lit(0)
    for x in inner:
        leaf = leaf + (F.col(point) >= x).cast("int")
    return points.withColumn(out, leaf)
