"""Duplicate marking: keys of read ends, the best row of each key, optical copies, metrics of libraries.

The best row of a key is found by a partial aggregate, so no key's rows meet in one task before they are reduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewing.functions import cigar as C
from sedgewing.functions import flags as G
from sedgewing.operators.skew import with_key_rows

PAIR_KEY = ["lib", "tag", "ref1", "coord1", "orient", "ref2", "coord2"]
FRAGMENT_KEY = ["lib", "tag", "ref1", "coord1", "orient"]


def _best_first(score: str, order: list[str]) -> Column:
    """Greatest for the highest score, and the least in order of those."""
    return F.struct(F.col(score), *[-F.col(c) for c in order])


def mark_best(df: DataFrame, keys: list[str], score: str, tie: str, order: list[str] | None = None) -> DataFrame:
    """df with ``is_dup``: false for the row of the highest score, ties going to the smallest ``tie``, or the first in ``order`` where
    columns give another."""
    best = df.groupBy(*keys).agg(F.max_by(F.col(tie), _best_first(score, order or [tie])).alias("_best"), F.count(F.lit(1)).alias("_n"))
    return with_key_rows(df, best, keys, "_n").withColumn("is_dup", F.col(tie) != F.col("_best")).drop("_best")


def mark_pairs(pairs: DataFrame, score: str = "score", index: str = "idx1", keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Pairs of one key: the best score stays, ties to the first read's smallest index; each duplicate counts for two reads."""
    return mark_best(pairs, keys or PAIR_KEY, score, index, order)


def mark_fragments(ends: DataFrame, is_pair: str = "is_pair", score: str = "score", index: str = "idx1", keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Ends of one key: where a pair's end is among them all fragments are duplicates; among fragments alone the first of the
    highest score stays; ends of pairs are never marked."""
    keys = keys or FRAGMENT_KEY
    fragment = ~F.col(is_pair)
    state = ends.groupBy(*keys).agg(F.max(is_pair).alias("_paired"), F.max_by(F.when(fragment, F.col(index)), F.when(fragment, _best_first(score, order or [index]))).alias("_best"), F.count(F.lit(1)).alias("_n"))
    return with_key_rows(ends, state, keys, "_n").withColumn("is_dup", fragment & (F.col("_paired") | (F.col(index) != F.col("_best")))).drop("_paired", "_best")


def mark_optical(pairs: DataFrame, distance: int = 100, keys: list[str] | None = None, index: str = "idx1") -> DataFrame:
    """Pairs with ``is_optical``: whether a pair of the same key, read group and tile (0 is none) lies within ``distance`` in x
    and y and has a smaller index. Pairs are compared by cells of that size, so that only near ones meet."""
    keys = [*(keys or PAIR_KEY), "rg", "tile"]
    cell = lambda c: F.floor(F.col(c) / F.lit(distance + 1)).cast("long")
    some = pairs.filter(F.col("tile") != 0)
    placed = some.select(*keys, F.col(index).alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = placed.select(*keys, F.col("_i").alias("_j"), F.col("_x").alias("_xj"), F.col("_y").alias("_yj"), F.col("_cx").alias("_bx"), F.col("_cy").alias("_by"), F.explode(around).alias("_n"))
    other = other.withColumn("_cx", F.col("_bx") + F.col("_n.a")).withColumn("_cy", F.col("_by") + F.col("_n.b")).drop("_n", "_bx", "_by")
    near = (F.abs(F.col("_x") - F.col("_xj")) <= distance) & (F.abs(F.col("_y") - F.col("_yj")) <= distance) & (F.col("_j") < F.col("_i"))
    hit = placed.join(other, [*keys, "_cx", "_cy"]).filter(near).select(F.col("_i").alias(index)).distinct().withColumn("is_optical", F.lit(True))
    return pairs.join(hit, index, "left").withColumn("is_optical", F.coalesce("is_optical", F.lit(False)))


def read_ends(records: DataFrame) -> DataFrame:
    """Keys of single ends from alignment records (lib, tag, ref_id, pos, cigar, flags, score, rank)."""
    reverse = G.has(F.col("flags"), "REVERSE")
    return records.withColumns(
        {
            "ref1": F.col("ref_id").cast("long") + 1,
            "coord1": C.five_prime(F.col("pos"), F.col("cigar"), reverse) + 1,
            "orient": F.when(reverse, "R").otherwise("F"),
            "idx1": F.col("rank"),
            "is_pair": G.has(F.col("flags"), "PAIRED") & ~G.has(F.col("flags"), "MUNMAP"),
        }
    )


def pair_ends(pairs: DataFrame) -> DataFrame:
    """Keys of pairs from columns of both reads (suffix 1 and 2): ordered by reference and 5' coordinate; the score is the sum."""

    def side(k: int) -> Column:
        reverse = G.has(F.col(f"flags{k}"), "REVERSE")
        return F.struct(F.col(f"ref_id{k}").cast("long").alias("ref"), C.five_prime(F.col(f"pos{k}"), F.col(f"cigar{k}"), reverse).alias("coord"), F.col(f"rank{k}").alias("rank"), F.col(f"flags{k}").alias("flags"))

    a, b = side(1), side(2)
    first = F.when(F.struct(a["ref"], a["coord"], a["rank"]) <= F.struct(b["ref"], b["coord"], b["rank"]), a).otherwise(b)
    second = F.when(F.struct(a["ref"], a["coord"], a["rank"]) <= F.struct(b["ref"], b["coord"], b["rank"]), b).otherwise(a)
    out = pairs.withColumn("_a", first).withColumn("_b", second)
    return out.withColumns(
        {
            "ref1": F.col("_a.ref") + 1,
            "coord1": F.col("_a.coord") + 1,
            "ref2": F.col("_b.ref") + 1,
            "coord2": F.col("_b.coord") + 1,
            "orient": G.pair_orientation(F.col("_a.flags"), F.col("_b.flags")),
            "idx1": F.col("_a.rank"),
            "idx2": F.col("_b.rank"),
            "score": F.col("score1") + F.col("score2"),
        }
    ).drop("_a", "_b")


def percent_duplication(unpaired: Column, pairs: Column, unpaired_dup: Column, pair_dup: Column) -> Column:
    all_reads = unpaired + 2 * pairs
    return F.when(all_reads > 0, (unpaired_dup + 2 * pair_dup) / all_reads).otherwise(F.lit(0.0))


def library_size(pairs: Column, unique: Column, steps: int = 40) -> Column:
    """The number of molecules of a library by the equation of Lander and Waterman, c / x = 1 - exp(-n / x): bisection with a
    fixed number of steps. -1 where no pair is a duplicate, null where there is none at all."""
    n, c = pairs.cast("double"), unique.cast("double")
    over = lambda x: c / x - 1 + F.exp(-n / x)
    ten = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(100.0), lambda m, _: F.when(over(m * c) > 0, m * 10).otherwise(m))
    start = F.struct(F.lit(1.0).alias("low"), ten.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        up = over(mid * c) > 0
        return F.struct(F.when(up, mid).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(mid).alias("high"))

    size = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: F.floor(c * (s["low"] + s["high"]) / 2).cast("long"))
    return F.when(pairs <= unique, F.lit(-1).cast("long")).when(unique > 0, size)


def return_on_investment(size: Column, x: Column, pairs: Column, unique: Column) -> Column:
    """How many times more unique pairs x times the sequencing would give."""
    return size * (1 - F.exp(-(x * pairs) / size)) / unique


def metrics(marked: DataFrame, library: str = "lib") -> DataFrame:
    """Counts per library from rows (is_pair, is_dup, is_optical, is_unmapped)."""
    count = lambda c: F.count_if(c).cast("long")
    pair, dup = F.col("is_pair"), F.col("is_dup")
    out = marked.groupBy(library).agg(
        count(F.col("is_unmapped")).alias("unmapped"),
        count(~pair & ~F.col("is_unmapped")).alias("unpaired"),
        count(pair).alias("pairs"),
        count(~pair & dup).alias("unpaired_dup"),
        count(pair & dup).alias("pair_dup"),
        count(pair & F.col("is_optical")).alias("optical"),
    )
    return out.withColumn("percent", percent_duplication(F.col("unpaired"), F.col("pairs"), F.col("unpaired_dup"), F.col("pair_dup"))).withColumn(
        "library_size", library_size(F.col("pairs") - F.col("optical"), F.col("pairs") - F.col("pair_dup"))
    )


def roi_histogram(metric: DataFrame, upto: int = 100) -> DataFrame:
    """(…, x, roi) for x = 1 .. upto of each row of metrics with a library size."""
    rows = metric.filter("library_size > 0").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(upto))))
    return rows.withColumn("roi", return_on_investment(F.col("library_size"), F.col("x"), F.col("pairs") - F.col("optical"), F.col("pairs") - F.col("pair_dup")))
