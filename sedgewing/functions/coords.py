"""Bins, ranges and range predicates over reference coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_bin(level: int) -> int:
    return ((1 << level * 3) - 1) // 7


def reg2bin(beg: Column, end: Column, min_shift: int = 14, depth: int = 5, widest: int = 0) -> Column:
    """The smallest bin of the hierarchy that holds [beg, end). With a ``widest`` level there are no bins above it: what fits in none goes
    to the one of that level in which it begins, and a search looks there as far back as the longest record reaches."""
    last = end - 1
    out = F.lit(_first_bin(widest)) + F.shiftright(beg.cast("long"), min_shift + 3 * (depth - widest)) if widest else F.lit(0).cast("long")
    for level in range(max(1, widest), depth + 1):
        shift = min_shift + 3 * (depth - level)
        a, b = F.shiftright(beg.cast("long"), shift), F.shiftright(last.cast("long"), shift)
        out = F.when(a == b, F.lit(_first_bin(level)) + a).otherwise(out)
    return out


def reg2bins(beg: Column, end: Column, min_shift: int = 14, depth: int = 5) -> Column:
    """All bins that overlap [beg, end); none if it is empty."""

    def of(level: int) -> Column:
        shift, first = min_shift + 3 * (depth - level), _first_bin(level)
        return F.sequence(F.shiftright(beg.cast("long"), shift) + first, F.shiftright((end - 1).cast("long"), shift) + first)

    return F.when(end > beg, F.flatten(F.array(*[of(level) for level in range(depth + 1)]))).otherwise(F.array().cast("array<bigint>"))


def record_bin(pos: Column, ref_length: Column, widest: int = 0) -> Column:
    """The bin of a record; without a position that of [-1, 0)."""
    end = pos + F.greatest(ref_length, F.lit(1))
    return F.when(pos < 0, reg2bin(F.lit(-1), F.lit(0))).otherwise(reg2bin(pos, end, widest=widest))


def parse_range(text: Column) -> Column:
    """(name, start, end) of ``name``, ``name:start`` or ``name:start-end``: one-based and inclusive in the text, with commas
    allowed, zero-based start here. The last colon cuts off the name; missing parts are null."""
    tail = F.regexp_extract(text, ":([0-9,]+(?:-[0-9,]+)?)$", 1)
    name = F.when(tail != "", F.regexp_replace(text, ":[0-9,]+(?:-[0-9,]+)?$", "")).otherwise(text)
    number = lambda k: F.regexp_replace(F.regexp_extract(tail, "^([0-9,]+)(?:-([0-9,]+))?$", k), ",", "").try_cast("long")
    return F.struct(name.alias("name"), (number(1) - 1).alias("start"), number(2).alias("end"))


def in_half_open(ref_end: Column, start: Column) -> Column:
    """A record of [pos, ref_end) lies in ``name:start``."""
    return ref_end > start


def in_interval(pos: Column, ref_end: Column, start: Column, end: Column) -> Column:
    """A record lies in ``name:start-end``; a record that begins at ``end`` still counts."""
    return (ref_end > start) & (pos <= end)


def coordinate_key(ref_id: Column, pos: Column) -> list[Column]:
    """Sort columns of coordinate order: records without a reference come last."""
    return [F.when(ref_id < 0, F.lit(2**32) + ref_id).otherwise(ref_id).cast("long"), pos]


def binning_index(records: DataFrame, ref_length: Column, min_shift: int = 14, depth: int = 5, widest: int = 0) -> DataFrame:
    """(ref_id, bin, n, first_pos, last_end): for each bin of the hierarchy the records that it is the smallest bin of."""
    stop = F.col("pos") + F.greatest(ref_length, F.lit(1))
    placed = records.select("ref_id", "pos", stop.cast("long").alias("_stop"), reg2bin(F.col("pos"), stop, min_shift, depth, widest).cast("int").alias("bin"))
    return placed.groupBy("ref_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("_stop").alias("last_end"))


def linear_index(records: DataFrame, ref_length: Column, shift: int = 14) -> DataFrame:
    """(ref_id, stretch, first_pos): the first record that reaches into each stretch of 2**shift positions."""
    last = F.col("pos") + F.greatest(ref_length, F.lit(1)) - 1
    each = records.select("ref_id", "pos", F.explode(F.sequence(F.shiftright(F.col("pos").cast("long"), shift), F.shiftright(last.cast("long"), shift))).alias("stretch"))
    return each.groupBy("ref_id", "stretch").agg(F.min("pos").alias("first_pos"))
