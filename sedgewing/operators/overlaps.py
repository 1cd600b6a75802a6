"""Pairwise overlaps of reads (§ overlaps: aread, bread, inv, abpos, aepos, bbpos, bepos, diffs, trace), their checks and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["aread", "bread", "inv", "abpos", "aepos", "bbpos", "bepos"]


def order(full: bool = True) -> list[Column]:
    """Sort columns: reads, forward before inverse, start; the full order goes on with the other ends."""
    return [F.col(c) for c in (KEY if full else KEY[:4])]


def error_rate(diffs: Column, abpos: Column, aepos: Column) -> Column:
    return F.when(aepos > abpos, diffs / (aepos - abpos)).otherwise(F.lit(0.0))


def swapped(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """The overlaps seen from the other read; inverse ones are turned by the reads' lengths (read_id, rlen)."""
    length = reads.select("read_id", "rlen")
    both = overlaps.join(length.withColumnsRenamed({"read_id": "aread", "rlen": "_la"}), "aread").join(length.withColumnsRenamed({"read_id": "bread", "rlen": "_lb"}), "bread")
    turn = lambda a, b, n: F.when(F.col("inv"), F.col(n) - F.col(b)).otherwise(F.col(a))
    return both.select(
        F.col("bread").alias("aread"),
        F.col("aread").alias("bread"),
        "inv",
        turn("bbpos", "bepos", "_lb").alias("abpos"),
        F.when(F.col("inv"), F.col("_lb") - F.col("bbpos")).otherwise(F.col("bepos")).alias("aepos"),
        turn("abpos", "aepos", "_la").alias("bbpos"),
        F.when(F.col("inv"), F.col("_la") - F.col("abpos")).otherwise(F.col("aepos")).alias("bepos"),
        "diffs",
    )


def asymmetric(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """Overlaps whose swapped form is missing."""
    return overlaps.select(*KEY, "diffs").exceptAll(swapped(overlaps, reads).select(*KEY, "diffs"))


#: Rows whose keys one task puts together.
UNIQUE_ROWS = 1_000_000


def unique(overlaps: DataFrame) -> DataFrame:
    """One overlap of each key, that of the fewest differences. Rows are dealt by their keys to as many tasks as their number asks for, so
    that a task's memory stays what it is however long the table; rows of one key are one in memory."""
    tasks = max(overlaps.sparkSession.sparkContext.defaultParallelism, -(-overlaps.count() // UNIQUE_ROWS))
    rest = [c for c in overlaps.columns if c not in KEY]
    best = F.min("diffs").alias("diffs") if rest == ["diffs"] else F.min_by(F.struct(*rest), "diffs").alias("_r")
    out = overlaps.repartition(tasks, *KEY).groupBy(*KEY).agg(best)
    return out if rest == ["diffs"] else out.select(*KEY, "_r.*")


def of_reads(overlaps: DataFrame, low: int, high: int) -> DataFrame:
    """Overlaps of a reads in [low, high); a range over a sorted column prunes files and row groups."""
    return overlaps.filter((F.col("aread") >= low) & (F.col("aread") < high))


def proper(overlaps: DataFrame, reads: DataFrame, overhang: int = 0) -> DataFrame:
    """Overlaps that reach an end of either read on both sides, up to an overhang."""
    length = reads.select("read_id", "rlen")
    both = overlaps.join(length.withColumnsRenamed({"read_id": "aread", "rlen": "_la"}), "aread").join(length.withColumnsRenamed({"read_id": "bread", "rlen": "_lb"}), "bread")
    left = F.least("abpos", "bbpos") <= overhang
    right = F.least(F.col("_la") - F.col("aepos"), F.col("_lb") - F.col("bepos")) <= overhang
    return both.filter(left & right).drop("_la", "_lb")


def trace_points(overlaps: DataFrame, tspace: int) -> DataFrame:
    """(aread, bread, inv, block, apos, bpos): the borders of the blocks of ``tspace`` bases of a, with the place in b that the
    trace (err, blen per block) gives."""
    first = F.floor(F.col("abpos") / tspace).cast("int")
    ends = F.transform("trace", lambda t, i: F.struct(F.least((first + i + 1) * tspace, F.col("aepos")).alias("apos"), (F.col("bbpos") + F.aggregate(F.slice("trace", F.lit(1), i + 1), F.lit(0), lambda s, x: s + x["blen"])).alias("bpos")))
    points = F.concat(F.array(F.struct(F.col("abpos").alias("apos"), F.col("bbpos").alias("bpos"))), ends)
    return overlaps.select("aread", "bread", "inv", F.posexplode(points).alias("block", "_p")).select("aread", "bread", "inv", "block", "_p.apos", "_p.bpos")


def trace_fits(trace: Column, bbpos: Column, bepos: Column) -> Column:
    """Whether the blocks' lengths in b add up to its stretch."""
    return F.aggregate(trace, F.lit(0), lambda s, x: s + x["blen"]) == bepos - bbpos


def share_block(a: DataFrame, b: DataFrame, tspace: int) -> DataFrame:
    """Pairs of overlaps of the same reads that cover a whole block of a in common."""
    blocks = lambda d, n: d.select(*[F.col(c).alias(f"{c}{n}" if c not in ("aread", "bread") else c) for c in KEY], F.explode(F.sequence(F.ceil(F.col("abpos") / tspace), F.floor(F.col("aepos") / tspace) - 1)).alias("_block")).filter(F.col("_block") >= F.ceil(F.col(f"abpos{n}") / tspace))
    some = lambda d: d.filter(F.floor(F.col("aepos") / tspace) - 1 >= F.ceil(F.col("abpos") / tspace))
    return blocks(some(a), "1").join(blocks(some(b), "2"), ["aread", "bread", "_block"]).drop("_block").distinct()


def kept_reads(reads: DataFrame, cutoff: int | None, best_only: bool, best_bit: int = 1024) -> DataFrame:
    """The reads of a trimmed view, numbered anew (trimmed_id) in the order of read_id."""
    from sedgewing.operators.ordered import numbered

    keep = F.lit(True)
    if best_only:
        keep = keep & (F.col("flags").bitwiseAND(best_bit) != 0)
    if cutoff is not None:
        keep = keep & (F.col("rlen") >= cutoff)
    return numbered(reads.filter(keep), ["read_id"], "trimmed_id")


def files_of_range(index: DataFrame, low: int, high: int) -> DataFrame:
    """Files (file, first, last) whose reads [first, last) meet [low, high)."""
    return index.filter((F.col("first") < high) & (F.col("last") > low))


def true_to_reference(overlaps: DataFrame, mapped: DataFrame) -> DataFrame:
    """overlaps with ``truth``: whether the places of both reads on a reference (read_id, ref, start, stop) meet; overlaps of reads
    without a place are left out."""
    side = lambda k: mapped.select(F.col("read_id").alias(f"{k}read"), F.col("ref").alias(f"_r{k}"), F.col("start").alias(f"_s{k}"), F.col("stop").alias(f"_e{k}"))
    both = overlaps.join(side("a"), "aread").join(side("b"), "bread")
    meet = (F.col("_ra") == F.col("_rb")) & (F.col("_sa") < F.col("_eb")) & (F.col("_sb") < F.col("_ea"))
    return both.withColumn("truth", meet).drop(*[f"_{c}{k}" for c in "rse" for k in "ab"])


def as_records(overlaps: DataFrame) -> DataFrame:
    """Alignment records of b reads on a reads as references: name, flags, ref_id, pos, cigar."""
    return overlaps.select(F.concat(F.lit("b"), "bread").alias("name"), F.when(F.col("inv"), 16).otherwise(0).alias("flags"), F.col("aread").alias("ref_id"), F.col("abpos").alias("pos"), F.concat(F.col("aepos") - F.col("abpos"), F.lit("M")).alias("cigar"))
