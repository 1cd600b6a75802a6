"""CIGAR arrays (``array<struct<len:int,op:string>>``) as columns: lengths, clips, coordinates, traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: operations by what they consume
READ_OPS = ("M", "I", "S", "=", "X")
REFERENCE_OPS = ("M", "D", "N", "=", "X")
MATCH_OPS = ("M", "=", "X")
TRACE_OPS = ("I", "D", "=", "X")
TYPE = "array<struct<len:int,op:string>>"


def parse(text: Column) -> Column:
    """Elements of a CIGAR text; ``*`` and empty text give none."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def to_text(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def length_of(cigar: Column, ops: tuple[str, ...]) -> Column:
    """Bases of the given operations."""
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def read_length(cigar: Column) -> Column:
    return length_of(cigar, READ_OPS)


def reference_length(cigar: Column) -> Column:
    return length_of(cigar, REFERENCE_OPS)


def leading(cigar: Column, through: tuple[str, ...], weights: dict[str, int]) -> Column:
    """Weighted bases of the elements before the first whose operation is not in ``through``."""
    def step(a: Column, x: Column) -> Column:
        open_ = a["open"] & x["op"].isin(*through)
        w = F.lit(0)
        for op, k in weights.items():
            w = F.when(x["op"] == op, F.lit(k)).otherwise(w)
        return F.struct(open_.alias("open"), (a["n"] + F.when(open_, w * x["len"]).otherwise(F.lit(0))).alias("n"))

    return F.aggregate(cigar, F.struct(F.lit(True).alias("open"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])


BEFORE_MATCH = ("I", "D", "N", "S", "H", "P")


def front_clip(cigar: Column) -> Column:
    return leading(cigar, ("S", "H"), {"S": 1, "H": 1})


def back_clip(cigar: Column) -> Column:
    return front_clip(F.reverse(cigar))


def front_soft_clip(cigar: Column) -> Column:
    return leading(cigar, ("S", "H"), {"S": 1})


def back_soft_clip(cigar: Column) -> Column:
    return front_soft_clip(F.reverse(cigar))


def front_hard_clip(cigar: Column) -> Column:
    return leading(cigar, ("S", "H"), {"H": 1})


def back_hard_clip(cigar: Column) -> Column:
    return front_hard_clip(F.reverse(cigar))


def front_deletion(cigar: Column) -> Column:
    """Bases of D before the first match."""
    return leading(cigar, BEFORE_MATCH, {"D": 1})


def offset_before_match(cigar: Column) -> Column:
    """Insertions less deletions and skips before the first match."""
    return leading(cigar, BEFORE_MATCH, {"I": 1, "D": -1, "N": -1})


def reference_advance(cigar: Column) -> Column:
    """Bases of the reference from the first match on."""
    return reference_length(cigar) - leading(cigar, BEFORE_MATCH, {"D": 1, "N": 1})


def measures(cigar: Column) -> Column:
    """All lengths and clips of a CIGAR in one pass: read, reference, front_soft, front_hard, back_soft, back_hard, before_match (insertions
    less deletions and skips) and before_advance (deletions and skips before the first match)."""
    names = ("read", "reference", "front_soft", "front_hard", "back_soft", "back_hard", "before_match", "before_advance")
    zero = F.lit(0).cast("long")

    def step(s: Column, x: Column) -> Column:
        op, n = x["op"], x["len"]
        clip = op.isin("S", "H")
        front, open_ = s["front"] & clip, s["open"] & op.isin(*BEFORE_MATCH)
        add = lambda name, when: (s[name] + F.when(when, n).otherwise(F.lit(0))).alias(name)
        back = lambda name, letter: F.when(clip, s[name] + F.when(op == letter, n).otherwise(F.lit(0))).otherwise(zero).alias(name)
        before = F.when(open_, F.when(op == "I", n).when(op.isin("D", "N"), -n).otherwise(F.lit(0))).otherwise(F.lit(0))
        return F.struct(
            add("read", op.isin(*READ_OPS)), add("reference", op.isin(*REFERENCE_OPS)), add("front_soft", front & (op == "S")), add("front_hard", front & (op == "H")),
            back("back_soft", "S"), back("back_hard", "H"), (s["before_match"] + before).alias("before_match"), add("before_advance", open_ & op.isin("D", "N")), front.alias("front"), open_.alias("open"),
        )

    start = F.struct(*[zero.alias(n) for n in names], F.lit(True).alias("front"), F.lit(True).alias("open"))
    return F.aggregate(cigar, start, step, lambda s: F.struct(*[s[n].alias(n) for n in names]))


def alignment_end(pos: Column, cigar: Column) -> Column:
    return pos + reference_length(cigar) - 1


def unclipped_start(pos: Column, cigar: Column) -> Column:
    return pos - front_clip(cigar)


def unclipped_end(pos: Column, cigar: Column) -> Column:
    return alignment_end(pos, cigar) + back_clip(cigar)


def five_prime(pos: Column, cigar: Column, reverse: Column) -> Column:
    """The coordinate of the read's 5' end."""
    return F.when(reverse, unclipped_end(pos, cigar)).otherwise(unclipped_start(pos, cigar))


def covered_read_interval(cigar: Column) -> Column:
    return F.struct(front_clip(cigar).alias("from"), (read_length(cigar) - back_clip(cigar) - 1).alias("to"))


def reference_interval(pos: Column, cigar: Column) -> Column:
    return F.struct(pos.cast("long").alias("from"), alignment_end(pos, cigar).alias("to"))


def op_counts(cigar: Column) -> Column:
    """Bases by operation, as a map of the operations that occur."""
    ops = F.array_sort(F.array_distinct(F.transform(cigar, lambda x: x["op"])))
    return F.map_from_entries(F.transform(ops, lambda o: F.struct(o.alias("op"), F.aggregate(F.filter(cigar, lambda x: x["op"] == o), F.lit(0).cast("long"), lambda a, x: a + x["len"]).alias("n"))))


def _without_m(cigar: Column, value: Column) -> Column:
    return F.when(F.exists(cigar, lambda x: x["op"] == "M"), F.raise_error("an M operation says nothing of matches").cast("double")).otherwise(value)


def identity(cigar: Column) -> Column:
    """Matches over matches and mismatches; an M operation is an error, no base gives 0."""
    eq, diff = length_of(cigar, ("=",)), length_of(cigar, ("X", "I", "D"))
    return _without_m(cigar, F.when(eq + diff > 0, eq / (eq + diff)).otherwise(F.lit(0.0)))


def error_rate(cigar: Column) -> Column:
    """Errors over errors and matches."""
    eq, bad = length_of(cigar, ("=",)), length_of(cigar, ("X", "I", "D"))
    return _without_m(cigar, F.when(eq + bad > 0, bad / (eq + bad)).otherwise(F.lit(0.0)))


def to_trace(cigar: Column) -> Column:
    """One letter for each base of I, D, = and X; other operations leave none."""
    return F.array_join(F.transform(F.filter(cigar, lambda x: x["op"].isin(*TRACE_OPS)), lambda x: F.repeat(x["op"], x["len"])), "")


def from_trace(trace: Column) -> Column:
    """Runs of a trace's letters."""
    runs = F.regexp_extract_all(trace, F.lit("(I+|D+|=+|X+|M+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.length(r).alias("len"), F.substring(r, 1, 1).alias("op")))


def positions(pos: Column, cigar: Column) -> Column:
    """(op, len, ref, read) of each element, with the reference and read position at which it begins."""
    empty = F.array().cast("array<struct<op:string,len:int,ref:bigint,read:bigint>>")
    start = F.struct(pos.cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        here = F.struct(x["op"].alias("op"), x["len"].alias("len"), a["ref"].alias("ref"), a["read"].alias("read"))
        return F.struct(
            (a["ref"] + F.when(x["op"].isin(*REFERENCE_OPS), x["len"]).otherwise(F.lit(0))).alias("ref"),
            (a["read"] + F.when(x["op"].isin(*READ_OPS), x["len"]).otherwise(F.lit(0))).alias("read"),
            F.concat(a["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(cigar, start, step, lambda a: a["out"])


def match_pairs(pos: Column, cigar: Column) -> Column:
    """(ref, read) positions of every aligned base."""
    blocks = F.filter(positions(pos, cigar), lambda x: x["op"].isin(*MATCH_OPS) & (x["len"] > 0))
    return F.flatten(F.transform(blocks, lambda x: F.transform(F.sequence(F.lit(0), x["len"] - 1), lambda k: F.struct((x["ref"] + k).alias("ref"), (x["read"] + k).alias("read")))))


def ref_pos_of(pos: Column, cigar: Column, read_pos: Column) -> Column:
    """The reference position of a read position; null where it is not aligned."""
    return F.get(F.transform(F.filter(match_pairs(pos, cigar), lambda x: x["read"] == read_pos), lambda x: x["ref"]), 0)


def cross(pos_a: Column, cigar_a: Column, pos_b: Column, cigar_b: Column) -> Column:
    """Whether two alignments of one read share an aligned pair."""
    return F.arrays_overlap(match_pairs(pos_a, cigar_a), match_pairs(pos_b, cigar_b))
