"""Alignment flags as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of the flag bits, from bit 0 on
NAMES = ("PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY")
BIT = {name: 1 << k for k, name in enumerate(NAMES)}


def has(flags: Column, *names: str) -> Column:
    """Whether any of the named bits is set."""
    return flags.bitwiseAND(F.lit(sum(BIT[n] for n in names))) != 0


def to_text(flags: Column) -> Column:
    """The names of bits 0 to 10, each followed by a semicolon; the supplementary bit has no text."""
    return F.concat(*[F.when(has(flags, n), F.lit(f"{n};")).otherwise(F.lit("")) for n in NAMES[:11]])


def from_text(text: Column) -> Column:
    """The mask of comma-separated names; an unknown name is an error."""
    known = F.create_map(*[x for n in NAMES for x in (F.lit(n), F.lit(BIT[n]))])

    def bit(name: Column) -> Column:
        found = F.try_element_at(known, name)
        return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("Unknown flag "), name)).cast("int"))

    return F.aggregate(F.split(text, ","), F.lit(0), lambda a, name: a.bitwiseOR(bit(name)))


def set_bit(flags: Column, name: str, on: Column) -> Column:
    return F.when(on, flags.bitwiseOR(F.lit(BIT[name]))).otherwise(flags.bitwiseAND(F.lit(~BIT[name])))


def pair_orientation(first: Column, second: Column) -> Column:
    """FR, RF, FF or RR of an ordered pair of flags; on one strand the first one's read number decides."""
    r1, r2, read1 = has(first, "REVERSE"), has(second, "REVERSE"), has(first, "READ1")
    return F.when(r1 != r2, F.when(~r1, "FR").otherwise("RF")).otherwise(F.when(r1 != read1, "FF").otherwise("RR"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
