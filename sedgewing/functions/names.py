"""Read names: natural order, tile fields, stripping, record names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column, width: int = 20) -> Column:
    """A string whose byte order is the natural order of names: runs of digits compare as numbers (below 10**width), other
    text by bytes; numbers that differ in leading zeros only are told apart by the name itself (use it as a second key)."""
    parts = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda p: F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), width, "0")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), digits(p)).otherwise(p)), "")


def name_order(name: Column, flags: Column) -> list[Column]:
    """Sort columns of query-name order: name, then read number (1, 2, none), then secondary and supplementary bits."""
    number = F.when(flags.bitwiseAND(64) != 0, 0).when(flags.bitwiseAND(128) != 0, 1).otherwise(2)
    return [natural_key(name), name, number, flags.bitwiseAND(256 + 2048)]


def name_hit_order(name: Column, flags: Column, hit: Column) -> list[Column]:
    """Name order with the hit index before the read number; rows without one come first."""
    key = name_order(name, flags)
    return [*key[:2], hit.asc_nulls_first(), *key[2:]]


def tile_fields(name: Column) -> Column:
    """(tile, x, y) of names whose last three fields between colons are numbers; tile is one more than written, 0 where the
    name has no such fields."""
    parts = F.split(name, ":")
    field = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("long")
    ok = (F.size(parts) >= 3) & name.rlike("(^|:)[0-9]+:[0-9]+:[0-9]+$")
    pick = lambda k, plus: F.when(ok, field(k) + plus).otherwise(F.lit(0).cast("long"))
    return F.struct(pick(-3, 1).alias("tile"), pick(-2, 0).alias("x"), pick(-1, 0).alias("y"))


def strip_blank_and_slash(name: Column) -> Column:
    """The text before the first white space, cut at its last slash."""
    return strip_slash(F.regexp_extract(name, "^(\\S*)", 1))


def strip_slash(name: Column) -> Column:
    return F.regexp_replace(name, "/[^/]*$", "")


def valid(name: Column) -> Column:
    """1 to 255 printable characters without the blank and ``@``."""
    return name.rlike("^[!-?A-~]{1,255}$")


def read_record_name(prolog: Column, origin: Column, fpulse: Column, rlen: Column) -> Column:
    return F.format_string("%s/%d/%d_%d", prolog, origin, fpulse, fpulse + rlen)


def hash32_text(name: Column) -> Column:
    """A hash of 32 bits of a name, as hex: the first of its MD5."""
    return F.substring(F.md5(name.cast("binary")), 1, 8)
