"""Checksums of sets of records that do not depend on their order.

A record's digest is added modulo 2**bits (``sums``), or its residue multiplied modulo a prime (``products``); both combine on
the map side. Decimal limbs hold the sums: 2**60 per limb, so that 10**20 records fit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewing.functions.digests import digest

#: Hex digits of a limb.
LIMB = 15


def _limbs(hexa: Column, digits: int) -> list[Column]:
    """Numbers of so many digits each, the lowest first."""
    out = []
    for stop in range(digits, 0, -LIMB):
        start = max(0, stop - LIMB)
        out.append(F.conv(F.substring(hexa, start + 1, stop - start), 16, 10).cast("decimal(38,0)"))
    return out


def sums(df: DataFrame, by: list[str], hexa: str, bits: int) -> DataFrame:
    """(by, n, checksum): the sum of hex digests modulo 2**bits, as hex."""
    digits = bits // 4
    limbs = _limbs(F.lpad(F.col(hexa), digits, "0"), digits)
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"_l{i}") for i, x in enumerate(limbs)])
    base, carry, texts = 1 << 4 * LIMB, F.lit(0).cast("decimal(38,0)"), []
    for i in range(len(limbs)):
        size = min(LIMB, digits - i * LIMB)
        whole = (F.col(f"_l{i}") + carry).cast("decimal(38,0)")
        own = F.pmod(whole, F.lit(1 << 4 * size).cast("decimal(38,0)"))
        carry = ((whole - F.pmod(whole, F.lit(base).cast("decimal(38,0)"))) / F.lit(base).cast("decimal(38,0)")).cast("decimal(38,0)")
        texts.append(F.lpad(F.lower(F.hex(own.cast("long"))), size, "0"))
    return total.select(*by, "n", F.concat(*texts[::-1]).alias("checksum"))


def products(df: DataFrame, by: list[str], hexa: str, prime: int) -> DataFrame:
    """(by, n, checksum): the product of digests modulo a prime, a residue of 0 counting as 1. Each task multiplies what it
    reads per group; the few partial products are then multiplied per group."""
    names, width = [*by, hexa], len(by)
    arrow = pa.schema([*[(c, _arrow(df, c)) for c in by], ("checksum", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch], partial: bool = False) -> Iterator[pa.RecordBatch]:
        have: dict[tuple, list[int]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, value, n = row[:width], row[width], row[width + 1] if partial else 1
                if value is None:
                    continue
                x = int(value, 16) % prime or 1
                if key in have:
                    have[key][0] = have[key][0] * x % prime
                    have[key][1] += n
                else:
                    have[key] = [x, n]
        cols = {c: [k[i] for k in have] for i, c in enumerate(arrow.names[:width])}
        cols |= {"checksum": [f"{x:x}" for x, _ in have.values()], "n": [n for _, n in have.values()]}
        yield pa.RecordBatch.from_pydict(cols, schema=arrow)

    schema = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in by], "checksum string", "n long"])
    part = df.select(*names).mapInArrow(run, schema)
    return part.repartition(*by).mapInArrow(lambda b: run(b, True), schema).select(*by, "n", "checksum")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def record_text(name: Column, flags: Column, seq: Column, qual: Column, tags: Column | None, kind: str) -> Column:
    """What of a record enters its digest: ``b`` flags and bases, ``nb`` also the name, ``bq`` also the qualities, ``bt`` also
    the tags BC, FI, QT, RT and TC. Reverse strands are turned back; of the flags the bits 0xC1 count."""
    from sedgewing.functions.sequences import reverse_complement

    reverse = flags.bitwiseAND(16) != 0
    bases = F.when(reverse, reverse_complement(seq)).otherwise(seq)
    own = F.concat(F.char(flags.bitwiseAND(0xC1)), bases)
    if kind == "b":
        return own
    if kind == "nb":
        return F.concat(name, F.lit("\x00"), own)
    if kind == "bq":
        return F.concat(own, F.when(reverse, F.reverse(qual)).otherwise(qual))
    if kind == "bt":
        return F.concat(own, *[F.coalesce(F.concat(F.lit(t), F.try_element_at(tags, F.lit(t))), F.lit("")) for t in ("BC", "FI", "QT", "RT", "TC")])
    raise ValueError(kind)


def sequence_checksums(records: DataFrame, by: list[str], kind: str, hash_name: str = "md5", bits: int = 128) -> DataFrame:
    """Sums of the digests of primary records per group, of all and of those that pass (no QC failure)."""
    primary = records.filter(F.col("flags").bitwiseAND(256 + 2048) == 0)
    text = record_text(F.col("name"), F.col("flags"), F.col("seq"), F.col("qual"), F.col("tags") if "tags" in records.columns else None, kind)
    hashed = primary.select(*by, "flags", digest(hash_name, text).alias("_hex"))
    every = sums(hashed, by, "_hex", bits).withColumn("which", F.lit("all"))
    passed = sums(hashed.filter(F.col("flags").bitwiseAND(512) == 0), by, "_hex", bits).withColumn("which", F.lit("pass"))
    return every.unionByName(passed)


def prime_sums(df: DataFrame, by: list[str], hexa: str, prime: int = 2147483629) -> DataFrame:
    """(by, n, checksum): the sum of digests modulo a prime below 2**31, from residues of 32 bits at a time."""
    from sedgewing.functions.numbers import limbs, limbs_modulo

    rest = limbs_modulo(limbs(F.col(hexa), 4), F.lit(prime))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.pmod(F.sum(rest), F.lit(prime)).alias("checksum"))
