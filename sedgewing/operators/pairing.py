"""Pairing of reads by name, and what the mates know of each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewing.functions import cigar as C
from sedgewing.functions import flags as G


def pair_rows(rows: DataFrame, keys: list[str], first: Column, second: Column) -> DataFrame:
    """Full outer join of the first and second rows of a key: columns a and b (structs), kind pair, orphan1 or orphan2. Rows
    that are neither come as single."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    a = rows.filter(first).select(*keys, row.alias("a"))
    b = rows.filter(second & ~first).select(*keys, row.alias("b"))
    kind = F.when(F.col("a").isNull(), "orphan2").when(F.col("b").isNull(), "orphan1").otherwise("pair")
    both = a.join(b, keys, "full").withColumn("kind", kind)
    rest = rows.filter(~F.coalesce(first | second, F.lit(False))).select(*keys, row.alias("a"), F.lit(None).cast(b.schema["b"].dataType).alias("b"), F.lit("single").alias("kind"))
    return both.unionByName(rest)


def mates(records: DataFrame) -> DataFrame:
    """Pairs, orphans and singles of primary alignment records, by name."""
    flags = F.col("flags")
    primary = records.filter(~G.has(flags, "SECONDARY", "SUPPLEMENTARY"))
    paired = G.has(flags, "PAIRED")
    return pair_rows(primary, ["name"], paired & G.has(flags, "READ1"), paired & G.has(flags, "READ2"))


def is_pair(a: str, b: str) -> Column:
    fa, fb = F.col(f"{a}.flags"), F.col(f"{b}.flags")
    return G.has(fa, "PAIRED") & G.has(fb, "PAIRED") & (F.col(f"{a}.name") == F.col(f"{b}.name")) & (G.has(fa, "READ1") & G.has(fb, "READ2") | G.has(fa, "READ2") & G.has(fb, "READ1"))


def five_prime(r: str) -> Column:
    return C.five_prime(F.col(f"{r}.pos"), F.col(f"{r}.cigar"), G.has(F.col(f"{r}.flags"), "REVERSE"))


def insert_size(a: str, b: str) -> Column:
    """5' coordinate of b less that of a; 0 where either is unmapped or the references differ."""
    apart = G.has(F.col(f"{a}.flags"), "UNMAP") | G.has(F.col(f"{b}.flags"), "UNMAP") | (F.col(f"{a}.ref_id") != F.col(f"{b}.ref_id"))
    return F.when(apart, F.lit(0).cast("long")).otherwise(five_prime(b) - five_prime(a))


def with_mate(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the mate information made consistent, as columns of each side: next_ref, next_pos, mate flags, tlen and
    the mate's mapping quality."""
    ua, ub = G.has(F.col("a.flags"), "UNMAP"), G.has(F.col("b.flags"), "UNMAP")
    both, none = ~ua & ~ub, ua & ub
    size = insert_size("a", "b")

    def side(own: str, other: str, sign: int) -> Column:
        mine, theirs = F.col(own), F.col(other)
        u_own, u_other = G.has(mine["flags"], "UNMAP"), G.has(theirs["flags"], "UNMAP")
        flags = G.set_bit(G.set_bit(mine["flags"], "MREVERSE", G.has(theirs["flags"], "REVERSE")), "MUNMAP", u_other)
        # an unmapped read stands where its mapped mate does
        ref = F.when(none, F.lit(-1)).when(u_own, theirs["ref_id"]).otherwise(mine["ref_id"])
        pos = F.when(none, F.lit(-1)).when(u_own, theirs["pos"]).otherwise(mine["pos"])
        next_ref = F.when(none, F.lit(-1)).when(u_other, mine["ref_id"]).otherwise(theirs["ref_id"])
        next_pos = F.when(none, F.lit(-1)).when(u_other, mine["pos"]).otherwise(theirs["pos"])
        return F.struct(
            mine["name"].alias("name"),
            mine["rank"].alias("rank"),
            flags.alias("flags"),
            ref.alias("ref_id"),
            pos.alias("pos"),
            next_ref.alias("next_ref"),
            next_pos.alias("next_pos"),
            F.when(both, sign * size).otherwise(F.lit(0).cast("long")).alias("tlen"),
            F.when(both, theirs["mapq"]).when(~none & u_own, theirs["mapq"]).alias("mate_mapq"),
        )

    return pairs.select(side("a", "b", 1).alias("a"), side("b", "a", -1).alias("b"))


def mate_tags(pairs: DataFrame) -> DataFrame:
    """One row per read with its mate's score (ms), 5' coordinate (mc) and CIGAR (mate_cigar)."""

    def side(own: str, other: str) -> DataFrame:
        return pairs.select(
            F.col(f"{own}.name").alias("name"), F.col(f"{own}.rank").alias("rank"), F.col(f"{other}.score").alias("ms"), five_prime(other).alias("mc"), C.to_text(F.col(f"{other}.cigar")).alias("mate_cigar")
        )

    return side("a", "b").unionByName(side("b", "a"))


def with_library(records: DataFrame, read_groups: DataFrame) -> DataFrame:
    """records with the id and library of their read group, -1 where it is unknown. The groups come from a header and are few."""
    known = read_groups.select(F.col("id").alias("rg"), "rg_id", "library_id")
    return records.join(known, "rg", "left").fillna({"rg_id": -1, "library_id": -1})
