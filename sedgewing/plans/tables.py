"""The driver's tables, and stand-ins for record tables that are projections of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.functions import arithmetic as A


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A number of its own for each line item, in SQL.
ITEM = "((CAST(l_orderkey * 8 + l_linenumber AS BIGINT) * 1000000 + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT)"


def item_number() -> Column:
    """The number that ITEM says, in two's complement: beyond 63 bits (above 1.8 million orders), where SQL's integers overflow, it is taken
    modulo 2**64 and stays a number of its own. No key of 64 bits overflows; 10**10 times 64 is 5**10 times 2**16, 10**4 times 64 is 625 times 2**10."""
    order, line, part = A.wrapped_times(F.col("l_orderkey"), 9_765_625), F.col("l_linenumber").cast("long") * 9_765_625, A.wrapped_times(F.col("l_partkey"), 625)
    return A.wrapped_sum(F.shiftleft(order, 19), F.shiftleft(line, 16), F.shiftleft(part, 10), F.shiftleft(F.col("l_suppkey"), 6), F.col("l_quantity"))


#: Columns of item_order.
ORDER = ["major", "minor"]


def item_order() -> list[Column]:
    """(major, minor): in the order of the exact number, also beyond 63 bits, where item_number has lost it. The number is major times
    640,000 and minor."""
    low = F.col("l_suppkey") * 64 + F.col("l_quantity").cast("long")
    minor = F.pmod(low, F.lit(640_000))
    major = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey") + F.call_function("div", low - minor, F.lit(640_000))
    return [major.alias("major"), minor.alias("minor")]


def alignments(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """A record per line item: name by order, read 1 or 2 by line number, a CIGAR of up to seven elements; more columns of line items."""
    t = table(spark, sf_dir, "lineitem")
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    flag = lambda c, bit: F.when(c, F.lit(bit)).otherwise(F.lit(0))
    flags = F.lit(1) + flag(line % 2 == 1, 64) + flag(line % 2 == 0, 128) + flag(F.col("l_returnflag") == "R", 16) + flag(F.col("l_linestatus") == "O", 32) + flag(line >= 3, 256) + flag(F.col("l_discount") > 0.08, 512) + flag(line >= 6, 2048) + flag(F.col("l_quantity") > 48, 4)
    element = lambda n, op: F.struct(n.cast("int").alias("len"), F.lit(op).alias("op"))
    cigar = F.array(element(line, "S"), element(F.col("l_quantity"), "="), element(supp % 4, "I"), element(part % 3, "X"), element(part % 5, "D"), element(line + 10, "="), element(supp % 2, "H"))
    return t.select(
        item_number().alias("rank"),
        F.concat(F.lit("r"), F.col("l_orderkey")).alias("name"),
        flags.alias("flags"),
        (supp % 5 - 1).cast("int").alias("ref_id"),
        (part * 7).cast("int").alias("pos"),
        (part % 60).cast("int").alias("mapq"),
        F.filter(cigar, lambda x: x["len"] > 0).alias("cigar"),
        F.round("l_extendedprice").cast("long").alias("score"),
        (supp % 3).cast("int").alias("lib"),
        *more,
    )


#: The stand-in in SQL, for oracles: the lengths of its elements as columns.
ALIGNMENTS_SQL = f"""
    SELECT {ITEM} AS rank, 'r' || l_orderkey AS name,
           1 + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 32 ELSE 0 END
             + CASE WHEN l_linenumber >= 3 THEN 256 ELSE 0 END + CASE WHEN l_discount > 0.08 THEN 512 ELSE 0 END + CASE WHEN l_linenumber >= 6 THEN 2048 ELSE 0 END
             + CASE WHEN l_quantity > 48 THEN 4 ELSE 0 END AS flags,
           CAST(l_suppkey % 5 - 1 AS INTEGER) AS ref_id, CAST(l_partkey * 7 AS INTEGER) AS pos, CAST(l_partkey % 60 AS INTEGER) AS mapq,
           CAST(l_linenumber AS BIGINT) AS cs, CAST(l_quantity AS BIGINT) AS ce, l_suppkey % 4 AS ci, l_partkey % 3 AS cx, l_partkey % 5 AS cd,
           CAST(l_linenumber + 10 AS BIGINT) AS ce2, l_suppkey % 2 AS ch, CAST(round(l_extendedprice) AS BIGINT) AS score, CAST(l_suppkey % 3 AS INTEGER) AS lib
    FROM lineitem"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlap per line item: part over supplier, its stretches from quantity and line number."""
    t = table(spark, sf_dir, "lineitem")
    qty, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    return t.select(
        F.col("l_partkey").alias("aread"),
        F.col("l_suppkey").alias("bread"),
        (F.col("l_returnflag") == "R").alias("inv"),
        (line * 100).alias("abpos"),
        (line * 100 + qty * 10).alias("aepos"),
        (line * 50).alias("bbpos"),
        (line * 50 + qty * 10).alias("bepos"),
        F.round(F.col("l_discount") * 100).cast("int").alias("diffs"),
    )


OVERLAPS_SQL = """
    SELECT l_partkey AS aread, l_suppkey AS bread, l_returnflag = 'R' AS inv, l_linenumber * 100 AS abpos, l_linenumber * 100 + CAST(l_quantity AS INTEGER) * 10 AS aepos,
           l_linenumber * 50 AS bbpos, l_linenumber * 50 + CAST(l_quantity AS INTEGER) * 10 AS bepos, CAST(round(l_discount * 100) AS INTEGER) AS diffs
    FROM lineitem"""


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval in days per line item: from the order to the shipment, by customer's order."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    return t.select(F.col("l_suppkey").alias("grp"), item_number().alias("id"), F.col("l_linenumber").alias("line"), F.least(day("o_orderdate"), day("l_shipdate")).alias("start"), (F.least(day("o_orderdate"), day("l_shipdate")) + F.col("l_quantity").cast("long")).alias("stop"))


SPANS_SQL = f"""
    SELECT l_suppkey AS grp, {ITEM} AS id, l_linenumber AS line,
           CAST(datediff('day', DATE '1970-01-01', least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS BIGINT) AS start,
           CAST(datediff('day', DATE '1970-01-01', least(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) + CAST(l_quantity AS BIGINT) AS BIGINT) AS stop
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
