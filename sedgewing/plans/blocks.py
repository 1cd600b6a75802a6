"""Blocked gzip and packed sequences; positions of a trace with a positive score."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.operators import folds
from sedgewing.operators.skew import spread
from sedgewing.plans import Book
from sedgewing.plans.tables import table
from sedgewing.scratch import shared_dir
from sedgewing.sources import blocks, files

BOOK = Book()
_TEXT = "SELECT string_agg('>' || p_partkey || chr(10) || p_name || chr(10), '' ORDER BY p_partkey) AS t FROM part"


def _file(spark: SparkSession, sf_dir: str) -> str:
    """One file of all parts as FASTA, in blocks of 4,096 bytes."""
    path = f"{shared_dir(spark)}/blocked-{uuid.uuid4().hex}"
    line = F.concat(F.lit(">"), "p_partkey", F.lit("\n"), "p_name", F.lit("\n"))
    rows = table(spark, sf_dir, "part").select("p_partkey", line.alias("line")).orderBy("p_partkey").coalesce(1)

    def pack(batches):
        import pyarrow as pa

        text = "".join(x for b in batches for x in b.column(1).to_pylist()).encode()
        yield pa.RecordBatch.from_pydict({"name": pa.array(["parts.fa.gz"]), "content": pa.array([blocks.blocked(text, 4096)], pa.binary())})

    files.write_files(rows.mapInArrow(pack, "name string, content binary"), path).count()
    return path


@BOOK.add(f"SELECT CAST(i * 4096 AS BIGINT) AS start, CAST(least(4096, n - i * 4096) AS BIGINT) AS length FROM (SELECT strlen(t) AS n, unnest(range(0, CAST(ceil(strlen(t) / 4096.0) AS BIGINT))) AS i FROM ({_TEXT}))")
def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_index(spark, _file(spark, sf_dir)).filter("length > 0").select("start", "length")


@BOOK.add(f"SELECT CAST(i * 4096 AS BIGINT) AS start, md5(substr(t, CAST(i * 4096 + 1 AS BIGINT), 4096)) AS md5 FROM (SELECT t, unnest(range(0, CAST(ceil(strlen(t) / 4096.0) AS BIGINT))) AS i FROM ({_TEXT}))")
def inflated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks inflated by many tasks."""
    index = blocks.block_index(spark, _file(spark, sf_dir)).filter("length > 0").repartition(8)
    return blocks.inflated(index).select("start", F.md5("content").alias("md5"))


@BOOK.add(f"SELECT CAST(i * 1000 AS BIGINT) AS low, substr(t, CAST(i * 1000 + 1 AS BIGINT), 5000) AS content FROM (SELECT t, unnest(range(0, strlen(t) // 1000)) AS i FROM ({_TEXT})) WHERE i % 3 = 0")
def block_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of what is inflated, each from the few blocks that hold it."""
    index = blocks.block_index(spark, _file(spark, sf_dir)).filter("length > 0")
    end = index.groupBy("path").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    wanted = end.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / 1000) - 1, F.lit(3).cast("long"))).alias("i"), "end")
    wanted = wanted.select("path", (F.col("i") * 1000).alias("low"), F.least(F.col("i") * 1000 + 5000, "end").alias("high"))
    return blocks.stretches(index, wanted).select("low", F.decode("content", "utf-8").alias("content"))


_SEQ = "translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@BOOK.add(f"SELECT p_partkey, {_SEQ} AS whole, substr({_SEQ}, 1 + p_size % 20, 9) AS part, 12 AS bytes, {_SEQ} || reverse(translate({_SEQ}, 'ACGT', 'TGCA')) AS strands FROM part")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences at two bits a base, read whole and in part, and with their other strand."""
    seq = F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", blocks.packed_bases(seq).alias("b"), blocks.packed_bases(blocks.both_strands(seq)).alias("two"))
    low = F.col("p_size") % 20
    return p.select("p_partkey", blocks.unpacked_bases("b", F.lit(0), F.lit(99)).alias("whole"), blocks.unpacked_bases("b", low, low + 9).alias("part"), F.octet_length("b").alias("bytes"), blocks.unpacked_bases("two", F.lit(0), F.lit(64)).alias("strands"))


@BOOK.add("""
    WITH t AS (SELECT o_orderkey, unnest(range(60)) AS i FROM orders), g AS (SELECT o_orderkey, i, CASE WHEN (i * i + o_orderkey) % 7 = 0 THEN -4 ELSE 1 END AS gain FROM t),
    p AS (SELECT o_orderkey, i, sum(gain) OVER (PARTITION BY o_orderkey ORDER BY i) AS upto, sum(gain) OVER (PARTITION BY o_orderkey ORDER BY i DESC) AS since FROM g)
    SELECT o_orderkey, CAST(coalesce(max(CASE WHEN upto > 0 THEN i + 1 END), 0) AS INTEGER) AS prefix, CAST(coalesce(min(CASE WHEN since > 0 THEN i END), 60) AS INTEGER) AS suffix FROM p GROUP BY o_orderkey""")
def positive_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest start and end of a trace with a score above zero."""
    key = F.col("o_orderkey")
    t = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.when((i * i + key) % 7 == 0, "X").otherwise("=")), "")
    ends = folds.positive_ends(t, 1, -4)
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", ends.alias("e"))
    return o.select("o_orderkey", "e.prefix", "e.suffix")
