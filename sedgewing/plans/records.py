"""Duplicate marking over event records and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.operators import dedup
from sedgewing.plans import Book
from sedgewing.plans.tables import ALIGNMENTS_SQL, ORDER, alignments, item_order, table

BOOK = Book()

_RANKED = "SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events"


@BOOK.add(f"SELECT event_type, count(*) AS examined, CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates FROM ({_RANKED}) GROUP BY event_type")
def dedup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = dedup.mark_best(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")
    return marked.groupBy("event_type").agg(F.count(F.lit(1)).alias("examined"), F.sum(F.col("is_dup").cast("long")).alias("duplicates"))


@BOOK.add(f"SELECT event_id, user_id, event_type, value FROM ({_RANKED}) WHERE rn = 1")
def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = dedup.mark_best(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")
    return marked.filter("NOT is_dup").select("event_id", "user_id", "event_type", "value")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignments(spark, sf_dir, *item_order()).withColumn("tag", F.col("mapq").cast("long") % 4)
    return dedup.read_ends(rows).withColumn("is_pair", F.col("flags").bitwiseAND(32) == 0)


_KEYED = f"""
    SELECT rank, lib, CAST(mapq % 4 AS BIGINT) AS tag, ref_id + 1 AS ref1, flags, score, (flags & 32) = 0 AS is_pair,
           CASE WHEN (flags & 16) <> 0 THEN pos + ce + cx + cd + ce2 - 1 + ch ELSE pos - cs END + 1 AS coord1, CASE WHEN (flags & 16) <> 0 THEN 'R' ELSE 'F' END AS orient
    FROM ({ALIGNMENTS_SQL})"""


@BOOK.add(f"SELECT rank, coord1, orient FROM ({_KEYED})")
def read_end_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("rank", "coord1", "orient")


@BOOK.add(f"""
    SELECT rank, is_pair, NOT is_pair AND (bool_or(is_pair) OVER w OR row_number() OVER (PARTITION BY lib, tag, ref1, orient, is_pair ORDER BY score DESC, rank) > 1) AS is_dup
    FROM ({_KEYED}) WINDOW w AS (PARTITION BY lib, tag, ref1, orient)""")
def frag_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.mark_fragments(_keyed(spark, sf_dir), index="rank", keys=["lib", "tag", "ref1", "orient"], order=ORDER).select("rank", "is_pair", "is_dup")


@BOOK.add(f"SELECT rank, row_number() OVER (PARTITION BY lib, tag, ref1, coord1, orient ORDER BY score DESC, rank) > 1 AS is_dup FROM ({_KEYED})")
def pair_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.mark_pairs(_keyed(spark, sf_dir), index="rank", keys=dedup.FRAGMENT_KEY, order=ORDER).select("rank", "is_dup")


_TILED = "SELECT l_suppkey AS lib, l_linenumber - 1 AS tile, CAST(l_partkey * 3 AS BIGINT) AS x, CAST(l_quantity * 40 AS BIGINT) AS y, l_orderkey AS o, l_linenumber AS n"


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgewing.plans.tables import item_number

    t = table(spark, sf_dir, "lineitem")
    return t.select(item_number().alias("idx1"), F.struct(*item_order()).alias("place"), F.col("l_suppkey").alias("lib"), F.lit(0).alias("rg"), (F.col("l_linenumber") - 1).alias("tile"), (F.col("l_partkey") * 3).alias("x"), (F.col("l_quantity") * 40).cast("long").alias("y"))


def _optical_sql() -> str:
    from sedgewing.plans.tables import ITEM

    return f"""
        WITH t AS (SELECT {ITEM} AS idx1, l_suppkey AS lib, l_linenumber - 1 AS tile, l_partkey * 3 AS x, CAST(l_quantity * 40 AS BIGINT) AS y FROM lineitem)
        SELECT a.idx1, EXISTS (SELECT 1 FROM t b WHERE a.lib = b.lib AND a.tile = b.tile AND a.tile <> 0 AND abs(a.x - b.x) <= 100 AND abs(a.y - b.y) <= 100 AND b.idx1 < a.idx1) AS is_optical
        FROM t a"""


@BOOK.add(_optical_sql())
def optical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.mark_optical(_tiled(spark, sf_dir), 100, ["lib"], "place").select("idx1", "is_optical")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(spark, sf_dir)
    marked = dedup.mark_pairs(rows, index="rank", keys=["lib", "tag", "ref1", "orient", "mapq"], order=ORDER)
    return dedup.metrics(marked.withColumns({"is_optical": F.col("score") % 7 == 0, "is_unmapped": F.col("flags").bitwiseAND(4) != 0}))


_METRICS = f"""
    WITH m AS (SELECT lib, flags, score, (flags & 32) = 0 AS is_pair, (flags & 4) <> 0 AS u,
               row_number() OVER (PARTITION BY lib, mapq % 4, ref_id, (flags & 16) <> 0, mapq ORDER BY score DESC, rank) > 1 AS is_dup FROM ({ALIGNMENTS_SQL})),
    g AS (SELECT lib, count_if(u) AS unmapped, count_if(NOT is_pair AND NOT u) AS unpaired, count_if(is_pair) AS pairs, count_if(NOT is_pair AND is_dup) AS unpaired_dup,
          count_if(is_pair AND is_dup) AS pair_dup, count_if(is_pair AND is_dup IS NOT NULL AND score % 7 = 0) AS optical FROM m GROUP BY lib)"""


@BOOK.add(_METRICS + """
    SELECT lib, CAST(unmapped AS BIGINT) AS unmapped, CAST(unpaired AS BIGINT) AS unpaired, CAST(pairs AS BIGINT) AS pairs, CAST(unpaired_dup AS BIGINT) AS unpaired_dup,
           CAST(pair_dup AS BIGINT) AS pair_dup, CAST(optical AS BIGINT) AS optical, round((unpaired_dup + 2 * pair_dup) / CAST(unpaired + 2 * pairs AS DOUBLE), 9) AS percent
    FROM g""")
def duplication_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).drop("library_size").withColumn("percent", F.round("percent", 9))


def _size_sql() -> str:
    over = "c / x - 1 + exp(-n / x)"
    return f"""
        WITH RECURSIVE p AS (SELECT o_orderpriority AS lib, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS c FROM orders GROUP BY ALL),
        s AS (SELECT 0 AS i, lib, n, c, CAST(1.0 AS DOUBLE) AS lo, CAST(100.0 AS DOUBLE) AS hi FROM p
              UNION ALL SELECT i + 1, lib, n, c, CASE WHEN {over.replace("x", "((lo + hi) / 2 * c)").replace("e((lo + hi) / 2 * c)p", "exp")} > 0 THEN (lo + hi) / 2 ELSE lo END,
                     CASE WHEN {over.replace("x", "((lo + hi) / 2 * c)").replace("e((lo + hi) / 2 * c)p", "exp")} > 0 THEN hi ELSE (lo + hi) / 2 END FROM s WHERE i < 40)
        SELECT lib, CAST(floor(c * (lo + hi) / 2) AS BIGINT) AS library_size FROM s WHERE i = 40"""


@BOOK.add(_size_sql())
def library_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("lib")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("c"))
    return o.select("lib", dedup.library_size(F.col("n"), F.col("c")).alias("library_size"))


_OVER = "c / ((lo + hi) / 2 * c) - 1 + exp(-n / ((lo + hi) / 2 * c))"


@BOOK.add(_METRICS.replace("WITH m AS", "WITH RECURSIVE m AS", 1) + f"""
    , p AS (SELECT lib, CAST(pairs - optical AS DOUBLE) AS n, CAST(pairs - pair_dup AS DOUBLE) AS c FROM g WHERE optical < pair_dup),
    s AS (SELECT 0 AS i, lib, n, c, CAST(1.0 AS DOUBLE) AS lo, CAST(100.0 AS DOUBLE) AS hi FROM p
          UNION ALL SELECT i + 1, lib, n, c, CASE WHEN {_OVER} > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_OVER} > 0 THEN hi ELSE (lo + hi) / 2 END FROM s WHERE i < 40),
    z AS (SELECT lib, n, c, floor(c * (lo + hi) / 2) AS size, CAST(unnest(range(1, 101)) AS INTEGER) AS x FROM s WHERE i = 40)
    SELECT lib, x, round(size * (1 - exp(-(x * n) / size)) / c, 6) AS roi FROM z""")
def roi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.roi_histogram(_metrics(spark, sf_dir)).select("lib", "x", F.round("roi", 6).alias("roi"))
