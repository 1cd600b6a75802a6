"""Graph queries over nations, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.operators import graph
from sedgewing.plans import Book
from sedgewing.plans.tables import table
from sedgewing.scratch import written

BOOK = Book()

#: Customers and suppliers (numbered below zero) that share a line, either way.
_TRADE = "SELECT DISTINCT o_custkey AS a, -1 - l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each line, written once; copies stay, as putting them together costs more than they do."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return written(t.select(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL"), "trade")


def _reach_sql(rounds: int = 12) -> str:
    """Levels one after the other; those beyond the last are empty."""
    parts = [f"t AS MATERIALIZED ({_TRADE}), e AS MATERIALIZED (SELECT a AS src, b AS dst FROM t UNION ALL SELECT b, a FROM t), l0 AS MATERIALIZED (SELECT min(src) AS node, 0 AS depth FROM e WHERE src >= 0)"]
    for k in range(1, rounds):
        seen = " UNION ALL ".join(f"SELECT node FROM l{j}" for j in range(max(0, k - 2), k))
        parts.append(f"l{k} AS MATERIALIZED (SELECT DISTINCT dst AS node, {k} AS depth FROM e JOIN l{k - 1} ON src = node WHERE dst NOT IN ({seen}))")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT node, CAST(depth AS INTEGER) AS depth FROM l{k}" for k in range(rounds))


@BOOK.add(_reach_sql())
def reach_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the customer of the least number reaches over shared lines."""
    edges = _trade(spark, sf_dir)
    least = lambda c: F.min(F.when(F.col(c) >= 0, F.col(c)))
    return graph.reachable(edges, edges.agg(F.least(least("src"), least("dst")).alias("node")), both_ways=True, stored=True)


_DAG = "SELECT p_partkey AS src, 2 * p_partkey + 1 + p_size % 2 AS dst FROM part UNION SELECT p_partkey, 3 * p_partkey + 1 + p_size FROM part"


@BOOK.add(f"""
    WITH RECURSIVE e AS ({_DAG}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    r AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node)
    SELECT CAST(node AS BIGINT) AS node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY node""")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part")
    e = p.select(k.alias("src"), (2 * k + 1 + size % 2).cast("long").alias("dst")).union(p.select(k, (3 * k + 1 + size).cast("long"))).distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graph.levels(e, nodes)[1]


_RETURNS = "SELECT DISTINCT l_partkey AS src, -1 - l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 4 UNION SELECT DISTINCT -1 - l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 4"


@BOOK.add(f"""
    WITH RECURSIVE e AS ({_RETURNS}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
    SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts point to suppliers of returned lines, suppliers to parts of accepted ones, where few were bought."""
    t = table(spark, sf_dir, "lineitem").filter("l_quantity < 4")
    part, supplier = F.col("l_partkey"), -1 - F.col("l_suppkey")
    e = t.filter("l_returnflag = 'R'").select(part.alias("src"), supplier.alias("dst")).union(t.filter("l_returnflag = 'A'").select(supplier, part)).distinct()
    e = written(e, "returns")
    return graph.strong_components(e, e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())


@BOOK.add("SELECT src, list_sort(list(dst)) AS targets FROM (SELECT DISTINCT c_nationkey AS src, c_custkey % 40 AS dst FROM customer) GROUP BY src")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 40).alias("dst")).distinct())


@BOOK.add("""
    WITH e AS (SELECT s_nationkey AS src, s_suppkey % 25 AS dst, min(s_suppkey) AS w FROM supplier GROUP BY ALL),
    t AS (SELECT a.src, b.dst, min(greatest(a.w, b.w)) AS w FROM e a JOIN e b ON a.dst = b.src GROUP BY ALL)
    SELECT e.src, e.dst, e.w FROM e LEFT JOIN t ON e.src = t.src AND e.dst = t.dst WHERE t.w IS NULL OR t.w >= e.w""")
def reduced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 25).cast("int").alias("dst")).agg(F.min("s_suppkey").alias("w"))
    return graph.transitively_reduced(e)
