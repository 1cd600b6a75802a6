"""Sort orders, order checks, positions, window folds and block splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.functions import coords, names
from sedgewing.operators import folds, ordered, overlaps
from sedgewing.operators.skew import spread
from sedgewing.plans import Book
from sedgewing.plans.tables import ALIGNMENTS_SQL, ORDER, OVERLAPS_SQL, alignments, item_order, table
from sedgewing.plans.tables import overlaps as overlap_table

BOOK = Book()
_A = f"({ALIGNMENTS_SQL})"


@BOOK.add("SELECT c_name, row_number() OVER (ORDER BY length(ltrim(CAST(n AS VARCHAR), '0')), n, c_name) - 1 AS rank FROM (SELECT 'c' || (c_custkey * 37 % 1009) || 'x' || c_custkey AS c_name, c_custkey * 37 % 1009 AS k, (c_custkey * 37 % 1009) * 1000000 + c_custkey AS n FROM customer)")
def natural_sort_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey") * 37 % 1009, F.lit("x"), F.col("c_custkey")).alias("c_name"))
    return ordered.numbered(c.withColumn("_key", names.natural_key(F.col("c_name"))), ["_key", "c_name"], "rank").select("c_name", "rank")


@BOOK.add(f"SELECT rank, ref_id, pos FROM {_A} ORDER BY CASE WHEN ref_id < 0 THEN 4294967296 + ref_id ELSE ref_id END, pos, rank LIMIT 500")
def coord_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir, *item_order()).orderBy(*coords.coordinate_key(F.col("ref_id"), F.col("pos")), *ORDER).select("rank", "ref_id", "pos").limit(500)


@BOOK.add(f"SELECT rank FROM {_A} ORDER BY CAST(substr(name, 2) AS BIGINT), CASE WHEN (flags & 64) <> 0 THEN 0 ELSE 1 END, flags & 2304, rank LIMIT 300")
def name_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir, *item_order()).orderBy(*names.name_order(F.col("name"), F.col("flags")), *ORDER).select("rank").limit(300)


@BOOK.add("SELECT count_if(p > o_orderdate) = 0 AS is_sorted, CAST(count_if(p > o_orderdate) AS BIGINT) AS falls FROM (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders)")
def sort_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.is_sorted(table(spark, sf_dir, "orders"), "o_orderkey", [F.col("o_orderdate")])


@BOOK.add("SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders) WHERE rank % 256 = 0")
def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.every(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 256).select("o_orderkey", "rank")


@BOOK.add("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1 OFFSET 17")
def select_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("flag"))
    return ordered.select_nth(o, ["o_orderkey"], "flag", 17).select("o_orderkey")


@BOOK.add("SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS least FROM orders")
def window_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.window_minimum(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 2, 2).select("o_orderkey", "least")


@BOOK.add(f"SELECT aread, bread, inv, abpos, aepos, bbpos, bepos, n FROM (SELECT aread, bread, inv, abpos, aepos, bbpos, bepos, count(*) AS n FROM ({OVERLAPS_SQL}) GROUP BY ALL) ORDER BY aread, bread, inv, abpos, aepos, bbpos, bepos LIMIT 400")
def overlap_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_table(spark, sf_dir).groupBy(*overlaps.KEY).agg(F.count(F.lit(1)).alias("n")).orderBy(*overlaps.order()).limit(400)


def _trace(key, n: int = 60):
    """A trace of = and X by a rule of the row's number."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i * i + key) % 7 == 0, "X").otherwise("=")), "")


_TRACE = "[CASE WHEN (i * i + o_orderkey) % 7 = 0 THEN 1 ELSE 0 END FOR i IN range(60)]"


@BOOK.add(f"SELECT o_orderkey, CAST(list_max([list_sum(e[k:k + 9]) FOR k IN range(1, 52)]) AS INTEGER) AS most, CAST(60 - list_sum(e) AS INTEGER) AS matches FROM (SELECT o_orderkey, {_TRACE} AS e FROM orders)")
def window_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trace(F.col("o_orderkey"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", folds.window_error(t, 10).alias("most"), F.length(F.translate(t, "X", "")).alias("matches"))


@BOOK.add("""
    WITH t AS (SELECT o_orderkey AS k, list_aggregate([CASE WHEN (i * i + o_orderkey) % 7 = 0 THEN 'X' ELSE '=' END FOR i IN range(60)], 'string_agg', '') AS s FROM orders),
    r AS (SELECT k, s, unnest(regexp_extract_all(s, '=+')) AS run FROM t), l AS (SELECT k, max(length(run)) AS n FROM r GROUP BY k)
    SELECT t.k, CAST(strpos(s, repeat('=', CAST(n AS INTEGER))) - 1 AS INTEGER) AS start, CAST(strpos(s, repeat('=', CAST(n AS INTEGER))) - 1 + n AS INTEGER) AS stop FROM t JOIN l USING (k)""")
def longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = folds.longest_match(_trace(F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), m["start"].alias("start"), m["stop"].alias("stop"))


@BOOK.add("""
    WITH t AS (SELECT o_orderkey, unnest(range(60)) AS i FROM orders), g AS (SELECT o_orderkey, i, CASE WHEN (i * i + o_orderkey) % 7 = 0 THEN -4 ELSE 1 END AS gain FROM t),
    p AS (SELECT o_orderkey, i, sum(gain) OVER (PARTITION BY o_orderkey ORDER BY i) AS upto, sum(gain) OVER (PARTITION BY o_orderkey ORDER BY i) - gain AS before FROM g),
    m AS (SELECT *, min(before) OVER (PARTITION BY o_orderkey ORDER BY i) AS low FROM p), s AS (SELECT *, upto - low AS score FROM m),
    b AS (SELECT o_orderkey, max(score) AS score, arg_max(i, struct_pack(a := score, b := -i)) AS i FROM s GROUP BY o_orderkey)
    SELECT b.o_orderkey, CAST(b.score AS INTEGER) AS score, CAST(max(p.i) AS INTEGER) AS start, CAST(b.i + 1 AS INTEGER) AS stop
    FROM b JOIN m ON m.o_orderkey = b.o_orderkey AND m.i = b.i JOIN p ON p.o_orderkey = b.o_orderkey AND p.i <= b.i AND p.before = m.low GROUP BY ALL""")
def best_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = folds.best_score(_trace(F.col("o_orderkey")), 1, -4)
    return table(spark, sf_dir, "orders").select("o_orderkey", b["score"].alias("score"), b["start"].alias("start"), b["stop"].alias("stop"))


@BOOK.add("""
    WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    r AS (SELECT o_custkey, i, p, 1 AS n FROM o UNION SELECT o.o_custkey, o.i, o.p, r.n + 1 FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i > r.i AND o.p > r.p)
    SELECT o.o_custkey, CAST((SELECT max(n) FROM r WHERE r.o_custkey = o.o_custkey) AS INTEGER) AS longest, CAST(count(*) AS INTEGER) AS orders FROM o GROUP BY o.o_custkey""")
def increasing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest increasing run of prices among a customer's orders."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("p"))
    return o.select("o_custkey", F.size(folds.longest_increasing(F.col("p"))).alias("longest"), F.size("p").alias("orders"))


@BOOK.add("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders) WHERE m IS NULL OR o_totalprice > m")
def price_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.envelope(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice")


@BOOK.add("""
    WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, n_chars FROM documents),
    r AS (SELECT i, n_chars, CAST(0 AS BIGINT) AS block, CAST(n_chars AS BIGINT) AS size FROM d WHERE i = 1
          UNION ALL SELECT d.i, d.n_chars, CASE WHEN r.size + d.n_chars > 100000 THEN r.block + 1 ELSE r.block END, CASE WHEN r.size + d.n_chars > 100000 THEN d.n_chars ELSE r.size + d.n_chars END FROM r JOIN d ON d.i = r.i + 1)
    SELECT block, min(i) - 1 AS low, max(i) AS high, CAST(sum(n_chars) AS BIGINT) AS size FROM r GROUP BY block""")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.split_blocks(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 100_000)


@BOOK.add("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS trimmed_id FROM documents WHERE n_chars >= 1000")
def trimmed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.col("n_chars").alias("rlen"), F.lit(0).alias("flags"))
    return overlaps.kept_reads(reads, 1000, False).select(F.col("read_id").alias("doc_id"), "trimmed_id")
