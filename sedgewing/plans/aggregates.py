"""Histograms, statistics, checksums, k-mers and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.functions.digests import digest
from sedgewing.operators import checksums, clustering, graph, histograms, kmers, ordered
from sedgewing.plans import Book
from sedgewing.plans.tables import table

BOOK = Book()


@BOOK.add("SELECT CAST(floor(value) AS BIGINT) AS value, count(*) AS n FROM events GROUP BY ALL")
def hist_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.histogram(table(spark, sf_dir, "events").select(F.floor("value").alias("v")), "v")


@BOOK.add("""
    WITH h AS (SELECT CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (ORDER BY v) AS cum, sum(n) OVER () AS total FROM h)
    SELECT CAST((SELECT sum(n) FROM h) AS BIGINT) AS points, CAST((SELECT sum(v * n) FROM h) AS BIGINT) AS total, round((SELECT sum(v * n) / sum(n) FROM h), 6) AS average,
           (SELECT min(v) FROM c WHERE cum > total // 2) AS median""")
def hist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.summary(hist_events(spark, sf_dir)).withColumn("average", F.round("average", 6))


@BOOK.add("""
    WITH h AS (SELECT CAST(floor(value) AS BIGINT) AS value, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (ORDER BY value) / CAST(sum(n) OVER () AS DOUBLE) AS share FROM h)
    SELECT value, n, round(share, 9) AS share FROM c WHERE share <= 0.9""")
def hist_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.head_fraction(hist_events(spark, sf_dir), 0.9).withColumn("share", F.round("share", 9))


@BOOK.add("""
    WITH c AS (SELECT n_chars, sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM documents), t AS (SELECT sum(n_chars) AS total, count(*) AS rows FROM documents)
    SELECT (SELECT avg(n_chars) FROM c, t WHERE n_chars > 0 AND cum - n_chars <= total * 50 / 100.0 AND total * 50 / 100.0 <= cum) AS n, round(total / CAST(rows AS DOUBLE), 6) AS avg FROM t""")
def nstat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.n_statistic(table(spark, sf_dir, "documents"), ["n_chars", "doc_id"], "n_chars", 50, 100).withColumn("avg", F.round("avg", 6))


@BOOK.add("SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) - o_custkey AS BIGINT) AS before, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    sums = ordered.exclusive_sums(o, ["o_orderdate", "o_orderkey"], "o_custkey", "before")
    return ordered.numbered(sums, ["o_orderdate", "o_orderkey"], "rank").select("o_orderkey", "before", "rank")


def _checksum_sql() -> str:
    # 128-bit sums modulo 2**128 from the two halves of the digests
    return """
        WITH h AS (SELECT lang, md5(coalesce(text, '')) AS m FROM documents),
        l AS (SELECT lang, count(*) AS n, sum(CAST(('0x' || substr(m, 18, 15)) AS BIGINT)) AS l0, sum(CAST(('0x' || substr(m, 3, 15)) AS BIGINT)) AS l1, sum(CAST(('0x' || substr(m, 1, 2)) AS BIGINT)) AS l2 FROM h GROUP BY lang),
        c AS (SELECT lang, n, l0 % 1152921504606846976 AS a, (l1 + l0 // 1152921504606846976) AS b, l2 FROM l)
        SELECT lang, n, lpad(lower(hex(CAST((l2 + b // 1152921504606846976) % 256 AS BIGINT))), 2, '0') || lpad(lower(hex(CAST(b % 1152921504606846976 AS BIGINT))), 15, '0') || lpad(lower(hex(CAST(a AS BIGINT))), 15, '0') AS checksum
        FROM c"""


@BOOK.add(_checksum_sql())
def seq_checksum_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", digest("md5", F.coalesce("text", F.lit(""))).alias("hex"))
    return checksums.sums(d, ["lang"], "hex", 128)


@BOOK.add()
def seq_checksum_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", digest("crc32", F.coalesce("text", F.lit(""))).alias("hex"))
    return checksums.products(d, ["source"], "hex", (1 << 61) - 1)


_WINDOWS = "SELECT item_id, i AS pos, substr(text, i + 1, {k}) AS kmer FROM (SELECT item_id, text, unnest(range(0, length(text) - {k} + 1)) AS i FROM benchmark)"


@BOOK.add(f"""
    WITH w AS ({_WINDOWS.format(k=8)}) SELECT kmer, count(*) AS n FROM (SELECT kmer FROM w UNION ALL SELECT reverse(translate(kmer, 'ACGTacgtMRWSYKVHDBNmrwsykvhdbnUu', 'TGCAtgcaKYWSRMBDHVNkywsrmbdhvnAa')) FROM w) GROUP BY kmer""")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.count(table(spark, sf_dir, "benchmark"), "text", 8)


@BOOK.add(f"SELECT item_id, kmer, count(*) AS n, min(pos) AS first_at, max(pos) AS last_at FROM ({_WINDOWS.format(k=6)}) GROUP BY item_id, kmer HAVING count(*) >= 2")
def kmer_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmers.repeats(table(spark, sf_dir, "benchmark"), "item_id", "text", 6)
    return found.select("item_id", "kmer", "n", F.array_min("places").cast("long").alias("first_at"), F.array_max("places").cast("long").alias("last_at"))


@BOOK.add("""
    WITH b AS (SELECT DISTINCT item_id, substr(text, i + 1, 48) AS kmer FROM (SELECT item_id, text, unnest(range(0, length(text) - 47)) AS i FROM benchmark)),
    d AS (SELECT DISTINCT doc_id, substr(text, i + 1, 48) AS kmer FROM (SELECT doc_id, text, unnest(range(0, length(text) - 47)) AS i FROM documents WHERE text IS NOT NULL))
    SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (kmer) GROUP BY doc_id, item_id""")
def contamination_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    wanted = kmers.windows(b, "item_id", "text", 48).select("item_id", "kmer").distinct()
    found = kmers.windows_among(d.filter("text IS NOT NULL"), "doc_id", "text", 48, wanted.select("kmer")).select("doc_id", "kmer").join(wanted, "kmer").distinct()
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@BOOK.add("""
    WITH w AS (SELECT item_id, i AS at, substr(text, i + 1, 24) AS kmer FROM (SELECT item_id, text, unnest(range(0, length(text) - 23)) AS i FROM benchmark)),
    m AS (SELECT a.item_id AS id_a, b.item_id AS id_b, a.at AS at_a, b.at AS at_b FROM w a JOIN w b ON a.kmer = b.kmer AND a.item_id < b.item_id),
    r AS (SELECT *, at_a - row_number() OVER (PARTITION BY id_a, id_b, at_a - at_b ORDER BY at_a) AS run FROM m)
    SELECT id_a, id_b, min(at_a) AS start_a, min(at_b) AS start_b, count(*) + 23 AS length FROM r GROUP BY id_a, id_b, at_a - at_b, run""")
def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    found = kmers.seeds(b, b, "item_id", "text", "item_id", "text", 24).filter("id_a < id_b")
    return kmers.exact_matches(found, 24).select("id_a", "id_b", F.col("start_a").cast("long").alias("start_a"), F.col("start_b").cast("long").alias("start_b"), "length")


@BOOK.add("SELECT degree, count(*) AS n FROM (SELECT o_custkey, count(*) AS degree FROM orders GROUP BY o_custkey) GROUP BY degree")
def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.degree_distribution(table(spark, sf_dir, "orders"), "o_custkey")


@BOOK.add("""
    SELECT a, b, CAST(sum(c) AS BIGINT) AS c FROM (SELECT l_suppkey AS a, l_partkey % 50 AS b, l_linenumber AS c FROM lineitem UNION ALL SELECT o_custkey % 100 AS a, o_orderkey % 50 AS b, 1 AS c FROM orders) WHERE a <> b GROUP BY a, b""")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"), F.col("l_linenumber").alias("c"))
    two = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("a"), (F.col("o_orderkey") % 50).alias("b"), F.lit(1).alias("c"))
    return graph.merged_edges(one, two)


@BOOK.add("SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("lines"), F.count(F.lit(1)).alias("n"))


@BOOK.add("SELECT source, count(*) AS reads, CAST(sum(n_chars) AS BIGINT) AS bases, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def read_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("reads"), F.sum("n_chars").alias("bases"), F.round(F.avg("n_chars"), 6).alias("mean"))


@BOOK.add("SELECT c AS symbol, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> '' GROUP BY c")
def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "")).alias("symbol")).filter("symbol <> ''").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


_CENTRES = [[0.0, 0.0], [2000.0, 100000.0], [5000.0, 250000.0], [9000.0, 400000.0]]


@BOOK.add("SELECT o_orderkey, CAST(CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 175000 THEN 1 WHEN o_totalprice < 325000 THEN 2 ELSE 3 END AS INTEGER) AS cluster FROM orders")
def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("v", F.array(F.col("o_totalprice")))
    return clustering.quantised(o, "v", [[0.0], [100000.0], [250000.0], [400000.0]], last=True).select("o_orderkey", "cluster")


@BOOK.add()
def kmeans_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    centres, _ = clustering.kmeans(e, "embedding", 10, restarts=1, rounds=8, id_col="vec_id")
    return clustering.quantised(e, "embedding", centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 6).alias("sse"))


@BOOK.add("""
    WITH p AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM embeddings),
    d AS (SELECT a.vec_id, a.label AS own, b.label AS other, b.vec_id AS o, sum((CAST(a.x AS DOUBLE) - b.x) * (CAST(a.x AS DOUBLE) - b.x)) AS d FROM p a JOIN p b ON a.j = b.j GROUP BY ALL),
    m AS (SELECT vec_id, own, other, avg(d) AS d FROM d GROUP BY ALL),
    s AS (SELECT vec_id, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM m GROUP BY vec_id)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS points FROM s""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.silhouette(table(spark, sf_dir, "embeddings"), "embedding", "label").withColumn("silhouette", F.round("silhouette", 6))
