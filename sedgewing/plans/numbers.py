"""Numbers, strings and small structures: exact arithmetic, polynomials, matrices, hashes, sets, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.functions import arithmetic as A
from sedgewing.functions import digests, numbers
from sedgewing.functions import sequences as S
from sedgewing.operators import clustering, folds, histograms, kmers, ordered, simulate
from sedgewing.operators.skew import spread
from sedgewing.plans import Book
from sedgewing.plans.tables import table

BOOK = Book()


@BOOK.add("SELECT p_partkey, CAST((a * d + c * b) / gcd(a * d + c * b, b * d) AS BIGINT) AS num, CAST(b * d / gcd(a * d + c * b, b * d) AS BIGINT) AS den, CAST(a * c / gcd(a * c, b * d) AS BIGINT) AS pnum FROM (SELECT p_partkey, p_partkey + 1 AS a, CAST(p_size + 1 AS BIGINT) AS b, CAST(p_size * 2 + 3 AS BIGINT) AS c, p_partkey % 97 + 1 AS d FROM part)")
def rationals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = numbers.rational(k + 1, size + 1), numbers.rational(size * 2 + 3, k % 97 + 1)
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", x.alias("x"), y.alias("y"))
    total, product = numbers.plus(F.col("x"), F.col("y")), numbers.times(F.col("x"), F.col("y"))
    return p.select("p_partkey", total["num"].cast("long").alias("num"), total["den"].cast("long").alias("den"), product["num"].cast("long").alias("pnum"))


@BOOK.add("SELECT o_orderkey, lower(lpad(to_base(CAST(x // 18446744073709551616 AS BIGINT), 16), 16, '0') || lpad(to_base(CAST((x % 18446744073709551616) // 4294967296 AS BIGINT), 16), 8, '0') || lpad(to_base(CAST(x % 4294967296 AS BIGINT), 16), 8, '0')) AS total, CAST(x % 1000003 AS BIGINT) AS rest FROM (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * 18446744073709551616 + 18446744073709551615 + CAST(o_custkey AS HUGEINT) * 4294967296 + 4294967295 AS x FROM orders)")
def wide_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of 128 bits as limbs: a sum with carries, and its remainder."""
    hexa = lambda c, n: F.lpad(F.hex(c), n, "0")
    a = numbers.limbs(F.concat(hexa(F.col("o_orderkey"), 16), F.lit("f" * 16)), 4)
    b = numbers.limbs(F.concat(hexa(F.col("o_custkey"), 8), F.lit("f" * 8)), 4)
    o = table(spark, sf_dir, "orders").select("o_orderkey", numbers.limbs_plus(a, b).alias("x"))
    return o.select("o_orderkey", numbers.limbs_hex(F.col("x")).alias("total"), numbers.limbs_modulo(F.col("x"), F.lit(1_000_003)).alias("rest"))


@BOOK.add("SELECT p_partkey, CAST(list_sum([i * i * i FOR i IN range(1, p_size + 1)]) AS BIGINT) AS cubes, CAST(list_sum([i * i * i * i * i * i FOR i IN range(1, p_size + 1)]) AS BIGINT) AS sixths FROM part")
def power_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.power_sum(3, size).cast("long").alias("cubes"), numbers.power_sum(6, size).cast("long").alias("sixths"))


@BOOK.add("SELECT p_partkey, CAST(3 + 2 * x + 5 * x * x * x AS BIGINT) AS y FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS x FROM part)")
def polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", numbers.evaluated([3, 2, 0, 5], F.col("p_size").cast("long")).alias("y"))


@BOOK.add("""
    WITH a AS (SELECT o_custkey, list(CAST(o_orderkey % 10 AS BIGINT) ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey),
    t AS (SELECT o_custkey, i + j - 2 AS k, x[i] * x[j] AS v FROM (SELECT o_custkey, x, unnest(range(1, len(x) + 1)) AS i FROM a), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j))
    SELECT o_custkey, list(v ORDER BY k) AS product FROM (SELECT o_custkey, k, CAST(sum(v) AS BIGINT) AS v FROM t GROUP BY ALL) GROUP BY o_custkey""")
def convolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of polynomials whose coefficients are the last digits of a customer's orders."""
    x = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k % 10)
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(x.alias("x"))
    return o.select("o_custkey", numbers.convolution(F.col("x"), F.col("x")).alias("product"))


@BOOK.add("WITH a AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY ALL) SELECT x.i, y.i AS j, CAST(sum(x.v * y.v) AS BIGINT) AS v FROM a x JOIN a y ON x.j = y.j GROUP BY ALL")
def matrix_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_linenumber").alias("v"))
    return numbers.matrix_product(a, numbers.transposed(a))


@BOOK.add("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_partkey * 1000 + p_size END AS value FROM part")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("p_partkey") * 1000 + F.col("p_size")).cast("string"), F.when(F.col("p_size") % 3 == 0, "x").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", A.parse_decimal(text).alias("value"))


@BOOK.add("""
    WITH t AS (SELECT DISTINCT p_size AS n FROM part), c AS (SELECT n, unnest(range(0, n + 1)) AS k FROM t)
    SELECT CAST(n AS INTEGER) AS n, round(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.3) + (n - k) * ln(0.7))), 9) AS tail FROM c WHERE k >= n // 2 GROUP BY n""")
def binomial_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct()
    return n.select("n", F.round(A.binomial_upper(F.lit(0.3), F.floor(F.col("n") / 2).cast("int"), F.col("n")), 9).alias("tail"))


@BOOK.add("SELECT CAST(n AS INTEGER) AS n, round(exp(-4.5 + n * ln(4.5) - lgamma(n + 1)), 9) AS p FROM (SELECT DISTINCT p_size AS n FROM part)")
def poisson_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct()
    return n.select("n", F.round(A.poisson_pmf(F.lit(4.5), F.col("n")), 9).alias("p"))


@BOOK.add("SELECT count(*) AS n, true AS uniform_fits, true AS normal_fits, true AS log_normal_fits, true AS poisson_fits FROM orders")
def sampled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of drawn numbers within five standard errors of what they should be."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(simulate.uniform(k).alias("u"), simulate.normal(10.0, 2.0, k).alias("g"), F.log(simulate.log_normal(1.0, 0.5, k)).alias("l"), simulate.poisson(4.0, k).cast("double").alias("p"))
    near = lambda c, mean, sd: F.abs(F.avg(c) - mean) < 5 * sd / F.sqrt(F.count(F.lit(1)))
    spread = lambda c, sd: F.abs(F.stddev(c) / sd - 1) < 0.1
    return o.agg(F.count(F.lit(1)).alias("n"), near("u", 0.5, 0.2887).alias("uniform_fits"), (near("g", 10.0, 2.0) & spread("g", 2.0)).alias("normal_fits"), (near("l", 1.0, 0.5) & spread("l", 0.5)).alias("log_normal_fits"), (near("p", 4.0, 2.0) & spread("p", 2.0)).alias("poisson_fits"))


@BOOK.add("SELECT count(DISTINCT o_orderkey) AS n, CAST(0 AS BIGINT) AS collisions, true AS even FROM orders")
def mixed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different numbers have different hashes, whose low bit is set for half of them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey").distinct().select(numbers.mixed_hash(F.array("o_orderkey", (F.col("o_orderkey") * 7))).alias("h"))
    low = F.avg(F.col("h").bitwiseAND(1).cast("double"))
    return o.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("h")).alias("collisions"), (F.abs(low - 0.5) < 2.5 / F.sqrt(F.count(F.lit(1)))).alias("even"))


@BOOK.add("SELECT n_nationkey, string_split(n_name || ';' || n_nationkey, ';') AS tokens, n_name AS decoded, upper(n_name) AS upper_case, regexp_replace(n_name, '[AEIOU]+', '_', 'g') AS replaced, regexp_matches(n_name, '^[A-M]') AS matched FROM nation")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.split(F.concat(name, F.lit(";"), "n_nationkey"), ";").alias("tokens"), F.decode(F.unbase64(F.base64(F.encode(name, "utf-8"))), "utf-8").alias("decoded"), F.upper(F.lower(name)).alias("upper_case"), F.regexp_replace(name, "[AEIOU]+", "_").alias("replaced"), name.rlike("^[A-M]").alias("matched")
    )


_K8 = "(SELECT p_partkey, translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8), '0123456789abcdef', 'ACGTACGTACGTACGT') AS k FROM part)"


@BOOK.add(f"""
    SELECT p_partkey, CAST(list_sum([(instr('ACGT', substr(k, CAST(i AS INTEGER), 1)) - 1) * CAST(pow(4, 8 - i) AS BIGINT) FOR i IN range(1, 9)]) AS BIGINT) AS number,
           translate(k, 'ACGT', 'TGCA') AS complement, substr(k, 1, 2) || substr(k, 7, 2) || substr(k, 3, 4) AS reordered, round(pow(10, -p_partkey % 40 / 10.0), 12) AS wrong,
           '@r' || p_partkey || chr(10) || k || chr(10) || '+' || chr(10) || 'IIIIIIII' || chr(10) AS fastq, substr(k, 3, 4) AS inner_bases,
           CAST(instr('ACGT', substr(k, 1, 1)) - 1 AS INTEGER) AS first_code
    FROM (SELECT part.p_partkey, k FROM part JOIN {_K8} USING (p_partkey))""")
def kmer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, complements, orders for searches and FASTQ of short sequences."""
    seq = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 8), "0123456789abcdef", "ACGTACGTACGTACGT")
    k = F.col("k")
    return table(spark, sf_dir, "part").select("p_partkey", seq.alias("k")).select(
        "p_partkey", S.kmer_number(k).alias("number"), S.complement(k).alias("complement"), S.middle_last(k, 2, 6).alias("reordered"), F.round(S.error_probability(F.col("p_partkey") % 40), 12).alias("wrong"),
        S.fastq_text(F.concat(F.lit("r"), "p_partkey"), k, F.repeat(F.lit("I"), 8)).alias("fastq"), S.clipped(k, F.lit(2), F.lit(2)).alias("inner_bases"), S.code(F.substring(k, 1, 1)).cast("int").alias("first_code"),
    )


@BOOK.add("SELECT o_custkey, list_sum(list_transform(x, lambda v, i: coalesce(list_max(list_filter(range(1, i), lambda j: x[j] < v)) - 1, -1)))::BIGINT AS parents, len(x)::INTEGER AS n FROM (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey)")
def smaller_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier order of a smaller price, summed over a customer's orders."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda v: v["o_totalprice"])
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(x.alias("x"))
    return o.select("o_custkey", F.aggregate(folds.smaller_before(F.col("x")), F.lit(0).cast("long"), lambda s, v: s + v).alias("parents"), F.size("x").alias("n"))


@BOOK.add("SELECT p_partkey, CAST(max(CASE WHEN substr(t, 1, k) = right(t, k) THEN k ELSE 0 END) AS INTEGER) AS border FROM (SELECT p_partkey, t, CAST(unnest(range(0, length(t))) AS INTEGER) AS k FROM (SELECT p_partkey, p_type || p_type AS t FROM part)) GROUP BY p_partkey")
def string_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest proper border of a text written twice."""
    t = F.concat("p_type", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(folds.borders(t), -1).alias("border"))


@BOOK.add("SELECT p_partkey, CAST(max(k) AS INTEGER) AS length FROM (SELECT p_partkey, p_name, unnest(range(0, 13)) AS k FROM part) WHERE contains(p_name, substr('small ringle', 1, CAST(k AS INTEGER))) GROUP BY p_partkey")
def prefix_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest start of a needle that a name holds."""
    return table(spark, sf_dir, "part").select("p_partkey", folds.needle_prefix("small ringle")(F.col("p_name")).alias("length"))


@BOOK.add("SELECT value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT p_size AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT c_nationkey AS value, count(*) AS n FROM customer GROUP BY ALL) GROUP BY value")
def merged_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda t, c: histograms.histogram(table(spark, sf_dir, t), c)
    return histograms.merged(h("lineitem", "l_linenumber"), h("part", "p_size"), h("customer", "c_nationkey"))


@BOOK.add("SELECT DISTINCT l_partkey % 1000 AS a, l_suppkey AS b FROM lineitem")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 1000).alias("a"), F.col("l_suppkey").alias("b")).distinct()


@BOOK.add("SELECT l_suppkey AS k, max(l_partkey) AS latest, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 3")
def keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of keys to counts and last values; keys below an occurrence threshold are left out."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.max("l_partkey").alias("latest"), F.count(F.lit(1)).alias("n")).filter("n >= 3")


@BOOK.add("SELECT o_custkey, CAST(sum(CASE WHEN p IS DISTINCT FROM o_orderpriority THEN 1 ELSE 0 END) AS INTEGER) AS runs, CAST(max(o_orderkey) AS BIGINT) AS last FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) GROUP BY o_custkey")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run-length index of priorities along each customer's orders."""
    runs = ordered.run_lengths(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority")
    return runs.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("runs"), F.max("last").alias("last"))


@BOOK.add("""
    WITH m AS (SELECT o_orderstatus AS flag, CAST(o_orderdate AS DATE) AS d FROM orders GROUP BY ALL), i AS (SELECT flag, d, d - CAST(row_number() OVER (PARTITION BY flag ORDER BY d) AS INTEGER) AS g FROM m)
    SELECT flag, CAST(datediff('day', DATE '1970-01-01', min(d)) AS BIGINT) AS start, CAST(datediff('day', DATE '1970-01-01', max(d)) AS BIGINT) AS stop FROM i GROUP BY flag, g""")
def flagged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with an order of each status, as intervals."""
    from sedgewing.operators import intervals

    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    days = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("flag"), day.alias("start"), day.alias("stop"))
    return intervals.merged(days, ["flag"], 1, width=64)


@BOOK.add("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey * 2 FROM customer UNION ALL SELECT s_suppkey FROM supplier)")
def merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(c.alias("k")) for t, c in (("orders", F.col("o_custkey")), ("customer", F.col("c_custkey") * 2), ("supplier", F.col("s_suppkey")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@BOOK.add("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1 AS BIGINT) AS id FROM orders")
def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small numbers for the pairs of two tags."""
    o = table(spark, sf_dir, "orders")
    ids = ordered.numbered(o.select("o_orderpriority", "o_orderstatus").distinct(), ["o_orderpriority", "o_orderstatus"], "id")
    return o.join(F.broadcast(ids) if ids.count() <= 10_000 else ids, ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", "id")


@BOOK.add("SELECT o_orderkey, p_size AS found FROM orders LEFT JOIN part ON o_custkey = p_partkey")
def resolved_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys looked up in a table of values."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("o_custkey"), F.col("p_size").alias("found"))
    return table(spark, sf_dir, "orders").join(p, "o_custkey", "left").select("o_orderkey", "found")


@BOOK.add("SELECT row_number() OVER (ORDER BY l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity) - 1 AS rank, l_partkey AS first, l_suppkey AS second FROM lineitem")
def sorted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of numbers in the order of the first, with their places."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")  # noqa: E741
    return ordered.numbered(l, ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"], "rank").select("rank", F.col("l_partkey").alias("first"), F.col("l_suppkey").alias("second"))


@BOOK.add("SELECT row_number() OVER (ORDER BY l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity) - 1 AS rank, l_suppkey AS second, l_partkey AS first FROM lineitem")
def sorted_by_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")  # noqa: E741
    return ordered.numbered(l, ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity"], "rank").select("rank", F.col("l_suppkey").alias("second"), F.col("l_partkey").alias("first"))


@BOOK.add("SELECT row_number() OVER (ORDER BY hash, c_custkey) - 1 AS rank, c_custkey FROM (SELECT c_custkey, md5(c_name) AS hash FROM customer)")
def hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order of a digest of theirs, which spreads them evenly."""
    c = table(spark, sf_dir, "customer").select("c_custkey", digests.digest("md5", F.col("c_name")).alias("hash"))
    return ordered.numbered(c, ["hash", "c_custkey"], "rank").select("rank", "c_custkey")


@BOOK.add("SELECT substr(text, i + 1, 5) AS kmer, count(*) AS n, min(item_id) AS first_item FROM (SELECT item_id, text, unnest(range(0, length(text) - 4)) AS i FROM benchmark) GROUP BY kmer HAVING count(*) >= 4")
def frequent_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers above an occurrence threshold, with the first text of each: a cache of places."""
    w = kmers.windows(table(spark, sf_dir, "benchmark"), "item_id", "text", 5)
    return w.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item")).filter("n >= 4")


@BOOK.add("SELECT rank, substr(s, 1, 12) AS symbols FROM (SELECT s, row_number() OVER (ORDER BY s, id, i) - 1 AS rank FROM (SELECT item_id AS id, i, substr(text, i + 1) AS s FROM (SELECT item_id, text, unnest(range(0, length(text))) AS i FROM benchmark))) WHERE rank % 100 = 0")
def decoded_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first symbols at every hundredth place of the suffix order."""
    from sedgewing.operators import textindex

    b = table(spark, sf_dir, "benchmark")
    some = textindex.suffix_array(b, "item_id", "text").filter("rank % 100 = 0")
    return some.join(b.withColumnRenamed("item_id", "id"), "id").select("rank", F.substring(F.col("text"), F.col("at") + 1, F.lit(12)).alias("symbols"))


@BOOK.add("""
    WITH r AS (SELECT item_id, i, substr(text, i + 1) || substr(text, 1, i) AS s FROM (SELECT item_id, text, CAST(unnest(range(0, length(text))) AS INTEGER) AS i FROM benchmark))
    SELECT item_id, CAST(arg_min(i, struct_pack(s := s, i := i)) AS INTEGER) AS at FROM r GROUP BY item_id""")
def least_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the least rotation of each text begins."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("at"))
    turned = F.concat(F.substring(F.col("text"), F.col("at") + 1, F.length("text")), F.substring(F.col("text"), F.lit(1), F.col("at")))
    return b.groupBy("item_id").agg(F.min_by("at", F.struct(turned.alias("s"), F.col("at"))).alias("at"))


@BOOK.add("SELECT CAST(count(*) AS BIGINT) AS values_, true AS fits FROM (SELECT DISTINCT p_size FROM part)")
def phred_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarser table of qualities from a histogram of them: at most eight values are left."""
    h = {r["value"]: r["n"] for r in histograms.histogram(table(spark, sf_dir, "part"), "p_size").collect()}  # 94 values at most
    found = clustering.rephred(h, 8)
    return spark.createDataFrame([(len(found), len(set(found.values())) <= 8)], "values_ long, fits boolean")


@BOOK.add("SELECT c_nationkey, count(*) AS n FROM customer WHERE CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 2)) AS BIGINT) < 64 GROUP BY c_nationkey")
def subsampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the keys, by their digests."""
    return simulate.by_digest(table(spark, sf_dir, "customer"), "c_custkey", 64).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("SELECT cluster, true AS ordered FROM (SELECT CASE WHEN o_totalprice < 150000 THEN 0 WHEN o_totalprice < 300000 THEN 1 ELSE 2 END AS cluster FROM orders) GROUP BY ALL")
def scalar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of numbers: three centres, which rise, each with rows nearest to it."""
    o = table(spark, sf_dir, "orders").withColumn("v", F.array("o_totalprice"))
    centres, _ = clustering.kmeans(o, "v", 3, restarts=1, rounds=10, id_col="o_orderkey")
    centres = sorted(centres)
    near = clustering.quantised(o, "v", centres).groupBy("cluster").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    return near.select(F.col("cluster").cast("int").alias("cluster"), (F.element_at(F.array(*[F.lit(c[0]) for c in centres]), F.col("cluster") + 1).between(F.col("low"), F.col("high"))).alias("ordered"))


@BOOK.add("SELECT item_id, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS repeats, CAST(max(n) AS BIGINT) AS most FROM (SELECT item_id, substr(text, i + 1, 4) AS k, count(*) AS n FROM (SELECT item_id, text, unnest(range(0, length(text) - 3)) AS i FROM benchmark) GROUP BY ALL) GROUP BY item_id")
def repeat_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal k-mers and the most frequent one of each text."""
    w = kmers.windows(table(spark, sf_dir, "benchmark"), "item_id", "text", 4).groupBy("item_id", "kmer").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("item_id").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("repeats"), F.max("n").alias("most"))
