"""Further queries: validity, text forms, seeds and overlaps, further orders and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.functions import names, sequences, tags, validity
from sedgewing.operators import folds, graph, histograms, intervals, kmers, ordered, overlaps, pairing, pileup, textindex
from sedgewing.operators.skew import spread
from sedgewing.plans import Book
from sedgewing.plans.tables import ALIGNMENTS_SQL, ITEM, ORDER, OVERLAPS_SQL, alignments, item_number, item_order, table
from sedgewing.plans.tables import overlaps as overlap_table

BOOK = Book()
_A = f"({ALIGNMENTS_SQL})"


@BOOK.add(f"""
    SELECT CASE WHEN rank % 11 = 0 THEN 'queryname_contains_illegal_symbols' WHEN (flags & 4) = 0 AND (flags & 768) <> 768 AND rank % 7 = 0 THEN 'cigar_is_inconsistent_with_sequence_length'
                WHEN rank % 5 = 0 THEN 'invalid_mapping_position' WHEN ref_id >= 3 THEN 'invalid_reference' ELSE 'valid' END AS code, count(*) AS n FROM {_A} GROUP BY ALL""")
def record_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alignments(spark, sf_dir)
    rank = F.col("rank")
    from sedgewing.functions.cigar import read_length

    size = read_length(F.col("cigar")) + F.when(rank % 7 == 0, 1).otherwise(0)
    name = F.when(rank % 11 == 0, F.concat(F.col("name"), F.lit("@"))).otherwise(F.col("name"))
    code = validity.code(name, F.col("flags"), F.when(rank % 5 == 0, -2).otherwise(F.col("pos")), F.lit(-1), F.lit(0), F.col("cigar"), size, None, F.col("ref_id"), 3)
    return a.select(F.coalesce(code, F.lit("valid")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("SELECT c_custkey, '@' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '/1' ELSE '/2' END || chr(10) || CASE WHEN c_nationkey % 2 = 0 THEN 'AACG' ELSE 'CGTT' END || chr(10) || '+' || chr(10) || CASE WHEN c_nationkey % 2 = 0 THEN '!5II' ELSE 'II5!' END || chr(10) AS fastq FROM customer")
def fastq_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    flags = F.lit(1) + F.when(F.col("c_custkey") % 2 == 0, 64).otherwise(128) + F.when(F.col("c_nationkey") % 2 == 0, 0).otherwise(16)
    return c.select("c_custkey", sequences.fastq_of_alignment(F.col("c_name"), flags, F.lit("AACG"), F.lit("!5II")).alias("fastq"))


@BOOK.add(f"SELECT rank, name || chr(9) || flags || chr(9) || 'c' || ref_id || chr(9) || (pos + 1) || chr(9) || mapq || chr(9) || cs || 'S' || ce || '=' || CASE WHEN ci > 0 THEN ci || 'I' ELSE '' END || CASE WHEN cx > 0 THEN cx || 'X' ELSE '' END || CASE WHEN cd > 0 THEN cd || 'D' ELSE '' END || ce2 || '=' || CASE WHEN ch > 0 THEN ch || 'H' ELSE '' END || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || '*' || chr(9) || '*' || chr(9) || 'AS:i:' || score AS line FROM {_A}")
def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgewing.sources.alignments import sam_line

    a = alignments(spark, sf_dir).withColumns({"ref": F.concat(F.lit("c"), F.col("ref_id")), "next_ref": F.lit(None).cast("string"), "next_pos": F.lit(-1), "tlen": F.lit(0), "seq": F.lit("*"), "qual": F.lit("*"), "tags": F.create_map(F.lit("AS"), F.concat(F.lit("i:"), F.col("score")))})
    return a.select("rank", sam_line(a).alias("line"))


@BOOK.add("SELECT c_custkey, 'run/' || c_nationkey || '/' || c_custkey || '_' || (c_custkey + 100) AS name, regexp_extract(c_name, '^([^ ]*)', 1) AS stripped FROM customer")
def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    made = names.read_record_name(F.lit("run"), F.col("c_nationkey"), key, F.lit(100).cast("long"))
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("name"), names.strip_blank_and_slash(F.concat("c_name", F.lit("/1 rest"))).alias("stripped"))


@BOOK.add("""
    WITH w AS (SELECT item_id, i AS pos, substr(text, i + 1, 12) AS kmer FROM (SELECT item_id, text, unnest(range(0, length(text) - 11)) AS i FROM benchmark)),
    m AS (SELECT a.item_id AS id_a, b.item_id AS id_b, (a.pos - b.pos) >> 6 AS band FROM w a JOIN w b ON a.kmer = b.kmer)
    SELECT id_a, id_b, CAST(band AS INTEGER) AS band, count(*) AS n FROM m GROUP BY ALL""")
def seed_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return kmers.bands(kmers.seeds(b, b, "item_id", "text", "item_id", "text", 12), 12).select("id_a", "id_b", "band", "n")


@BOOK.add("""
    WITH w AS (SELECT item_id, i AS pos, substr(text, i + 1, 4) AS kmer FROM (SELECT item_id, text, unnest(range(0, length(text) - 3)) AS i FROM benchmark))
    SELECT copies, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY item_id, kmer ORDER BY pos RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS copies FROM w) GROUP BY copies""")
def kmer_window_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = kmers.copies_in_windows(table(spark, sf_dir, "benchmark"), "item_id", "text", 4, 50)
    return w.groupBy("copies").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(f"""
    WITH o AS (SELECT aread, bread, inv, abpos, aepos, bbpos, n FROM (SELECT aread, bread, inv, abpos, aepos, bbpos, count(*) AS n FROM ({OVERLAPS_SQL}) GROUP BY ALL)),
    p AS (SELECT aread, bread, inv, abpos, aepos, bbpos, unnest(range(0, CAST(ceil((aepos - abpos // 100 * 100) / 100.0) AS BIGINT) + 1)) AS block FROM o)
    SELECT aread, bread, inv, CAST(block AS INTEGER) AS block, CAST(CASE WHEN block = 0 THEN abpos ELSE least((abpos // 100 + block) * 100, aepos) END AS INTEGER) AS apos, CAST(bbpos + block * 10 AS INTEGER) AS bpos FROM p""")
def trace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 100 bases of a, each with ten bases of b in the stand-in."""
    o = overlap_table(spark, sf_dir).select("aread", "bread", "inv", "abpos", "aepos", "bbpos").distinct()
    blocks = F.ceil((F.col("aepos") - F.floor(F.col("abpos") / 100) * 100) / 100).cast("int")
    o = o.withColumn("trace", F.array_repeat(F.struct(F.lit(0).alias("err"), F.lit(10).alias("blen")), blocks))
    return overlaps.trace_points(o, 100).select("aread", "bread", "inv", "block", F.col("apos").cast("int").alias("apos"), F.col("bpos").cast("int").alias("bpos"))


@BOOK.add(f"""
    WITH o AS (SELECT DISTINCT aread, bread, inv, abpos, aepos, bbpos, bepos FROM ({OVERLAPS_SQL}))
    SELECT count(*) AS pairs FROM o x JOIN o y ON x.aread = y.aread AND x.bread = y.bread
    WHERE greatest(ceil(x.abpos / 100.0), ceil(y.abpos / 100.0)) <= least(x.aepos // 100, y.aepos // 100) - 1""")
def shared_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = overlap_table(spark, sf_dir).select(*overlaps.KEY).distinct()
    return overlaps.share_block(o, o, 100).agg(F.count(F.lit(1)).alias("pairs"))


@BOOK.add(f"SELECT aread, bread, abpos, aepos, bbpos FROM (SELECT DISTINCT aread, bread, inv, abpos, aepos, bbpos, bepos FROM ({OVERLAPS_SQL})) WHERE least(abpos, bbpos) <= 100 AND least(700 - aepos, 500 - bepos) <= 100")
def proper_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 700 bases as a and 500 as b: the stand-in has no read table, so b is numbered apart."""
    o = overlap_table(spark, sf_dir).select(*overlaps.KEY).distinct().withColumn("bread", -F.col("bread") - 1)
    size = lambda c, n: o.select(F.col(c).alias("read_id")).distinct().withColumn("rlen", F.lit(n))
    near = overlaps.proper(o, size("aread", 700).unionByName(size("bread", 500)), 100)
    return near.select("aread", (-F.col("bread") - 1).alias("bread"), "abpos", "aepos", "bbpos")


@BOOK.add("SELECT value, count(*) AS n FROM (SELECT n_chars AS value FROM documents UNION ALL SELECT length(text) AS value FROM benchmark) GROUP BY value")
def read_length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = histograms.histogram(table(spark, sf_dir, "documents"), "n_chars")
    b = histograms.histogram(table(spark, sf_dir, "benchmark").select(F.length("text").cast("long").alias("n")), "n")
    return histograms.merged(a, b)


@BOOK.add("""
    WITH s AS (SELECT item_id AS id, CAST(i AS INTEGER) AS pos, substr(text, i + 1) AS s FROM (SELECT item_id, text, unnest(range(0, length(text))) AS i FROM benchmark)),
    r AS (SELECT id, pos, s, lag(s) OVER w AS p, lead(s) OVER w AS q FROM s WINDOW w AS (ORDER BY s, id, pos)),
    c AS (SELECT id, pos, list_max(list_filter(range(0, length(s) + 1), lambda k: starts_with(p, substr(s, 1, CAST(k AS INTEGER))))) AS a, list_max(list_filter(range(0, length(s) + 1), lambda k: starts_with(q, substr(s, 1, CAST(k AS INTEGER))))) AS b FROM r)
    SELECT id, pos, CAST(greatest(coalesce(a, 0), coalesce(b, 0)) + 1 AS INTEGER) AS depth FROM c""")
def unique_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.unique_depths(textindex.lcp_array(table(spark, sf_dir, "benchmark"), "item_id", "text")).select("id", F.col("at").alias("pos"), "depth")


@BOOK.add("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) - 1 AS rank FROM customer")
def symbol_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.symbol_rank(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", ["c_nationkey"]).select("c_custkey", "rank")


@BOOK.add(f"SELECT rank FROM {_A} ORDER BY CAST(score % 1000 AS VARCHAR), rank LIMIT 200")
def tag_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.create_map(F.lit("AS"), (F.col("score") % 1000).cast("string"))
    return alignments(spark, sf_dir, *item_order()).orderBy(tags.get(t, "AS"), *ORDER).select("rank").limit(200)


@BOOK.add(f"SELECT {ITEM} AS idx1 FROM lineitem ORDER BY l_linenumber, l_partkey, l_quantity, idx1 LIMIT 250")
def optical_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(item_number().alias("idx1"), F.col("l_linenumber").alias("tile"), F.col("l_partkey").alias("x"), F.col("l_quantity").alias("y"), *item_order()).orderBy("tile", "x", "y", *ORDER).select("idx1").limit(250)


@BOOK.add("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r FROM orders) WHERE r IN (0, 7, 4999)")
def rows_at_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.at_positions(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], [0, 7, 4999]).select("o_orderkey", "o_totalprice")


@BOOK.add("SELECT e.event_id, min(p.ts_us) AS next_purchase FROM (SELECT *, epoch_us(CAST(ts AS TIMESTAMP)) AS ts_us FROM events) e LEFT JOIN (SELECT *, epoch_us(CAST(ts AS TIMESTAMP)) AS ts_us FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts_us >= e.ts_us GROUP BY e.event_id")
def asof_next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgewing.operators.asof import asof_join

    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    p = e.filter("event_type = 'purchase'").select("user_id", "at", F.col("at").alias("next_purchase"))
    return asof_join(e.select("event_id", "user_id", "at"), p, ["user_id"], "at", "next_purchase", stretch=86_400_000_000, direction="forward").select("event_id", "next_purchase")


@BOOK.add("""
    SELECT o_orderkey, least(a1, b1) AS span_from, greatest(a2, b2) AS span_to, greatest(abs(a1 - b1), abs(a2 - b2)) AS hausdorff, a1 <= b1 AND b2 <= a2 AS holds
    FROM (SELECT o_orderkey, CAST(o_orderkey % 50 AS BIGINT) AS a1, CAST(o_orderkey % 50 + o_custkey % 30 AS BIGINT) AS a2, CAST(o_custkey % 40 AS BIGINT) AS b1, CAST(o_custkey % 40 + o_orderkey % 20 AS BIGINT) AS b2 FROM orders)""")
def interval_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, b = F.struct((k % 50).alias("from"), (k % 50 + c % 30).alias("to")), F.struct((c % 40).alias("from"), (c % 40 + k % 20).alias("to"))
    s = intervals.span(a, b)
    return table(spark, sf_dir, "orders").select("o_orderkey", s["from"].alias("span_from"), s["to"].alias("span_to"), intervals.hausdorff(a, b).alias("hausdorff"), intervals.contains(a, b).alias("holds"))


@BOOK.add("SELECT c_custkey AS read_id FROM customer WHERE c_custkey % 9 = 0")
def contained_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    reads = c.select(F.col("c_custkey").alias("read_id"), (F.col("c_custkey") % 90 + 10).alias("rlen"))
    o = c.select(F.col("c_custkey").alias("aread"), (F.col("c_custkey") + 1).alias("bread"), (F.col("c_custkey") % 9).alias("abpos"), (F.col("c_custkey") % 90 + 10).alias("aepos"))
    return graph.contained(o, reads)


@BOOK.add()
def match_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    found = kmers.exact_matches(kmers.seeds(b, b, "item_id", "text", "item_id", "text", 8).filter("id_a < id_b"), 8)
    return folds.chains(found, ["id_a", "id_b"])


@BOOK.add()
def md_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over a made reference, their MD and NM."""
    from sedgewing.functions.cigar import reference_length

    a = alignments(spark, sf_dir).filter("ref_id >= 0").withColumn("seq", F.substring(F.repeat(F.lit("ACGGT"), 40), F.lit(1), _read_length().cast("int")))
    end = a.agg(F.max(F.col("pos") + reference_length(F.col("cigar"))).alias("end"))  # the references reach the last record
    refs = spark.range(4).crossJoin(end).select(F.col("id").cast("int").alias("ref_id"), F.repeat(F.lit("ACGT"), F.ceil(F.col("end") / 4).cast("int")).alias("bases"))
    return pileup.with_md(a, refs).groupBy("nm").agg(F.count(F.lit(1)).alias("n"))


def _read_length():
    from sedgewing.functions.cigar import read_length

    return read_length(F.col("cigar"))


@BOOK.add("SELECT name, count(*) AS n FROM (SELECT 'r' || l_orderkey AS name FROM lineitem) GROUP BY name HAVING count(*) >= 6")
def names_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 6")


@BOOK.add(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN (flags & 2304) = 0 THEN 'primary' ELSE 'other' END AS kind FROM {_A}) GROUP BY kind")
def primary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    singles = pairing.mates(alignments(spark, sf_dir).withColumn("name", F.col("rank").cast("string")))
    n = singles.select(F.lit("primary").alias("kind"))
    other = alignments(spark, sf_dir).filter("(flags & 2304) <> 0").select(F.lit("other").alias("kind"))
    return n.unionByName(other).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("""
    WITH r AS (SELECT item_id * 1000 + i AS id, substr(text, CAST(i + 1 AS INTEGER), 60) AS s FROM (SELECT item_id, text, unnest(range(0, length(text) - 59, 25)) AS i FROM benchmark)),
    m AS (SELECT a.id AS a, b.id AS b, a.s AS x, b.s AS y, unnest(range(21, 61)) AS n FROM r a JOIN r b ON a.id <> b.id WHERE contains(a.s, substr(b.s, 1, 21))),
    c AS (SELECT a, b, n, len(list_filter(range(1, n + 1), lambda k: substr(x, CAST(60 - n + k AS INTEGER), 1) <> substr(y, CAST(k AS INTEGER), 1))) AS d FROM m WHERE substr(x, CAST(61 - n AS INTEGER), 21) = substr(y, 1, 21))
    SELECT a, b, max(n - 4 * d) AS score FROM c WHERE n - 4 * d > 0 GROUP BY a, b""")
def suffix_prefix_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(sequences.shreds(F.col("text"), 60, 25)).alias("_s"))
    reads = b.select((F.col("item_id") * 1000 + F.col("_s.start")).alias("id"), F.col("_s.piece").alias("seq"))
    return kmers.suffix_prefix(reads, "id", "seq").select("a", "b", F.col("score").cast("long").alias("score"))


@BOOK.add(f"SELECT rank, CAST(ce + ce2 AS INTEGER) AS matches, CAST(cx AS INTEGER) AS mismatches, CAST(ci AS INTEGER) AS insertions, CAST(cd AS INTEGER) AS deletions FROM {_A}")
def trace_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgewing.functions.cigar import to_trace
    from sedgewing.operators.aligners import trace_statistics as statistics

    s = statistics(to_trace(F.col("cigar")))
    return alignments(spark, sf_dir).select("rank", *[s[c].alias(c) for c in ("matches", "mismatches", "insertions", "deletions")])


@BOOK.add(f"SELECT rank FROM {_A} ORDER BY CAST(substr(name, 2) AS BIGINT), CASE WHEN lib = 0 THEN NULL ELSE lib END NULLS FIRST, CASE WHEN (flags & 64) <> 0 THEN 0 ELSE 1 END, flags & 2304, rank LIMIT 300")
def name_hit_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.when(F.col("lib") != 0, F.col("lib"))
    return alignments(spark, sf_dir, *item_order()).orderBy(*names.name_hit_order(F.col("name"), F.col("flags"), hit), *ORDER).select("rank").limit(300)


@BOOK.add("WITH s AS (SELECT o_custkey % 50 AS grp, o_orderkey AS id, o_orderkey % 997 AS start, o_orderkey % 997 + o_custkey % 5 AS stop FROM orders) SELECT a.id FROM s a WHERE a.id % 2 = 0 AND EXISTS (SELECT 1 FROM s b WHERE b.id % 2 = 1 AND a.grp = b.grp AND a.start <= b.stop AND b.start <= a.stop)")
def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("grp"), k.alias("id"), (k % 997).alias("start"), (k % 997 + F.col("o_custkey") % 5).alias("stop"))
    return intervals.range_join(s.filter("id % 2 = 0"), s.filter("id % 2 = 1"), ["grp"], 16, "left_semi").select("id")


@BOOK.add()
def noisy_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedgewing.operators.simulate import noisy

    reads = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.repeat(F.lit("ACGT"), 25).alias("seq"))
    n = noisy(reads, "p_partkey", "seq", 0.05, 0.02, 0.02)
    return n.select("p_partkey", F.length("noisy").alias("length"), F.levenshtein("seq", "noisy").alias("edits"))


@BOOK.add()
def stream_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fragments of their users, replayed behind a frontier; what it has not passed stays held."""
    from sedgewing.plans.streams import _replayed
    from sedgewing.streaming.dedup import mark_streaming

    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = e.select(F.col("user_id").alias("part"), F.lit(0).alias("ref_id"), at.alias("pos"), (F.floor(at / 3600) * 3600).cast("long").alias("coord"), F.col("event_type").alias("orient"), F.lit(False).alias("paired"), F.round("value").cast("long").alias("score"), F.col("event_id").cast("string").alias("name"), F.col("event_id").alias("rank"))
    return _replayed(spark, mark_streaming(rows, "part", 7200), "marked").groupBy("is_dup").agg(F.count(F.lit(1)).alias("n"))
