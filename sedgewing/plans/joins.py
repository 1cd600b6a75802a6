"""Pairing, interval, as-of and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.functions import flags as G
from sedgewing.operators import asof, intervals, ordered, overlaps, pairing
from sedgewing.plans import Book
from sedgewing.plans.tables import ALIGNMENTS_SQL, ORDER, OVERLAPS_SQL, SPANS_SQL, alignments, item_order, order_spans, table
from sedgewing.plans.tables import overlaps as overlap_table

BOOK = Book()
_A = f"({ALIGNMENTS_SQL})"


@BOOK.add("""
    SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.t, b.t) AS pair, a.turn AS first_turn, b.turn AS second_turn,
           CASE WHEN a.turn IS NULL THEN 'orphan2' WHEN b.turn IS NULL THEN 'orphan1' ELSE 'pair' END AS kind
    FROM (SELECT *, turn // 2 AS t FROM conversations WHERE turn % 2 = 0) a FULL JOIN (SELECT *, turn // 2 AS t FROM conversations WHERE turn % 2 = 1) b ON a.conv_id = b.conv_id AND a.t = b.t""")
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).cast("long").alias("pair"))
    both = pairing.pair_rows(rows, ["conv_id", "pair"], F.col("turn") % 2 == 0, F.col("turn") % 2 == 1)
    return both.select("conv_id", "pair", F.col("a.turn").alias("first_turn"), F.col("b.turn").alias("second_turn"), "kind")


_FIRST = f"SELECT * FROM {_A} WHERE (flags & 2304) = 0 AND (flags & 64) <> 0 AND rank % 3 <> 0"
_SECOND = f"SELECT * FROM {_A} WHERE (flags & 2304) = 0 AND (flags & 128) <> 0 AND rank % 3 <> 1"


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the reads of an order one first and one second at most, so that names pair them."""
    t = alignments(spark, sf_dir, *item_order())
    first = G.has(F.col("flags"), "READ1")
    primary = t.filter(~G.has(F.col("flags"), "SECONDARY", "SUPPLEMENTARY"))
    best = primary.groupBy("name", first.alias("one")).agg(F.min_by(F.struct(*t.drop(*ORDER).columns), F.struct(*ORDER)).alias("_r")).select("_r.*")
    return best


_BEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, (flags & 64) <> 0 ORDER BY rank) AS rn FROM {_A} WHERE (flags & 2304) = 0) WHERE rn = 1"
_PAIRS = f"(SELECT * FROM ({_BEST}) WHERE (flags & 64) <> 0) a {{join}} JOIN (SELECT * FROM ({_BEST}) WHERE (flags & 64) = 0) b ON a.name = b.name"


@BOOK.add(f"SELECT coalesce(a.name, b.name) AS name, a.rank AS rank1, b.rank AS rank2, CASE WHEN a.rank IS NULL THEN 'orphan2' WHEN b.rank IS NULL THEN 'orphan1' ELSE 'pair' END AS kind FROM {_PAIRS.format(join='FULL')}")
def mate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.mates(_mates(spark, sf_dir)).select("name", F.col("a.rank").alias("rank1"), F.col("b.rank").alias("rank2"), "kind")


_FIVE = lambda r: f"CASE WHEN ({r}.flags & 16) <> 0 THEN {r}.pos + {r}.ce + {r}.cx + {r}.cd + {r}.ce2 - 1 + {r}.ch ELSE {r}.pos - {r}.cs END"


@BOOK.add(f"SELECT a.name, CASE WHEN (a.flags & 4) <> 0 OR (b.flags & 4) <> 0 OR a.ref_id <> b.ref_id THEN 0 ELSE {_FIVE('b')} - {_FIVE('a')} END AS insert_size FROM {_PAIRS.format(join='')}")
def insert_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairing.mates(_mates(spark, sf_dir)).filter("kind = 'pair'")
    return both.select("name", pairing.insert_size("a", "b").alias("insert_size"))


def _fixed_sql() -> str:
    def side(o: str, t: str, sign: str) -> str:
        uo, ut = f"(({o}.flags & 4) <> 0)", f"(({t}.flags & 4) <> 0)"
        bit = f"(({o}.flags & ~40) | CASE WHEN ({t}.flags & 16) <> 0 THEN 32 ELSE 0 END | CASE WHEN {ut} THEN 8 ELSE 0 END)"
        pick = lambda c: f"CASE WHEN {uo} AND {ut} THEN -1 WHEN {uo} THEN {t}.{c} ELSE {o}.{c} END"
        nxt = lambda c: f"CASE WHEN {uo} AND {ut} THEN -1 WHEN {ut} THEN {o}.{c} ELSE {t}.{c} END"
        size = f"CASE WHEN {uo} OR {ut} OR a.ref_id <> b.ref_id THEN 0 ELSE {_FIVE('b')} - {_FIVE('a')} END"
        return f"SELECT {o}.rank, CAST({bit} AS INTEGER) AS flags, {pick('ref_id')} AS ref_id, {pick('pos')} AS pos, {nxt('ref_id')} AS next_ref, {nxt('pos')} AS next_pos, CAST({sign}({size}) AS BIGINT) AS tlen FROM {_PAIRS.format(join='')}"

    return side("a", "b", "") + " UNION ALL " + side("b", "a", "-")


@BOOK.add(_fixed_sql())
def fixed_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairing.with_mate(pairing.mates(_mates(spark, sf_dir)).filter("kind = 'pair'"))
    out = both.select("a.*").unionByName(both.select("b.*"))
    return out.select("rank", "flags", "ref_id", "pos", "next_ref", "next_pos", "tlen")


@BOOK.add(f"SELECT a.rank, b.score AS ms, {_FIVE('b')} AS mc FROM {_PAIRS.format(join='')} UNION ALL SELECT b.rank, a.score AS ms, {_FIVE('a')} AS mc FROM {_PAIRS.format(join='')}")
def mate_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.mate_tags(pairing.mates(_mates(spark, sf_dir)).filter("kind = 'pair'")).select("rank", "ms", "mc")


@BOOK.add("SELECT c_custkey, coalesce(n_regionkey, -1) AS rg_id, CASE WHEN n_nationkey IS NULL THEN -1 ELSE n_nationkey % 4 END AS library_id FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("rg_id"), (F.col("n_nationkey") % 4).alias("library_id"))
    return pairing.with_library(table(spark, sf_dir, "customer").withColumn("rg", F.col("c_nationkey")), groups).select("c_custkey", "rg_id", "library_id")


_MERGE = """
    WITH s AS ({spans}), m AS (SELECT *, max(stop) OVER (PARTITION BY grp ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s WHERE start <= stop),
    i AS (SELECT *, sum(CASE WHEN seen IS NULL OR seen + {gap} < start THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT grp, min(start) AS start, max(stop) AS stop FROM i GROUP BY grp, island"""


@BOOK.add(_MERGE.format(spans=SPANS_SQL, gap=0))
def interval_merge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(order_spans(spark, sf_dir), ["grp"], 0, width=64)


@BOOK.add(_MERGE.format(spans=SPANS_SQL, gap=1))
def interval_merge_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(order_spans(spark, sf_dir), ["grp"], 1)


@BOOK.add(_MERGE.format(spans=SPANS_SQL, gap=7))
def interval_merge_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(order_spans(spark, sf_dir), ["grp"], 7, width=100)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every span is on one side: those of odd line numbers and those of even ones."""
    s = order_spans(spark, sf_dir)
    return s.filter("line % 2 = 1").drop("line"), s.filter("line % 2 = 0").drop("line")


@BOOK.add(f"""
    WITH s AS ({SPANS_SQL}), a AS (SELECT * FROM s WHERE line % 2 = 1), days AS (SELECT grp, id, unnest(range(start, stop + 1)) AS d FROM a),
    left_over AS (SELECT grp, id, d FROM days WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.line % 2 = 0 AND b.grp = days.grp AND b.start <= d AND d <= b.stop)),
    r AS (SELECT *, d - row_number() OVER (PARTITION BY id ORDER BY d) AS run FROM left_over)
    SELECT grp, id, min(d) AS start, max(d) AS stop FROM r GROUP BY grp, id, run""")
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return intervals.difference(a, b, ["grp"], "id", 64)


@BOOK.add(f"WITH s AS ({SPANS_SQL}) SELECT a.grp, a.id, b.id AS id_b FROM s a JOIN s b ON a.grp = b.grp AND a.line % 2 = 1 AND b.line % 2 = 0 AND a.start <= b.stop AND b.start <= a.stop")
def range_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return intervals.range_join(a, b, ["grp"], 64).select("grp", "id", "id_b")


@BOOK.add(f"WITH s AS ({SPANS_SQL}) SELECT a.id, a.start AS point, (SELECT count(*) FROM s b WHERE b.line % 2 = 0 AND b.grp = a.grp AND b.start <= a.start AND a.start <= b.stop) AS hits FROM s a WHERE a.line % 2 = 1")
def stab_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return intervals.stab(a.select("grp", "id", F.col("start").alias("point")), b, ["grp"], "point", 64).select("id", "point", "hits")


@BOOK.add("SELECT o_orderkey, CAST((o_totalprice >= 50000)::INT + (o_totalprice >= 100000)::INT + (o_totalprice >= 300000)::INT AS INTEGER) AS leaf FROM orders")
def interval_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.leaf_of(table(spark, sf_dir, "orders"), [0, 50_000, 100_000, 300_000, 1_000_000], "o_totalprice").select("o_orderkey", "leaf")


@BOOK.add("""
    SELECT e.event_id, max_by(p.event_id, struct_pack(t := p.ts, i := p.event_id)) AS last_purchase
    FROM events e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts <= e.ts GROUP BY e.event_id""")
def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    p = e.filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("last_purchase"))
    return asof.asof_join(e.select("event_id", "user_id", "at"), p, ["user_id"], "at", "last_purchase", stretch=3_600_000_000 * 24).select("event_id", "last_purchase")


@BOOK.add("""
    WITH k AS (SELECT DISTINCT c_custkey * 3 AS key FROM customer)
    SELECT o_orderkey, coalesce((SELECT max(key) FROM k WHERE key < o_orderkey), (SELECT min(key) FROM k)) AS found FROM orders""")
def largest_smaller_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("o_orderkey"))
    return asof.largest_smaller(table(spark, sf_dir, "orders").select("o_orderkey"), keys, "o_orderkey", stretch=1000)


@BOOK.add("""
    SELECT o_orderkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS prev,
           min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next
    FROM orders""")
def nearest_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("_f", F.col("o_orderstatus") == "F")
    return ordered.next_set(ordered.previous_set(o, "o_orderkey", "_f", keys=["o_custkey"]), "o_orderkey", "_f", keys=["o_custkey"]).select("o_orderkey", "prev", "next")


@BOOK.add("SELECT doc_id, true AS labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, false AS labelled FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_anti_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return d.join(labels.filter("quality = 1"), "doc_id", "left_semi").withColumn("labelled", F.lit(True)).unionByName(d.join(labels, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@BOOK.add("""
    (SELECT 'except' AS kind, o_custkey AS k FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))
    UNION ALL (SELECT 'intersect', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))
    UNION ALL (SELECT 'union', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))""")
def set_except_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    f, g = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    name = lambda d, n: d.select(F.lit(n).alias("kind"), "k")
    return name(f.exceptAll(g), "except").unionByName(name(f.intersectAll(g), "intersect")).unionByName(name(f.unionByName(g).distinct(), "union"))


@BOOK.add(f"SELECT aread, bread, inv, abpos, aepos, bbpos, bepos, round(diffs / CAST(aepos - abpos AS DOUBLE), 9) AS rate FROM (SELECT DISTINCT ON (aread, bread, inv, abpos, aepos, bbpos, bepos) * FROM ({OVERLAPS_SQL}) ORDER BY aread, bread, inv, abpos, aepos, bbpos, bepos, diffs)")
def overlap_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.unique(overlap_table(spark, sf_dir)).select(*overlaps.KEY, F.round(overlaps.error_rate(F.col("diffs"), F.col("abpos"), F.col("aepos")), 9).alias("rate"))


@BOOK.add(f"SELECT aread, bread, count(*) AS n, CAST(sum(diffs) AS BIGINT) AS diffs, min(abpos) AS low FROM ({OVERLAPS_SQL}) WHERE aread >= 100 AND aread < 900 GROUP BY aread, bread")
def overlap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.of_reads(overlap_table(spark, sf_dir), 100, 900).groupBy("aread", "bread").agg(F.count(F.lit(1)).alias("n"), F.sum("diffs").alias("diffs"), F.min("abpos").alias("low"))


@BOOK.add(f"""
    WITH o AS ({OVERLAPS_SQL}), f AS (SELECT aread, bread, inv, abpos, aepos, bbpos, bepos, diffs FROM o),
    s AS (SELECT bread AS aread, aread AS bread, inv, CASE WHEN inv THEN 1000 - bepos ELSE bbpos END AS abpos, CASE WHEN inv THEN 1000 - bbpos ELSE bepos END AS aepos,
          CASE WHEN inv THEN 2000 - aepos ELSE abpos END AS bbpos, CASE WHEN inv THEN 2000 - abpos ELSE aepos END AS bepos, diffs FROM o)
    SELECT count(*) AS missing FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM s)""")
def overlap_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads below 1000 as b have 1000 bases, as a 2000: the stand-in has no read table."""
    o = overlap_table(spark, sf_dir)
    shifted = o.withColumn("bread", -F.col("bread") - 1)
    reads = o.select(F.col("aread").alias("read_id")).distinct().withColumn("rlen", F.lit(2000)).unionByName(shifted.select(F.col("bread").alias("read_id")).distinct().withColumn("rlen", F.lit(1000)))
    turned = overlaps.swapped(shifted, reads).withColumn("aread", -F.col("aread") - 1)
    return o.select(*overlaps.KEY, "diffs").exceptAll(turned.select(*overlaps.KEY, "diffs")).agg(F.count(F.lit(1)).alias("missing"))
