"""Column functions over stand-in records: flags, CIGARs, coordinates, names, tags, sequences, numbers, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.functions import arithmetic as A
from sedgewing.functions import cigar as C
from sedgewing.functions import coords as K
from sedgewing.functions import digests as D
from sedgewing.functions import flags as G
from sedgewing.functions import names as N
from sedgewing.functions import sequences as S
from sedgewing.functions import tags as T
from sedgewing.plans import Book
from sedgewing.plans.tables import ALIGNMENTS_SQL, alignments, table

BOOK = Book()
_A = f"({ALIGNMENTS_SQL})"


@BOOK.add(f"SELECT rank, cs + ce + ci + cx + ce2 AS read_len, ce + cx + cd + ce2 AS ref_len, cs AS front, ch AS back, cs AS front_soft, CAST(0 AS BIGINT) AS back_soft, CAST(0 AS BIGINT) AS front_hard, ch AS back_hard, ce + cx + cd + ce2 AS advance, CAST(0 AS BIGINT) AS before_match FROM {_A}")
def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda name: F.col(f"m.{name}")
    rows = alignments(spark, sf_dir).select("rank", C.measures(F.col("cigar")).alias("m"))
    return rows.select(
        "rank", m("read").alias("read_len"), m("reference").alias("ref_len"), (m("front_soft") + m("front_hard")).alias("front"), (m("back_soft") + m("back_hard")).alias("back"), m("front_soft").alias("front_soft"), m("back_soft").alias("back_soft"),
        m("front_hard").alias("front_hard"), m("back_hard").alias("back_hard"), (m("reference") - m("before_advance")).alias("advance"), m("before_match").alias("before_match"),
    )


_TEXT = "cs || 'S' || ce || '=' || CASE WHEN ci > 0 THEN ci || 'I' ELSE '' END || CASE WHEN cx > 0 THEN cx || 'X' ELSE '' END || CASE WHEN cd > 0 THEN cd || 'D' ELSE '' END || ce2 || '=' || CASE WHEN ch > 0 THEN ch || 'H' ELSE '' END"


@BOOK.add(f"SELECT rank, {_TEXT} AS cigar, repeat('=', CAST(ce AS INTEGER)) || repeat('I', CAST(ci AS INTEGER)) || repeat('X', CAST(cx AS INTEGER)) || repeat('D', CAST(cd AS INTEGER)) || repeat('=', CAST(ce2 AS INTEGER)) AS trace, true AS same FROM {_A}")
def cigar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cigar")
    return alignments(spark, sf_dir).select("rank", C.to_text(c).alias("cigar"), C.to_trace(c).alias("trace"), (C.parse(C.to_text(c)) == c).alias("same"))


@BOOK.add(f"SELECT rank, round((ce + ce2) / CAST(ce + ce2 + cx + ci + cd AS DOUBLE), 9) AS identity, round((cx + ci + cd) / CAST(ce + ce2 + cx + ci + cd AS DOUBLE), 9) AS error FROM {_A}")
def cigar_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select("rank", F.round(C.identity(F.col("cigar")), 9).alias("identity"), F.round(C.error_rate(F.col("cigar")), 9).alias("error"))


@BOOK.add(f"SELECT op, CAST(sum(n) AS BIGINT) AS bases FROM (SELECT unnest(['S', '=', 'I', 'X', 'D', '=', 'H']) AS op, unnest([cs, ce, ci, cx, cd, ce2, ch]) AS n FROM {_A}) WHERE n > 0 GROUP BY op")
def cigar_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).select(F.explode(C.op_counts(F.col("cigar"))).alias("op", "n")).groupBy("op").agg(F.sum("n").alias("bases"))


@BOOK.add(f"SELECT rank, pos - cs AS unclipped_start, pos + ce + cx + cd + ce2 - 1 + ch AS unclipped_end, CASE WHEN (flags & 16) <> 0 THEN pos + ce + cx + cd + ce2 - 1 + ch ELSE pos - cs END AS five_prime, cs AS covered_from, cs + ce + ci + cx + ce2 - ch - 1 AS covered_to FROM {_A}")
def five_prime_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, pos = F.col("cigar"), F.col("pos")
    covered = C.covered_read_interval(c)
    return alignments(spark, sf_dir).select(
        "rank", C.unclipped_start(pos, c).alias("unclipped_start"), C.unclipped_end(pos, c).alias("unclipped_end"), C.five_prime(pos, c, G.has(F.col("flags"), "REVERSE")).alias("five_prime"), covered["from"].alias("covered_from"), covered["to"].alias("covered_to")
    )


@BOOK.add(f"SELECT rank, CAST(pos + ce + cx + cd AS BIGINT) AS ref_at, ce + ce2 + cx AS aligned FROM {_A}")
def position_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, pos = F.col("cigar"), F.col("pos")
    second = C.length_of(c, ("S", "I", "X")) + F.get(F.filter(c, lambda x: x["op"] == "="), 0)["len"]
    return alignments(spark, sf_dir).select("rank", C.ref_pos_of(pos, c, second).alias("ref_at"), F.size(C.match_pairs(pos, c)).cast("long").alias("aligned"))


_NAMES = " || ".join(f"CASE WHEN (flags & {1 << k}) <> 0 THEN '{n};' ELSE '' END" for k, n in enumerate(G.NAMES[:11]))


@BOOK.add(f"SELECT flags, {_NAMES} AS names, count(*) AS n FROM {_A} GROUP BY ALL")
def flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).groupBy("flags").agg(F.count(F.lit(1)).alias("n")).select("flags", G.to_text(F.col("flags")).alias("names"), "n")


@BOOK.add(f"SELECT flags & 2047 AS mask, count(*) AS n FROM {_A} GROUP BY ALL")
def flag_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace(G.to_text(F.col("flags")), ";$", ""), ";", ",")
    return alignments(spark, sf_dir).groupBy(G.from_text(text).alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def _bin_sql(beg: str, end: str) -> str:
    levels = [(14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)]
    return "CASE " + " ".join(f"WHEN (({beg}) >> {s}) = (({end} - 1) >> {s}) THEN {o} + (({beg}) >> {s})" for s, o in levels) + " ELSE 0 END"


@BOOK.add(f"SELECT rank, CAST({_bin_sql('CAST(pos AS BIGINT) * 50', '(CAST(pos AS BIGINT) * 50 + ce * 1000)')} AS BIGINT) AS bin FROM {_A}")
def genomic_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos").cast("long") * 50
    equal = F.get(F.filter("cigar", lambda x: x["op"] == "="), 0)["len"]
    return alignments(spark, sf_dir).select("rank", K.reg2bin(pos, pos + equal * 1000).alias("bin"))


def _bins_sql() -> str:
    levels = [(29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)]
    n = " + ".join(f"((e - 1) >> {s}) - (b >> {s}) + 1" for s, _ in levels)
    return f"SELECT rank, CAST({n} AS INTEGER) AS n_bins, CAST(4681 + ((e - 1) >> 14) AS BIGINT) AS last_bin FROM (SELECT rank, CAST(pos AS BIGINT) * 50 AS b, CAST(pos AS BIGINT) * 50 + ce * 10000 AS e FROM {_A})"


@BOOK.add(_bins_sql())
def genomic_bin_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos").cast("long") * 50
    equal = F.get(F.filter("cigar", lambda x: x["op"] == "="), 0)["len"]
    bins = K.reg2bins(pos, pos + equal * 10000)
    return alignments(spark, sf_dir).select("rank", F.size(bins).alias("n_bins"), F.element_at(bins, -1).alias("last_bin"))


@BOOK.add(f"SELECT rank, CAST(pos AS BIGINT) - 1 AS start, CAST(pos AS BIGINT) + 999 AS stop FROM {_A}")
def range_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos").cast("long")
    text = F.concat(F.lit("chr:"), F.col("ref_id"), F.lit(":"), F.format_number(pos, 0), F.lit("-"), pos + 999)
    return alignments(spark, sf_dir).select("rank", K.parse_range(text).alias("r")).select("rank", "r.start", F.col("r.end").alias("stop"))


@BOOK.add(f"SELECT rank FROM {_A} WHERE ref_id = 2 AND pos + ce + cx + cd + ce2 > 3000 AND pos <= 9000")
def range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("pos") + C.reference_length(F.col("cigar"))
    return alignments(spark, sf_dir).filter((F.col("ref_id") == 2) & K.in_interval(F.col("pos"), end, F.lit(3000), F.lit(9000))).select("rank")


@BOOK.add("SELECT c_custkey, regexp_matches(c_name, '^[!-?A-~]{1,255}$') AS valid, regexp_extract(c_name, '^([^#]*)', 1) AS head, CAST(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) + 1 AS BIGINT) AS tile FROM customer")
def name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    number = F.regexp_extract("c_name", "([0-9]+)$", 1)
    tile = N.tile_fields(F.concat_ws(":", F.lit("run"), number, F.lit("7"), F.lit("9")))
    return c.select("c_custkey", N.valid(F.col("c_name")).alias("valid"), N.strip_slash(F.regexp_replace("c_name", "#", "/")).alias("head"), tile["tile"].alias("tile"))


@BOOK.add("SELECT o_orderkey, o_orderpriority AS pr, o_orderstatus AS st, '2' AS n_tags FROM orders")
def tag_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("PR"), F.col("o_orderpriority"), F.lit("XX"), F.lit("0"))
    tags = T.put(T.drop(tags, ["XX"]), "ST", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.get(tags, "PR").alias("pr"), T.get_any_case(tags, "st").alias("st"), F.size(T.names(T.ordered(tags))).cast("string").alias("n_tags"))


@BOOK.add("SELECT doc_id, reverse(translate(t, 'ACGTacgtMRWSYKVHDBNmrwsykvhdbnUu', 'TGCAtgcaKYWSRMBDHVNkywsrmbdhvnAa')) AS rc, CAST(length(t) AS BIGINT) AS n, regexp_matches(t, '[^ACGT]') AS other FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", S.reverse_complement(t).alias("rc"), F.length(t).cast("long").alias("n"), S.has_other_bases(t).alias("other"))


@BOOK.add("SELECT p_partkey, CAST(list_sum(list_filter([ascii(c) - 33 FOR c IN string_split(p_name, '')], lambda q: q >= 70)) AS BIGINT) AS score FROM part WHERE len(list_filter([ascii(c) - 33 FOR c IN string_split(p_name, '')], lambda q: q >= 70)) > 0")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.base_score(S.qualities(F.col("p_name")), 70).alias("score")).filter("score > 0")


@BOOK.add("SELECT p_partkey, CAST(gcd(p_partkey, p_size * 12) AS BIGINT) AS gcd, CAST(floor(sqrt(p_partkey)) AS BIGINT) AS root, CAST(bit_count(p_partkey) AS INTEGER) AS ones, CAST(length(ltrim(bin(p_partkey), '0')) AS INTEGER) AS bits, CAST(p_size AS BIGINT) * 1024 AS unit FROM part WHERE p_partkey > 0")
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey > 0").select(
        "p_partkey", A.gcd(k, F.col("p_size") * 12).alias("gcd"), A.isqrt(k).alias("root"), A.popcount(k).alias("ones"), A.bit_length(k).alias("bits"), A.unit_number(F.concat(F.col("p_size").cast("string"), F.lit("k"))).alias("unit")
    )


@BOOK.add("SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", *[D.digest(n, t).alias(n) for n in ("md5", "sha1", "sha256")])


@BOOK.add()
def other_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("c_name", F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", *[D.digest(n, t).alias(n) for n in ("crc32", "crc32c", "sha3_256", "murmur3", "sha224", "sha384", "sha512")])


@BOOK.add("SELECT item_id, CAST(i AS INTEGER) AS start, substr(text, i + 1, 60) AS piece FROM (SELECT item_id, text, unnest(range(0, length(text) - 59, 25)) AS i FROM benchmark)")
def shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(S.shreds(F.col("text"), 60, 25)).alias("_s")).select("item_id", "_s.start", "_s.piece")
