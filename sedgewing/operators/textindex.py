"""What full-text indexes answer, over texts in a table: suffix order, common prefixes, places of patterns, unique depths, Bloom
filters, tries. Suffixes are ranked by doubling, in rounds of joins and global ranks, so no text is one task's alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgewing.functions import arithmetic
from sedgewing.operators import ordered
from sedgewing.scratch import written


#: Letters by which suffixes are ranked first.
HEAD = 16


def suffix_array(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, rank): the place of each suffix in the order of all; equal suffixes of different texts go by id."""
    letters = F.filter(F.split(text_col, ""), lambda c: c != "")
    heads = F.transform(F.array(letters), lambda s: F.transform(s, lambda c, i: F.array_join(F.slice(s, i + 1, HEAD), "")))
    first = written(texts.select(F.col(id_col).alias("id"), F.posexplode(F.flatten(heads)).alias("at", "c")), "heads")
    names = ordered.running_sum(first.groupBy("c").agg(F.count(F.lit(1)).alias("n")), ["c"], F.col("n"), "r")
    now = written(first.join(names, "c").select("id", "at", "r"), "suffixes")
    k = HEAD
    while True:
        after = now.select("id", (F.col("at") - k).alias("at"), F.col("r").alias("r2"))
        pairs = now.join(after, ["id", "at"], "left").withColumn("r2", F.coalesce("r2", F.lit(-1).cast("long")))
        keys = written(pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")), "pairs")
        names = ordered.running_sum(keys, ["r", "r2"], F.col("n"), "upto").select("r", "r2", F.col("upto").alias("new"), "n")
        now = written(pairs.join(names, ["r", "r2"]).select("id", "at", F.col("new").alias("r")), "suffixes")
        if keys.filter("n > 1").isEmpty():
            break
        k *= 2
        longest = texts.agg(F.max(F.length(text_col))).first()[0] or 0
        if k > longest:
            break
    return ordered.numbered(now, ["r", "id", "at"], "rank").select("id", "at", "rank")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings, by halving."""
    top = F.least(F.length(a), F.length(b))
    state = F.struct(F.lit(0).alias("lo"), top.alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), state, step, lambda s: s["lo"])


def lcp_array(texts: DataFrame, id_col: str, text_col: str, suffixes: DataFrame | None = None) -> DataFrame:
    """(id, at, rank, lcp): the common prefix with the suffix before."""
    sa = suffixes if suffixes is not None else suffix_array(texts, id_col, text_col)
    before = sa.select((F.col("rank") + 1).alias("rank"), F.col("id").alias("_i"), F.col("at").alias("_a"))
    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    both = sa.join(before, "rank", "left").join(t, "id").join(t.withColumnsRenamed({"id": "_i", "_t": "_u"}), "_i", "left")
    end = lambda s, at: F.substring(F.col(s), (F.col(at) + 1).cast("int"), F.length(s))
    return both.select("id", "at", "rank", F.coalesce(common_prefix(end("_t", "at"), end("_u", "_a")), F.lit(0)).alias("lcp"))


def unique_depths(lcp: DataFrame) -> DataFrame:
    """(id, at, depth): length of the shortest string that starts there and nowhere else, in no suffix before or after."""
    after = lcp.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("_n"))
    return lcp.join(after, "rank", "left").select("id", "at", (F.greatest("lcp", F.coalesce("_n", F.lit(0))) + 1).alias("depth"))


def places(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, pattern: str, k: int) -> DataFrame:
    """(id, pattern, at): every place of patterns of at least k letters, by a join on their first k; only windows that may be among them
    become rows."""
    from sedgewing.operators.kmers import windows_among

    p = patterns.select(F.col(pattern).alias("pattern")).distinct().filter(F.length("pattern") >= k).withColumn("kmer", F.substring("pattern", 1, k))
    found = windows_among(texts, id_col, text_col, k, p.select("kmer")).join(p, "kmer").join(texts.select(id_col, F.col(text_col).alias("_t")), id_col)
    return found.filter(F.substring(F.col("_t"), F.col("at") + 1, F.length("pattern")) == F.col("pattern")).select(F.col(id_col).alias("id"), "pattern", "at")


def places_within(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, pattern: str, mismatches: int, both_strands: bool = False) -> DataFrame:
    """(id, pattern, strand, at, distance): places where a pattern lies with at most so many mismatches. Patterns are cut into
    mismatches + 1 parts, one of which must be there unchanged; all places of the parts are then counted exactly."""
    from sedgewing.functions.sequences import kmers, reverse_complement
    from sedgewing.operators.kmers import hamming

    p = patterns.select(F.col(pattern).alias("pattern")).distinct()
    q = p.select("pattern", F.lit(0).alias("strand"), F.col("pattern").alias("_q"))
    if both_strands:
        q = q.unionByName(p.select("pattern", F.lit(1).alias("strand"), reverse_complement(F.col("pattern")).alias("_q")))
    parts = mismatches + 1
    size = F.floor(F.length("_q") / parts).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct((i * size).alias("off"), F.substring(F.col("_q"), i * size + 1, size).alias("kmer")))
    q = q.filter(size >= 1).withColumn("_size", size).withColumn("_p", F.explode(pieces)).select("pattern", "strand", "_q", "_size", "_p.off", "_p.kmer")
    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    w = t.crossJoin(F.broadcast(q.select("_size").distinct()))  # a row for each length of piece
    w = w.select("id", "_size", F.posexplode(kmers(F.col("_t"), F.col("_size"))).alias("_w", "kmer"))
    found = w.join(q, ["_size", "kmer"]).select("id", "pattern", "strand", "_q", (F.col("_w") - F.col("off")).alias("at"))
    found = found.filter("at >= 0").distinct().join(t, "id").withColumn("_s", F.substring(F.col("_t"), F.col("at") + 1, F.length("_q"))).filter(F.length("_s") == F.length("_q"))
    return found.withColumn("distance", hamming(F.col("_s"), F.col("_q"))).filter(F.col("distance") <= mismatches).select("id", "pattern", "strand", "at", "distance")


def symbol_rank(chars: DataFrame, order: str, symbol: str, keys: list[str]) -> DataFrame:
    """chars with the number of earlier rows of the same symbol (rank of the symbol at its place)."""
    w = Window.partitionBy(*keys, symbol).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chars.withColumn("rank", F.count(F.lit(1)).over(w))


class Bloom:
    """A Bloom filter over a column: a bitmap table of buckets, built and probed with built-in functions."""

    def __init__(self, keys: DataFrame, key: str, n: int, p: float = 0.01):
        size = keys.sparkSession.range(1).select(arithmetic.bloom_bits(F.lit(float(max(1, n))), p).alias("m"))
        size = size.select("m", arithmetic.bloom_hashes(F.col("m"), F.lit(float(max(1, n)))).alias("k")).first()
        self.bits, self.hashes = max(32768, size["m"]), size["k"]
        places = keys.select(F.explode(self._places(F.col(key))).alias("_p"))
        self.table = places.groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))

    def _places(self, key: Column) -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)])

    def contains(self, rows: DataFrame, key: str, out: str = "maybe") -> DataFrame:
        """rows with a flag: false means that the key was surely never put in."""
        asked = rows.select(key).distinct().withColumn("_p", F.explode(self._places(F.col(key)))).withColumn("_bucket", F.bitmap_bucket_number("_p")).withColumn("_at", F.bitmap_bit_position("_p"))
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright("_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("_at").bitwiseAND(7) + 1).cast("int"))) != 0
        flags = asked.join(self.table, "_bucket", "left").groupBy(key).agg(F.min(F.coalesce(bit, F.lit(False))).alias(out))
        return rows.join(flags, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def dictionary_ids(strings: DataFrame, col: str, out: str = "id") -> DataFrame:
    """(string, id): ids of the distinct strings in their order, as a trie or string hash gives them."""
    return ordered.numbered(strings.select(col).distinct(), [col], out)
