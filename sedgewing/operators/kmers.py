"""k-mers: counting, repeats, seed joins, adapter search, search with mismatches.

Sequences are exploded into windows; counts are summed on the map side, and joins on k-mers leave frequent ones to Spark's
skew handling."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewing.functions import sequences as S


def windows(df: DataFrame, id_col: str, seq_col: str, k: int) -> DataFrame:
    """(id, at, kmer): all windows, at from 0."""
    return df.select(F.col(id_col), F.posexplode(S.kmers(F.col(seq_col), k)).alias("at", "kmer"))


#: Stored windows up to which their hashes are sent to all tasks (8 bytes each); more are joined.
MOST_STORED = 1 << 20
#: Characters that are hashed at once.
BLOCK = 1 << 19
_ODD = 0x9E3779B97F4A7C15


def _window_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit number of each window of k characters."""
    letters = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    if len(letters) < k:
        return np.zeros(0, np.uint64)
    letters = (letters + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    letters ^= letters >> np.uint64(32)
    up, down = np.full(len(letters), _ODD, np.uint64), np.full(len(letters), pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * np.cumprod(up, dtype=np.uint64), out=sums[1:], dtype=np.uint64)
    return (sums[k:] - sums[:-k]) * np.cumprod(down, dtype=np.uint64)[: len(letters) - k + 1]


def windows_among(df: DataFrame, id_col: str, seq_col: str, k: int, stored: DataFrame, most: int = MOST_STORED) -> DataFrame:
    """(id, at, kmer): the windows that may be among the stored ones (kmer); all that are, and a few that only share a hash of 64
    bits with one. Windows are hashed within a row, and only hits become rows. More than ``most`` stored windows are joined."""
    hashes = stored.select("kmer").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"h": pa.array([int(_window_hashes(x, k)[0]) - (1 << 63) for x in b.column(0).to_pylist() if x and len(x) == k], pa.int64())}) for b in batches), "h long").distinct()
    found = [r[0] for r in hashes.limit(most + 1).collect()]
    if len(found) > most:
        return windows(df, id_col, seq_col, k).join(stored.select("kmer").distinct(), "kmer", "left_semi")
    wanted = np.sort(np.array(found, dtype=np.int64).astype(np.uint64) + np.uint64(1 << 63))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ats, texts = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                for begin in range(0, max(1, len(text) - k + 1), BLOCK):
                    h = _window_hashes(text[begin : begin + BLOCK + k - 1], k)
                    place = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                    for i in np.flatnonzero(wanted[place] == h).tolist() if len(wanted) else ():
                        rows.append(r)
                        ats.append(begin + i)
                        texts.append(text[begin + i : begin + i + k])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ats, pa.int32()), pa.array(texts, pa.string())], names=["id", "at", "kmer"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.filter(F.col(seq_col).isNotNull()).select(F.col(id_col), F.col(seq_col)).mapInArrow(run, f"id {kind}, at int, kmer string")
    return out.withColumnRenamed("id", id_col)


def count(df: DataFrame, seq_col: str, k: int, both_strands: bool = True) -> DataFrame:
    """(kmer, n). On both strands each window counts for itself and for its reverse complement."""
    own = S.kmers(F.col(seq_col), k)
    every = F.concat(own, F.transform(own, S.reverse_complement)) if both_strands else own
    return df.select(F.explode(every).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def repeats(df: DataFrame, id_col: str, seq_col: str, k: int, least: int = 2) -> DataFrame:
    """(id, kmer, n, places): windows that occur so often in one sequence. Only repeated ones gather their places."""
    found = windows(df, id_col, seq_col, k).groupBy(id_col, "kmer").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("at")).alias("places"))
    return found.filter(F.col("n") >= least)


def seeds(a: DataFrame, b: DataFrame, id_a: str, seq_a: str, id_b: str, seq_b: str, k: int, max_count: int | None = None) -> DataFrame:
    """(id_a, id_b, at_a, at_b): equal windows. With ``max_count`` windows more frequent in b are left out, as a parameter of the
    search; nothing else is."""
    left = windows(a, id_a, seq_a, k).withColumnsRenamed({id_a: "id_a", "at": "at_a"})
    right = windows(b, id_b, seq_b, k).withColumnsRenamed({id_b: "id_b", "at": "at_b"})
    if max_count is not None:
        right = right.join(right.groupBy("kmer").count().filter(F.col("count") > max_count).select("kmer"), "kmer", "left_anti")
    return left.join(right, "kmer")


def bands(found: DataFrame, k: int, log_width: int = 6) -> DataFrame:
    """(id_a, id_b, band, n, covered): seeds by diagonal band; covered is the number of bases of a that the seeds touch."""
    diagonal = F.col("at_a") - F.col("at_b")
    cells = found.withColumn("band", F.shiftright(diagonal, log_width)).groupBy("id_a", "id_b", "band").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("at_a")).alias("_at"))
    step = lambda s, x: F.struct((s["n"] + F.least(F.lit(k), x - s["last"])).alias("n"), x.alias("last"))
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last")), step, lambda s: s["n"])
    return cells.select("id_a", "id_b", "band", "n", covered.alias("covered"))


def exact_matches(found: DataFrame, k: int) -> DataFrame:
    """(id_a, id_b, start_a, start_b, length): maximal runs of seeds on one diagonal."""
    from pyspark.sql import Window

    diag = F.col("at_a") - F.col("at_b")
    w = Window.partitionBy("id_a", "id_b", "_d").orderBy("at_a")
    runs = found.withColumn("_d", diag).withColumn("_r", F.col("at_a") - F.row_number().over(w))
    out = runs.groupBy("id_a", "id_b", "_d", "_r").agg(F.min("at_a").alias("start_a"), F.min("at_b").alias("start_b"), (F.count(F.lit(1)) + k - 1).alias("length"))
    return out.drop("_d", "_r")


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x != y), lambda d: d))


#: Choices of places up to which k-mers are joined without those places.
MOST_MASKS = 32


def neighbours(queries: DataFrame, stored: DataFrame, kmer: str, mismatches: int, k: int) -> DataFrame:
    """(query, kmer, distance): stored k-mers within so many mismatches of a query. Where there are few choices of so many places, k-mers
    are joined by what is left without them, which only neighbours share. Else they are cut into mismatches + 1 parts, one of which must
    agree; pairs are found by that part and then counted exactly."""
    if 0 < mismatches < k and comb(k, mismatches) <= MOST_MASKS:
        left = lambda gone: F.concat(*[F.substring(F.col(kmer), i + 1, 1) for i in range(k) if i not in gone])
        masks = F.array(*[F.struct(F.lit(i).alias("mask"), left(gone).alias("rest")) for i, gone in enumerate(combinations(range(k), mismatches))])
        side = lambda d, c: d.select(F.col(kmer).alias(c), F.explode(masks).alias("_m")).select(c, F.col("_m.mask").alias("_mask"), F.col("_m.rest").alias("_rest"))
        near = side(queries, "query").join(side(stored, "kmer"), ["_mask", "_rest"]).select("query", "kmer").distinct()
        return near.withColumn("distance", hamming(F.col("query"), F.col("kmer"))).filter(F.col("distance") <= mismatches)
    parts = mismatches + 1
    cuts = [k * i // parts for i in range(parts + 1)]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.substring(F.col(kmer), cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("piece")) for i in range(parts)])
    q = queries.select(F.col(kmer).alias("query"), F.explode(keys).alias("_key"))
    s = stored.select(F.col(kmer).alias("kmer"), F.explode(F.transform(keys, lambda x: x)).alias("_key"))
    return q.join(s, "_key").drop("_key").distinct().withColumn("distance", hamming(F.col("query"), F.col("kmer"))).filter(F.col("distance") <= mismatches)


def best_segment(a: Column, b: Column, match: int = 1, mismatch: int = -2) -> Column:
    """(score, start, stop) of the best run of two strings laid side by side; the first of equal ones."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    n = F.least(F.length(a), F.length(b))
    gains = F.zip_with(letters(F.substring(a, F.lit(1), n)), letters(F.substring(b, F.lit(1), n)), lambda x, y: F.when(x == y, match).otherwise(mismatch))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"), F.lit(0).alias("from"), F.lit(-1).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("stop"))

    def step(s: Column, g: Column) -> Column:
        total, i = s["sum"] + g, s["i"] + 1
        fell = total < 0
        now, since = F.when(fell, F.lit(0)).otherwise(total), F.when(fell, i).otherwise(s["from"])
        better = now > s["score"]
        return F.struct(i.alias("i"), now.alias("sum"), since.alias("from"), F.when(better, now).otherwise(s["score"]).alias("score"), F.when(better, since).otherwise(s["start"]).alias("start"), F.when(better, i).otherwise(s["stop"]).alias("stop"))

    return F.aggregate(gains, start, step, lambda s: F.struct(s["score"], s["start"], s["stop"]))


def adapter_hits(reads: DataFrame, adapters: DataFrame, id_col: str, seq_col: str, seed: int, min_score: int, min_fraction: float, min_overlap_fraction: float, both_strands: bool = True) -> DataFrame:
    """(id, adapter, strand, offset, score, frac, pfrac): adapters that lie in reads. Equal seeds give an offset; along it the best
    segment is scored by +1 and -2. ``adapters`` (adapter, seq) is a short list and may be broadcast by Spark; of the reads only windows
    that may be seeds become rows."""
    a = adapters.select("adapter", F.lit(0).alias("strand"), F.col("seq").alias("_adp"))
    if both_strands:
        a = a.unionByName(adapters.select("adapter", F.lit(1).alias("strand"), S.reverse_complement(F.col("seq")).alias("_adp")))
    pieces = a.select("adapter", "strand", "_adp", F.posexplode(S.kmers(F.col("_adp"), seed)).alias("_apos", "kmer"))
    found = windows_among(reads, id_col, seq_col, seed, pieces.select("kmer")).join(pieces, "kmer").select(id_col, "adapter", "strand", (F.col("_apos") - F.col("at")).alias("offset")).distinct()
    found = found.join(a, ["adapter", "strand"]).join(reads.select(id_col, F.col(seq_col).alias("_seq")), id_col)
    in_read, in_adp = F.greatest(-F.col("offset"), F.lit(0)), F.greatest(F.col("offset"), F.lit(0))
    common = F.least(F.length("_seq") - in_read, F.length("_adp") - in_adp)
    piece = lambda s, at: F.substring(F.col(s), at + 1, common)
    found = found.withColumn("_best", best_segment(piece("_adp", in_adp), piece("_seq", in_read))).withColumn("_n", F.col("_best.stop") - F.col("_best.start"))
    out = found.select(id_col, "adapter", "strand", "offset", F.col("_best.score").alias("score"), (F.col("_n") / F.length("_adp")).alias("frac"), (F.col("_n") / common).alias("pfrac"))
    return out.filter((F.col("score") >= min_score) & (F.col("frac") >= min_fraction) & (F.col("pfrac") >= min_overlap_fraction))


def suffix_prefix(reads: DataFrame, id_col: str, seq_col: str, seed: int = 21, match: int = 1, mismatch: int = -3, both_strands: bool = False) -> DataFrame:
    """(a, b, strand, at, length, score): the best overlap of an end of a with a start of b (turned round for strand 1), among
    those that begin with an equal seed. Only first windows of b are joined, so a read gives one row there."""
    r = reads.select(F.col(id_col).alias("b"), F.col(seq_col).alias("_b"), F.lit(0).alias("strand"))
    if both_strands:
        r = r.unionByName(reads.select(F.col(id_col).alias("b"), S.reverse_complement(F.col(seq_col)).alias("_b"), F.lit(1).alias("strand")))
    heads = r.filter(F.length("_b") >= seed).withColumn("kmer", F.substring("_b", 1, seed))
    found = windows(reads, id_col, seq_col, seed).withColumnRenamed(id_col, "a").join(heads, "kmer").filter("a <> b")
    found = found.join(reads.select(F.col(id_col).alias("a"), F.col(seq_col).alias("_a")), "a")
    size = F.length("_a") - F.col("at")
    found = found.filter(size <= F.length("_b")).withColumn("length", size)
    apart = hamming(F.substring(F.col("_a"), F.col("at") + 1, F.col("length")), F.substring(F.col("_b"), F.lit(1), F.col("length")))
    found = found.withColumn("score", match * (F.col("length") - apart) + mismatch * apart).filter("score > 0")
    best = F.max_by(F.struct("at", "length", "score"), F.struct("score", "length"))
    return found.groupBy("a", "b", "strand").agg(best.alias("_x")).select("a", "b", "strand", "_x.at", "_x.length", "_x.score")


def copies_in_windows(df: DataFrame, id_col: str, seq_col: str, k: int, width: int) -> DataFrame:
    """(id, at, copies): how often the k-mer at a place occurs in the next ``width`` places."""
    from pyspark.sql import Window

    w = Window.partitionBy(id_col, "kmer").orderBy("at").rangeBetween(0, width - 1)
    return windows(df, id_col, seq_col, k).withColumn("copies", F.count(F.lit(1)).over(w))
