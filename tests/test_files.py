"""Files in ranges, long-read formats, exact numbers, skewed keys and long intervals."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewing.functions import cigar as C
from sedgewing.functions import numbers
from sedgewing.operators import dedup, folds, intervals, kmers, skew
from sedgewing.sources import files, longreads


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_records_of_ranges_come_once(spark, tmp_path, size):
    rng = random.Random(size)
    reads = [(f"r{i} x", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 9)))) for i in range(20)]
    (tmp_path / "a.fq").write_text("".join(f"@{n}\n{s}\n+\n{'@' + 'I' * (len(s) - 1)}\n" for n, s in reads))
    got = files.fastq_in_ranges(files.ranges(spark, str(tmp_path / "a.fq"), size)).collect()
    assert sorted((r["id"], r["seq"]) for r in got) == sorted(reads)
    (tmp_path / "a.fa").write_text("".join(f">{n}\n{s}\n{s}\n" for n, s in reads))
    got = files.fasta_in_ranges(files.ranges(spark, str(tmp_path / "a.fa"), size)).collect()
    assert sorted((r["id"], r["seq"]) for r in got) == sorted((n, s + s) for n, s in reads)


def test_empty_files_have_no_ranges(spark, tmp_path):
    (tmp_path / "a.fq").write_text("")
    assert files.ranges(spark, str(tmp_path / "a.fq"), 10).count() == 0


def test_overlap_files(spark, tmp_path):
    rng = random.Random(2)
    rows = [{"aread": a, "bread": rng.randint(0, 9), "inv": rng.random() < 0.5, "abpos": 10, "aepos": 250, "bbpos": 3, "bepos": 240, "diffs": 7, "trace": [{"err": 1, "blen": 90}] * rng.randint(0, 3)} for a in (0, 0, 2, 5, 5, 5)]
    for tspace in (100, 500):
        data = longreads.overlap_file(rows, tspace)
        (tmp_path / f"{tspace}.las").write_bytes(data)
        got = [r.asDict(recursive=True) for r in longreads.read_overlaps(spark, str(tmp_path / f"{tspace}.las")).collect()]
        assert got == rows
        index = longreads.overlap_index(spark, str(tmp_path / f"{tspace}.las"))
        assert [(r["aread"], r["n"]) for r in index.orderBy("aread").collect()] == [(0, 2), (2, 1), (5, 3)]
        assert longreads.overlaps_of_reads(index, 2, 5).count() == 1 and longreads.overlaps_of_reads(index, 6, 9).count() == 0


def test_databases(spark, tmp_path):
    rng = random.Random(3)
    reads = [(i, i * 2, i % 3, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 11)))) for i in range(25)]
    index, bases = longreads.database_files(reads)
    notes, data = longreads.track_files([[i, -i] if i % 2 else [] for i in range(25)])
    for name, content in (("i", index), ("b", bases), ("n", notes), ("d", data)):
        (tmp_path / name).write_bytes(content)
    for per in (1, 4, 100):
        got = longreads.read_database(spark, str(tmp_path / "i"), str(tmp_path / "b"), per).orderBy("read_id").collect()
        assert [(r["origin"], r["fpulse"], r["flags"], r["bases"]) for r in got] == reads
        track = longreads.read_track(spark, str(tmp_path / "n"), str(tmp_path / "d"), per).orderBy("read_id").collect()
        assert [list(r["track"]) for r in track] == [[i, -i] if i % 2 else [] for i in range(25)]


def test_packed_numbers():
    rng = random.Random(4)
    for bits in (1, 5, 17, 60):
        v = [rng.randrange(1 << bits) for _ in range(rng.randint(0, 40))]
        assert files.unpacked_numbers(files.packed_numbers(v, bits)).tolist() == v


def test_written_files_and_schemes(spark, tmp_path):
    rows = spark.createDataFrame([("a", bytearray(b"12")), ("b", bytearray(b""))], "name string, content binary")
    out = files.write_files(rows, f"file://{tmp_path}/out")
    assert sorted((r["path"].rpartition("/")[2], r["bytes"]) for r in out.collect()) == [("a", 2), ("b", 0)]
    assert (tmp_path / "out" / "a").read_bytes() == b"12"
    assert files.contents(spark, files.keep_in_memory("x", b"abc")).first()["length"] == 3


def test_exact_numbers(spark):
    rng = random.Random(5)
    pairs = [tuple(rng.randint(-(10**6), 10**6) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long, c long, d long")
    x, y = numbers.rational(F.col("a"), F.col("b")), numbers.rational(F.col("c"), F.col("d"))
    for r in df.select("*", numbers.plus(x, y).alias("s"), numbers.times(x, y).alias("p")).collect():
        if r["b"] and r["d"]:
            s, p = Fraction(r["a"], r["b"]) + Fraction(r["c"], r["d"]), Fraction(r["a"], r["b"]) * Fraction(r["c"], r["d"])
            assert (int(r["s"]["num"]), int(r["s"]["den"])) == (s.numerator, s.denominator)
            assert (int(r["p"]["num"]), int(r["p"]["den"])) == (p.numerator, p.denominator)
    assert numbers.bernoulli_numbers(6) == [1, Fraction(-1, 2), Fraction(1, 6), 0, Fraction(-1, 30), 0, Fraction(1, 42)]
    got = spark.range(1, 30).select("id", *[numbers.power_sum(p, F.col("id")).cast("string").alias(f"p{p}") for p in (0, 1, 5, 8)]).collect()
    for r in got:
        assert [int(r[f"p{p}"]) for p in (0, 1, 5, 8)] == [sum(i**p for i in range(1, r["id"] + 1)) for p in (0, 1, 5, 8)]


def test_long_convolutions(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(-9, 9, 300).tolist(), rng.integers(-9, 9, 200).tolist()
    got = spark.createDataFrame([(a, b), ([], b), (None, b)], "a array<long>, b array<long>").select(numbers.convolution("a", "b").alias("p")).collect()
    assert [r["p"] for r in got] == [np.convolve(a, b).tolist(), [], None]


def test_hot_keys_are_joined_without_a_shuffle_of_their_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7 + 1).alias("k"), (F.col("id") * 37 % 101).alias("score"), F.col("id").alias("i"))
    want = {}
    for r in rows.collect():
        want[r["k"]] = max(want.get(r["k"], (-1, 0)), (r["score"], -r["i"]))
    best = rows.groupBy("k").agg(F.max_by("i", F.struct("score", -F.col("i"))).alias("_best"), F.count(F.lit(1)).alias("_n"))
    out = skew.with_key_rows(rows, best, ["k"], "_n", least=1000)
    assert out.count() == 3000 and {r["k"]: r["_best"] for r in out.collect()} == {k: -i for k, (_, i) in want.items()}
    assert {r["i"] for r in dedup.mark_best(rows, ["k"], "score", "i").filter("NOT is_dup").collect()} == {-i for _, i in want.values()}


def test_long_intervals_take_few_bins(spark):
    rng = random.Random(7)
    make = lambda n: [(rng.randint(0, 2), i, s, s + rng.choice([0, 3, 40, 5000, 10**7]) - (i % 11 == 0)) for i in range(n) for s in [rng.randint(0, 10**7)]]
    a, b = make(120), make(120)
    schema = "g int, id int, start long, stop long"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r["id"], r["id_b"]) for r in intervals.range_join(da, db, ["g"], 8).collect()) == want
    assert intervals._binned(da, 8, intervals._highest(8, da)).count() < 120 * 90
    points = spark.createDataFrame([(g, p) for g in range(3) for p in range(0, 2 * 10**7, 999_983)], "g int, p long")
    hits = {(r["g"], r["p"]): r["hits"] for r in intervals.stab(points, da, ["g"], "p", 8).collect()}
    assert hits == {(g, p): sum(x[0] == g and x[2] <= p <= x[3] for x in a) for g, p in hits}


def test_measures_of_cigars_agree_with_single_ones(spark):
    texts = ["", "*", "5S10M2I3D4M6H", "3H2S4=1X2N7=9S", "2D3I4M", "7S", "4H3M1P2M"]
    c = C.parse(F.col("t"))
    single = {"read": C.read_length, "reference": C.reference_length, "front_soft": C.front_soft_clip, "front_hard": C.front_hard_clip, "back_soft": C.back_soft_clip, "back_hard": C.back_hard_clip, "before_match": C.offset_before_match}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.measures(c).alias("m"), *[f(c).alias(n) for n, f in single.items()], C.reference_advance(c).alias("advance"))
    for r in df.collect():
        if "M" in r["t"] or "=" in r["t"]:
            assert {n: r["m"][n] for n in single} == {n: r[n] for n in single}, r["t"]
            assert r["m"]["reference"] - r["m"]["before_advance"] == r["advance"], r["t"]


def test_windows_among_stored_ones(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("abé日") for _ in range(rng.randint(0, 60)))) for i in range(20)] + [(20, None)]
    df = spark.createDataFrame(texts, "id int, t string")
    stored = {t[k : k + 4] for _, t in texts[:3] for k in range(len(t) - 3)}
    wanted = spark.createDataFrame([(x,) for x in sorted(stored)], "kmer string")
    want = sorted((i, k, t[k : k + 4]) for i, t in texts if t for k in range(len(t) - 3) if t[k : k + 4] in stored)
    for most in (1 << 20, 3):
        got = kmers.windows_among(df, "id", "t", 4, wanted, most).join(wanted, "kmer").select("id", "at", "kmer").collect()
        assert sorted(tuple(r) for r in got) == want


def test_needles(spark):
    t = spark.createDataFrame([("find the need in the haystack",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(folds.needle_prefix("needlene")(F.col("t"))).collect()] == [4, 0, None]
