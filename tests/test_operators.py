"""Operators over small rows, against values worked out by hand or by plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sedgewing.operators import aligners, asof, checksums, clustering, dedup, folds, graph, histograms, intervals, kmers, ordered, overlaps, pairing, pileup, textindex


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_pairs_keep_best_score_then_smallest_index(spark):
    df = spark.createDataFrame([(1, 50, 3), (1, 60, 2), (1, 60, 1), (2, 5, 9)], "k int, score long, idx1 long")
    assert rows(dedup.mark_pairs(df, keys=["k"]), "idx1", "is_dup") == [(1, False), (2, True), (3, True), (9, False)]


def test_fragments_lose_against_pairs(spark):
    df = spark.createDataFrame([(1, True, 1, 1), (1, False, 9, 2), (1, False, 8, 3), (2, False, 4, 4), (2, False, 4, 5), (3, True, 1, 6)], "k int, is_pair boolean, score long, idx1 long")
    assert rows(dedup.mark_fragments(df, keys=["k"]), "idx1", "is_dup") == [(1, False), (2, True), (3, True), (4, False), (5, True), (6, False)]


def test_metrics(spark):
    one = spark.range(1).select(dedup.percent_duplication(F.lit(10), F.lit(20), F.lit(1), F.lit(3)), dedup.library_size(F.lit(100), F.lit(100)), dedup.library_size(F.lit(1000), F.lit(900))).first()
    assert one[0] == pytest.approx(0.14)
    assert one[1] == -1
    n, c, x = 1000, 900, one[2]
    import math

    assert abs(c / x - (1 - math.exp(-n / x))) < 1e-3


def test_optical(spark):
    df = spark.createDataFrame([(1, 0, 1, 10, 10, 1), (1, 0, 1, 100, 50, 2), (1, 0, 1, 300, 50, 3), (1, 0, 0, 10, 10, 4), (1, 0, 1, 190, 120, 5)], "k int, rg int, tile int, x long, y long, idx1 long")
    assert rows(dedup.mark_optical(df, keys=["k"]), "idx1", "is_optical") == [(1, False), (2, True), (3, False), (4, False), (5, True)]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 9, 9), (1, 8, 7)], "g int, start long, stop long")
    assert rows(intervals.merged(df, ["g"], 1), "start", "stop") == [(1, 6), (9, 9)]
    assert rows(intervals.merged(df, ["g"], 0), "start", "stop") == [(1, 3), (4, 6), (9, 9)]
    a = spark.createDataFrame([(1, 7, 1, 10)], "g int, id long, start long, stop long")
    b = spark.createDataFrame([(1, 3, 4), (1, 5, 6)], "g int, start long, stop long")
    assert rows(intervals.difference(a, b, ["g"], "id", 4), "start", "stop") == [(1, 2), (7, 10)]


def test_stabbing(spark):
    union = [(50, 61), (57, 69), (20, 39), (1000, 1047)]
    df = spark.createDataFrame([(1, a, b) for a, b in union], "g int, start long, stop long")
    points = spark.range(1100).select(F.lit(1).alias("g"), F.col("id").alias("p"))
    hit = {r["p"] for r in intervals.stab(points, df, ["g"], "p", 16).filter("hits > 0").collect()}
    assert hit == {*range(20, 40), *range(50, 70), *range(1000, 1048)}


@pytest.mark.parametrize("stretch", [None, 10])
@pytest.mark.parametrize(("strict", "direction"), [(False, "backward"), (True, "backward"), (False, "forward"), (True, "forward")])
def test_asof(spark, stretch, strict, direction):
    rng = random.Random(3)
    left, right = sorted(rng.sample(range(100), 30)), sorted(rng.sample(range(100), 12))
    l = spark.createDataFrame([(1, x) for x in left], "k int, at long")  # noqa: E741
    r = spark.createDataFrame([(1, x, x * 10) for x in right], "k int, at long, v long")
    got = dict(rows(asof.asof_join(l, r, ["k"], "at", "v", stretch, strict, direction), "at", "v"))
    for x in left:
        if direction == "backward":
            want = max((y for y in right if y < x or y == x and not strict), default=None)
        else:
            want = min((y for y in right if y > x or y == x and not strict), default=None)
        assert got[x] == (None if want is None else want * 10)


def test_largest_smaller_gives_the_minimum_where_none_is(spark):
    q, i = spark.createDataFrame([(1,), (5,), (9,)], "key long"), spark.createDataFrame([(5,), (7,)], "key long")
    assert rows(asof.largest_smaller(q, i, "key"), "key", "found") == [(1, 5), (5, 5), (9, 7)]


def test_histogram(spark):
    h = histograms.histogram(spark.createDataFrame([(1,), (1,), (2,), (5,)], "v long"), "v")
    assert tuple(histograms.summary(h).first()) == (4, 9, 2.25, 2)
    assert rows(histograms.merged(h, h), "value", "n") == [(1, 4), (2, 2), (5, 2)]
    one = histograms.n_statistic(spark.createDataFrame([(1, 5)], "o long, n long"), ["o"], "n", 50, 100).first()
    assert tuple(one) == (5.0, 5.0)
    none = histograms.n_statistic(spark.createDataFrame([], "o long, n long"), ["o"], "n", 50, 100).first()
    assert tuple(none) == (0.0, 0.0)


def test_ordered(spark):
    df = spark.createDataFrame([(i, (i * 7) % 10) for i in range(40)], "i long, v long")
    sums = dict(rows(ordered.exclusive_sums(df, ["i"], "v", "s"), "i", "s"))
    assert all(sums[i] == sum((j * 7) % 10 for j in range(i)) for i in range(40))
    assert rows(ordered.at_positions(df, ["i"], [3, 39]), "i", "rank") == [(3, 3), (39, 39)]
    assert tuple(ordered.is_sorted(df, "i", [F.col("i")]).first()) == (True, 0)
    assert ordered.is_sorted(df, "i", [F.col("v")]).first()[0] is False


def test_kmers(spark):
    df = spark.createDataFrame([(1, "ACGTAC")], "id long, s string")
    counts = dict(rows(kmers.count(df, "s", 2), "kmer", "n"))
    assert counts == {"AC": 4, "CG": 2, "GT": 3, "TA": 2} or sum(counts.values()) == 10
    assert rows(kmers.repeats(df, "id", "s", 2), "kmer", "n") == [("AC", 2)]
    assert kmers.repeats(df, "id", "s", 2).first()["places"] == [0, 4]


def test_adapter_search(spark):
    reads = spark.createDataFrame([(1, "TTTTACGTACGGAATT"), (2, "CCCCCCCCCCCC")], "id long, s string")
    adapters = spark.createDataFrame([(7, "ACGTACGGAA")], "adapter long, seq string")
    hit = kmers.adapter_hits(reads, adapters, "id", "s", 5, 5, 0.5, 0.5, both_strands=False)
    assert rows(hit, "id", "adapter", "offset", "score") == [(1, 7, -4, 10)]


def test_checksums_do_not_depend_on_order(spark):
    data = [(1, f"{i:032x}") for i in (2**128 - 1, 2, 7)]
    for d in (data, data[::-1]):
        assert rows(checksums.sums(spark.createDataFrame(d, "k int, h string"), ["k"], "h", 128), "n", "checksum") == [(3, f"{8:032x}")]
    got = rows(checksums.products(spark.createDataFrame(data, "k int, h string"), ["k"], "h", 97), "n", "checksum")
    want = 1
    for _, h in data:
        want = want * (int(h, 16) % 97 or 1) % 97
    assert got == [(3, f"{want:x}")]


def test_strong_components(spark):
    edges = "0-1 1-2 2-3 3-0 2-4 4-2 3-4 4-5 5-6 6-5 5-9 9-5 6-7 7-8 8-9 9-6 9-10 10-9"
    df = spark.createDataFrame([tuple(map(int, e.split("-"))) for e in edges.split()], "src long, dst long")
    got = dict(rows(graph.strong_components(df, spark.range(11).select(F.col("id").alias("node"))), "node", "component"))
    assert got == {**{i: 0 for i in range(5)}, **{i: 5 for i in range(5, 11)}}


def test_topological_order(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    ok, pos = graph.topological_positions(df, nodes)
    assert ok and rows(pos, "node", "position") == [(1, 0), (2, 1), (3, 2)]
    assert graph.levels(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"), nodes)[0] is False


def test_reachable_holds_its_root(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (4, 1)], "src long, dst long")
    assert rows(graph.reachable(df, spark.createDataFrame([(1,)], "node long")), "node", "depth") == [(1, 0), (2, 1), (3, 2)]


def test_pairing(spark):
    df = spark.createDataFrame([("a", 65, 1), ("a", 129, 2), ("b", 65, 3), ("c", 129, 4), ("d", 0, 5)], "name string, flags int, rank long")
    got = rows(pairing.mates(df), "name", "kind", F.col("a.rank"), F.col("b.rank"))
    assert got == [("a", "pair", 1, 2), ("b", "orphan1", 3, None), ("c", "orphan2", None, 4), ("d", "single", 5, None)]


def test_insert_size(spark):
    from sedgewing.functions.cigar import parse

    df = spark.createDataFrame([(0, 16, 100, 200)], "fa int, fb int, pa int, pb int")
    side = lambda f, p: F.struct(F.col(f).alias("flags"), F.lit(1).alias("ref_id"), F.col(p).alias("pos"), parse(F.lit("50M")).alias("cigar"))
    assert df.select(side("fa", "pa").alias("a"), side("fb", "pb").alias("b")).select(pairing.insert_size("a", "b")).first()[0] == 149


def test_alignments_agree_with_distances():
    rng = random.Random(5)

    def brute(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(0, 12))) for _ in range(2))
        score, _, _, _, _, trace = aligners.align_global(a, b)
        assert -score == brute(a, b) == len(trace) - trace.count("=")
        assert len(a) == len(trace) - trace.count("I") and len(b) == len(trace) - trace.count("D")
        s, i, j, k, m, trace = aligners.align_local(a, b)
        assert s == trace.count("=") - trace.count("X") - 3 * (trace.count("I") + trace.count("D")) and j - i == len(trace) - trace.count("I")
        n = aligners.common_substring(a, b)[0]
        assert n == max((y - x for x in range(len(a) + 1) for y in range(x, len(a) + 1) if a[x:y] in b), default=0)
        if a:
            ends = {e for e, _ in aligners.find_approximate(a, b, 1)}
            assert ends == {e for e in range(1, len(b) + 1) if min(brute(a, b[s:e]) for s in range(e + 1)) <= 1}


def test_overlap_alignment():
    assert aligners.align_overlap("TTACGT", "ACGTGG")[:5] == (4, 2, 6, 0, 4)
    assert aligners.common_subsequence("ABCBDAB", "BDCABA")[0] == 4


def test_folds():
    assert folds.increasing_subsequence([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert folds.increasing_from([3, 1, 2]) == ([1, 2, 1], [-1, 2, -1])
    assert folds.previous_smaller([2, 1, 3, 3]) == [-1, -1, 1, 1]
    assert folds.border_array("abacaba") == [0, 0, 1, 0, 1, 2, 3]
    assert folds.longest_prefix_match("needlene", "find the need in the haystack") == (9, 4)


def test_trace_folds(spark):
    t = F.lit("==XX===I=")
    one = spark.range(1).select(folds.window_error(t, 3), folds.last_good_window(t, 3, 0), folds.longest_match(t), folds.best_score(t, 1, -2), folds.low_quality(t, 3, 1), folds.diagonals(t)).first()
    assert one[0] == 2 and one[1] == 7 and tuple(one[2]) == (4, 7) and tuple(one[3]) == (3, 4, 7)
    assert [tuple(x) for x in one[4]] == [(1, 5)]
    assert [tuple(x) for x in one[5]] == [(-1, 1), (0, 5)]


def test_chains(spark):
    df = spark.createDataFrame([(1, 0, 0, 5), (1, 10, 10, 5), (1, 3, 50, 4)], "k int, start_a long, start_b long, length long")
    assert rows(folds.chains(df, ["k"]), "chain", "start_a", "score") == [(0, 0, 10.0), (0, 10, 10.0), (1, 3, 4.0)]


def test_split_blocks_is_greedy(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([6, 6, 3, 20, 1])], "i long, n long")
    assert rows(folds.split_blocks(df, "i", "n", 10), "block", "low", "high", "size") == [(0, 0, 1, 6), (1, 1, 3, 9), (2, 3, 4, 20), (3, 4, 5, 1)]


def test_md_round_trip():
    ref, seq, cig = "ACGTACGTAC", "ACTTACAC", "6M2D2M"
    md, nm = pileup.md_of(cig, seq, ref)
    assert (md, nm) == ("2G3^GT2", 3)
    assert pileup.reference_from_md(cig, seq, md) == ref
    assert pileup.recoded(cig, seq, ref) == "2=1X3=2D2="
    assert pileup.checks("2=1X3=2D2=", seq, ref) and not pileup.checks("6=2D2=", seq, ref)
    with pytest.raises(ValueError):
        pileup.reference_from_md("4M", "ACGT", "2?1")


def test_pileup(spark):
    from sedgewing.functions.cigar import parse

    df = spark.createDataFrame([(1, 0, 10, "ACGTA", "1S2=1I1D1=")], "rank long, ref_id int, pos int, seq string, c string").withColumn("cigar", parse(F.col("c")))
    assert rows(pileup.explode(df), "ref_pos", "predif", "read_pos", "symbol") == [(10, 0, 1, "C"), (11, 0, 2, "G"), (12, -1, 3, "T"), (12, 0, 4, "-"), (13, 0, 4, "A")]


def test_suffix_array(spark):
    texts = {1: "banana", 2: "bandana" * 6, 3: "é日本"}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    want = sorted((t[i:], k, i) for k, t in texts.items() for i in range(len(t)))
    got = [(r["id"], r["at"]) for r in textindex.suffix_array(df, "id", "t").orderBy("rank").collect()]
    assert got == [(k, i) for _, k, i in want]


def test_mismatched_places(spark):
    texts = spark.createDataFrame([(1, "AAAACGTTTTACCTAA")], "id long, t string")
    patterns = spark.createDataFrame([("ACGT",)], "p string")
    assert rows(textindex.places_within(texts, patterns, "id", "t", "p", 1), "at", "distance") == [(3, 0), (10, 1)]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).select((F.col("id") * 3).alias("k"))
    marked = textindex.Bloom(keys, "k", 2000).contains(spark.range(6000).select(F.col("id").alias("k")), "k")
    assert marked.filter("k % 3 = 0 AND NOT maybe").isEmpty()
    assert marked.filter("k % 3 <> 0 AND maybe").count() < 400


def test_silhouette_counts_the_point_itself(spark):
    v = [([0.0], 0), ([1.0], 0), ([10.0], 1), ([12.0], 1)]
    got = clustering.silhouette(spark.createDataFrame(v, "v array<double>, c int"), "v", "c").first()[0]
    d = lambda x, c: sum((x - y[0]) ** 2 for y, k in v if k == c) / 2
    want = sum((d(x[0], 1 - c) - d(x[0], c)) / max(d(x[0], 1 - c), d(x[0], c)) for x, c in v) / 4
    assert got == pytest.approx(want)


def test_kmeans_finds_clear_groups(spark):
    df = spark.createDataFrame([(i, [float(i % 3 * 100 + i % 5), 0.0]) for i in range(60)], "i long, v array<double>")
    centres, error = clustering.kmeans(df, "v", 3, restarts=3, id_col="i")
    assert sorted(round(c[0]) for c in centres) == [2, 102, 202] and error == pytest.approx(120.0)


def test_overlaps(spark):
    reads = spark.createDataFrame([(1, 100), (2, 100)], "read_id long, rlen int")
    o = spark.createDataFrame([(1, 2, False, 10, 60, 0, 50, 3), (2, 1, False, 0, 50, 10, 60, 3), (1, 2, True, 0, 20, 0, 20, 1)], "aread long, bread long, inv boolean, abpos int, aepos int, bbpos int, bepos int, diffs int")
    assert rows(overlaps.asymmetric(o, reads), "aread", "inv") == [(1, True)]
    t = spark.createDataFrame([(1, 2, False, 95, 230, 7, 140, [(1, 5), (2, 98), (0, 30)])], "aread long, bread long, inv boolean, abpos int, aepos int, bbpos int, bepos int, trace array<struct<err:int,blen:int>>")
    assert rows(overlaps.trace_points(t, 100), "apos", "bpos") == [(95, 7), (100, 12), (200, 110), (230, 140)]
    assert t.select(overlaps.trace_fits(F.col("trace"), F.col("bbpos"), F.col("bepos"))).first()[0]


def test_draws(spark):
    from sedgewing.operators import simulate

    d = spark.range(20_000).select(simulate.uniform(F.col("id")).alias("u"), simulate.normal(5.0, 2.0, F.col("id")).alias("n"), simulate.poisson(3.0, F.col("id")).alias("p"))
    u, n, s, p = d.agg(F.avg("u"), F.avg("n"), F.stddev("n"), F.avg("p")).first()
    assert abs(u - 0.5) < 0.01 and abs(n - 5) < 0.06 and abs(s - 2) < 0.06 and abs(p - 3) < 0.05
    pairs = spark.createDataFrame([(k, r) for k in range(2000) for r in (1, 2)], "k int, r int")
    kept = simulate.subsample(pairs, "k", 1, 4)
    assert 700 < kept.count() < 1300 and kept.groupBy("k").count().filter("count <> 2").isEmpty()
    with pytest.raises(ValueError):
        simulate.subsample(pairs, "k", 2, 1)
    same = spark.createDataFrame([(1, "ACGTACGT")], "k int, s string")
    assert simulate.noisy(same, "k", "s", 0, 0, 0).first()["noisy"] == "ACGTACGT"


def test_rephred():
    got = clustering.rephred({2: 10, 3: 10, 30: 100, 31: 100, 40: 50}, 2)
    assert set(got) == {2, 3, 30, 31, 40} and len(set(got.values())) == 2 and got[30] == got[31] == got[40]


def test_suffix_prefix(spark):
    df = spark.createDataFrame([(1, "TTTTTACGTACGTAA"), (2, "ACGTACGTAAGGGGG"), (3, "CCCCCCCCCCCCCCC")], "id long, s string")
    assert rows(kmers.suffix_prefix(df, "id", "s", 6), "a", "b", "at", "length", "score") == [(1, 2, 5, 10, 10)]


def test_places_of_patterns_of_many_lengths(spark):
    rng = random.Random(12)
    text = "".join(rng.choice("ACGT") for _ in range(400))
    patterns = [(text[n : 3 * n],) for n in range(1, 91)]  # 90 lengths of pieces with one mismatch
    got = textindex.places_within(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, t string"), spark.createDataFrame(patterns, "p string"), "id", "t", "p", 1)
    want = set()
    for (p,) in patterns:
        for i in range(len(text) - len(p) + 1):
            d = sum(x != y for x, y in zip(text[i : i + len(p)], p, strict=True))
            if d <= 1:
                want.add((1, p, i, d))
    found = [(r["id"], r["pattern"], r["at"], r["distance"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len({p for _, p, _, _ in found}) == 90
    assert textindex.places_within(spark.createDataFrame([(1, text)], "id long, t string"), spark.createDataFrame([], "p string"), "id", "t", "p", 1).count() == 0


def test_md_texts_reads_records_at_all_positions(spark, tmp_path):
    from sedgewing.plans import more

    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(300)
    # moved by whole periods of the reference, so that every NM stays as it is
    far = items.withColumn("l_partkey", (F.col("l_partkey") + 60 * 500).cast(items.schema["l_partkey"].dataType))
    items.unionByName(far).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["nm"]: r["n"] for r in more.md_texts(spark, str(tmp_path)).collect()}
    near = items.filter("l_suppkey % 5 > 0").count()
    assert sum(got.values()) == 2 * near and None not in got and all(n % 2 == 0 for n in got.values())
