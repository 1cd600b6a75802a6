"""What larger tables hold that small ones do not: numbers beyond 63 bits, places beyond a bin, ties, copies, long references."""

from __future__ import annotations

import math
import random
import sys

import pytest
from pyspark.sql import functions as F

from sedgewing import scratch
from sedgewing.functions import arithmetic, coords, numbers
from sedgewing.operators import aligners, clustering, folds, graph, kmers, overlaps, pileup, textindex
from sedgewing.plans import aggregates, columns, files, joins, tables
from sedgewing.sources import bam


def test_item_numbers_beyond_63_bits(spark):
    rows = [(149_999, 19_999, 999, 7, 50.0), (1_800_000, 5, 6, 1, 1.0), (9_000_000, 1_200_000, 60_000, 7, 50.0), (54_000_000, 7_200_000, 360_000, 3, 9.0), (10**11, 1, 1, 1, 2.0)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    exact = [(((o * 8 + n) * 1_000_000 + p) * 10_000 + s) * 64 + int(q) for o, p, s, n, q in rows]
    got = [r[0] for r in df.select(tables.item_number()).collect()]
    assert got == [(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in exact]
    assert got[0] == exact[0]


def test_md_of_records_in_all_pieces_and_without_a_reference(spark, monkeypatch):
    monkeypatch.setattr(pileup, "PIECE", 8)
    bases = "".join("ACGT"[(i * i + i // 3) % 4] for i in range(101))
    records = [(i, 0, i, [(5, "=")], bases[i : i + 5]) for i in range(97)] + [(200, 0, 20, [(2, "="), (30, "N"), (3, "=")], bases[20:22] + bases[52:55]), (201, -1, 3, [(2, "=")], "AC"), (202, 7, 3, [(2, "=")], "AC"), (203, 0, -1, [(2, "=")], "AC")]
    df = spark.createDataFrame(records, "rank long, ref_id int, pos int, cigar array<struct<len:int,op:string>>, seq string")
    out = pileup.with_md(df, spark.createDataFrame([(0, bases), (1, "")], "ref_id int, bases string"))
    got = {r["rank"]: (r["md"], r["nm"]) for r in out.collect()}
    assert got == {i: ("5", 0) for i in range(97)} | {200: ("5", 0)} | {i: (None, None) for i in (201, 202, 203)}


def test_bins_with_a_widest_level(spark):
    cut = F.struct(coords.reg2bin(F.col("a"), F.col("b")).alias("all"), coords.reg2bin(F.col("a"), F.col("b"), widest=3).alias("three"))
    df = spark.createDataFrame([((1 << 20) - 5, (1 << 20) + 5), ((3 << 20) - 5, (3 << 20) + 5), (100, 200), ((1 << 17) - 1, (1 << 17) + 1)], "a long, b long").select("a", cut.alias("c"))
    got = [(r["c"]["all"], r["c"]["three"]) for r in df.collect()]
    assert got == [(9, 73), (9, 75), (4681, 4681), (73, 73)]
    rows = spark.createDataFrame([(0, (1 << 20) - 5, 10)], "ref_id int, pos int, n int")
    assert [r["bin"] for r in coords.binning_index(rows, F.col("n"), widest=3).collect()] == [73]


def test_prices_between_two_centres(spark, tmp_path):
    prices = [49_999.99, 50_000.0, 50_000.01, 174_999.99, 175_000.0, 325_000.0, 0.0, 500_000.0]
    spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    assert [r["cluster"] for r in aggregates.quantised(spark, str(tmp_path)).orderBy("o_orderkey").collect()] == [0, 1, 1, 1, 2, 3, 0, 3]
    df = spark.createDataFrame([([5.0],)], "v array<double>")
    assert clustering.quantised(df, "v", [[0.0], [10.0]]).first()["cluster"] == 0


def test_each_pair_of_strings_is_aligned_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def counted(a, b):
        calls.add(1)
        return aligners.align_global(a, b)

    rows = [(i, x, y) for i, (x, y) in enumerate([("abc", "abd"), ("abc", "xbc"), ("", "ab"), (None, "a"), ("a", None)] * 40)]
    df = spark.createDataFrame(rows, "i int, x string, y string")
    want = [tuple(r) for r in aligners.aligned(df, "x", "y").select("i", "alignment.*").orderBy("i").collect()]
    for most in (100, 1):
        monkeypatch.setattr(aligners, "MOST_BROADCAST", most)
        before = calls.value
        got = aligners.aligned_once(df, "x", "y", counted).select("i", "alignment.*").orderBy("i").collect()
        assert [tuple(r) for r in got] == want and calls.value - before == 3


def _one_by_one(seqs):
    seqs = sorted(seqs, key=lambda s: (-len(s), s))
    columns = [{c: 1} for c in seqs[0]]
    for n, s in enumerate(seqs[1:], 1):
        now = "".join(max(sorted(c), key=lambda x: (c[x], x != "-")) for c in columns)
        trace, i, j, out = aligners.align_global(now.replace("-", "\x00"), s)[5], 0, 0, []
        for op in trace:
            if op == "I":
                out.append({"-": n, s[j]: 1})
                j += 1
                continue
            letter = "-" if op == "D" else s[j]
            columns[i][letter] = columns[i].get(letter, 0) + 1
            out.append(columns[i])
            i, j = i + 1, j + (op != "D")
        columns = out
    return "".join(max(sorted(c), key=lambda x: c[x]) for c in columns).replace("-", "")


def test_consensus_of_many_copies(spark, monkeypatch):
    draw = random.Random(7)
    for _ in range(150):
        some = ["".join(draw.choice("ACG") for _ in range(draw.randint(1, 8))) for _ in range(draw.randint(1, 5))]
        copies = [draw.randint(1, 12) for _ in some]
        whole = {}
        for s, k in zip(some, copies, strict=True):
            whole[s] = whole.get(s, 0) + k
        assert aligners._consensus(list(whole.items())) == _one_by_one([s for s, k in whole.items() for _ in range(k)])
    runs, align = [], aligners.align_global
    monkeypatch.setattr(aligners, "align_global", lambda a, b: runs.append(1) or align(a, b))
    assert aligners._consensus([("ACGTAC", 100_000), ("ACGTAN", 20_000)]) == "ACGTAC" and len(runs) < 10
    df = spark.createDataFrame([(1, "ACGT"), (1, "ACGT"), (1, "ACG"), (1, None), (2, None), (3, "")], "g int, s string")
    assert sorted(tuple(r) for r in aligners.consensus(df, "g", "s").collect()) == [(1, "ACGT", 3), (2, "", 0), (3, "", 0)]


def test_neighbours_meet_only_neighbours(spark):
    words = [f"{a}{b}{c}{d}" for a in "ab" for b in "abc" for c in "ab" for d in "abcd"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for mismatches in (1, 2):
        got = [tuple(r) for r in kmers.neighbours(df, df, "w", mismatches, 4).collect()]
        want = {(x, y, n) for x in words for y in words if (n := sum(p != q for p, q in zip(x, y, strict=True))) <= mismatches}
        assert len(got) == len(set(got)) and set(got) == want
    # the join gives no pair that is none
    plan = kmers.neighbours(df, df, "w", 1, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "_rest" in plan


def test_only_stored_windows_become_rows(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all windows became rows")

    monkeypatch.setattr(kmers, "windows", refuse)
    texts = spark.createDataFrame([(1, "xxabcdeabcdfyy"), (2, None), (3, "abc"), (4, "zzz\U0001f600abcde")], "id long, t string")
    p = spark.createDataFrame([("abcde",), ("abcd",), ("ab",)], "p string")
    assert sorted(tuple(r) for r in textindex.places(texts, p, "id", "t", "p", 4).collect()) == [(1, "abcd", 2), (1, "abcd", 7), (1, "abcde", 2), (4, "abcd", 4), (4, "abcde", 4)]
    adapters = spark.createDataFrame([(7, "abcde")], "adapter long, seq string")
    got = kmers.adapter_hits(texts, adapters, "id", "t", 4, 4, 0.5, 0.5, both_strands=False)
    assert sorted(tuple(r)[:5] for r in got.collect()) == [(1, 7, 0, -7, 4), (1, 7, 0, -2, 5), (4, 7, 0, -4, 5)]


def test_divisors_of_small_and_large_numbers(spark):
    fib = [1, 1]
    while len(fib) < 185:
        fib.append(fib[-1] + fib[-2])
    draw = random.Random(3)
    pairs = [(fib[i], fib[i - 1]) for i in (5, 40, 80, 86, 90, 120, 170, 180)] + [(fib[79], fib[80]), (0, 5), (5, 0), (0, 0), (10**18 * 6, 4), (-12, 18)]
    pairs += [(g * draw.randrange(1, 10**d), g * draw.randrange(1, 10**d)) for d in (2, 8, 17) for g in (1, 12, 10**6) for _ in range(5)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs] + [(None, "3"), ("3", None)], "a string, b string")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    got = [r[0] for r in df.select(numbers._gcd(whole("a"), whole("b"))).collect()]
    assert [None if x is None else int(x) for x in got] == [math.gcd(a, b) for a, b in pairs] + [None, None]
    small = [(a, b) for a, b in pairs if max(abs(a), abs(b)) < 1 << 63]
    assert [r[0] for r in spark.createDataFrame(small, "a long, b long").select(arithmetic.gcd(F.col("a"), F.col("b"))).collect()] == [math.gcd(a, b) for a, b in small]


def test_traces_of_a_batch(spark):
    draw = random.Random(5)
    traces = [None, "", "=", "X", "\u00e9=\U0001f600", *["".join(draw.choice("==XID") for _ in range(draw.randint(0, 30))) for _ in range(200)], ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(traces)], "i int, t string").repartition(3)
    e = folds.positive_ends(F.col("t"), 1, -2)
    got = df.select("i", folds.window_error(F.col("t"), 4).alias("most"), e.alias("e")).orderBy("i").collect()

    def score(t):
        return sum(1 if c == "=" else -2 for c in t)

    for t, r in zip(traces, got, strict=True):
        if t is None:
            assert r["most"] is None and r["e"] is None
            continue
        n = len(t)
        assert r["most"] == max([sum(c != "=" for c in t[max(0, k - 4) : k]) for k in range(1, n + 1)], default=0)
        assert tuple(r["e"]) == (max([k for k in range(1, n + 1) if score(t[:k]) > 0], default=0), min([k for k in range(n) if score(t[k:]) > 0], default=n))


def test_costly_rows_of_one_file_are_dealt_out(spark, tmp_path):
    from sedgewing.plans import blocks, more, orders

    spark.range(1000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for query in (orders.window_errors, blocks.positive_ends, more.noisy_reads):
        used = query(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert len(used) >= 4 and sum(r["count"] for r in used) == 1000


def test_overlap_files_are_written_one_by_one(spark, tmp_path):
    from sedgewing.sources import longreads

    df = spark.range(600).select((F.col("id") % 30).alias("aread"), F.col("id").alias("bread"), F.lit(False).alias("inv"), *[F.lit(n).alias(c) for c, n in (("abpos", 0), ("aepos", 100), ("bbpos", 5), ("bepos", 95), ("diffs", 1))], F.array(F.struct(F.lit(1).alias("err"), F.lit(90).alias("blen"))).alias("trace"))
    folder = f"file://{tmp_path}/las"
    done = longreads.write_overlap_files(df.withColumn("block", F.floor(F.col("aread") / 8)), 100, "block", folder)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in done.collect()) == [f"overlaps.{k}.las" for k in range(4)]
    got = longreads.read_overlaps(spark, folder).select("aread", "bread")
    assert sorted(map(tuple, got.collect())) == sorted((i % 30, i) for i in range(600))


def test_diagonals_of_elements_of_any_length(spark):
    cigar = "array<struct<len:int,op:string>>"
    rows = [([(5, "S"), (1_000_000_000, "="), (3, "D"), (7, "="), (3, "I"), (2, "X"), (1_000_000_000, "="), (4, "H")],), ([(3, "X")],), ([],)]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame(rows, f"c {cigar}").select(folds.cigar_diagonals(F.col("c"))).collect()]
    assert got == [[(0, 2_000_000_000), (3, 7)], [], []]


def test_reached_levels_are_put_together_and_nulls_left_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_TABLES", 2)
    names = []
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or scratch.written(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(0, None), (3, None), (None, 4), (9, 2)], "src long, dst long")
    root = spark.createDataFrame([(0,)], "node long")
    assert sorted(map(tuple, graph.reachable(edges, root).collect())) == [(i, i) for i in range(7)]
    assert names.count("edges") == 1 and names.count("reached") == 4
    assert sorted(map(tuple, graph.reachable(edges, root, both_ways=True).collect())) == [(i, i) for i in range(7)] + [(9, 3)]


def test_strong_components_without_a_broadcast(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(i, i + 1) for i in range(100, 120)] + [(120, 110), (None, 5), (5, None)]
    after = {n: {b for a, b in pairs if a == n and b is not None} for n in {x for p in pairs for x in p if x is not None}}

    def reach(n):
        found, todo = {n}, [n]
        while todo:
            for m in after[todo.pop()] - found:
                found.add(m)
                todo.append(m)
        return found

    reached = {n: reach(n) for n in after}
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = graph.strong_components(edges, edges.select(F.col("src").alias("node")).union(edges.select("dst")))
    assert dict(map(tuple, got.collect())) == {n: min(m for m in reached[n] if n in reached[m]) for n in after}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_unique_overlaps_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "UNIQUE_ROWS", 100)
    rows = [(i % 400, i % 7, i % 2 == 0, 100, 200, 50, 150, i % 10, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "aread long, bread long, inv boolean, abpos int, aepos int, bbpos int, bepos int, diffs int, more int")
    least = {}
    for r in rows:
        least[r[:7]] = min(least.get(r[:7], 99), r[7])
    got = overlaps.unique(df.drop("more"))
    assert {tuple(r)[:7]: r["diffs"] for r in got.collect()} == least and got.rdd.getNumPartitions() == 30
    whole = overlaps.unique(df).collect()
    assert {tuple(r)[:7]: r["diffs"] for r in whole} == least and all(tuple(r) in rows for r in whole)


def test_ties_go_by_the_exact_number_beyond_63_bits(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([7, 1_801_439, 1_801_440, 3_602_879, 9_000_000]), rng.randrange(1_200_000), rng.randrange(60_000), rng.randrange(1, 4), float(rng.randrange(1, 51))) for _ in range(300)]
    df = spark.createDataFrame([(*r, 1.0, 0.0, "A", "F") for r in rows], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string")
    exact = sorted((((o * 8 + n) * 1_000_000 + p) * 10_000 + s) * 64 + int(q) for o, p, s, n, q in rows)
    wrapped = [(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in exact]
    got = [r[0] for r in df.orderBy(*tables.item_order()).select(tables.item_number()).collect()]
    assert got == wrapped and got != sorted(got)
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    least = {}
    for o, p, s, n, q in rows:
        if n < 3:
            x = (((o * 8 + n) * 1_000_000 + p) * 10_000 + s) * 64 + int(q)
            least[o, n % 2] = min(least.get((o, n % 2), x), x)
    pairs = joins.mate_pairs(spark, str(tmp_path)).collect()
    want = {(f"r{o}", k): wrapped[exact.index(x)] for (o, k), x in least.items()}
    assert {(r["name"], k): v for r in pairs for k, v in ((1, r["rank1"]), (0, r["rank2"])) if v is not None} == want


#: (order, part, supplier, line, quantity): two at one place whose order the modulus turns, a long one at the highest place of 1 GB, a small one.
ITEMS = [(2_000_000, 5, 6, 2, 3.0), (1_000_000, 5, 6, 2, 3.0), (9_000_000, 1_200_000, 60_000, 7, 50.0), (54_000_000, 7, 11, 1, 50.0), (3, 4, 5, 1, 2.0)]


def _items(spark, tmp_path) -> str:
    """Tables of ITEMS, their orders and no other."""
    day = "TIMESTAMP '2024-01-01'"
    line = spark.createDataFrame(ITEMS, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    line = line.withColumns({"l_extendedprice": F.lit(10.4), "l_discount": F.lit(0.0), "l_returnflag": F.lit("N"), "l_linestatus": F.lit("F"), "l_shipdate": F.expr(f"{day} + INTERVAL 9 DAYS")})
    line.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    line.select(F.col("l_orderkey").alias("o_orderkey"), F.expr(day).alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def _shown(o: int, p: int, s: int, n: int, q: float) -> int:
    return ((((o * 8 + n) * 1_000_000 + p) * 10_000 + s) * 64 + int(q) + (1 << 63)) % (1 << 64) - (1 << 63)


def _elements(o: int, p: int, s: int, n: int, q: float) -> list[tuple[int, str]]:
    return [(int(k), op) for k, op in [(n, "S"), (q, "="), (s % 4, "I"), (p % 3, "X"), (p % 5, "D"), (n + 10, "="), (s % 2, "H")] if k]


def _of(elements: list[tuple[int, str]], ops: str) -> int:
    return sum(k for k, op in elements if op in ops)


def test_binary_files_of_items_beyond_63_bits(spark, tmp_path):
    d = _items(spark, tmp_path)
    got = {r["name"]: tuple(r) for r in files.bam_round_trip(spark, d).collect()}
    want = {}
    for x in ITEMS:
        e, pos = _elements(*x), x[1] * 7
        if pos >> 14 == (pos + _of(e, "=XD") - 1) >> 14:
            want[f"r{x[0]}"] = (_shown(*x), f"r{x[0]}", 65 + 64 * (x[3] % 2 == 0) + 256 * (x[3] >= 3) + 2048 * (x[3] >= 6) + 4 * (x[4] > 48), x[2] % 5 - 1, pos, x[1] % 60, "".join(f"{k}{op}" for k, op in e), 10, _of(e, "S=IX"), 4681 + (pos >> 14))
    assert got == want and len(got) >= 4
    # two records of one place lie by the exact number, though the shown one is negative
    rows = bam.read_bam(spark, files._bam_folder(spark, d)).filter("pos = 35").select("name", F.input_file_name().alias("f"), "rank").orderBy("f", "rank").collect()
    assert [r["name"] for r in rows] == ["r1000000", "r2000000"]


def test_equal_cigars_are_coded_once():
    row = {"name": "r", "flags": 4, "ref_id": -1, "pos": -1, "mapq": 0, "cigar": "3S20=1I", "next_ref_id": -1, "next_pos": -1, "tlen": 0, "seq": "acgtNéRy=", "qual": None, "tags": {}}
    bam._cigar_bytes.cache_clear()
    bam._cigar_text.cache_clear()
    data = bam.file_of(iter([row] * 500), [])
    assert {r[8:] for r in [(*x[:13], str(x[13]), x[14]) for x in bam.records(data)]} == {(-1, -1, 0, "ACGTNNRY=", "*", "[]", None)}
    assert bam._cigar_bytes.cache_info().misses == bam._cigar_text.cache_info().misses == 1


def test_cigars_of_items_beyond_63_bits(spark, tmp_path):
    d = _items(spark, tmp_path)
    lengths, texts = {}, {}
    for x in ITEMS:
        e = _elements(*x)
        ref, hard = _of(e, "=XD"), _of(e, "H")
        lengths[_shown(*x)] = (_of(e, "S=IX"), ref, x[3], hard, x[3], 0, 0, hard, ref, 0)
        texts[_shown(*x)] = ("".join(f"{k}{op}" for k, op in e), "".join(op * k for k, op in e if op in "=IXD"), True)
    assert {r["rank"]: tuple(r)[1:] for r in columns.cigar_lengths(spark, d).collect()} == lengths
    assert {r["rank"]: tuple(r)[1:] for r in columns.cigar_text(spark, d).collect()} == texts


def test_bins_of_items_beyond_63_bits(spark, tmp_path):
    d = _items(spark, tmp_path)
    firsts = [(29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)]
    smallest, lists = {}, {}
    for x in ITEMS:
        b = x[1] * 350
        last = b + int(x[4]) * 1000 - 1
        smallest[_shown(*x)] = next(f + (b >> k) for k, f in reversed(firsts) if b >> k == last >> k)
        last = b + int(x[4]) * 10_000 - 1
        lists[_shown(*x)] = (sum((last >> k) - (b >> k) + 1 for k, _ in firsts), 4681 + (last >> 14))
    assert {r["rank"]: r["bin"] for r in columns.genomic_bins(spark, d).collect()} == smallest
    assert {r["rank"]: tuple(r)[1:] for r in columns.genomic_bin_lists(spark, d).collect()} == lists


def test_difference_of_items_beyond_63_bits(spark, tmp_path):
    # lines 7 and 1 have no other of their supplier: their spans stay whole
    day = 19_723
    got = {r["id"]: tuple(r) for r in joins.interval_difference(spark, _items(spark, tmp_path)).collect()}
    assert got == {_shown(*x): (x[2], _shown(*x), day, day + int(x[4])) for x in ITEMS if x[3] % 2}


def test_wrapped_numbers(spark):
    rng, ends = random.Random(5), [0, 1, -1, (1 << 31) - 1, 1 << 31, 1 << 32, (1 << 63) - 1, -(1 << 63)]
    rows = [(a, b) for a in ends for b in ends] + [(rng.randrange(-(1 << 63), 1 << 63), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(200)] + [(None, 1)]
    wrapped = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    factors = (0, 1, 625, 9_765_625, (1 << 31) - 1)
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", arithmetic.wrapped_sum(a, b, a, b, b), *[arithmetic.wrapped_times(a, k) for k in factors])
    assert [tuple(r)[2:] for r in got.collect()] == [(wrapped(2 * a + 3 * b), *[wrapped(a * k) for k in factors]) if a is not None else (None,) * 6 for a, b in rows]


def test_item_numbers_of_wide_keys(spark):
    rng, top = random.Random(6), (1 << 63) - 1
    rows = [(top, top, top, 2**31 - 1, 50.0), (-top - 1, -top - 1, -top - 1, 1, 1.0), (59 << 32, 1, 1, 7, 2.0)] + [(rng.randrange(1 << rng.randrange(1, 64)), rng.randrange(1 << rng.randrange(1, 64)), rng.randrange(1 << rng.randrange(1, 64)), rng.randrange(1, 8), float(rng.randrange(1, 51))) for _ in range(200)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    assert [r[0] for r in df.select(tables.item_number()).collect()] == [_shown(*x) for x in rows]


#: As ITEMS, with order keys beyond 118 thousand million.
WIDE = [(59 << 32, 5, 6, 2, 3.0), (1 << 45, 5, 7, 3, 3.0), ((1 << 60) + 9, 1_200_000, 60_000, 7, 50.0), (120 * 10**9, 7, 11, 1, 50.0), (3, 4, 5, 1, 2.0)]


@pytest.mark.parametrize("check", [test_cigars_of_items_beyond_63_bits, test_bins_of_items_beyond_63_bits, test_difference_of_items_beyond_63_bits])
def test_queries_of_wide_order_keys(spark, tmp_path, monkeypatch, check):
    monkeypatch.setattr(sys.modules[__name__], "ITEMS", WIDE)
    check(spark, tmp_path)
