"""Column functions against values worked out by hand."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sedgewing.functions import arithmetic, cigar, coords, digests, flags, names, sequences, tags


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(row) == 1 else tuple(row)


def test_base_score(spark):
    q = F.array(F.lit(10), F.lit(15), F.lit(20))
    assert one(spark, sequences.base_score(q)) == 35


def test_cigar_lengths(spark):
    c = cigar.parse(F.lit("5S10M2I3D4N6M"))
    assert one(spark, cigar.reference_length(c)) == 23
    assert one(spark, cigar.read_length(c)) == 23
    c = cigar.parse(F.lit("5S10M2S"))
    assert one(spark, cigar.unclipped_start(F.lit(100), c), cigar.unclipped_end(F.lit(100), c)) == (95, 111)
    assert one(spark, cigar.to_text(cigar.parse(F.lit("3H2S7=1X4I")))) == "3H2S7=1X4I"
    assert one(spark, cigar.parse(F.lit("*"))) == []


def test_leading_operations(spark):
    c = cigar.parse(F.lit("2H3S4I1D2P5N6M3I2S1H"))
    assert one(spark, cigar.offset_before_match(c), cigar.front_deletion(c), cigar.front_clip(c), cigar.front_soft_clip(c), cigar.front_hard_clip(c), cigar.back_clip(c)) == (-2, 1, 5, 3, 2, 3)
    assert one(spark, cigar.reference_advance(c)) == 6


def test_trace_round_trip(spark):
    assert one(spark, cigar.to_trace(cigar.parse(F.lit("2S3=1X2I1D")))) == "===XIID"
    assert one(spark, cigar.to_text(cigar.from_trace(F.lit("===XIID")))) == "3=1X2I1D"


def test_identity_refuses_m(spark):
    assert one(spark, cigar.identity(cigar.parse(F.lit("9=1X")))) == pytest.approx(0.9)
    assert one(spark, cigar.identity(cigar.parse(F.lit("4S")))) == 0.0
    with pytest.raises(Exception, match="M operation"):
        one(spark, cigar.identity(cigar.parse(F.lit("5M"))))


def test_positions(spark):
    c = cigar.parse(F.lit("2S3=1I2D2="))
    assert one(spark, cigar.ref_pos_of(F.lit(10), c, F.lit(6))) == 15
    assert one(spark, cigar.ref_pos_of(F.lit(10), c, F.lit(5))) is None
    assert one(spark, cigar.cross(F.lit(10), c, F.lit(11), c)) is False
    assert one(spark, cigar.cross(F.lit(10), c, F.lit(10), cigar.parse(F.lit("2S3=")))) is True


def test_bins(spark):
    assert one(spark, coords.reg2bin(F.lit(0), F.lit(1))) == 4681
    assert one(spark, coords.reg2bin(F.lit(0), F.lit(1 << 29))) == 0
    assert one(spark, coords.record_bin(F.lit(-1), F.lit(0))) == 4680
    bins = one(spark, coords.reg2bins(F.lit(0), F.lit(1)))
    assert bins == [0, 1, 9, 73, 585, 4681]
    assert one(spark, coords.reg2bins(F.lit(5), F.lit(5))) == []


def test_ranges(spark):
    assert tuple(one(spark, coords.parse_range(F.lit("chr1:1,000-2,000")))) == ("chr1", 999, 2000)
    assert tuple(one(spark, coords.parse_range(F.lit("a:b:7")))) == ("a:b", 6, None)
    assert tuple(one(spark, coords.parse_range(F.lit("chrX")))) == ("chrX", None, None)
    assert one(spark, coords.in_interval(F.lit(20), F.lit(25), F.lit(10), F.lit(20))) is True


def test_flags(spark):
    assert one(spark, flags.to_text(F.lit(3))) == "PAIRED;PROPER_PAIR;"
    assert one(spark, flags.to_text(F.lit(2048))) == ""
    assert one(spark, flags.from_text(F.lit("PAIRED,SUPPLEMENTARY"))) == 2049
    with pytest.raises(Exception, match="Unknown flag"):
        one(spark, flags.from_text(F.lit("ODD")))
    pairs = [(0, 16, "FR"), (16, 0, "RF"), (64, 0, "FF"), (0, 64, "RR"), (16 + 64, 16, "RR"), (16, 16 + 64, "FF")]
    for a, b, want in pairs:
        assert one(spark, flags.pair_orientation(F.lit(a), F.lit(b))) == want


def test_names(spark):
    ok = [names.valid(F.lit(x)) for x in ("", "a b", "a@b", "a:b", "x" * 256)]
    assert one(spark, *[c.alias(str(i)) for i, c in enumerate(ok)]) == (False, False, False, True, False)
    rows = spark.createDataFrame([("a2",), ("a10",), ("a1",), ("a02",)], "n string").orderBy(names.natural_key(F.col("n")), "n")
    assert [r[0] for r in rows.collect()] == ["a1", "a02", "a2", "a10"]
    assert tuple(one(spark, names.tile_fields(F.lit("m:1:1101:22:33")))) == (1102, 22, 33)
    assert tuple(one(spark, names.tile_fields(F.lit("m:x:22:33")))) == (0, 0, 0)
    assert one(spark, names.strip_blank_and_slash(F.lit("r/1/2 rest/3"))) == "r/1"


def test_sequences(spark):
    assert one(spark, sequences.reverse_complement(F.lit("AACGTN"))) == "NACGTT"
    assert one(spark, sequences.kmer_number(F.lit("ACGT"))) == 0b00011011
    assert one(spark, sequences.kmers(F.lit("abcd"), 3)) == ["abc", "bcd"]
    assert one(spark, sequences.kmers(F.lit("ab"), 3)) == []
    text = "".join(chr(97 + i * i % 26) for i in range(1000)) + "é"
    assert one(spark, sequences.kmers(F.lit(text), 7)) == [text[i : i + 7] for i in range(len(text) - 6)]
    assert one(spark, sequences.quality_text(sequences.qualities(F.lit("!5I")))) == "!5I"
    assert one(spark, sequences.fastq_of_alignment(F.lit("r"), F.lit(1 + 16 + 128), F.lit("AC"), F.lit("!I"))) == "@r/2\nGT\n+\nI!\n"
    assert [tuple(x) for x in one(spark, sequences.shreds(F.lit("abcdefg"), 3, 2))] == [(0, "abc"), (2, "cde"), (4, "efg")]


def test_tags(spark):
    t = F.create_map(F.lit("Zb"), F.lit("1"), F.lit("aa"), F.lit("2"))
    assert one(spark, tags.names(tags.put(t, "RG", F.lit("x")))) == ["RG", "Zb", "aa"]
    assert one(spark, tags.get_any_case(t, "zB")) == "1"
    assert one(spark, tags.copied(t, F.create_map(F.lit("aa"), F.lit("9"), F.lit("bb"), F.lit("8")), ["aa"])) == {"Zb": "1", "aa": "9"}
    with pytest.raises(Exception, match="missing tag"):
        one(spark, tags.checked(t, "QQ"))


def test_numbers(spark):
    assert one(spark, arithmetic.gcd(F.lit(84), F.lit(-36))) == 12
    for n in (0, 1, 8, 9, 10**14, 10**14 - 1):
        r = one(spark, arithmetic.isqrt(F.lit(n)))
        assert r * r <= n < (r + 1) * (r + 1)
    assert one(spark, arithmetic.unit_number(F.lit("3k"))) == 3072
    assert one(spark, arithmetic.parse_decimal(F.lit("99999999999999999999"))) is None
    assert one(spark, arithmetic.bloom_bits(F.lit(1000.0), 0.01)) == 16384
    assert one(spark, arithmetic.binomial_upper(F.lit(0.5), F.lit(2), F.lit(2))) == pytest.approx(0.25)
    assert one(spark, arithmetic.poisson_pmf(F.lit(2.0), F.lit(0))) == pytest.approx(0.1353352832)


def test_digests(spark):
    assert one(spark, digests.digest("crc32c", F.lit("123456789"))) == "e3069283"
    assert one(spark, digests.digest("crc32", F.lit("123456789"))) == "cbf43926"
    assert one(spark, digests.digest("sha3_256", F.lit("abc"))) == hashlib.sha3_256(b"abc").hexdigest()
    h = digests.murmur3_x64_128(b"hello")
    assert (int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little")) == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    with pytest.raises(ValueError):
        digests.digest("none", F.lit("x"))
