"""Text sources and sinks, and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedgewing.sources import alignments
from sedgewing.streaming import dedup

SAM = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\nr1\t99\tchr1\t8\t30\t3S4M\t=\t37\t39\tTTAGATA\tIIIIIII\tNM:i:1\nr2\tx\tchr1\t8\t30\t4M\t*\t0\t0\tACGT\t*\n"


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    df = alignments.read_sam(spark, str(tmp_path / "a.sam"))
    got = {r["name"]: r for r in df.collect()}
    assert got["r1"]["pos"] == 7 and got["r1"]["error"] is None and got["r1"]["next_ref"] == "chr1" and got["r1"]["tags"] == {"NM": "i:1"}
    assert got["r2"]["error"] == "flags"
    alignments.write_sam(df.filter("error IS NULL"), str(tmp_path / "out"))
    again = alignments.read_sam(spark, str(tmp_path / "out")).first()
    assert again["cigar"] == got["r1"]["cigar"] and again["tags"] == got["r1"]["tags"]
    head = alignments.read_sam_header(spark, str(tmp_path / "a.sam"))
    assert [tuple(r) for r in alignments.references(head).collect()] == [("chr1", 1000)]


def test_fastx(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n>two\n\nGG\n")
    assert sorted(tuple(r) for r in alignments.read_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("one x", "ACGTAC"), ("two", "GG")]
    (tmp_path / "a.fq").write_text("@r1\nAC\nGT\n+\n@@\nII\n@r2\nA\n+r2\nI\n")
    assert [tuple(r) for r in alignments.read_fastq(spark, str(tmp_path / "a.fq")).collect()] == [("r1", "ACGT", "", "@@II"), ("r2", "A", "r2", "I")]
    assert alignments.is_fastq(spark, str(tmp_path / "a.fq")) and not alignments.is_fastq(spark, str(tmp_path / "a.fa"))
    index = alignments.fasta_index(alignments.read_fasta(spark, str(tmp_path / "a.fa")), 4)
    assert sorted(tuple(r) for r in index.collect()) == [("one", 6, 7, 4, 5), ("two", 2, 20, 4, 5)]


def test_genes_and_numbers(spark, tmp_path):
    (tmp_path / "g.txt").write_text("G\tT\tchr1\t+\t1\t90\t5\t80\t2\t1,50,\t20,90,\n")
    g = alignments.read_genes(spark, str(tmp_path / "g.txt")).first()
    assert (g["tx_end"], [tuple(e) for e in g["exons"]]) == (90, [(1, 20), (50, 90)])
    (tmp_path / "n.bin").write_bytes(b"".join(i.to_bytes(8, "little") for i in (1, 2, 300)))
    assert [r["v"] for r in alignments.read_numbers(spark, str(tmp_path / "n.bin")).collect()] == [1, 2, 300]


SCHEMA = "part long, ref_id int, pos long, coord long, orient string, paired boolean, score long, name string, rank long"


def _run(spark, tmp_path, batches, length=10):
    import json
    import os

    src = tmp_path / "in"
    src.mkdir()
    for i, b in enumerate(batches):
        name = src / f"{i:03}.json"
        name.write_text("\n".join(json.dumps(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r, strict=True))) for r in b))
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))  # the order in which the stream takes them
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    out = dedup.mark_streaming(stream, "part", length)
    q = out.writeStream.format("memory").queryName("marked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r["rank"]: r["is_dup"] for r in spark.table("marked").collect()}


def test_frontier_releases_keys(spark, tmp_path):
    a = [(1, 0, 5, 5, "F", True, 9, "b", 1), (1, 0, 5, 5, "F", True, 9, "a", 2), (1, 0, 6, 6, "F", False, 1, "c", 3)]
    b = [(1, 0, 30, 30, "F", False, 1, "d", 4), (1, 1, 1, 1, "F", False, 1, "e", 5), (1, 1, 90, 90, "F", False, 1, "f", 6)]
    got = _run(spark, tmp_path, [a, b])
    assert got[1] is True and got[2] is False and got[3] is False and got[4] is False and got[5] is False


def test_frontier_refuses_disorder(spark, tmp_path):
    with pytest.raises(Exception, match="coordinate order"):
        _run(spark, tmp_path, [[(1, 0, 50, 5, "F", True, 9, "b", 1)], [(1, 0, 5, 5, "F", True, 9, "a", 2)]])


def test_length_bound(spark):
    df = spark.createDataFrame([(5,)], "n int")
    assert dedup.checked(df, F.col("n"), 5).count() == 1
    with pytest.raises(Exception, match="longer than the bound"):
        dedup.checked(df, F.col("n"), 4).collect()


def test_bam_round_trip(spark, tmp_path):
    from sedgewing.sources import bam, formats

    refs = [("chr1", 1000), ("chr2", 500)]
    data = [(f"r{i}", 99, i % 2, i * 3, 30, 0, "4M1I3S", -1, -1, i - 50, "ACGTNACG", "IIIIIII!" if i % 3 else "*", {"NM": f"i:{i}", "XA": "A:c", "XZ": "Z:a b", "XB": "B:s,1,-2", "XF": "f:0.5"}) for i in range(3000)]
    schema = "name string, flags int, ref_id int, pos int, mapq int, bin int, cigar string, next_ref_id int, next_pos int, tlen int, seq string, qual string, tags map<string,string>"
    df = spark.createDataFrame(data, schema).coalesce(1)
    content = bam.as_files(df, refs).first()[0]
    (tmp_path / "a.bam").write_bytes(content)
    got = formats.read(spark, "bam", str(tmp_path / "a.bam"))
    assert got.filter("validity IS NOT NULL").isEmpty()
    rows = [tuple(r) for r in got.orderBy("rank").select(*df.columns).collect()]
    assert rows == data
    assert [tuple(r)[1:] for r in bam.read_bam_references(spark, str(tmp_path / "a.bam")).collect()] == [(0, "chr1", 1000), (1, "chr2", 500)]
    near = formats.read(spark, "bam", str(tmp_path / "a.bam"), "chr2:100-110")
    assert sorted(r["pos"] for r in near.select("pos").collect()) == sorted(d[3] for d in data if d[2] == 1 and d[3] + 4 > 99 and d[3] <= 110)
    import gzip

    assert gzip.decompress(content)[:4] == b"BAM\x01"


def test_record_validity():
    import struct

    from sedgewing.sources import bam

    good = {"name": "r", "flags": 0, "ref_id": 0, "pos": 1, "mapq": 0, "cigar": "4M", "next_ref_id": -1, "next_pos": -1, "tlen": 0, "seq": "ACGT", "qual": "IIII", "tags": {}}
    code = lambda **x: bam.decode(bam.encode(good | x)[4:])[-1]
    assert code() is None and code(qual="*") is None and code(flags=4, cigar="*") is None
    assert code(cigar="3M") == "cigar_is_inconsistent_with_sequence_length"
    assert code(name="a b") == "queryname_contains_illegal_symbols" and code(name="") == "queryname_empty"
    assert code(pos=-2) == "invalid_mapping_position" and code(next_pos=-2) == "invalid_next_mapping_position" and code(tlen=-(1 << 31)) == "invalid_tlen"
    raw = bam.encode(good)[4:]
    assert bam.decode(raw[:20])[-1] == "block_too_small" and bam.decode(raw[:-5])[-1] == "sequence_extends_over_block" and bam.decode(raw[:-1])[-1] == "quality_extends_over_block"
    assert bam.decode(raw + b"XXq1")[-1] == "invalid_auxiliary_data"
    assert bam.decode(raw[:-1] + b"\x60")[-1] == "invalid_quality_value"
    assert bam.decode(raw[:12] + struct.pack("<H", 60000) + raw[14:])[-1] == "cigar_extends_over_block"


def test_formats(spark):
    from sedgewing.sources import formats

    with pytest.raises(NotImplementedError):
        formats.read(spark, "cram", "x")
    for kind in ("sam", "odd"):
        with pytest.raises(ValueError):
            formats.read(spark, kind, "x", "chr1")
    assert formats.merged_references([[("a", 1), ("c", 3)], [("b", 2), ("c", 3)]]) == ([("a", 1), ("b", 2), ("c", 3)], True)
    assert formats.merged_references([[("a", 1), ("b", 2)], [("b", 2), ("a", 1)]]) == ([("a", 1), ("b", 2)], False)
    with pytest.raises(ValueError):
        formats.merged_references([[("a", 1)], [("a", 2)]])
    one = spark.createDataFrame([(0, 5, 0), (-1, -1, 1)], "ref_id int, pos int, rank int")
    two = spark.createDataFrame([(0, 5, 0), (0, 3, 1)], "ref_id int, pos int, rank int")
    assert [(r["ref_id"], r["pos"], r["input"]) for r in formats.merged([one, two], "coordinate").collect()] == [(0, 3, 1), (0, 5, 0), (0, 5, 1), (-1, -1, 0)]
    heads = spark.createDataFrame([("g", 0), ("g", 1), ("h", 1)], "id string, input int")
    assert sorted(r["new_id"] for r in formats.renamed_groups(heads).collect()) == ["g_0", "g_1", "h"]
