"""Text sources and sinks of alignment records, sequences and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.functions import cigar as C
from sedgewing.functions import sequences as S

# fixed values: the mandatory fields of a SAM line
SAM_FIELDS = ("name", "flags", "ref", "pos", "mapq", "cigar", "next_ref", "next_pos", "tlen", "seq", "qual")


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of SAM text: one row a line, positions from 0, tags as a map from name to ``type:value``; ``error`` names the first
    field that does not parse, else null."""
    lines = spark.read.text(paths).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    part = F.split("value", "\t")
    field = {n: F.get(part, i) for i, n in enumerate(SAM_FIELDS)}
    number = {n: field[n].try_cast("int") for n in ("flags", "pos", "mapq", "next_pos", "tlen")}
    tags = F.map_from_entries(F.transform(F.filter(F.slice(part, 12, 10_000), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:")), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(4), F.length(t)))))
    error = F.when(F.size(part) < 11, "fields")
    for n, c in number.items():
        error = error.when(c.isNull(), n)
    error = error.when(~field["cigar"].rlike("^(\\*|([0-9]+[MIDNSHP=X])+)$"), "cigar").when(~field["seq"].rlike("^(\\*|[A-Za-z=.]+)$"), "seq")
    error = error.when((field["qual"] != "*") & (field["seq"] != "*") & (F.length(field["qual"]) != F.length(field["seq"])), "qual")
    return lines.select(
        field["name"].alias("name"),
        number["flags"].alias("flags"),
        field["ref"].alias("ref"),
        (number["pos"] - 1).alias("pos"),
        number["mapq"].alias("mapq"),
        C.parse(field["cigar"]).alias("cigar"),
        F.when(field["next_ref"] == "=", field["ref"]).otherwise(field["next_ref"]).alias("next_ref"),
        (number["next_pos"] - 1).alias("next_pos"),
        number["tlen"].alias("tlen"),
        field["seq"].alias("seq"),
        field["qual"].alias("qual"),
        tags.alias("tags"),
        error.alias("error"),
    )


def read_sam_header(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(kind, fields): header lines as maps."""
    lines = spark.read.text(paths).filter(F.col("value").startswith("@"))
    entries = F.transform(F.slice(F.split("value", "\t"), 2, 10_000), lambda t: F.struct(F.substring_index(t, ":", 1), F.substring(t, F.locate(":", t) + 1, F.length(t))))
    return lines.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(entries).alias("fields"))


def references(header: DataFrame) -> DataFrame:
    """(name, length) of the reference sequences of a header."""
    return header.filter("kind = 'SQ'").select(F.col("fields")["SN"].alias("name"), F.col("fields")["LN"].cast("long").alias("length"))


def sam_line(records: DataFrame) -> Column:
    tag_text = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])) if "tags" in records.columns else F.array().cast("array<string>")
    cigar = C.to_text(F.col("cigar"))
    main = [F.col("name"), F.col("flags"), F.coalesce("ref", F.lit("*")), F.col("pos") + 1, F.col("mapq"), F.when(cigar == "", "*").otherwise(cigar), F.coalesce("next_ref", F.lit("*")), F.col("next_pos") + 1, F.col("tlen"), F.col("seq"), F.col("qual")]
    return F.concat_ws("\t", *[c.cast("string") for c in main], tag_text)


def write_sam(records: DataFrame, path: str, compression: str = "none") -> None:
    records.select(sam_line(records).alias("value")).write.text(path, compression=compression)


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id, seq): records from ``>`` on; line ends within a sequence are dropped. Compressed files are read as such."""
    parts = spark.read.text(paths, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")).filter("value <> ''")
    return parts.select(F.regexp_extract("value", "^([^\n\r]*)", 1).alias("id"), F.regexp_replace(F.regexp_replace("value", "^[^\n\r]*", ""), "\\s+", "").alias("seq"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id, seq, plus, qual): four lines a record. Records are cut at a line end before ``@`` that a name, bases and a plus line
    follow; quality lines may begin with ``@`` as well."""
    import gzip

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for content in batch.column(0).to_pylist():
                if content[:2] == b"\x1f\x8b":  # gzip, of one member or many
                    content = gzip.decompress(content)
                out += parse_fastq(content.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], pa.string()) for i, k in enumerate(("id", "seq", "plus", "qual"))})

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, "id string, seq string, plus string, qual string")


def parse_fastq(text: str) -> list[tuple[str, str, str, str]]:
    """Records of FASTQ text, sequences and qualities over several lines allowed: a record ends where as many quality characters
    as bases have been read."""
    lines, at, out = text.split("\n"), 0, []
    while at < len(lines):
        if not lines[at].startswith("@"):
            at += 1
            continue
        name, seq, qual = lines[at][1:].rstrip("\r"), [], []
        at += 1
        while at < len(lines) and not lines[at].startswith("+"):
            seq.append("".join(lines[at].split()))
            at += 1
        bases = "".join(seq)
        plus = lines[at][1:].rstrip("\r") if at < len(lines) else ""
        at += 1
        size = 0
        while at < len(lines) and size < len(bases):
            qual.append("".join(lines[at].split()))
            size += len(qual[-1])
            at += 1
        out.append((name, bases, plus, "".join(qual)))
    return out


def is_fastq(spark: SparkSession, path: str) -> bool:
    """Whether a file begins as FASTQ; other than ``@`` and ``>`` is an error."""
    first = spark.read.text(path).filter("value <> ''").first()
    mark = first[0][:1] if first else ""
    if mark not in ("@", ">"):
        raise ValueError("neither FASTA nor FASTQ")
    return mark == "@"


def write_fastq(reads: DataFrame, path: str, compression: str = "gzip") -> None:
    reads.select(F.regexp_replace(S.fastq_text(F.col("id"), F.col("seq"), F.col("qual")), "\n$", "").alias("value")).write.text(path, compression=compression)


def fastq_streams(pairs: DataFrame) -> DataFrame:
    """(stream, value) from paired rows (a, b, kind): matched 1 and 2, orphans 1 and 2, single; ``write.partitionBy("stream")``
    gives a folder each."""
    text = lambda r: S.fastq_of_alignment(F.col(f"{r}.name"), F.col(f"{r}.flags"), F.col(f"{r}.seq"), F.col(f"{r}.qual"))
    one = pairs.filter("kind = 'pair'")
    out = one.select(F.lit("matched1").alias("stream"), text("a").alias("value")).unionByName(one.select(F.lit("matched2").alias("stream"), text("b").alias("value")))
    out = out.unionByName(pairs.filter("kind = 'orphan1'").select(F.lit("orphan1").alias("stream"), text("a").alias("value")))
    out = out.unionByName(pairs.filter("kind = 'orphan2'").select(F.lit("orphan2").alias("stream"), text("b").alias("value")))
    return out.unionByName(pairs.filter("kind = 'single'").select(F.lit("single").alias("stream"), text("a").alias("value")))


def fasta_index(fasta: DataFrame, line: int) -> DataFrame:
    """(id, length, offset, bases, bytes): a line index of FASTA written with ``line`` bases a line, records in the order of id."""
    from sedgewing.operators.ordered import exclusive_sums

    name = F.regexp_extract("id", "^(\\S*)", 1)
    body = F.length("seq") + F.ceil(F.length("seq") / line)
    sized = fasta.select("id", name.alias("name"), F.length("seq").alias("length"), (F.length("id") + 2).cast("long").alias("_head"), (F.length("id") + 2 + body).cast("long").alias("_all"))
    placed = exclusive_sums(sized, ["id"], "_all", "_at")
    return placed.select("name", "length", (F.col("_at") + F.col("_head")).alias("offset"), F.lit(line).alias("bases"), F.lit(line + 1).alias("bytes"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene annotation: tab-separated, exon borders as arrays; a field that is no number is an error."""
    p = F.split("value", "\t")
    number = lambda i: F.get(p, i).cast("long")
    many = lambda i: F.transform(F.filter(F.split(F.get(p, i), ","), lambda x: x != ""), lambda x: x.cast("long"))
    exons = F.zip_with(many(9), many(10), lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return spark.read.text(path).filter("value <> '' AND NOT startswith(value, '#')").select(
        F.get(p, 0).alias("gene_name"), F.get(p, 1).alias("name"), F.get(p, 2).alias("chrom"), F.get(p, 3).alias("strand"), number(4).alias("tx_start"), number(5).alias("tx_end"), number(6).alias("cds_start"), number(7).alias("cds_end"), exons.alias("exons")
    )


def read_numbers(spark: SparkSession, path: str, width: int = 8) -> DataFrame:
    """(file, at, v): little-endian unsigned numbers of a fixed width; of 8 bytes, those beyond 2**63 wrap."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(content.as_py(), dtype=f"<u{width}").astype(np.int64)
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(v), pa.string()), "at": pa.array(np.arange(len(v))), "v": pa.array(v)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, at long, v long")


def with_sort_order(header: DataFrame, order: str) -> DataFrame:
    """The header with another sort order in its first line."""
    changed = F.map_concat(F.map_filter("fields", lambda k, v: k != "SO"), F.create_map(F.lit("SO"), F.lit(order)))
    return header.withColumn("fields", F.when(F.col("kind") == "HD", changed).otherwise(F.col("fields")))


def write_fasta(records: DataFrame, path: str, line: int = 60, compression: str = "none") -> None:
    """Sequences in lines of so many bases."""
    body = F.regexp_replace("seq", f"(.{{{line}}})(?=.)", "$1\n")
    records.select(F.concat(F.lit(">"), "id", F.lit("\n"), body).alias("value")).write.text(path, compression=compression)
