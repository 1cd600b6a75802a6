"""Sources and sinks by name, several inputs as one, headers put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.functions import cigar as C
from sedgewing.functions import coords, names
from sedgewing.sources import alignments, bam

FORMATS = ("bam", "sam", "fasta", "fastq", "parquet")


def read(spark: SparkSession, kind: str, paths: str | list[str], ranges: str | None = None) -> DataFrame:
    """Records of a format. ``ranges`` (blanks between) is a filter over records with a reference name; it is refused for plain SAM text,
    as that has no index and no statistics to prune by. CRAM needs a codec that is not here."""
    if kind == "cram":
        raise NotImplementedError("reference-compressed alignments need a native codec")
    if kind not in FORMATS:
        raise ValueError(f"no format of the name {kind}; there are {', '.join(FORMATS)}")
    if ranges and kind in ("sam", "fasta", "fastq"):
        raise ValueError(f"no ranges over {kind}")
    if kind == "bam":
        df = bam.read_bam(spark, paths)
        if ranges:
            refs = bam.read_bam_references(spark, paths).select("ref_id", F.col("name").alias("ref")).distinct()
            df = df.join(refs, "ref_id", "left").filter(in_ranges(ranges, F.col("ref"), F.col("pos"), C.parse(F.col("cigar"))))
        return df
    if kind == "parquet":
        df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
        return df.filter(in_ranges(ranges, F.col("ref"), F.col("pos"), F.col("cigar"))) if ranges else df
    return {"sam": alignments.read_sam, "fasta": alignments.read_fasta, "fastq": alignments.read_fastq}[kind](spark, paths)


def in_ranges(ranges: str, ref: Column, pos: Column, cigar: Column) -> Column:
    """Whether a record lies in one of the ranges. The bounds are literals, so that Parquet prunes by them."""
    end = pos + F.greatest(C.reference_length(cigar), F.lit(1))
    out = F.lit(False)
    for text in ranges.split():
        name, _, tail = text.rpartition(":")
        digits = tail.replace(",", "").split("-")
        if not name or not all(d.isdigit() for d in digits):
            out = out | (ref == text)
        elif len(digits) == 1:
            out = out | (ref == name) & coords.in_half_open(end, F.lit(int(digits[0]) - 1))
        else:
            out = out | (ref == name) & coords.in_interval(pos, end, F.lit(int(digits[0]) - 1), F.lit(int(digits[1])))
    return out


def write(df: DataFrame, kind: str, path: str, references: list[tuple[str, int]] | None = None) -> None:
    if kind == "sam":
        alignments.write_sam(df, path)
    elif kind == "fastq":
        alignments.write_fastq(df, path)
    elif kind == "bam":
        bam.as_files(df, references or []).write.parquet(path)
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"no sink of the name {kind}")


def merged(parts: list[DataFrame], order: str, ties: tuple[str, ...] = ("rank",)) -> DataFrame:
    """Several inputs as one: by ``coordinate`` (ties by input, then by ``ties``), by ``name``, or one after the other (``concat``)."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("input", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if order == "coordinate":
        return out.orderBy(*coords.coordinate_key(F.col("ref_id"), F.col("pos")), "input", *ties)
    if order == "name":
        return out.orderBy(*names.name_order(F.col("name"), F.col("flags")))
    if order == "concat":
        return out.orderBy("input", *ties)
    raise ValueError(order)


def merged_references(lists: list[list[tuple[str, int]]]) -> tuple[list[tuple[str, int]], bool]:
    """(references, whether their order agrees with every input's): equal lists stay; others are put into an order that respects each
    where there is one, else in the order of first sight. One name with two lengths is an error. Lists come from headers and
    are short."""
    sizes: dict[str, int] = {}
    for refs in lists:
        for n, k in refs:
            if sizes.setdefault(n, k) != k:
                raise ValueError(f"two lengths of {n}")
    if all(x == lists[0] for x in lists):
        return list(lists[0]) if lists else [], True
    after: dict[str, set[str]] = {n: set() for n in sizes}
    waits = dict.fromkeys(sizes, 0)
    for refs in lists:
        for (a, _), (b, _) in zip(refs, refs[1:], strict=False):
            if b not in after[a]:
                after[a].add(b)
                waits[b] += 1
    order, free = [], [n for n in sizes if not waits[n]]
    while free:
        n = free.pop(0)
        order.append(n)
        for b in sorted(after[n], key=list(sizes).index):
            waits[b] -= 1
            if not waits[b]:
                free.append(b)
    whole = len(order) == len(sizes)
    return [(n, sizes[n]) for n in (order if whole else sizes)], whole


def renamed_groups(headers: DataFrame, id_col: str = "id", file_col: str = "input") -> DataFrame:
    """headers (one row per input and group id) with ``new_id``: an id that several inputs use gets the input's number."""
    shared = headers.groupBy(id_col).agg(F.countDistinct(file_col).alias("_n"))
    return headers.join(shared, id_col).withColumn("new_id", F.when(F.col("_n") > 1, F.concat_ws("_", id_col, F.col(file_col).cast("string"))).otherwise(F.col(id_col))).drop("_n")


def wrong_sequences(header: DataFrame, sequences: DataFrame) -> DataFrame:
    """Names whose MD5 in the header (name, m5) is not that of the reference's bases (name, bases) in upper case, or that have none."""
    own = sequences.select("name", F.md5(F.upper("bases").cast("binary")).alias("_own"))
    return header.join(own, "name", "left").filter(F.col("_own").isNull() | (F.col("_own") != F.lower("m5"))).select("name")
