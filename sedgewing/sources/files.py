"""Files of any content by the scheme of their path: whole, in ranges, one after the other; and rows written as files.

Ranges of a file are read by tasks of their own, which open the file themselves; nothing is copied to the driver."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Readers by scheme: from (session, paths) to (path, length, content).
READERS: dict[str, Callable[[SparkSession, list[str]], DataFrame]] = {}
_MEMORY: dict[str, bytes] = {}


def scheme_of(path: str) -> str:
    return path.partition(":")[0] if ":" in path.split("/")[0] else ""


def register(scheme: str, reader: Callable[[SparkSession, list[str]], DataFrame]) -> None:
    READERS[scheme] = reader


def keep_in_memory(name: str, content: bytes) -> str:
    """A small file of the driver's by the name ``mem:name``."""
    _MEMORY[name] = content
    return f"mem:{name}"


def _from_memory(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = [(p, len(_MEMORY[p[4:]]), bytearray(_MEMORY[p[4:]])) for p in paths]
    return spark.createDataFrame(rows, "path string, length long, content binary")


register("mem", _from_memory)


def contents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, content) of whole files. Schemes without a reader of their own are Spark's."""
    out = None
    by_scheme: dict[str, list[str]] = {}
    for p in [paths] if isinstance(paths, str) else paths:
        by_scheme.setdefault(scheme_of(p), []).append(p)
    for scheme, some in by_scheme.items():
        part = READERS[scheme](spark, some) if scheme in READERS else spark.read.format("binaryFile").load(some).select("path", "length", "content")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no paths")
    return out


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_file(folder: str, name: str, content: bytes) -> tuple[str, int, str]:
    """Writes one file; (path, bytes, md5). It gets its name when it is whole, so a repeated task does no harm."""
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    digest = hashlib.md5(content).hexdigest()
    part = f"{base}/.{name}.{digest}"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, f"{base}/{name}")
    return f"{folder}/{name}", len(content), digest


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row (name, content) as a file below the folder; (path, bytes, md5) of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [write_file(folder, name.as_py(), content.as_py()) for name, content in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "md5"])

    from sedgewing.scratch import written

    return written(files.select("name", "content").mapInArrow(run, "path string, bytes long, md5 string"), "written-files")


def ranges(spark: SparkSession, paths: str | list[str], size: int) -> DataFrame:
    """(path, low, high): files cut into ranges of so many bytes; the contents are not read."""
    found = spark.read.format("binaryFile").load(paths).select("path", "length")
    lows = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return found.select("path", F.explode(lows).alias("low"), "length").select("path", "low", F.least(F.col("low") + size, "length").alias("high"))


def _lines(path: str, low: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) from the first line that begins at low or later."""
    fs, name = opened(path)
    with fs.open_input_file(name) as raw:
        f = io.BufferedReader(raw, 1 << 20)
        at = max(0, low - 1)
        f.seek(at)
        if low:
            at += len(f.readline())
        while line := f.readline():
            yield at, line
            at += len(line)


def _mapped(parts: DataFrame, schema: str, records: Callable[[str, int, int], Iterator[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64() if c.endswith(" long") else pa.string() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for path, low, high in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, size = [], 0
                for r in records(path, low, high):
                    rows.append(r)
                    size += sum(len(x) for x in r if isinstance(x, str))
                    if size > 4 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                yield packed(rows)

    return parts.select("path", "low", "high").mapInArrow(run, schema)


def fastq_in_ranges(parts: DataFrame) -> DataFrame:
    """(path, at, id, seq, plus, qual): FASTQ records of four lines that begin in the ranges (path, low, high). A record begins where a
    line starts with ``@``, the next but one with ``+``, and bases and qualities are of one length; a quality line that starts with
    ``@`` has a name behind it and is none."""

    def records(path: str, low: int, high: int) -> Iterator[tuple]:
        held: list[tuple[int, str]] = []
        for at, raw in _lines(path, low):
            held.append((at, raw.decode("utf-8", "replace").rstrip("\r\n")))
            if held[0][0] >= high:
                return
            if len(held) < 4:
                continue
            (first, name), (_, seq), (_, plus), (_, qual) = held
            if name.startswith("@") and plus.startswith("+") and len(seq) == len(qual):
                yield path, first, name[1:], seq, plus[1:], qual
                held = []
            else:
                held.pop(0)

    return _mapped(parts, "path string, at long, id string, seq string, plus string, qual string", records)


def fasta_in_ranges(parts: DataFrame) -> DataFrame:
    """(path, at, id, seq): FASTA records that begin in the ranges (path, low, high)."""

    def records(path: str, low: int, high: int) -> Iterator[tuple]:
        first, name, seq = -1, "", []
        for at, raw in _lines(path, low):
            line = raw.decode("utf-8", "replace").strip()
            if line.startswith(">"):
                if first >= 0:
                    yield path, first, name, "".join(seq)
                if at >= high:
                    first = -1
                    break
                first, name, seq = at, line[1:], []
            elif first < 0 and at >= high:
                break
            else:
                seq.append("".join(line.split()))
        if first >= 0:
            yield path, first, name, "".join(seq)

    return _mapped(parts, "path string, at long, id string, seq string", records)


def intervals(records: DataFrame, per: int, length: str = "seq") -> DataFrame:
    """(path, low, high, offset, symbols, shortest, longest): an index of every ``per`` records of each file, low and high counting
    records; from records (path, at, ...). Ranks are taken file by file over a small table of offsets and lengths."""
    from sedgewing.operators.ordered import numbered
    from sedgewing.scratch import written

    small = written(records.select("path", "at", F.length(length).cast("long").alias("n")), "fastx")
    placed = numbered(small, ["path", "at"], "_r")
    first = small.groupBy("path").agg(F.min("at").alias("_a"))
    start = placed.join(first, (placed["path"] == first["path"]) & (placed["at"] == first["_a"])).select(placed["path"].alias("path"), F.col("_r").alias("_first"))
    cells = placed.join(start, "path").withColumn("_i", F.col("_r") - F.col("_first")).withColumn("_cell", F.floor(F.col("_i") / per))
    return cells.groupBy("path", "_cell").agg(F.min("_i").alias("low"), (F.max("_i") + 1).alias("high"), F.min("at").alias("offset"), F.sum("n").alias("symbols"), F.min("n").alias("shortest"), F.max("n").alias("longest")).drop("_cell")


def one_after_the_other(parts: DataFrame, order: str, content: str = "content") -> DataFrame:
    """(offset, content) with each part's place in the stream that the parts form in the given order."""
    from sedgewing.operators.ordered import exclusive_sums

    sized = parts.withColumn("_n", F.octet_length(content).cast("long"))
    return exclusive_sums(sized, [order], "_n", "offset").drop("_n")


def split_by_size(rows: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """rows with ``file``: a new one begins with each row that reaches into the next ``most`` bytes of the whole."""
    from sedgewing.operators.ordered import exclusive_sums

    return exclusive_sums(rows, [order], size, "_at").withColumn("file", F.floor(F.col("_at") / most)).drop("_at")


def split_by_rows(rows: DataFrame, order: str, most: int) -> DataFrame:
    from sedgewing.operators.ordered import numbered

    return numbered(rows, [order], "_at").withColumn("file", F.floor(F.col("_at") / most)).drop("_at")


def packed_numbers(values: list[int] | np.ndarray, bits: int) -> bytes:
    """Numbers of so many bits each, the highest bit first, behind their count and width (64 bits each)."""
    v = np.asarray(values, dtype=np.uint64)
    flat = ((v[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.array([len(v), bits], dtype="<u8").tobytes() + np.packbits(flat.ravel()).tobytes()


def unpacked_numbers(data: bytes) -> np.ndarray:
    n, bits = (int(x) for x in np.frombuffer(data[:16], dtype="<u8"))
    flat = np.unpackbits(np.frombuffer(data[16:], dtype=np.uint8), count=n * bits).reshape(n, bits)
    return (flat.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64)


def read_packed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, at, v) of files of packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = unpacked_numbers(content.as_py())
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(v), pa.string()), "at": pa.array(np.arange(len(v))), "v": pa.array(v)})

    return contents(spark, paths).select("path", "content").mapInArrow(run, "path string, at long, v long")


def read_pairs(spark: SparkSession, paths: str | list[str], size: int = 1 << 24) -> DataFrame:
    """(key, value) of files of pairs of little-endian 64-bit numbers, in ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, high in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    f.seek(low)
                    v = np.frombuffer(f.read(high - low), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"key": pa.array(v[:, 0].copy()), "value": pa.array(v[:, 1].copy())})

    return ranges(spark, paths, size // 16 * 16).mapInArrow(run, "key long, value long")
