"""Long-read databases and files of overlaps, in the public formats of the long-read assembler family.

An overlap file is a count and a trace spacing, then records of 40 bytes with their trace. A database is an index of 40-byte
records behind a header of 112 bytes, and the bases, four to a byte. Both are read in ranges: overlaps by an index of offsets,
reads by number."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.scratch import written
from sedgewing.sources.files import contents, opened, write_file

# fixed values: layouts of records and headers, letters, flag of an inverse overlap, spacing up to which a trace has bytes
OVERLAP, HEAD, READ = "<6iI2i4x", "<qi", "<3i4xqqi4x"
DATABASE, HEAD_BYTES = "<4i4fi4xq5i", 112
LETTERS, INVERSE, SMALL = "ACGT", 1, 125
FIELDS = ("aread", "bread", "inv", "abpos", "aepos", "bbpos", "bepos", "diffs", "trace")
SCHEMA = "aread long, bread long, inv boolean, abpos int, aepos int, bbpos int, bepos int, diffs int, trace array<struct<err:int,blen:int>>"
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 5, pa.list_(pa.struct([("err", pa.int32()), ("blen", pa.int32())]))]


def overlap_file(rows: list[dict], tspace: int) -> bytes:
    """A file of overlaps; rows have FIELDS."""
    kind = np.uint8 if tspace <= SMALL else np.dtype("<u2")
    out = [struct.pack(HEAD, len(rows), tspace)]
    for r in rows:
        trace = [x for t in r["trace"] or [] for x in (t["err"], t["blen"])]
        out.append(struct.pack(OVERLAP, len(trace), r["diffs"], r["abpos"], r["bbpos"], r["aepos"], r["bepos"], INVERSE if r["inv"] else 0, r["aread"], r["bread"]))
        out.append(np.array(trace, dtype=kind).tobytes())
    return b"".join(out)


def overlaps_of(data: bytes, tspace: int, at: int = 0) -> Iterator[tuple[int, tuple]]:
    """(offset, fields) of the records from a place on."""
    kind = np.dtype(np.uint8 if tspace <= SMALL else "<u2")
    size = struct.calcsize(OVERLAP)
    while at < len(data):
        n, diffs, ab, bb, ae, be, flags, a, b = struct.unpack_from(OVERLAP, data, at)
        t = np.frombuffer(data, dtype=kind, count=n, offset=at + size).reshape(-1, 2).tolist()
        yield at, (a, b, bool(flags & INVERSE), ab, ae, bb, be, diffs, [{"err": x, "blen": y} for x, y in t])
        at += size + n * kind.itemsize


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=list(FIELDS))


def overlap_files(overlaps: DataFrame, tspace: int, block: str, prefix: str = "overlaps") -> DataFrame:
    """(name, content): a sorted file for each value of ``block``, as many tasks as there are blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: [r[c] for c in FIELDS[:7]])
        return pa.table({"name": pa.array([f"{prefix}.{key[0].as_py()}.las"]), "content": pa.array([overlap_file(rows, tspace)], pa.binary())})

    return overlaps.select(block, *FIELDS).groupBy(block).applyInArrow(run, "name string, content binary")


def write_overlap_files(overlaps: DataFrame, tspace: int, block: str, folder: str, prefix: str = "overlaps") -> DataFrame:
    """Writes a sorted file for each value of ``block``; (path, bytes, md5). A task writes a block's file before it reads the next block,
    so that it holds one file however many it has."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: [r[c] for c in FIELDS[:7]])
        path, size, digest = write_file(folder, f"{prefix}.{key[0].as_py()}.las", overlap_file(rows, tspace))
        return pa.table({"path": pa.array([path]), "bytes": pa.array([size], pa.int64()), "md5": pa.array([digest])})

    return written(overlaps.select(block, *FIELDS).groupBy(block).applyInArrow(run, "path string, bytes long, md5 string"), "written-files")


def read_overlaps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The overlaps of whole files; several files are one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                some: list[tuple] = []
                for _, r in overlaps_of(data, struct.unpack_from(HEAD, data)[1], struct.calcsize(HEAD)):
                    some.append(r)
                    if len(some) == 20_000:
                        yield _batch(some)
                        some = []
                yield _batch(some)

    return contents(spark, paths).select("content").mapInArrow(run, SCHEMA)


def overlap_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, aread, offset, n, stop): where the overlaps of each a read lie in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, out = content.as_py(), []
                for at, r in overlaps_of(data, struct.unpack_from(HEAD, data)[1], struct.calcsize(HEAD)):
                    if not out or out[-1][0] != r[0]:
                        out.append([r[0], at, 0])
                    out[-1][2] += 1
                stops = [x[1] for x in out[1:]] + [len(data)]
                cols = {"aread": [x[0] for x in out], "offset": [x[1] for x in out], "n": [x[2] for x in out], "stop": stops[: len(out)]}
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(out), pa.string())} | {k: pa.array(v, pa.int64()) for k, v in cols.items()})

    return contents(spark, paths).select("path", "content").mapInArrow(run, "path string, aread long, offset long, n long, stop long")


def overlaps_of_reads(index: DataFrame, low: int, high: int) -> DataFrame:
    """The overlaps of a reads in [low, high), read from the places that the index names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    tspace = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))[1]
                    f.seek(at)
                    yield _batch([r for _, r in overlaps_of(f.read(stop - at), tspace)])

    wanted = index.filter((F.col("aread") >= low) & (F.col("aread") < high)).groupBy("path").agg(F.min("offset").alias("at"), F.max("stop").alias("stop"))
    return wanted.select("path", "at", "stop").mapInArrow(run, SCHEMA)


def database_files(reads: list[tuple[int, int, int, str]]) -> tuple[bytes, bytes]:
    """(index, bases) of reads (origin, fpulse, flags, bases)."""
    index, bases, at = [], [], 0
    counts = np.zeros(4)
    for origin, fpulse, flags, seq in reads:
        codes = np.frombuffer(seq.translate(str.maketrans(LETTERS, "\0\1\2\3")).encode(), dtype=np.uint8)
        counts += np.bincount(codes, minlength=4)
        padded = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
        index.append(struct.pack(READ, origin, len(seq), fpulse, at, 0, flags))
        bases.append((padded[:, 0] << 6 | padded[:, 1] << 4 | padded[:, 2] << 2 | padded[:, 3]).astype(np.uint8).tobytes())
        at += len(padded)
    total = int(counts.sum())
    head = struct.pack(DATABASE, len(reads), len(reads), 0, 0, *(counts / max(1, total)).tolist(), max((len(r[3]) for r in reads), default=0), total, len(reads), 0, 0, 0, 0)
    return head.ljust(HEAD_BYTES, b"\0") + b"".join(index), b"".join(bases)


def read_database(spark: SparkSession, index_path: str, bases_path: str, per: int = 10_000) -> DataFrame:
    """(read_id, origin, rlen, fpulse, flags, bases): reads by ranges of ``per`` numbers, each fetched by a task."""
    fs, name = opened(index_path)
    with fs.open_input_file(name) as f:
        n = struct.unpack_from(DATABASE, f.read(HEAD_BYTES))[10]
    size = struct.calcsize(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in batch.column(0).to_pylist():
                fs, name = opened(index_path)
                with fs.open_input_file(name) as f:
                    f.seek(HEAD_BYTES + low * size)
                    rows = list(struct.iter_unpack(READ, f.read(min(per, n - low) * size)))
                if not rows:
                    continue
                fs, name = opened(bases_path)
                with fs.open_input_file(name) as f:
                    f.seek(rows[0][3])
                    raw = np.frombuffer(f.read(rows[-1][3] - rows[0][3] + -(-rows[-1][1] // 4)), dtype=np.uint8)
                seqs = []
                for r in rows:
                    own = raw[r[3] - rows[0][3] :][: -(-r[1] // 4)]
                    codes = (own[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3
                    seqs.append(np.frombuffer(LETTERS.encode(), dtype=np.uint8)[codes.ravel()[: r[1]]].tobytes().decode())
                cols = {"read_id": range(low, low + len(rows)), "origin": [r[0] for r in rows], "rlen": [r[1] for r in rows], "fpulse": [r[2] for r in rows], "flags": [r[5] for r in rows]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()} | {"bases": pa.array(seqs, pa.string())})

    return spark.range(0, n, per).mapInArrow(run, "read_id long, origin long, rlen long, fpulse long, flags long, bases string")


def track_files(values: list[list[int]]) -> tuple[bytes, bytes]:
    """(annotation, data) of a track: a list of numbers for each read."""
    ends = np.cumsum([0, *[4 * len(v) for v in values]])
    return struct.pack("<2i", len(values), 8) + ends.astype("<i8").tobytes(), np.array([x for v in values for x in v], dtype="<i4").tobytes()


def read_track(spark: SparkSession, annotation_path: str, data_path: str, per: int = 10_000) -> DataFrame:
    """(read_id, track): a track's numbers by read, in ranges."""
    fs, name = opened(annotation_path)
    with fs.open_input_file(name) as f:
        n = struct.unpack("<2i", f.read(8))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in batch.column(0).to_pylist():
                fs, name = opened(annotation_path)
                with fs.open_input_file(name) as f:
                    f.seek(8 + 8 * low)
                    ends = np.frombuffer(f.read(8 * (min(per, n - low) + 1)), dtype="<i8")
                fs, name = opened(data_path)
                with fs.open_input_file(name) as f:
                    f.seek(int(ends[0]))
                    data = np.frombuffer(f.read(int(ends[-1] - ends[0])), dtype="<i4")
                at = ((ends - ends[0]) // 4).tolist()
                tracks = [data[x:y].tolist() for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"read_id": pa.array(range(low, low + len(tracks)), pa.int64()), "track": pa.array(tracks, pa.list_(pa.int32()))})

    return spark.range(0, n, per).mapInArrow(run, "read_id long, track array<int>")
