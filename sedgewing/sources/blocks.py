"""Blocked gzip by its blocks: a table of them, inflating in parallel, reading at a place; and sequences packed two bits a base."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sedgewing.sources.files import opened

#: Bytes of a block's head up to its size, if its first extra field is the size, as writers of the format put it.
HEAD = 18


def _block_size(head: bytes) -> int:
    if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
        raise ValueError("no blocked gzip")
    return struct.unpack_from("<H", head, 16)[0] + 1


def block_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, at, size, start, length): each block's place and size in the file, and in what is inflated. Only heads and tails of
    blocks are read, one file by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = opened(path)
                out, at, start = [], 0, 0
                with fs.open_input_file(name) as f:
                    while at < n:
                        f.seek(at)
                        size = _block_size(f.read(HEAD))
                        f.seek(at + size - 4)
                        length = struct.unpack("<I", f.read(4))[0]
                        out.append((at, size, start, length))
                        at, start = at + size, start + length
                cols = {k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("at", "size", "start", "length"))}
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(out), pa.string())} | cols)

    found = spark.read.format("binaryFile").load(paths).select("path", "length")
    return found.mapInArrow(run, "path string, at long, size long, start long, length long")


def inflated(index: DataFrame) -> DataFrame:
    """(path, start, content) of the blocks of an index, inflated by as many tasks as they are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, starts, contents = [], [], []
            for path, at, size, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    f.seek(at)
                    contents.append(zlib.decompress(f.read(size), 31))
                paths.append(path)
                starts.append(start)
                if len(contents) == 64:
                    yield pa.RecordBatch.from_pydict({"path": paths, "start": pa.array(starts, pa.int64()), "content": pa.array(contents, pa.binary())})
                    paths, starts, contents = [], [], []
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "start": pa.array(starts, pa.int64()), "content": pa.array(contents, pa.binary())})

    return index.select("path", "at", "size", "start").mapInArrow(run, "path string, start long, content binary")


def stretches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path, low, high) with ``content``: those bytes of what is inflated, from the blocks that hold them alone."""
    hit = index.join(wanted, "path").filter((F.col("start") < F.col("high")) & (F.col("start") + F.col("length") > F.col("low")))
    blocks = inflated(hit.select("path", "at", "size", "start").distinct())
    both = wanted.join(blocks, "path").filter((F.col("start") < F.col("high")) & (F.col("start") + F.octet_length("content") > F.col("low")))
    piece = F.expr("substring(content, int(greatest(low - start, 0) + 1), int(least(high - start, octet_length(content)) - greatest(low - start, 0)))")
    parts = both.select("path", "low", "high", F.struct("start", F.hex(piece).alias("h")).alias("p"))
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["h"]), ""))
    return parts.groupBy("path", "low", "high").agg(joined.alias("content"))


def blocked(content: bytes, block: int = 0xFF00) -> bytes:
    """Blocked gzip of some bytes, with the empty block that ends a file."""
    from sedgewing.sources.bam import END, deflated

    return b"".join([deflated(content[i : i + block]) for i in range(0, len(content), block)]) + END


@pandas_udf(T.BinaryType())
def packed_bases(seq: pd.Series) -> pd.Series:
    """A sequence of A, C, G and T at two bits a base behind its length (32 bits); another letter is an error."""

    def pack(s: str) -> bytes:
        codes = _CODES[np.frombuffer(s.encode(), dtype=np.uint8)]
        if (codes > 3).any():
            raise ValueError("a letter other than A, C, G and T")
        four = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
        return struct.pack("<I", len(s)) + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes()

    return seq.map(lambda s: None if s is None else pack(s))


_CODES = np.full(256, 4, dtype=np.uint8)
_CODES[[65, 67, 71, 84]] = range(4)


@pandas_udf(T.StringType())
def unpacked_bases(data: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """The bases [low, high) of packed sequences; only the bytes that hold them are unpacked."""

    def unpack(raw: bytes, a: int, b: int) -> str:
        b = min(b, struct.unpack_from("<I", raw)[0])
        if b <= a:
            return ""
        own = np.frombuffer(raw, dtype=np.uint8)[4 + a // 4 : 4 + -(-b // 4)]
        codes = ((own[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3).ravel()[a % 4 :][: b - a]
        return np.frombuffer(b"ACGT", dtype=np.uint8)[codes].tobytes().decode()

    return pd.Series([None if r is None else unpack(r, int(a), int(b)) for r, a, b in zip(data, low, high, strict=True)])


def both_strands(seq: Column) -> Column:
    """A sequence with its reverse complement behind it, as two-way indexes are built over."""
    from sedgewing.functions.sequences import reverse_complement

    return F.concat(seq, reverse_complement(seq))
