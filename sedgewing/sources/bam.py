"""The binary alignment format: blocked gzip, a header, and length-prefixed records.

A file is one task's work (blocks follow one another), many files are read in parallel; a file is inflated and decoded block by
block, so that a task holds one block and one batch of rows besides the file's compressed bytes. Writing gives one file for each
partition."""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: codes of bases, CIGAR operations and array types
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBER = {"c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}
#: The empty block that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SCHEMA = "rank long, name string, flags int, ref_id int, pos int, mapq int, bin int, cigar string, next_ref_id int, next_pos int, tlen int, seq string, qual string, tags map<string,string>, validity string"
BLOCK = 0xFF00
_NAME_OK = bytes([*range(0x21, 0x40), *range(0x41, 0x7F)])
#: Codes of bases as hexadecimal digits, two a byte, other letters as N; and back; qualities as letters and back.
_DIGITS = defaultdict(lambda: "f", {ord(c): f"{i:x}" for i, c in enumerate(BASES)})
_LETTERS = str.maketrans("0123456789abcdef", BASES)
_PHRED = bytes(min(q, 93) + 33 for q in range(256))
_QUALITY = bytes(max(c - 33, 0) for c in range(256))
#: CIGARs whose other form is kept at hand.
CIGARS = 1 << 16


def inflated(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one by one."""
    at = 0
    while at < len(data):
        size = _member_size(data, at)
        yield zlib.decompress(data[at : at + size], 31)
        at += size


def _member_size(data: bytes, at: int) -> int:
    """Compressed size of the member at a place: from its extra field, else by reading it."""
    if data[at : at + 4] == b"\x1f\x8b\x08\x04":
        extra = at + 12
        end = extra + struct.unpack_from("<H", data, at + 10)[0]
        while extra + 4 <= end:
            kind, n = data[extra : extra + 2], struct.unpack_from("<H", data, extra + 2)[0]
            if kind == b"BC":
                return struct.unpack_from("<H", data, extra + 4)[0] + 1
            extra += 4 + n
    z = zlib.decompressobj(31)
    z.decompress(data[at:])
    return len(data) - at - len(z.unused_data)


class _Stream:
    """Exact reads over a sequence of chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, b"", 0

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = next(self.chunks, None)
            if more is None:
                break
            self.held, self.at = self.held[self.at :] + more, 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def read_head(stream: _Stream) -> tuple[str, list[tuple[str, int]]]:
    if stream.read(4) != b"BAM\x01":
        raise ValueError("no alignment file")
    text = stream.read(struct.unpack("<i", stream.read(4))[0]).rstrip(b"\x00").decode("utf-8", "replace")
    refs = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        name = stream.read(struct.unpack("<i", stream.read(4))[0]).rstrip(b"\x00").decode()
        refs.append((name, struct.unpack("<i", stream.read(4))[0]))
    return text, refs


def _tags(raw: bytes) -> list[tuple[str, str]] | None:
    """(name, ``type:value``) of the tag area; None if it is malformed."""
    out, at = [], 0
    while at < len(raw):
        if len(raw) - at < 4:
            return None
        name, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        if kind == "A":
            if not 0x21 <= raw[at] <= 0x7E:
                return None
            out.append((name, f"A:{chr(raw[at])}"))
            at += 1
        elif kind in NUMBER:
            code, size = NUMBER[kind]
            if len(raw) - at < size:
                return None
            value = struct.unpack_from("<" + code, raw, at)[0]
            out.append((name, f"f:{value:g}" if kind == "f" else f"i:{value}"))
            at += size
        elif kind in "ZH":
            end = raw.find(b"\x00", at)
            if end < 0:
                return None
            out.append((name, f"{kind}:{raw[at:end].decode('latin-1')}"))
            at = end + 1
        elif kind == "B":
            if len(raw) - at < 5 or chr(raw[at]) not in NUMBER:
                return None
            (code, size), n = NUMBER[chr(raw[at])], struct.unpack_from("<i", raw, at + 1)[0]
            if n < 0 or len(raw) - at - 5 < n * size:
                return None
            values = struct.unpack_from(f"<{n}{code}", raw, at + 5)
            out.append((name, ",".join([f"B:{chr(raw[at])}", *[f"{v:g}" for v in values]])))
            at += 5 + n * size
        else:
            return None
    return out


@lru_cache(CIGARS)
def _cigar_text(raw: bytes) -> tuple[str, int, bool]:
    """(text, bases of the read, whether an operation is unknown) of packed elements."""
    ops = [(x >> 4, x & 15) for x in struct.unpack(f"<{len(raw) // 4}I", raw)]
    return "".join([f"{n}{OPS[o] if o < 9 else '?'}" for n, o in ops]) or "*", sum(n for n, o in ops if o < 9 and OPS[o] in "MIS=X"), any(o > 8 for _, o in ops)


@lru_cache(CIGARS)
def _cigar_bytes(text: str) -> tuple[int, bytes]:
    """(number, packed elements) of a CIGAR's text."""
    ops = [int(n) << 4 | OPS.index(o) for n, o in re.findall("([0-9]+)([MIDNSHP=X])", text)]
    return len(ops), struct.pack(f"<{len(ops)}I", *ops)


_HEAD = struct.Struct("<iiBBHHHiiii")


def decode(raw: bytes) -> tuple:
    """Fields of a record's block; the last is the first check that fails, or None."""
    none = ("", 0, -1, -1, 0, 0, "", -1, -1, 0, "", "", [])
    if len(raw) < 32:
        return *none, "block_too_small"
    ref, pos, n_name, mapq, bin_, n_cigar, flags, n_seq, next_ref, next_pos, tlen = _HEAD.unpack_from(raw)
    end = raw.find(b"\x00", 32)
    name = raw[32:end]
    if end < 0:
        return *none, "queryname_extends_over_block"
    at = 32 + n_name
    fault = "queryname_length_inconsistent" if len(name) + 1 != n_name else "queryname_empty" if not name else "queryname_contains_illegal_symbols" if name.translate(None, _NAME_OK) else None
    if not fault and at + 4 * n_cigar > len(raw):
        fault = "cigar_extends_over_block"
    bases = at + 4 * n_cigar
    quals = bases + (n_seq + 1) // 2
    if not fault and (n_seq < 0 or quals > len(raw)):
        fault = "sequence_extends_over_block"
    if not fault and quals + n_seq > len(raw):
        fault = "quality_extends_over_block"
    if fault:
        return *none, fault
    cigar, n_read, unknown = _cigar_text(raw[at:bases])
    seq = raw[bases:quals].hex().translate(_LETTERS)[:n_seq]
    qual = raw[quals : quals + n_seq]
    tags = _tags(raw[quals + n_seq :])
    mapped, annotation = not flags & 4, flags & 512 and flags & 256
    if unknown:
        fault = "unknown_cigar_op"
    elif mapped and not annotation and n_seq and n_read != n_seq:
        fault = "cigar_is_inconsistent_with_sequence_length"
    elif pos < -1:
        fault = "invalid_mapping_position"
    elif next_pos < -1:
        fault = "invalid_next_mapping_position"
    elif tlen < -(1 << 31) + 1:
        fault = "invalid_tlen"
    elif qual and max(qual) > 93 and qual.count(255) != n_seq:
        fault = "invalid_quality_value"
    elif tags is None:
        fault = "invalid_auxiliary_data"
    text = "*" if not n_seq or qual[:1] == b"\xff" else qual.translate(_PHRED).decode()
    return name.decode("latin-1"), flags, ref, pos, mapq, bin_, cigar, next_ref, next_pos, tlen, seq or "*", text, tags or [], fault


def records(data: bytes) -> Iterator[tuple]:
    stream = _Stream(inflated(data))
    read_head(stream)
    rank = 0
    while head := stream.read(4):
        size = struct.unpack("<i", head)[0]
        raw = stream.read(size)
        if len(raw) < size:
            raise ValueError("the file ends within a record")
        yield rank, *decode(raw)
        rank += 1


def _map_of(tags: tuple[list[tuple[str, str]], ...]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(t) for t in tags], dtype=np.int64)]).astype(np.int32)
    keys, values = [k for t in tags for k, _ in t], [v for t in tags for _, v in t]
    return pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def read_bam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of binary alignment files, rank counting within a file; ``validity`` is null or the first check that failed."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), *[pa.int32()] * 5, pa.string(), *[pa.int32()] * 3, pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([_map_of(c) if pa.types.is_map(t) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                some: list[tuple] = []
                for r in records(content.as_py()):
                    some.append(r)
                    if len(some) == 5000:
                        yield batch_of(some)
                        some = []
                yield batch_of(some)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, SCHEMA)


def read_bam_references(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ref_id, name, length) of the headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                refs = read_head(_Stream(inflated(content.as_py())))[1]
                yield pa.RecordBatch.from_pydict({"file": pa.array([path] * len(refs), pa.string()), "ref_id": pa.array(range(len(refs)), pa.int32()), "name": pa.array([n for n, _ in refs], pa.string()), "length": pa.array([n for _, n in refs], pa.int64())})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "file string, ref_id int, name string, length long")


def _tag_bytes(tags: list[tuple[str, str]]) -> bytes:
    out = []
    for name, text in tags:
        kind, value = text.split(":", 1)
        head = name.encode("latin-1")
        if kind == "i":
            out.append(head + b"i" + struct.pack("<i", int(value)) if -(1 << 31) <= int(value) < 1 << 31 else head + b"I" + struct.pack("<I", int(value)))
        elif kind == "f":
            out.append(head + b"f" + struct.pack("<f", float(value)))
        elif kind == "A":
            out.append(head + b"A" + value.encode("latin-1"))
        elif kind == "B":
            code, *items = value.split(",")
            values = [float(x) if code == "f" else int(x) for x in items]
            out.append(head + b"B" + code.encode() + struct.pack(f"<i{len(values)}{NUMBER[code][0]}", len(values), *values))
        else:
            out.append(head + kind.encode() + value.encode("latin-1") + b"\x00")
    return b"".join(out)


def _qualities(text: str) -> bytes:
    return text.encode("latin-1").translate(_QUALITY) if text.isascii() and min(text, default="!") >= "!" else bytes(ord(c) - 33 for c in text)


def encode(row: dict) -> bytes:
    """A record's block with its length before it."""
    name = row["name"].encode("latin-1") + b"\x00"
    n_ops, ops = _cigar_bytes(row["cigar"] or "")
    seq = "" if row["seq"] in ("*", None) else row["seq"].upper()
    packed = bytes.fromhex(seq.translate(_DIGITS) + "0" * (len(seq) % 2))
    qual = b"\xff" * len(seq) if row["qual"] in ("*", None) else _qualities(row["qual"])
    fixed = _HEAD.pack(row["ref_id"], row["pos"], len(name), row["mapq"], row.get("bin") or 0, n_ops, row["flags"], len(seq), row["next_ref_id"], row["next_pos"], row["tlen"])
    raw = fixed + name + ops + packed + qual + _tag_bytes(sorted((row.get("tags") or {}).items()))
    return struct.pack("<i", len(raw)) + raw


def deflated(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def file_of(rows: Iterator[dict], references: list[tuple[str, int]], text: str | None = None) -> bytes:
    text = (text if text is not None else "".join(["@HD\tVN:1.6\n", *[f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in references]])).encode()
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\x00" + struct.pack("<i", k) for n, k in references)
    out, held = [], bytearray(head)
    for r in rows:
        held += encode(r)
        while len(held) > BLOCK:
            out.append(deflated(bytes(held[:BLOCK])))
            del held[:BLOCK]
    return b"".join([*out, deflated(bytes(held)), END])


def _maps(column: pa.MapArray) -> list[dict[str, str]]:
    """The maps of a column; a null counts as empty."""
    if column.null_count:
        return [dict(m or []) for m in column.to_pylist()]
    at = column.offsets.to_pylist()
    keys, values = (c.slice(at[0], at[-1] - at[0]).to_pylist() for c in (column.keys, column.items))
    return [dict(zip(keys[i - at[0] : j - at[0]], values[i - at[0] : j - at[0]], strict=True)) for i, j in zip(at, at[1:], strict=False)]


def as_files(rows: DataFrame, references: list[tuple[str, int]]) -> DataFrame:
    """(content): one binary alignment file for each partition, rows in the order of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for b in batches:
                columns = [_maps(c) if pa.types.is_map(c.type) else c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist() for c in b.columns]
                for r in zip(*columns, strict=True):
                    yield dict(zip(b.schema.names, r, strict=True))

        yield pa.RecordBatch.from_pydict({"content": pa.array([file_of(each(), references)], pa.binary())})

    wanted = [c for c in (x.split()[0] for x in SCHEMA.replace("map<string,string>", "map").split(", ")) if c in rows.columns and c not in ("rank", "validity")]
    return rows.select(*wanted).mapInArrow(run, "content binary")


def with_digest(files: DataFrame) -> DataFrame:
    """(md5, bytes) of written contents."""
    return files.select(F.md5("content").alias("md5"), F.octet_length("content").alias("bytes"))


def unmapped(reads: DataFrame) -> DataFrame:
    """Records without a place of reads (id, seq, qual)."""
    none = {c: F.lit(-1) for c in ("ref_id", "pos", "next_ref_id", "next_pos")}
    return reads.select(F.regexp_extract("id", "^(\\S*)", 1).alias("name"), F.lit(4).alias("flags"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), F.lit(0).alias("tlen"), "seq", "qual", *[c.alias(k) for k, c in none.items()])


def write(rows: DataFrame, references: list[tuple[str, int]], folder: str) -> DataFrame:
    """Writes a file for each partition; (path, bytes, md5) of the files."""
    from sedgewing.sources.files import write_files

    named = as_files(rows, references).withColumn("name", F.concat(F.lit("part-"), F.lpad(F.spark_partition_id().cast("string"), 5, "0"), F.lit(".bam")))
    return write_files(named, folder)
