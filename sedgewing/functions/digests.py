"""Digests by name; those that Spark lacks are Arrow-batched."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StringType())
def sha3_256(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else hashlib.sha3_256(v if isinstance(v, bytes) else str(v).encode()).hexdigest())


@pandas_udf(T.StringType())
def sha512_224(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else hashlib.new("sha512_224", v if isinstance(v, bytes) else str(v).encode()).hexdigest())


def _crc32c_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


_CRC32C = [int(x) for x in _crc32c_table()]


def crc32c_bytes(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC32C[(c ^ b) & 255] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


@pandas_udf(T.LongType())
def crc32c(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else crc32c_bytes(v if isinstance(v, bytes) else str(v).encode())).astype("Int64")


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & 0xFFFFFFFFFFFFFFFF


def murmur3_x64_128(data: bytes, seed: int = 0) -> bytes:
    """The public 128-bit hash, from its description."""
    mask = 0xFFFFFFFFFFFFFFFF
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F  # fixed values

    def spread(k: int, first: bool) -> int:
        a, b, r = (c1, c2, 31) if first else (c2, c1, 33)
        return _rotl(k * a & mask, r) * b & mask

    def final(k: int) -> int:
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = (k ^ (k >> 33)) * m & mask
        return k ^ (k >> 33)

    h1 = h2 = seed
    whole = len(data) & ~15
    for i in range(0, whole, 16):
        h1 = (_rotl(h1 ^ spread(int.from_bytes(data[i : i + 8], "little"), True), 27) + h2) * 5 + 0x52DCE729 & mask
        h2 = (_rotl(h2 ^ spread(int.from_bytes(data[i + 8 : i + 16], "little"), False), 31) + h1) * 5 + 0x38495AB5 & mask
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= spread(int.from_bytes(tail[8:], "little"), False)
    if tail:
        h1 ^= spread(int.from_bytes(tail[:8], "little"), True)
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & mask
    h2 = (h2 + h1) & mask
    h1, h2 = final(h1), final(h2)
    h1 = (h1 + h2) & mask
    h2 = (h2 + h1) & mask
    return h1.to_bytes(8, "little") + h2.to_bytes(8, "little")


@pandas_udf(T.StringType())
def murmur3(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else murmur3_x64_128(v if isinstance(v, bytes) else str(v).encode()).hex())


#: Digests by name; each maps a string or binary column to lowercase hex.
DIGESTS: dict[str, Callable[[Column], Column]] = {
    "crc32": lambda c: F.lower(F.lpad(F.hex(F.crc32(c.cast("binary"))), 8, "0")),
    "crc32c": lambda c: F.lower(F.lpad(F.hex(crc32c(c)), 8, "0")),
    "md5": lambda c: F.md5(c.cast("binary")),
    "sha1": lambda c: F.sha1(c.cast("binary")),
    "sha224": lambda c: F.sha2(c.cast("binary"), 224),
    "sha256": lambda c: F.sha2(c.cast("binary"), 256),
    "sha384": lambda c: F.sha2(c.cast("binary"), 384),
    "sha512": lambda c: F.sha2(c.cast("binary"), 512),
    "sha3_256": sha3_256,
    "murmur3": murmur3,
}


def digest(name: str, value: Column) -> Column:
    if name not in DIGESTS:
        raise ValueError(f"no digest of the name {name}; there are {', '.join(DIGESTS)}")
    return DIGESTS[name](value)
