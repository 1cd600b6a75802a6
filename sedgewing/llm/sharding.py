"""Sharding by a permutation-filled lookup table (built-in functions only).

Each shard's name gives a permutation of the SLOTS (a prime) places of a table: an offset and a step. The shards take turns, a
shard of weight w taking w in its turn, and claim the first free place of their permutation, until the table is full. So the
shards' parts of the table differ by their weights at most, and when a shard comes or goes most other places keep theirs. The table's
size is a parameter and not the data's, so it can be broadcast; a row's place is a hash of its key modulo SLOTS.

A null key counts as empty; equal keys share a shard. Where ``spread`` columns are given, rows are placed by the key and those
columns together, so that one key with very many rows is dealt over the shards. An empty table gives an empty result; other
columns are kept by ``sharded``, but those named as its own two, which are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.llm.common import documents

#: Places of the table, a prime of 100 or more per shard, and the default number of shards.
SLOTS, SHARDS = 65537, 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The shard of each slot. The names are sorted first, so that their order does not matter."""
    if not names or len(set(names)) < len(names) or slots < len(names):
        raise ValueError("shards need different names and a slot each at least")
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    turns = weights or [1] * len(names)
    order = sorted(range(len(names)), key=lambda i: names[i])
    place = [_number(f"{x}/offset") % slots for x in names]
    step = [_number(f"{x}/step") % (slots - 1) + 1 for x in names]
    table, free = [-1] * slots, slots
    while free:
        for i in order:
            for _ in range(turns[i]):
                if not free:
                    break
                while table[place[i]] >= 0:
                    place[i] = (place[i] + step[i]) % slots
                table[place[i]] = i
                free -= 1
    return table


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_rows(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) of the lookup table."""
    text = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(text).alias("slot", "_s")).select("slot", F.col("_s").cast("int").alias("shard"))


def sharded(rows: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS, weights: list[int] | None = None, spread: tuple[str, ...] = (), shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """rows with their slot and shard (the place of its name in ``names``), by a broadcast lookup and without a shuffle."""
    names = names or [f"shard-{i:05d}" for i in range(SHARDS)]
    lookup = table_rows(rows.sparkSession, lookup_table(names, slots, weights)).withColumnsRenamed({"slot": "_slot", "shard": "_shard"})
    place = slot_of([F.col(key), *map(F.col, spread)], slots)
    wrapped = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in (shard_col, slot_col)]).alias("_row"), place.alias("_slot"))
    return wrapped.join(F.broadcast(lookup), "_slot").select("_row.*", F.col("_slot").alias(slot_col), F.col("_shard").alias(shard_col))


def write_shards(rows: DataFrame, path: str, key: str, names: list[str] | None = None, files: int = 1, **options) -> None:
    """One folder per shard, each of ``files`` files at most; rows are dealt by shard and key, so that no shard is one task's work alone."""
    placed = sharded(rows, key, names, **options)
    deal = F.pmod(F.xxhash64(key), F.lit(files))
    placed.repartition("shard", deal).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir).select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def _oracle() -> str:
    table = ",".join(map(str, lookup_table([f"shard-{i:05d}" for i in range(SHARDS)])))
    return f"""
        WITH t AS (SELECT string_split('{table}', ',') AS shards)
        SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard
        FROM (SELECT doc_id, CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents), t"""


QUERIES = {"op4_sharding": op4_sharding}
ORACLE = {"op4_sharding": _oracle()}
