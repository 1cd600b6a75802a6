"""Shared pieces of the training-data operators: the shared folder, bounded filters, and salting of hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a list of hot keys can have at most: each holds more than 1/HOT_SHARE of all rows.
HOT_SHARE = 1024
#: Tasks over which the rows of one hot key are dealt.
HOT_SALTS = 64
#: log2 of the bits of the largest key filter: 32 MB, whatever the input.
MAX_FILTER_BITS = 28
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='sedgewing-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends: what it wrote is read from the table, never from them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables that a job writes to the shared folder, so that it can delete those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t))[0])
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = {id(t) for t in tables}
        self.drop(*[t for k, (_, t) in list(self.paths.items()) if k not in kept])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from here on in this session, unless it has smaller ones: the JVM and Python hold a
    batch several times, which with the default of 64 MB is much of a small executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch("([0-9]+)([bkmg]?)b?", str(spark.conf.get(key, "64m")).lower())
    if not now or int(now[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[now[2]] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class KeyFilter:
    """A bitmap over hashes of keys: ``maybe`` is true for every key in it and for few others.

    Its size is 16 bits a key, 2**16 to 2**MAX_FILTER_BITS bits, so that what is broadcast stays below 32 MB whatever the
    input is; beyond that it only lets more rows through. Built and probed with built-in functions alone.
    """

    def __init__(self, keys: DataFrame, key: str, n_keys: int):
        self.log2 = min(MAX_FILTER_BITS, max(16, (16 * max(1, n_keys)).bit_length()))
        place = self._place(F.col(key))
        self.bits = keys.select(place.alias("_p")).groupBy(F.shiftright("_p", 15).cast("int").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.col("_p").bitwiseAND(32767)).alias("_bits")
        )

    def _place(self, key: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(key), 64 - self.log2)

    def mark(self, df: DataFrame, key: str, flag: str) -> DataFrame:
        """df with the boolean column flag: false means that the key is surely not in the filter."""
        place = self._place(F.col(key))
        byte = F.substring(F.col("_bits"), (F.shiftright(place.bitwiseAND(32767), 3) + 1).cast("int"), F.lit(1))
        bit = F.conv(F.hex(byte), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (place.bitwiseAND(7) + 1).cast("int"))
        joined = df.withColumn("_bucket", F.shiftright(place, 15).cast("int")).join(F.broadcast(self.bits), "_bucket", "left")
        return joined.withColumn(flag, F.coalesce(bit.bitwiseAND(mask) != 0, F.lit(False))).drop("_bucket", "_bits")


def hot_keys(groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Keys that hold more than 1/HOT_SHARE of all rows, so HOT_SHARE rows at most: safe to broadcast."""
    return groups.filter(F.col(count) > F.lit(max(1000, total // HOT_SHARE))).select(key)


def salted_join(rows: DataFrame, groups: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """Inner join of rows with the one row of their key in groups; rows of a hot key are dealt over HOT_SALTS tasks."""
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(1))), key, "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(HOT_SALTS)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    side = groups.join(F.broadcast(hot.withColumn("_hot", F.lit(1))), key, "left")
    last = F.when(F.col("_hot").isNotNull(), F.lit(HOT_SALTS - 1)).otherwise(F.lit(0))
    side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return marked.join(side, [key, "_salt"]).drop("_salt")
