"""Exact dedup by a log-structured merge index of text digests (built-in functions only).

A batch of texts is dealt into memtables: they become level-0 runs, one row per digest and run, sorted by run and digest within
each file and written with Parquet's Bloom filters. Compaction merges the runs of all levels into one and keeps one identifier and the
number of copies per digest. Digests with more than one row are hits: their texts, and only theirs, are read once more and
compared byte for byte; should texts of one digest differ, each different text becomes a class of its own.

Nulls: a null text counts as empty; a null id loses against any other id. Rows that share both id and text are one document
and carry one verdict; ``deduplicated`` keeps one of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.llm.common import KeyFilter, documents, hot_keys, new_folder, salted_join, saved, text_or_empty

#: Memtables into which one batch is dealt.
MEMTABLES = 4


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Runs of (digest, keep_id, n) below one folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "max"):
        self.spark, self.path, self.keep, self.runs = spark, path or new_folder(spark, "digest-index"), keep, []

    def _merge(self, rows: DataFrame, *keys: str) -> DataFrame:
        pick = F.max if self.keep == "max" else F.min
        return rows.groupBy(*keys).agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        path = f"{self.path}/{name}"
        # the filters are sized by what a run holds: the fixed default of 1 MB a file would outgrow small runs
        out = rows.sortWithinPartitions(*by, "digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        out.parquet(path)
        self.runs.append(path)

    def flush(self, batch: DataFrame) -> None:
        """Writes the runs of a batch of (digest, id)."""
        rows = batch.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.coalesce(F.pmod(F.xxhash64("id"), F.lit(MEMTABLES)), F.lit(0)).cast("int").alias("run"))
        self._write(self._merge(rows, "run", "digest"), f"level0-{len(self.runs)}", "run")

    def rows(self) -> DataFrame:
        parts = [self.spark.read.parquet(p).select("digest", "keep_id", "n") for p in self.runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self) -> DataFrame:
        """Merges all runs into one that takes their place."""
        merged, level = self._merge(self.rows(), "digest"), f"level1-{len(self.runs)}"
        self.runs = []
        self._write(merged, level)
        return self.rows()


def _verified(texts: DataFrame, groups: DataFrame, n_hits: int, keep: str) -> tuple[DataFrame, DataFrame | None]:
    """Byte verification of the hits: (digests whose texts differ, the classes by whole text that take their place)."""
    hits = groups.filter("n > 1").select("digest")
    members = KeyFilter(hits, "digest", n_hits).mark(texts, "digest", "_hit").filter("_hit").drop("_hit")
    # min and max combine on the map side: a hot group costs one row per task
    odd = saved(members.groupBy("digest").agg(F.min("text").alias("_a"), F.max("text").alias("_b")).filter("_a <> _b").select("digest"), "collisions")
    if odd.isEmpty():
        return odd, None
    pick = F.max if keep == "max" else F.min
    apart = members.join(odd, "digest", "left_semi").groupBy("digest", "text").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return odd, saved(apart, "collided")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, text_sha256."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", digest(F.col("text")))
    index = DigestIndex(spark, keep=keep)
    index.flush(texts.select("digest", "id"))
    groups = index.compact()
    total, n_hits = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0))).first()
    odd, apart = _verified(texts, groups, n_hits, keep)
    sha = F.lower(F.hex("digest")) if digest is sha256_digest else F.sha2(F.col("text").cast("binary"), 256)
    rows = texts.withColumn("text_sha256", sha)
    hot = hot_keys(groups, "digest", "n", total)
    if apart is None:
        return salted_join(rows.drop("text"), groups.withColumnRenamed("n", "group_size"), "digest", hot, F.col("id"))
    sure = salted_join(rows.join(odd, "digest", "left_anti").drop("text"), groups.withColumnRenamed("n", "group_size"), "digest", hot, F.col("id"))
    rest = rows.join(odd, "digest", "left_semi").join(apart.withColumnRenamed("n", "group_size"), ["digest", "text"]).drop("text")
    return sure.unionByName(rest)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    out = classes(docs, id_col, text_col, keep, digest)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the rows that lose against a copy, all columns kept; only rows of groups of copies are shuffled."""
    names = docs.columns
    lean = classes(docs, id_col, text_col, keep).filter("group_size > 1").select("id", "digest", "keep_id")
    lean = saved(lean, "copies")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("id"), sha256_digest(text_or_empty(text_col)).alias("digest"))
    marked = KeyFilter(lean, "digest", lean.count()).mark(marked, "digest", "_hit")
    wins = lean.filter(F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest").distinct()
    groups = lean.select("digest").distinct()
    maybe = marked.filter("_hit").drop("_hit")
    # one row of each winning (id, digest); copies that lost never meet in one task
    alone = maybe.join(groups, "digest", "left_anti").select("_row")
    won = maybe.join(wins.select(F.col("id").alias("_w"), F.col("digest").alias("_d")), F.col("id").eqNullSafe(F.col("_w")) & (F.col("digest") == F.col("_d")), "left_semi").dropDuplicates(["id", "digest"]).select("_row")
    return marked.filter(~F.col("_hit")).select("_row").unionByName(alone).unionByName(won).select("_row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir))


ORACLE = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
