"""Event-time windows in batch and stream, and de-duplication of a replayed stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.plans import Book
from sedgewing.plans.tables import table
from sedgewing.scratch import shared_dir
from sedgewing.streaming import dedup

BOOK = Book()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@BOOK.add("SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, CAST(ts AS TIMESTAMP))) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.tumbling(_events(spark, sf_dir), "ts", "1 day", ["event_type"]).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@BOOK.add("""
    SELECT start, event_type, count(*) AS n FROM (SELECT unnest([b, b - 43200]) AS start, event_type FROM (SELECT CAST(epoch(time_bucket(INTERVAL 12 HOUR, CAST(ts AS TIMESTAMP))) AS BIGINT) AS b, event_type FROM events)) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.tumbling(_events(spark, sf_dir), "ts", "1 day", ["event_type"], "12 hours").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@BOOK.add("""
    WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 3 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(CAST(min(ts) AS TIMESTAMP)) AS start, epoch_us(CAST(max(ts) AS TIMESTAMP)) + 10800000000 AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.sessions(_events(spark, sf_dir), "ts", "3 hours", ["user_id"]).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


def _replayed(spark: SparkSession, frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over files to its end into a table of the shared folder, and reads that."""
    import uuid

    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = frame.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{base}/out")


@BOOK.add("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed as a stream: one row per user and type, the watermark being wider than the table."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = _replayed(spark, dedup.first_seen(stream, ["user_id", "event_type"], "ts", "60 days"), "first-seen")
    return found.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
