"""Event streams over files: late data dropped by a watermark, closed periods only, repeats ignored.

Each job reads what is there and ends (availableNow); the same code runs continuously on a live source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..binding import Star
from ..operators.common import op
from ..sources.scans import scratch


def stream(s: Star, name: str = "events") -> DataFrame:
    path = f"{s.dir}/{name}.parquet"
    return s.spark.readStream.schema(s.spark.read.parquet(path).schema).parquet(f"{path}*")


def drained(s: Star, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming query to the end of its input into Parquet, exactly once by its checkpoint, and reads the result."""
    out, state = scratch(s.spark, name), scratch(s.spark, f"{name}-state")
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return s.spark.read.schema(df.schema).parquet(out)


@op("stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup(s):
    """Idempotent ingestion: an event counts once however often it arrives within the watermark."""
    once = stream(s).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    return drained(s, once.select("event_id", "event_type"), "dedup").groupBy("event_type").agg(F.count("*").alias("n"))


@op("stream_closed_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_closed_windows(s):
    """Only days that the watermark has passed come out."""
    days = stream(s).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drained(s, days, "windows").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
