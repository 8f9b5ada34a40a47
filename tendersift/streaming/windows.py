"""Event counts in event-time windows, as a stream or over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendersift.storage import shared_dir


def counted(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """start, event_type, n and total of each window; a stream in update or append mode leaves out rows later than the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(spark: SparkSession, path: str, width: str = "1 day") -> DataFrame:
    """Runs the stream over the files that are there and returns its last state; in complete mode no row is late, and the state holds all windows."""
    schema = spark.read.parquet(path).schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = counted(spark.readStream.schema(schema).parquet(path), width)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")
