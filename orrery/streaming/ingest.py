"""Incremental ingest of event partitions with Structured Streaming; files seen before are left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Appends each new file's rows to target once, and ends when there are no more."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def monthly_edits(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, month (its first instant), count: edits per user and calendar month of a stream of events(user_id, ts).

    The month is a time under the watermark, so in append mode a month is given out, and its state
    dropped, once the watermark has passed its first instant by `late` and 31 days.
    """
    late_by = F.date_trunc("month", "ts")
    months = stream.withColumn("month", late_by).withWatermark("month", f"{31 + int(late.split()[0])} days")
    return months.groupBy("user_id", "month").count()
