"""Daily statistics of an event stream: tumbling windows of one day with a watermark for late rows (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.ordinals import scratch

LATENESS = "7 days"


def windowed(events: DataFrame) -> DataFrame:
    """Counts and sums in cents by day and type; works on streams and tables alike."""
    at = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", at).withWatermark("ts", LATENESS)
    out = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")
    )
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


def stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    table = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(table).select("ts", "event_type", "value").schema
    return spark.readStream.schema(schema).parquet(f"{table}*")


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed statistics of the whole events table, read as a stream until its end.

    The stream's state is one row for each day and type; each batch writes the whole table of
    them anew, so the last one holds all.
    """
    folder = scratch(spark, "event-days")
    query = (
        windowed(stream_of(spark, sf_dir)).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/days")).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/days")


def start(stream: DataFrame, folder: str, **trigger):
    """Appends each day of a stream, once it can't change any more, to a Parquet table in folder/days; the state is kept in folder/state.

    trigger: as of writeStream.trigger (none: as fast as data come).
    """
    writer = windowed(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").format("parquet")
    return (writer.trigger(**trigger) if trigger else writer).start(f"{folder}/days")
